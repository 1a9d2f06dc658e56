"""Deterministic sharded WARC writer.

Each page becomes one response record, compressed as a gzip member of its own;
headers, lengths, digests and record ids are made anew from the content, so they
depend on nothing else. Records are sorted by (url, page_id, record id); those alike
in all three are alike in every byte, so that their order makes no difference. A
prefix sum of compressed sizes in that order gives each record's global start, and a
file takes the records that start within its ``TARGET`` bytes: files roll by
compressed size, alike for any partitioning. Records are compressed once, into a
staged table; a range sort of keys and sizes alone decides the files. Members then go
to their writers in one shuffle, each of which writes a run of whole files of about
``RUN`` bytes in order; only the first key of each run is held by the driver.

A file is written under a temporary name of its own and then renamed, so a task
that is lost or runs twice leaves the same file or none. Last, the manifest
(files, sizes, digests, records) is written the same way. A manifest that is there
already goes first, and files that the new one doesn't name go before it comes: a
folder is complete if and only if it has ``manifest.json``, and has nothing else.

Defined cases: a null html is an empty page; a null url has no target header and
sorts as the empty string; a null page_id sorts before others. Repeated rows are
written as often as they come, with equal record ids, and may part between files.
Control characters in URLs are percent-encoded. An empty table has a manifest without
files. Other columns are not used, whatever their names. A page longer than
``TARGET`` is one record of its own file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, shared_dir, staged, table

TARGET = 32 << 20
#: Compressed bytes that one task writes.
RUN = 2 * TARGET
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_NAMES = ["page_id", "url", "record", "digest", "size", "member"]


def _sha1(data: bytes) -> str:
    return _named(hashlib.sha1(data).digest())


def _named(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip header without time or name
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[str, str, bytes]:
    """(record id, payload digest, the record's bytes) of one page."""
    body = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    digest = _sha1(body)
    own = hashlib.sha256(f"{page_id}\n{target}\n{digest}".encode()).digest()
    record_id = str(uuid.UUID(bytes=own[:16], version=4))
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: {digest}",
        f"Content-Length: {len(block)}",
    ]
    return record_id, digest, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The member that opens a file."""
    block = b"software: sharded writer\r\nformat: WARC File Format 1.1\r\n"
    own = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
        "Content-Type: application/warc-fields", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}",
    ]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in part.columns)):
                record_id, digest, data = record(page_id, url, html)
                member = _member(data)
                # both as bytes: text would be a large part of what is staged and shuffled
                rows.append((uuid.UUID(record_id).bytes, base64.b32decode(digest[5:]), len(member), member))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=_NAMES)


def _runs(first: list[tuple]):
    """mapInArrow over (key columns, row): adds the run that each record belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in ("u", "p", "record", "at")))
            at = [bisect.bisect_right(first, (u.encode(), *rest)) - 1 for u, *rest in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "run"])

    return run


def file_name(shard: int) -> str:
    return f"pages-{shard:08d}.warc.gz"


def _write(folder: str, starts: list[int], target: int):
    """mapInArrow over records sorted by (run, key): writes the files, gives the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        own, at, shard, out, offset, temporary, digest = None, 0, None, None, 0, "", hashlib.sha256()
        done: list[tuple] = []

        def finish() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{root}/{file_name(shard)}")
                done.append((None, None, None, digest.hexdigest(), file_name(shard), shard, 0, offset))

        def index(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["page_id", "url", "record_id", "digest", "file", "shard", "offset", "length"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            rows = []
            for this, page_id, url, record_id, payload, member in zip(*(c.to_pylist() for c in batch.columns)):
                if this != own:
                    own, at = this, starts[this]
                if at // target != shard:
                    finish()
                    shard, digest = at // target, hashlib.sha256()
                    temporary = f"{root}/_temporary-{file_name(shard)}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary, compression=None)
                    head = info(file_name(shard))
                    out.write(head)
                    digest.update(head)
                    offset = len(head)
                out.write(member)
                digest.update(member)
                rows.append((page_id, url, str(uuid.UUID(bytes=record_id)), _named(payload), file_name(shard), shard, offset, len(member)))
                offset += len(member)
                at += len(member)
            yield index(rows)
        finish()
        if done:
            yield index(done)

    return run


def _placed(light: DataFrame, target: int, run_bytes: int) -> tuple[list[tuple], list[int]]:
    """The first key of each run of files and its global start, from keys and sizes."""
    total = light.agg(F.sum("size")).first()[0]
    if not total:
        return [], []
    runs = -(-total // run_bytes)
    ranged = staged(light.repartitionByRange(runs, "u", "p", "record", "at").withColumn("range", F.spark_partition_id()))
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("n")).collect())
    spark = light.sparkSession
    starts, at = [], 0
    for k, n in sums:
        starts.append((k, at))
        at += n
    base = spark.createDataFrame(starts, "range int, base long")
    within = Window.partitionBy("range").orderBy("u", "p", "record", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(base), "range").withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))
    # a file begins in the range that has its first record; the first of those that
    # begin in a range begins the run
    files = placed.groupBy(F.floor(F.col("start") / target).alias("file")).agg(F.min("start").alias("start"), F.min_by(F.struct("range", "u", "p", "record", "at"), "start").alias("k"))
    heads = files.groupBy("k.range").agg(F.min("start").alias("start"), F.min_by("k", "start").alias("k")).orderBy("start").collect()
    drop(ranged)
    return [(h["k"]["u"].encode(), h["k"]["p"], bytes(h["k"]["record"]), h["k"]["at"]) for h in heads], [h["start"] for h in heads]


def write(pages: DataFrame, folder: str, target: int = TARGET, run_bytes: int | None = None) -> DataFrame:
    """Writes the files and the manifest below ``folder``; gives the index: page_id,
    url, record_id, digest (of the payload), file, offset and length of the member."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    members = staged(
        plain.mapInArrow(_records, "page_id long, url string, record binary, digest binary, size long, member binary").withColumn("at", F.monotonically_increasing_id())
    )
    key = (F.coalesce("url", F.lit("")).alias("u"), F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "record", "at")
    first, starts = _placed(members.select(*key, "size"), target, run_bytes or max(RUN, 2 * target))
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    if system.get_file_info(f"{root}/manifest.json").type != fs.FileType.NotFound:
        system.delete_file(f"{root}/manifest.json")
    keyed = members.select("page_id", "url", "digest", "member", *key)
    names = keyed.schema.simpleString()[7:-1].replace(":", " ")
    schema = "page_id long, url string, record_id string, digest string, file string, shard long, offset long, length long"
    rows = staged(
        keyed.mapInArrow(_runs(first), f"{names}, run int").repartitionById(max(1, len(first)), "run").sortWithinPartitions("run", "u", "p", "record", "at")
        .select("run", "page_id", "url", "record", "digest", "member").mapInArrow(_write(folder, starts, target), schema)
    )
    drop(members)
    files = rows.where("record_id is null").orderBy("shard").collect()
    manifest = {
        "files": [{"name": f["file"], "bytes": f["length"], "sha256": f["digest"]} for f in files],
        "records": rows.where("record_id is not null").count(),
    }
    named = {f["file"] for f in files}
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name not in named and f.base_name.startswith(("pages-", "_temporary-")):
            system.delete_file(f.path)
    _commit(system, f"{root}/manifest.json", json.dumps(manifest, indent=1).encode())
    return rows.where("record_id is not null").drop("shard")


def _commit(system: fs.FileSystem, path: str, data: bytes) -> None:
    head, name = path.rsplit("/", 1)
    temporary = f"{head}/_temporary-{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return write(table(spark, sf_dir, "pages"), folder if "://" in folder else f"file://{folder}")
