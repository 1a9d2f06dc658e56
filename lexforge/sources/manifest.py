"""Manifests, checksums and file-based versions of JSONL datasets.

Folders may be on any filesystem that pyarrow's URIs reach; a plain path is local.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources.jsonl import lines_in, lines_of


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(str(path)) if ":/" in str(path) else (fs.LocalFileSystem(), str(path))


def files_of(path: str) -> list[fs.FileInfo]:
    """The files of a path, in the order of their path's parts; none if it's absent."""
    system, root = _at(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path.split("/"))


def exists(path: str) -> bool:
    system, root = _at(path)
    return system.get_file_info(root).type != fs.FileType.NotFound


def checksum(path: str, block: int = 1 << 20, data_only: bool = False) -> str:
    """SHA-256 over the bytes of a file, or of a folder's files in order.

    ``data_only`` leaves out markers and checksums that a job writes beside its
    data (names that begin with "_" or ".").
    """
    system, _ = _at(path)
    h = hashlib.sha256()
    for f in files_of(path):
        if data_only and f.base_name.startswith(("_", ".")):
            continue
        with system.open_input_stream(f.path) as s:
            while chunk := s.read(block):
                h.update(chunk)
    return h.hexdigest()


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, and a sum of row hashes that no order or layout changes.

    A row is its columns' values as text in the order of their names, nulls told apart;
    sixty bits of its md5 count.
    """
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in sorted(c for c in df.columns if c != "_seq")]
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *values)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def _variants(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _line, value, v) of each valid JSON line of a JSONL file or folder."""
    if not (str(path).endswith(".jsonl") or any(f.path.endswith(".jsonl") for f in files_of(path))):
        return spark.sql("SELECT array('') AS _file, 0L AS _block, 0L AS _line, '0' AS value, parse_json('0') AS v WHERE false")
    return lines_of(spark, path).select("_file", "_block", "_line", "value", F.try_parse_json("value").alias("v")).where("v is not null")


def _head(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(at, value, v) of the first ``rows`` objects in order. Files are read from the
    first on, twice as many each time, until there are enough."""
    names = [f.path for f in files_of(path) if f.path.endswith(".jsonl")]
    scheme = f"{str(path).split('://')[0]}://" if "://" in str(path) else ""
    order = ("_file", "_block", "_line")
    many = 1
    while True:
        part = [scheme + n for n in names[:many]]
        lines = (lines_in(spark, part) if part else _variants(spark, path)).where(F.json_object_keys("value").isNotNull())
        found = lines.select(*order, "value").orderBy(*order).limit(rows).collect()
        if len(found) >= rows or many >= len(names):
            break
        many *= 2
    held = spark.createDataFrame([(i, r["value"]) for i, r in enumerate(found)], "at long, value string")
    return held.select("at", "value", F.parse_json("value").alias("v"))


_TYPES = {"BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "STRING": "str", "VOID": "NoneType"}


def _type_name(schema):
    out = F.when(F.startswith(schema, F.lit("OBJECT")), "dict").when(F.startswith(schema, F.lit("ARRAY")), "list").when(F.startswith(schema, F.lit("DECIMAL")), "float")
    for k, v in _TYPES.items():
        out = out.when(schema == k, v)
    return out.otherwise(F.lower(schema))


def _fields(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(name, value) of each key of the first ``rows`` objects."""
    return _head(spark, path, rows).select("at", F.explode(F.col("v").cast("map<string,variant>")).alias("name", "value"))


def infer_schema(spark: SparkSession, path: str, max_rows: int = 100) -> dict[str, Any]:
    """Field names with the sorted names of their values' types."""
    rows = _fields(spark, path, max_rows).groupBy("name").agg(F.sort_array(F.collect_set(_type_name(F.schema_of_variant("value")))).alias("types"), F.min("at").alias("s")).orderBy("s", "name").collect()
    return {"fields": {r["name"]: r["types"] for r in rows}, "format": "jsonl"} if rows else {"fields": {}, "format": "unknown"}


def column_stats(spark: SparkSession, path: str, max_rows: int = 1000) -> dict[str, Any]:
    """min, max, mean of numeric keys (booleans too), and of the text's length."""
    kind = _type_name(F.schema_of_variant("value"))
    numeric = F.when(kind == "bool", F.try_variant_get("value", "$", "boolean").cast("int").cast("double")).when(kind.isin("int", "float"), F.try_variant_get("value", "$", "double"))
    length = F.when((F.col("name") == "text") & (kind == "str"), F.length(F.try_variant_get("value", "$", "string")).cast("double"))
    rows = _fields(spark, path, max_rows).select(F.when(length.isNotNull(), "text_length").otherwise(F.col("name")).alias("name"), F.coalesce(length, numeric).alias("x"))
    found = rows.where("x is not null").groupBy("name").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean")).collect()
    return {r["name"]: {"min": r["min"], "max": r["max"], "mean": r["mean"]} for r in found}


def count_rows(spark: SparkSession, path: str, encode: Callable[[str], list] | None = None) -> tuple[int, int]:
    """(valid JSON lines, tokens of their texts by ``encode``)."""
    lines = _variants(spark, path)
    if encode is None:
        return lines.count(), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())], names=["n"])

    texts = lines.select(F.try_variant_get("v", "$.text", "string").alias("t"))
    r = texts.mapInArrow(run, "n long").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return r["rows"], r["tokens"]


def build_manifest(
    spark: SparkSession, path: str, dataset_id: str | None = None, version: str | None = None, produced_by: str = "lexforge",
    metadata: dict | None = None, license_info: str | None = None, provenance: dict | None = None, now: datetime | None = None,
) -> dict[str, Any]:
    """What a dataset is: identity, content hash, rows, schema, statistics."""
    if not exists(path):
        raise FileNotFoundError(str(path))
    when = now or datetime.now(timezone.utc)
    name = str(path).rstrip("/").rsplit("/", 1)[-1]
    rows, _ = count_rows(spark, path)
    extra = dict(metadata or {}) | {"column_stats": column_stats(spark, path)}
    if license_info:
        extra["license"] = license_info
    if provenance:
        extra["provenance"] = provenance
    return {
        "id": dataset_id or (name.rsplit(".", 1)[0] if "." in name[1:] else name), "version": version or when.strftime("%Y.%m.%d"), "path": str(path),
        "content_hash": checksum(path, data_only=True), "row_count": rows, "schema": infer_schema(spark, path), "produced_by": produced_by,
        "created_at": when.isoformat(), "metadata": extra,
    }


class FileVersions:
    """Version records and lineage as JSON beside the data."""

    def __init__(self, spark: SparkSession, metadata_dir: str = "data/metadata"):
        self.spark, self.dir = spark, str(metadata_dir).rstrip("/")
        system, root = _at(self.dir)
        system.create_dir(root, recursive=True)

    def _read(self, name: str) -> Any:
        system, root = _at(f"{self.dir}/{name}")
        if system.get_file_info(root).type != fs.FileType.File:
            return None
        with system.open_input_stream(root) as f:
            return json.loads(f.read())

    def _write(self, name: str, value: Any) -> None:
        system, root = _at(f"{self.dir}/{name}")
        with system.open_output_stream(root + ".new") as f:
            f.write(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode())
        system.move(root + ".new", root)

    def create(self, path: str, dataset_id: str = "dataset", parents: list[str] | None = None, encode: Callable | None = None, metadata: dict | None = None) -> dict[str, Any]:
        when = datetime.now(timezone.utc).isoformat()
        rows, tokens = count_rows(self.spark, path, encode)
        record = {
            "dataset_id": dataset_id, "version": when, "path": str(path), "checksum": checksum(path), "sample_count": rows, "token_count": tokens,
            "parent_versions": list(parents or []), "metadata": dict(metadata or {}), "created_at": when,
        }
        self._write(f"{dataset_id}_version.json", record)
        history = self._read("dataset_lineage.json") or {}
        history.setdefault(dataset_id, []).append({k: record[k] for k in ("version", "checksum", "sample_count", "parent_versions", "created_at")})
        self._write("dataset_lineage.json", history)
        return record

    def lineage(self, dataset_id: str) -> list[dict[str, Any]]:
        return (self._read("dataset_lineage.json") or {}).get(dataset_id, [])

    @staticmethod
    def verify(path: str, expected: str) -> bool:
        return checksum(path) == expected
