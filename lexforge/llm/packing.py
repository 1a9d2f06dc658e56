"""Packing: concatenate and cut.

Documents in order of doc_id are laid end to end, with one separator token after
each, and cut into windows of ``WINDOW`` tokens. A token is a Unicode character,
or with ``tokenizer`` (a file for the ``tokenizers`` library) an id of its
vocabulary, ``separator`` being an id too. A window has its boundary records:
which tokens of which document are where in it.

Two passes: the first range-sorts the documents' keys and lengths alone, and a prefix
sum over the token totals of its partitions gives each partition's global offset; the
second sends each document to its partition's range (one shuffle of the texts, each
range one task), where it is cut in order. A window that starts in one range and ends
in a later one is cut by the first; the few documents it needs from there are sent
along as boundary records, picked by a light pass over lengths. So windows don't
depend on the partitioning. There are at most ``MAX_RANGES`` ranges: their bounds and
offsets, which the driver and the workers hold, are some megabytes however much text
there is.

Defined cases: a null text is an empty document, which has only its separator;
rows with a null doc_id come last; rows with the same doc_id, or null, are ordered by
the md5 of their text, and are spread over ranges by it; repeated rows are packed each
time, in one task if they are alike in both. A document longer than a window fills
several. The last window may be short. An empty table has no windows. Other columns
are not used, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, sized, staged, table

WINDOW = 2048
SEPARATOR = "\x1e"
#: Tokens for which there is a range (more, if there would be too many), and ranges.
RANGE_TOKENS, MAX_RANGES = 8_000_000, 100_000
_LAST = 2**63 - 1

_BOUNDS = "array<struct<doc_id: long, doc_from: long, doc_to: long, at: long>>"


def _counter(tokenizer: str):
    """mapInArrow: adds the token ids of the text as ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return run


def _range_of(bounds: list[tuple[int, bytes]]):
    """A vectorised function: the range of each (key, tie), from the first of each range."""
    keys = np.array([k for k, _ in bounds], np.int64)
    ties = [t for _, t in bounds]

    @F.pandas_udf("int")
    def run(key: pd.Series, tie: pd.Series) -> pd.Series:
        own = key.to_numpy(np.int64)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        at = np.maximum(high - 1, 0)
        for i in np.flatnonzero(low < high):  # a bound has this very key
            at[i] = max(0, bisect.bisect_right(ties, bytes(tie.iloc[i]), int(low[i]), int(high[i])) - 1)
        return pd.Series(at.astype(np.int32))

    return run


def _cut(starts: list[int], window: int, separator, is_text: bool):
    """mapInArrow over rows sorted by (range, key, tie): the windows of each range."""
    total = starts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, held, bounds, size = None, 0, [], [], 0
        out: list[tuple] = []
        ready = 0

        def close() -> None:
            nonlocal held, bounds, size, ready
            body = "".join(held) if is_text else [x for p in held for x in p]
            out.append(((at - 1) // window, size, body, bounds))
            ready += size
            held, bounds, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, ready
            rows, out, ready = out, [], 0
            kinds = [pa.int64(), pa.int64(), pa.large_string() if is_text else pa.list_(pa.int32()), pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "doc_from", "doc_to", "at")]))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["window_id", "n_tokens", "tokens", "boundaries"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for b, doc, body in zip(cols[0], cols[1], cols[2]):
                if b != own:
                    if size and at == total:
                        close()
                    # a window left open here ends in no range after this one: it can't be
                    own, at, held, bounds, size = b, starts[b], [], [], 0
                    first = -(-starts[b] // window) * window
                    stop = -(-starts[b + 1] // window) * window  # end of the last window that starts here
                body = (body or "") + separator if is_text else [*(body or []), separator]
                n, i = len(body), 0
                if at < first:  # the head belongs to a window of an earlier range
                    i = min(n, first - at)
                    at += i
                while i < n and at < stop:
                    take = min(n - i, window - at % window)
                    held.append(body[i : i + take])
                    bounds.append({"doc_id": doc, "doc_from": i, "doc_to": i + take, "at": at % window})
                    size += take
                    i += take
                    at += take
                    if at % window == 0:
                        close()
                        if ready >= 1 << 20:
                            yield flush()
                at += n - i if at >= stop else 0
            # a batch ends anywhere; the open window goes on
        if size and at >= total:
            close()
        if out:
            yield flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, separator: str | int | None = None, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """window_id, n_tokens, tokens, boundaries(doc_id, doc_from, doc_to, at).

    ``doc_from`` and ``doc_to`` count tokens of the document, its separator
    being the last; ``at`` is the place in the window.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if tokenizer:
        plain = staged(plain.mapInArrow(_counter(tokenizer), "doc_id long, text string, ids array<int>"))
        length, body, separator = F.size("ids") + 1, F.col("ids"), 0 if separator is None else separator
    else:
        separator = SEPARATOR if separator is None else separator
        length, body = F.length("text") + len(separator), F.col("text")
    kind = "string" if not tokenizer else "array<int>"
    schema = f"window_id long, n_tokens long, tokens {kind}, boundaries {_BOUNDS}"
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(_LAST))
    tie = F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("tie")
    light = staged(plain.select(key.alias("key"), tie, length.cast("long").alias("n")))
    total = light.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    ranges = -(-total // max(range_tokens, -(-total // MAX_RANGES)))
    placed = staged(light.repartitionByRange(ranges, "key", "tie").withColumn("range", F.spark_partition_id()))
    drop(light)
    # ranges without rows are left out, the others numbered in order
    found = placed.groupBy("range").agg(F.sum("n").alias("n"), F.min(F.struct("key", "tie")).alias("first")).orderBy("range").collect()
    number = spark.createDataFrame([(r["range"], i) for i, r in enumerate(found)], "range int, at int")
    placed = placed.join(F.broadcast(number), "range").drop("range").withColumnRenamed("at", "range")
    starts = [0]
    for r in found:
        starts.append(starts[-1] + r["n"])
    # boundary records: the documents at a range's head that an earlier window needs
    owner = [(k, bisect.bisect_right(starts, starts[k] // window * window) - 1, -starts[k] % window) for k in range(1, len(found)) if starts[k] % window]
    in_range = _range_of([(r["first"]["key"], bytes(r["first"]["tie"])) for r in found])
    rows = plain.select("doc_id", body.alias("body"), key.alias("key"), tie).select(in_range("key", "tie").alias("range"), "doc_id", "body", "key", "tie")
    if owner:
        need = spark.createDataFrame(owner, "range int, owner int, need long")
        order = Window.partitionBy("range").orderBy("key", "tie")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        lead = staged(
            placed.withColumn("before", before).join(F.broadcast(need), "range").where("before < need")
            .select(F.col("key").alias("k"), F.col("tie").alias("t"), "owner").distinct()
        )
        extra = rows.drop("range").join(sized(lead), (F.col("key") == F.col("k")) & (F.col("tie") == F.col("t"))).select(F.col("owner").alias("range"), "doc_id", "body", "key", "tie")
        rows = rows.union(extra)
    return (
        rows.repartitionById(len(found), "range").sortWithinPartitions("range", "key", "tie").select("range", "doc_id", "body")
        .mapInArrow(_cut(starts, window, separator, not tokenizer), schema)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return flat(packed)


def flat(packed: DataFrame) -> DataFrame:
    """The windows with their boundaries as text: doc_id:from-to@at, one after another."""
    bounds = F.transform("boundaries", lambda b: F.concat(F.coalesce(b["doc_id"].cast("string"), F.lit("")), F.lit(":"), b["doc_from"], F.lit("-"), b["doc_to"], F.lit("@"), b["at"]))
    return packed.select("window_id", "n_tokens", "tokens", F.transform("boundaries", lambda b: b["doc_id"]).alias("doc_ids"), F.array_join(bounds, " ").alias("boundaries"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') || chr(30) AS body FROM documents),
o AS (
  SELECT doc_id, body, length(body) AS n,
         CAST(sum(length(body)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(body) AS start
  FROM d
),
p AS (
  SELECT doc_id, body, start, n, unnest(range(start // 2048, (start + n - 1) // 2048 + 1)) AS window_id FROM o
),
q AS (
  SELECT window_id, doc_id, body, greatest(start, window_id * 2048) - start AS doc_from,
         least(start + n, (window_id + 1) * 2048) - start AS doc_to,
         greatest(start - window_id * 2048, 0) AS pos
  FROM p
)
SELECT CAST(window_id AS BIGINT) AS window_id,
       CAST(sum(doc_to - doc_from) AS BIGINT) AS n_tokens,
       string_agg(substr(body, CAST(doc_from + 1 AS BIGINT), CAST(doc_to - doc_from AS BIGINT)), '' ORDER BY pos) AS tokens,
       list(doc_id ORDER BY pos) AS doc_ids,
       string_agg(doc_id || ':' || CAST(doc_from AS BIGINT) || '-' || CAST(doc_to AS BIGINT) || '@' || CAST(pos AS BIGINT), ' ' ORDER BY pos) AS boundaries
FROM q GROUP BY window_id
"""
