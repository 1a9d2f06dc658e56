"""URL filter: the ratio of two character language models.

Two variable-order Markov models give each byte of a URL (lower case, with marks
for its start and end) a probability after the up to ``ORDER`` bytes before it.
One is counted over the accepted URLs, one over the rejected; an order that the
context is too rare for gives way to the next lower one by interpolation,
P_k = (count(context byte) + LAMBDA * P_(k-1)) / (count(context) + LAMBDA).
A URL's score is the difference of the two log-likelihoods divided by its
length; below the cut-off it is filtered.

What a byte adds to a score depends on its *window* only, the byte and the five
before it, six bytes that are one exact number. Windows are counted over all
URLs, by class; the table of distinct windows grows with the corpus and stays
distributed. Both models' values are worked out in it by groups of windows with the
same two bytes before the last: all contexts of two and more bytes are in one group,
and counts of pairs of bytes, at most 65,536, are held. Scores are sums over windows:
the ``HEAD`` most frequent windows, which nearly all URLs share, are broadcast (their
number is fixed), the others are joined by shuffle, where none is frequent.

The cut-off is calibrated over all labelled URLs, each scored with one
occurrence of its own windows taken out of its own model: the score at which the
mean of both classes' error rates is least, among those that lose at most
``MAX_LOST`` of the accepted.

Labels come from ``labels`` (url, accepted), or else from seed words in the host
(``SEEDS``): such a URL is an example of a rejected one, any other of an accepted
one. Then the models never see a seed word: it is cut out of every URL before
counting and scoring, so that they learn what else goes with it, not the list.

Defined cases: a null or empty URL has a null score and is not accepted; if
either class has no example, every other URL is accepted, with a score of 0.
Null labels are not used. Repeated rows count as often as they come and get the
same score. Scores equal to the cut-off are accepted; of equally good cut-offs the
middle one is taken. An empty table gives no rows. Other columns are not used,
whatever their names. Whole URLs are read, of any length; control characters count
as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, staged, table
from .textarrays import blocks

ORDER = 5
LAMBDA = 2.0
MAX_LOST = 0.01
HEAD = 100_000
SEEDS = ("casino", "bets", "pills", "spam", "adult", "ads-track", "viagra", "porn", "poker", "payday")
_START, _END, _CONTROL = b"\x02", b"\x03", b"\x04"
_CLEAN = bytes.maketrans(bytes(range(4)), _CONTROL * 4)
_BIN = 0.01
_BINS = 4000


def windows(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window of each byte of each URL and of its end, and which URL it is of.

    The last six bytes as one number, the last one lowest; zero where there are none.
    """
    lengths = np.array([len(u) + 2 for u in urls], np.int64)
    data = np.frombuffer(b"".join(_START + u.translate(_CLEAN) + _END for u in urls), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(urls)), lengths)
    depth = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = data.copy()
    for j in range(1, ORDER + 1):
        out[j:] += np.where(depth[j:] >= j, data[:-j] << (8 * j), 0)
    scored = depth > 0
    return out[scored], owner[scored]


def _grouped(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the sum of ``counts`` over the rows with its key."""
    _, at = np.unique(key, return_inverse=True)
    total = np.zeros((at.max() + 1 if len(at) else 0, counts.shape[1]))
    np.add.at(total, at, counts)
    return total[at]


def values(window: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each window adds to a score: log P accepted - log P rejected; the same with
    one occurrence taken out of the accepted, and out of the rejected.

    ``window`` holds all windows with the same two bytes before the last, ``counts``
    their occurrences by class (columns), ``pairs`` (256, 256, 2) those of each two bytes.
    """
    last, before = window & 255, (window >> 8) & 255
    ways = []
    for less in (0, 1):
        p = np.full((len(window), 2), 1 / 256)
        for k in range(ORDER + 1):
            if k == 0:
                gram, context = pairs.sum(axis=0)[last], np.broadcast_to(pairs.sum(axis=(0, 1)), p.shape)
            elif k == 1:
                gram, context = pairs[before, last], pairs.sum(axis=1)[before]
            else:
                gram = _grouped(window & ((1 << (8 * (k + 1))) - 1), counts)
                context = _grouped((window >> 8) & ((1 << (8 * k)) - 1), counts)
            there = ((window >> (8 * k)) & 255 != 0)[:, None]
            p = np.where(there, (np.maximum(gram - less, 0) + LAMBDA * p) / (np.maximum(context - less, 0) + LAMBDA), p)
        ways.append(np.log(p))
    whole, less = ways
    return whole[:, 0] - whole[:, 1], less[:, 0] - whole[:, 1], whole[:, 0] - less[:, 1]


def _bytes(urls: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for a, b in blocks(urls.cast(pa.large_string()), 1 << 18):
        yield a, [u.encode() for u in urls.slice(a, b - a).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (view, label): windows with their occurrences by class, and in all."""
    for batch in batches:
        label = np.array([2 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
        for a, urls in _bytes(batch.column(0)):
            w, owner = windows(urls)
            own, at = np.unique(w, return_inverse=True)
            kind = label[a + owner]
            counts = [np.bincount(at[x], minlength=len(own)) for x in (kind == 1, kind == 0, kind >= 0)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, counts)], names=["w", "accepted", "rejected", "n"])


def _valued(pairs: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        w = table.column("w").to_numpy()
        counts = np.stack([table.column(c).to_numpy() for c in ("accepted", "rejected")], axis=1).astype(float)
        return pa.table({"w": w, "n": table.column("n"), **dict(zip(("whole", "less_a", "less_r"), values(w, counts, pairs)))})

    return run


def _sums(shared):
    """mapInArrow over (at, view, label): bytes, sums over the held windows, the other windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = shared.value
        for batch in batches:
            label = batch.column(2).to_pylist()
            way = np.array([0 if x is None else 1 if x else 2 for x in label], np.int64)
            out: list[list] = [[], [], [], []]
            for a, urls in _bytes(batch.column(1)):
                w, owner = windows(urls)
                at = np.minimum(np.searchsorted(head, w), max(0, len(head) - 1))
                known = head[at] == w if len(head) else np.zeros(len(w), bool)
                for k, which in ((1, np.zeros(len(owner), np.int64)), (2, way[a + owner])):
                    out[k] += np.bincount(owner[known], held[at[known], which[known]], minlength=len(urls)).tolist()
                out[0] += [len(u) + 1 for u in urls]
                rest = np.split(w[~known], np.cumsum(np.bincount(owner[~known], minlength=len(urls)))[:-1])
                out[3] += [r.tolist() for r in rest]
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["at", "label", "n", "s", "own", "rest"])

    return run


def seed_label(url: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))
    hit = F.lit(False)
    for word in seeds:
        hit = hit | F.contains(host, F.lit(word))
    return ~hit


def best_cut(good: np.ndarray, bad: np.ndarray, max_lost: float = MAX_LOST) -> float:
    """The middle one of the best cut-offs, from the classes' histograms of scores."""
    lost = np.concatenate(([0], np.cumsum(good))) / max(1, good.sum())
    kept = 1 - np.concatenate(([0], np.cumsum(bad))) / max(1, bad.sum())
    error = np.where(lost <= max_lost, lost + kept, np.inf)
    same = np.flatnonzero(error <= error.min() + 1e-12)
    return float((same[len(same) // 2] - _BINS // 2) * _BIN)


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, seeds: tuple[str, ...] = SEEDS, head: int = HEAD) -> DataFrame:
    """page_id, url, score, accepted."""
    spark = pages.sparkSession
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    view = F.lower("url")
    if labels is None:
        view = F.regexp_replace(view, "|".join(seeds).replace(".", r"\."), "")
        rows = plain.select("page_id", "url", view.alias("view"), seed_label(F.col("url"), seeds).alias("label"), F.lit(True).alias("asked"))
    else:
        given = labels.select(F.col("url").cast("string").alias("url"), F.col("accepted").cast("boolean").alias("label")).where("url <> '' and label is not null")
        rows = plain.select("page_id", "url", view.alias("view"), F.lit(None).cast("boolean").alias("label"), F.lit(True).alias("asked")).union(
            given.select(F.lit(None).cast("long"), "url", view, "label", F.lit(False))
        )
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()))
    there = rows.where("url <> ''")
    found = staged(
        there.select("view", "label").mapInArrow(_count, "w long, accepted long, rejected long, n long")
        .groupBy("w").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "n")])
    )
    pairs = np.zeros((256, 256, 2))
    for r in found.groupBy(F.col("w").bitwiseAND(F.lit(0xFFFF)).alias("k")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect():
        pairs[r["k"] >> 8, r["k"] & 255] = r["a"], r["r"]
    if not pairs.sum(axis=(0, 1)).all():
        known = F.coalesce(F.length("url") > 0, F.lit(False))
        return rows.where("asked").select("page_id", "url", F.when(known, F.lit(0.0)).alias("score"), known.alias("accepted"))
    worth = staged(
        found.groupBy(F.shiftright("w", 8).bitwiseAND(F.lit(0xFFFF)).alias("context")).applyInArrow(_valued(pairs), "w long, n long, whole double, less_a double, less_r double")
    )
    top = worth.orderBy(F.desc("n"), "w").limit(head).select("w", "whole", "less_a", "less_r").toArrow().sort_by("w")
    held = spark.sparkContext.broadcast((top.column("w").to_numpy(), np.stack([top.column(c).to_numpy() for c in ("whole", "less_a", "less_r")], axis=1)))
    part = staged(there.select("at", "view", "label").mapInArrow(_sums(held), "at long, label boolean, n long, s double, own double, rest array<long>"))
    tail = part.select("at", "label", F.explode("rest").alias("w")).join(worth, "w")
    own = F.when(F.col("label").isNull(), F.col("whole")).when(F.col("label"), F.col("less_a")).otherwise(F.col("less_r"))
    added = tail.groupBy("at").agg(F.sum("whole").alias("s2"), F.sum(own).alias("own2"))
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0.0))) / F.col("n")
    scored = staged(part.join(added, "at", "left").select("at", "label", total("s", "s2").alias("score"), total("own", "own2").alias("own")))
    bins = {True: np.zeros(_BINS, np.int64), False: np.zeros(_BINS, np.int64)}
    at = F.least(F.greatest(F.floor(F.col("own") / _BIN) + _BINS // 2, F.lit(0)), F.lit(_BINS - 1))
    for r in scored.where("label is not null").groupBy("label", at.alias("bin")).agg(F.count("*").alias("n")).collect():
        bins[r["label"]][r["bin"]] = r["n"]
    cut = best_cut(bins[True], bins[False])
    drop(found, worth, part)
    return rows.where("asked").join(scored.select("at", "score"), "at", "left").select(
        "page_id", "url", F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= cut, F.lit(False)).alias("accepted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
