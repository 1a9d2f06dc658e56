"""Overlap of word n-grams: contamination, near-duplicates, memorised passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import ngrams
from lexforge.operators import grams
from lexforge.sources.staging import drop, staged


def contamination(train: DataFrame, evaluation: DataFrame, ngram_size: int = 5, threshold: float = 0.8, text: str = "text", seq: str = "_seq") -> DataFrame:
    """Each evaluation text that has n-grams: index, n_grams, n_shared, overlap, contaminated.

    Contaminated if its share of n-grams that the training texts have is above
    the threshold. The training texts' n-grams are looked up by hash where they stand;
    only those that can be the evaluation's are cut out, joined and made distinct.
    """
    own = evaluation.select(F.col(seq).alias("index"), F.explode(ngrams(text, ngram_size)).alias("g"))
    wanted = own.select("g").distinct()
    held = grams.marks(evaluation, ngram_size, 1, text)
    seen = grams.marked(train, held, ngram_size, text).select("g").join(wanted, "g", "left_semi").distinct().withColumn("hit", F.lit(1))
    return (
        own.join(seen, "g", "left").groupBy("index").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_shared"))
        .withColumn("overlap", F.col("n_shared") / F.col("n_grams")).withColumn("contaminated", F.col("overlap") > threshold)
    )


def contamination_report(train: DataFrame, evaluation: DataFrame, ngram_size: int = 5, threshold: float = 0.8, text: str = "text", seq: str = "_seq") -> dict:
    """The counts, and the first ten contaminated texts."""
    total = evaluation.count()
    found = contamination(train, evaluation, ngram_size, threshold, text, seq).where("contaminated").cache()
    n = found.count()
    first = found.join(evaluation.select(F.col(seq).alias("index"), F.substring(text, 1, 100).alias("text_preview")), "index").orderBy("index").limit(10).collect()
    found.unpersist()
    return {
        "contamination_detected": n > 0,
        "contamination_count": n,
        "contamination_rate": n / total if total else 0.0,
        "total_eval_texts": total,
        "contaminated_texts": [{"index": r["index"], "overlap": r["overlap"], "text_preview": r["text_preview"]} for r in first],
    }


#: Documents whose n-gram counts give the order of the prefix filter, and the n-grams
#: that it knows as common. Any order gives the same pairs; a good one gives few candidates.
_ORDER_ROWS, _COMMON = 20_000, 200_000


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, sorted; their counts): the common ones of some documents."""
    part = max(1, sets.count() // _ORDER_ROWS)
    counts = sets.where(F.pmod(F.xxhash64("i"), F.lit(part)) == 0).select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "g").limit(_COMMON).toArrow()
    g, n = (found.column(k).to_numpy() for k in ("g", "n"))
    at = np.argsort(g)
    return g[at], n[at]


def _prefix(common, threshold: float):
    """mapInArrow over (i, a, b, g sorted): the set's size, and in place of the set the
    first of its values, rarest first, that a set as similar can't do without."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for b in batches:
            lists = b.column(3)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, often[at], 0)
            flat = flat[np.lexsort((rank, row))]  # stable: values of one rank stay in order
            starts = np.cumsum(sizes) - sizes
            need = np.minimum(sizes, sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1)
            first = flat[(np.arange(len(flat)) - starts[row]) < need[row]]
            ends = pa.array(np.concatenate([[0], np.cumsum(need)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(first, pa.int64()))], names=["i", "a", "b", "n", "p"])

    return run


def _few(ids: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Ids to broadcast if there are few by count; else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def near_duplicate_classes(df: DataFrame, ngram_size: int = 5, threshold: float = 0.9, text: str = "text", seq: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """Classes of equal n-gram sets, and the similar pairs of classes.

    ``members`` (i, rep): each row that has n-grams, and its class's smallest row.
    ``links`` (i, j, similarity): all pairs i < j of classes, each by its smallest row,
    whose Jaccard similarity is at least ``threshold``. Copies are in no pair, so what
    is compared doesn't grow with the square of their number.

    Exact. Sets that reach the threshold share one of the first
    |A| - ceil(t |A|) + 1 n-grams of each, all in one order. Only these, about a
    tenth, are written and joined; the order has those last that are common in a part
    of the rows, which would make the join quadratic. The sets themselves are computed
    again for rows that have a candidate.
    """
    hashes = F.sort_array(F.array_distinct(F.transform(ngrams(text, ngram_size), lambda g: F.xxhash64(g))))
    sets = df.select(F.col(seq).cast("long").alias("i"), hashes.alias("g"))
    marked = sets.select("i", F.xxhash64("g").alias("a"), F.xxhash64(F.lit(1), "g").alias("b"), "g").where(F.size("g") > 0)
    spark = df.sparkSession
    common = spark.sparkContext.broadcast(_common(sets))
    short = staged(marked.mapInArrow(_prefix(common, max(threshold, 1e-6)), "i long, a long, b long, n long, p array<long>"))
    members = staged(short.select("i", "a", "b").join(short.groupBy("a", "b").agg(F.min("i").alias("rep")), ["a", "b"]).select("i", "rep"))
    one = short.join(members.where("i = rep").select("i"), "i", "left_semi")
    if threshold <= 0:
        near = one.select("i").join(one.select(F.col("i").alias("j")), F.col("i") < F.col("j"))
    else:
        rows = one.select("i", "n", F.posexplode("p").alias("at", "g")).repartition("g")
        other = rows.select("g", F.col("i").alias("j"), F.col("n").alias("m"), F.col("at").alias("to"))
        # what the two can have in common from their first common n-gram on
        enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= (F.col("n") + F.col("m")) * F.lit(threshold / (1 + threshold)) - 1e-6
        near = rows.join(other, "g").where((F.col("i") < F.col("j")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9) & enough).select("i", "j").distinct()
    near = staged(near)
    asked = _few(staged(near.select("i").union(near.select("j")).distinct()))
    held = staged(df.join(asked.select(F.col("i").alias("__asked")), F.col(seq) == F.col("__asked"), "left_semi").select(F.col(seq).cast("long").alias("i"), hashes.alias("x")))
    both = F.size(F.array_intersect("x", "y"))
    pairs = near.join(held, "i").join(held.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    links = staged(pairs.select("i", "j", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= threshold))
    drop(short, near, held)
    return members, links


def near_duplicates(df: DataFrame, ngram_size: int = 5, threshold: float = 0.9, text: str = "text", seq: str = "_seq", expand: bool = True) -> DataFrame:
    """Pairs i < j whose n-gram sets have a Jaccard similarity of at least ``threshold``.

    All of them; without ``expand`` those of ``near_duplicate_classes``' links, and each
    copy with the smallest row of its class (their similarity is 1, which links don't
    reach): from these all pairs follow.
    """
    members, links = near_duplicate_classes(df, ngram_size, threshold, text, seq)
    if threshold > 1:
        return links
    if not expand:
        return links.union(members.where("i <> rep").select(F.col("rep").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("similarity")))
    other = members.select(F.col("rep").alias("rep_j"), F.col("i").alias("j"))
    copies = members.join(other, F.col("rep") == F.col("rep_j")).where("i < j").select("i", "j", F.lit(1.0).alias("similarity"))
    across = links.select(F.col("i").alias("rep"), F.col("j").alias("rep_j"), "similarity").join(members, "rep").join(other, "rep_j")
    return copies.union(across.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "similarity"))


def near_duplicate_report(df: DataFrame, ngram_size: int = 5, threshold: float = 0.9, text: str = "text", seq: str = "_seq") -> dict:
    """The number of all pairs, from the classes' sizes."""
    n = df.count()
    members, links = near_duplicate_classes(df, ngram_size, threshold, text, seq)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    inside = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    a, b = sizes.select(F.col("rep").alias("i"), F.col("n").alias("a")), sizes.select(F.col("rep").alias("j"), F.col("n").alias("b"))
    pairs = inside + (links.join(a, "i").join(b, "j").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
    return {"near_duplicates_detected": pairs > 0, "near_duplicate_pairs": pairs, "near_duplicate_rate": pairs / (n * (n - 1) / 2) if n > 1 else 0.0}


def frequent_ngrams(df: DataFrame, ngram_size: int = 5, min_frequency: int = 10, text: str = "text") -> DataFrame:
    """n-grams that at least ``min_frequency`` texts have, with that number.

    Exact. Hashes tell first which n-grams can be that frequent; only these move as
    strings. The texts are read twice.
    """
    held = grams.marks(df, ngram_size, min_frequency, text)
    often = grams.marked(df, held, ngram_size, text).groupBy(F.col("g").alias("ngram")).agg(F.count("*").alias("frequency"))
    return often.where(F.col("frequency") >= min_frequency)


def memorization(df: DataFrame, ngram_size: int = 5, min_frequency: int = 10, text: str = "text", top: int = 20) -> DataFrame:
    """The most frequent n-grams; ties in order of the n-gram."""
    return frequent_ngrams(df, ngram_size, min_frequency, text).orderBy(F.desc("frequency"), "ngram").limit(top)


def memorization_report(df: DataFrame, ngram_size: int = 5, min_frequency: int = 10, text: str = "text") -> dict:
    found = frequent_ngrams(df, ngram_size, min_frequency, text).cache()
    n = found.count()
    top = {r["ngram"]: r["frequency"] for r in found.orderBy(F.desc("frequency"), "ngram").limit(20).collect()}
    found.unpersist()
    return {"patterns_detected": n > 0, "high_frequency_patterns": n, "top_patterns": top}
