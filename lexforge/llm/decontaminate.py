"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words that a fixed mask selects from a window; words
at the mask's gaps don't count, so a substituted word there leaves the seed as
it was. Seeds of all benchmark items are looked up at every word of every
document. Each hit fixes a diagonal (document position minus item position);
along it the words are compared one by one over the whole item, and every stretch
that begins and ends with an agreeing word counts: it is a leak if it has
``min_words`` words or the item's whole length, and ``identity`` of them agree. Of
these the longest is reported.

The benchmark's seeds are held by every Python worker while they are at most
``held_seeds``. A larger benchmark is joined by shuffling seeds; then only the texts
that have a seed in common with an item are fetched and compared with it. Whether a
document leaks depends on its text alone, so both ways give the same rows.

Defined cases: null or empty texts have no words and leak nothing; items with
fewer than ``LEAST_WORDS`` words are no evidence and never match; shorter items
than a mask's span are seeded by their whole length. Rows with null ids are judged
by their text like others, and reported with null ids. Of a document's equal
stretches with an item (as many words, as many agreeing) the first is reported.
Repeated rows give repeated results, one for each document row and distinct item
row. An empty benchmark leaks nowhere, an empty table gives no rows. Other columns
pass through ``clean_rows`` unchanged, whatever their names. Texts of any length are
hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import sized, staged, table, unused

#: Six selected words each; between them any single substitution, and one at
#: every third, fourth, fifth or sixth word, leaves a seed intact.
MASKS = ("111111", "11011011", "1110111", "1111011", "11100111", "101101011")
MIN_WORDS = 10
IDENTITY = 0.75
LEAST_WORDS = 4
HELD_SEEDS = 4_000_000

_U = np.uint64
_C = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _masks_for(lengths: set[int]) -> list[str]:
    """The masks, and a whole-length one for each item length below their spans."""
    least = max(map(len, MASKS))
    return list(MASKS) + [m for n in sorted(lengths) if LEAST_WORDS <= n < least and (m := "1" * n) not in MASKS]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed at each word from which the mask's span is available."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt * 0x9E37 + 1, np.uint64)
    for k, o in enumerate(_places(mask)):
        out += h[o : o + n] * _C[k % 16] + (h[o : o + n] >> _U(29)) * _U(k + 1)
    return ta.mix(out)


class Index:
    """Seeds of the items, sorted, with the item and place of each."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        h, first, _, _ = ta.hashed(pa.array(texts, pa.large_string()))
        self.items = [h[first[i] : first[i + 1]] for i in range(len(texts))]
        self.masks = _masks_for({len(x) for x in self.items})
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, mask in enumerate(self.masks):
            short = k >= len(MASKS)
            for i, item in enumerate(self.items):
                if len(item) < LEAST_WORDS or (short and len(item) != len(mask)):
                    continue
                s = seeds(item, mask, k)
                found.append((s, np.full(len(s), i), np.arange(len(s))))
        seed, item, at = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        # a bit for each 22-bit prefix or so; most words miss here
        self.bits = max(16, min(27, int(len(self.seed)).bit_length() + 6))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.seed >> _U(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, item, place in item) of each seed in common."""
        out = []
        for k, mask in enumerate(self.masks):
            s = seeds(h, mask, k)
            at = np.flatnonzero(self.filter[(s >> _U(64 - self.bits)).astype(np.int64)])
            if not len(at):
                continue
            lo = np.searchsorted(self.seed, s[at], "left")
            n = np.searchsorted(self.seed, s[at], "right") - lo
            if not n.sum():
                continue
            which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            out.append((np.repeat(at, n), self.item[which], self.at[which]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))  # type: ignore[return-value]


def longest_stretch(same: np.ndarray, least: int, identity: float) -> tuple[int, int] | None:
    """The longest run [a, b) of at least ``least`` words, the first and last of them
    agreeing, of which the share ``identity`` agrees; the first of equal ones."""
    begins = np.flatnonzero(same)
    if not len(begins):
        return None
    # a run qualifies if the sum of (agrees - identity) over it isn't negative
    total = np.concatenate(([0.0], np.cumsum(same - identity)))
    at = total[begins]
    # only a begin with a lower total than all before it can give the longest run
    lowest = np.concatenate(([True], at[1:] < np.minimum.accumulate(at)[:-1]))
    starts, x = begins[lowest], at[lowest]
    ends = begins + 1
    # the greatest total at an end from here on, which only falls
    reach = np.maximum.accumulate(total[ends][::-1])[::-1]
    last = np.searchsorted(-reach, -(x - 1e-9), "right") - 1
    length = np.where(last >= 0, ends[np.maximum(last, 0)] - starts, 0)
    k = int(np.argmax(length))
    return (int(starts[k]), int(starts[k] + length[k])) if length[k] >= least else None


def verify(doc: np.ndarray, item: np.ndarray, shift: int, min_words: int, identity: float) -> tuple[int, int, int] | None:
    """(first word in the document, words, agreeing words) of a leak on this diagonal."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b <= a:
        return None
    same = item[a:b] == doc[a + shift : b + shift]
    run = longest_stretch(same, min(min_words, len(item)), identity)
    return run and (a + run[0] + shift, run[1] - run[0], int(same[run[0] : run[1]].sum()))


def leaks_in(h: np.ndarray, index: Index, min_words: int, identity: float) -> list[tuple[int, int, int, int]]:
    """For each item that leaks into the words: (item, first word, words, agreeing)."""
    at, item, place = index.hits(h)
    if not len(at):
        return []
    diagonals = np.unique(np.stack([item, at - place], axis=1), axis=0)
    best: dict[int, tuple[int, int, int]] = {}
    for i, shift in diagonals.tolist():
        if (v := verify(h, index.items[i], shift, min_words, identity)) and (i not in best or (v[1], v[2], -v[0]) > (best[i][1], best[i][2], -best[i][0])):
            best[i] = v
    return [(i, *v) for i, v in sorted(best.items())]


def _scan(index, min_words: float, identity: float, clean: bool):
    """mapInArrow: leaks of each document, or (clean) the rows without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value if hasattr(index, "value") else index
        if clean:
            for batch in batches:
                text = ta.column(batch, "text").cast(pa.large_string())
                keep = []
                for a, b in ta.blocks(text):
                    h, first, _, _ = ta.hashed(text.slice(a, b - a))
                    keep += [not leaks_in(h[first[i] : first[i + 1]], held, min_words, identity) for i in range(b - a)]
                yield batch.filter(pa.array(keep, pa.bool_()))
            return
        for batch, texts in ta.iter_texts(batches):
            h, first, _, _ = ta.hashed(texts)
            ids = batch.column(0).to_pylist()
            rows = [
                (ids[d], held.ids[i], at, n, agree)
                for d in range(len(texts))
                for i, at, n, agree in leaks_in(h[first[d] : first[d + 1]], held, min_words, identity)
            ]
            yield _batch(rows)

    return run


_COLUMNS = "doc_id long, item_id long, first_word long, n_words long, n_same long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "first_word", "n_words", "n_same"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)


def _seed_rows(lengths: list[int], of_items: bool):
    """mapInArrow: the key of each text with its distinct seeds."""
    masks = _masks_for(set(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in ta.iter_texts(batches):
            h, first, _, _ = ta.hashed(texts)
            found = []
            for i in range(len(texts)):
                own = h[first[i] : first[i + 1]]
                use = [
                    (k, m) for k, m in enumerate(masks)
                    if not of_items or (len(own) >= LEAST_WORDS and (k < len(MASKS) or len(own) == len(m)))
                ]
                found.append(np.unique(np.concatenate([np.zeros(0, np.uint64)] + [seeds(own, m, k) for k, m in use])).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "seeds"])

    return run


def _pair_leaks(min_words: int, identity: float):
    """mapInArrow over texts with the text of an item that has a seed in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in ta.iter_texts([batch]):
                doc, first, _, _ = ta.hashed(texts)
                item, begin, _, _ = ta.hashed(b.column(4).cast(pa.large_string()))
                rows = []
                for r in range(b.num_rows):
                    one = Index.__new__(Index)
                    _one(one, item[begin[r] : begin[r + 1]])
                    for _, at, n, agree in leaks_in(doc[first[r] : first[r + 1]], one, min_words, identity):
                        rows.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(3)[r].as_py(), at, n, agree))
                found = _batch([x[1:] for x in rows])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), *found.columns], names=["key", *found.schema.names])

    return run


def _one(index: Index, item: np.ndarray) -> None:
    """An index of one item whose words are known by their hashes."""
    index.ids, index.items, index.masks = [0], [item], _masks_for({len(item)})
    parts = [(seeds(item, m, k), k) for k, m in enumerate(index.masks) if len(item) >= LEAST_WORDS and (k < len(MASKS) or len(item) == len(m))]
    seed = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
    at = np.concatenate([np.arange(len(p)) for p, _ in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(seed, kind="stable")
    index.seed, index.at, index.item = seed[order], at[order], np.zeros(len(seed), np.int64)
    index.bits = 16
    index.filter = np.zeros(1 << 16, bool)
    index.filter[(index.seed >> _U(48)).astype(np.int64)] = True


def _held(benchmark: DataFrame, limit: int) -> Index | None:
    """The index of a benchmark of at most ``limit`` seeds, by its size, else None."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).distinct()
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    # a word has at least one character and is followed by another
    if size / 2 * len(MASKS) > limit:
        return None
    rows = items.orderBy(F.col("i").asc_nulls_last(), "t").collect()
    return Index([r[0] for r in rows], [r[1] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_same of each leak: the best stretch
    of each item in each document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    index = _held(benchmark, held_seeds)
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        return plain.mapInArrow(_scan(shared, min_words, identity, False), _COLUMNS)
    return _shuffled(plain, benchmark, min_words, identity).drop("key")


def _key(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("string")))


def _shuffled(plain: DataFrame, benchmark: DataFrame, min_words: int, identity: float) -> DataFrame:
    """The leaks into ``plain`` (id, text), with the key of each leaking text."""
    items = staged(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item is not null").distinct()
        .withColumn("at", F.monotonically_increasing_id())
    )
    words = r"[0-9A-Za-z\x{80}-\x{10ffff}]+"
    short = items.select(F.regexp_count(F.lower("item"), F.lit(words)).alias("n")).where(F.col("n") < max(map(len, MASKS))).distinct().collect()
    lengths = [r[0] for r in short]
    own = items.select("at", F.col("item").alias("text")).mapInArrow(_seed_rows(lengths, True), "key long, seeds array<long>")
    texts = plain.where("text is not null").select(_key().alias("key"), "text").mapInArrow(_seed_rows(lengths, False), "key binary, seeds array<long>")
    pairs = staged(
        texts.select("key", F.explode("seeds").alias("seed"))
        .join(own.select(F.col("key").alias("at"), F.explode("seeds").alias("seed")), "seed").select("key", "at").distinct()
    )
    both = plain.where("text is not null").select(_key().alias("key"), "id", "text").join(sized(pairs), "key").join(items, "at")
    return both.select("key", "id", "text", "item_id", "item").mapInArrow(_pair_leaks(min_words, identity), "key binary, " + _COLUMNS)


def clean_rows(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, each judged by its text."""
    index = _held(benchmark, held_seeds)
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        return docs.mapInArrow(_scan(shared, min_words, identity, True), docs.schema)
    leak = unused(docs, "leak")
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = staged(_shuffled(plain, benchmark, min_words, identity).select(F.col("key").alias(leak)).distinct())
    return docs.join(sized(found), _key() == F.col(leak), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
