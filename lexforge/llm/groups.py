"""Candidate pairs from minhash bands, and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, sized, staged
from .textarrays import mix

_U = np.uint64
#: Values permuted in one go; bounds memory for very long texts.
_STEP = 4096


class MinHash:
    """``bands * rows`` minimum hashes of a set of 64-bit values.

    Function k takes the upper half of a value times an odd number, xor a mask:
    a permutation of 32-bit values. ``short`` keeps sixteen bits of each minimum,
    so that unequal sets agree in one function with probability
    J + (1 - J) / 65536.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.mul = rng.integers(1, 2**31, self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 2**32, self.k, dtype=np.uint32)

    def signature(self, values: np.ndarray) -> np.ndarray:
        low = (values >> _U(32)).astype(np.uint32)
        best = np.full(self.k, 2**32 - 1, np.uint32)
        for a in range(0, len(low), _STEP):
            part = self.mul[:, None] * low[None, a : a + _STEP]
            part ^= self.xor[:, None]
            np.minimum(best, part.min(axis=1), out=best)
        return best

    @staticmethod
    def short(signature: np.ndarray) -> bytes:
        return (signature * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").tobytes()


def fingerprint(values: np.ndarray) -> bytes:
    """Sixteen bytes that depend on the set only, not on its order."""
    a = int(mix(values).sum(dtype=np.uint64))
    b = int(mix(values ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), ">u2").reshape(len(signatures), -1).astype(np.uint16)


#: Nodes of a bucket up to which its pairs are spelled out; a larger bucket is
#: compared in blocks of ``BLOCK`` nodes, and only what it keeps is spelled out.
SPELLED, BLOCK = 48, 1024


class Candidates:
    """All pairs of nodes that share a band, pruned by ``keep``.

    ``nodes`` is a staged table (nid long, sig binary, weight long): ``sig`` holds
    ``bands * rows`` minima of sixteen bits. Nodes with the same ``rows`` minima in
    a band make a bucket; every two of a bucket are compared, however large it is.
    Most buckets have one node, which a count with map-side combining finds before
    anything else moves; the pair of a bucket of two is its smallest and its largest
    node, and needs no more. Pairs of small buckets are spelled out by ids, made
    distinct and joined with their signatures; a large bucket is cut into blocks,
    each two of which are one task's work whose memory is bounded, and a pair is
    given by the first band that it shares only.

    ``keep(sa, sb, wa, wb)`` takes the signature matrices and weights of as many
    pairs and gives (kept places, a number for each kept).
    """

    def __init__(self, nodes: DataFrame, bands: int, rows: int, keep):
        self.nodes, self.bands, self.rows, self.keep = nodes, bands, rows, keep

    def _rows(self) -> DataFrame:
        """(key, nid): a node in each of its buckets; the last five bits are the band."""
        assert self.bands <= 32
        wide = 2 * self.rows
        keys = [F.xxhash64(F.lit(i), F.substring("sig", i * wide + 1, wide)).bitwiseAND(F.lit(~31)) + F.lit(i) for i in range(self.bands)]
        return self.nodes.select("nid", F.explode(F.array(*keys)).alias("key"))

    def pairs(self) -> DataFrame:
        """u < v, value: distinct pairs that are kept, staged."""
        counted = staged(self._rows().groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("n > 1"))
        more = staged(counted.where("n > 2").select("key", "n"))
        two = counted.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        of = self._rows().join(sized(more), "key")
        few = of.where(F.col("n") <= SPELLED).groupBy("key").agg(F.sort_array(F.collect_list("nid")).alias("ids"))
        each = few.select("ids", F.posexplode("ids").alias("at", "u")).select("u", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("v"))
        spelled = two.union(each).distinct()
        sig = self.nodes.select(F.col("nid").alias("u"), F.col("sig").alias("su"), F.col("weight").alias("wu"))
        other = self.nodes.select(F.col("nid").alias("v"), F.col("sig").alias("sv"), F.col("weight").alias("wv"))
        small = spelled.join(sig, "u").join(other, "v").select("u", "v", "su", "sv", "wu", "wv").mapInArrow(self._each(), "u long, v long, value double")
        if more.where(F.col("n") > SPELLED).isEmpty():
            out = staged(small)
        else:
            out = staged(small.union(self._large(of)).distinct())
        drop(counted, more)
        return out

    def _large(self, of: DataFrame) -> DataFrame:
        placed = of.where(F.col("n") > SPELLED).join(self.nodes, "nid").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("nid"), "blocks").cast("int"))
        copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "nid", "sig", "weight"
        )
        return copies.groupBy("key", "a", "b").applyInArrow(self._block(), "u long, v long, value double")

    def _each(self):
        keep = self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sa, sb = (matrix(b.column(k).to_pylist()) for k in (2, 3))
                    at, value = keep(sa, sb, *(b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)))
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(value, pa.float64())], names=["u", "v", "value"])

        return run

    def _block(self):
        keep, bands, rows = self.keep, self.bands, self.rows

        def run(key: tuple, table: pa.Table) -> pa.Table:
            band, a, b = key[0].as_py() & 31, key[1].as_py(), key[2].as_py()
            nid, block, weight = (table.column(c).to_numpy() for c in ("nid", "block", "weight"))
            sig = matrix(table.column("sig").to_pylist())
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            # the bands before this one as single numbers, to know a pair that they have given
            wide = sig.reshape(len(sig), bands, rows)[:, :band]
            found = []
            for at in range(0, len(left), 64):
                i, j = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
                own = nid[i] < nid[j] if a == b else np.ones(len(i), bool)
                i, j = i[own], j[own]
                k, value = keep(sig[i], sig[j], weight[i], weight[j])
                i, j = i[k], j[k]
                first = ~(wide[i] == wide[j]).all(axis=2).any(axis=1)
                found.append((i[first], j[first], value[first]))
            i, j, value = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
            u, v = np.minimum(nid[i], nid[j]), np.maximum(nid[i], nid[j])
            return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "value": pa.array(value, pa.float64())})

        return run


def least_matches(compared: int, threshold: float, tolerance: float, chance: float = 1 / 65536) -> int:
    """The fewest matches of ``compared`` with which a pair stays.

    The similarity has a uniform prior. Given m matches the match rate follows
    Beta(m + 1, n - m + 1) above ``chance``; P(rate >= x) is then the
    probability of at most m successes in n + 1 trials of x.
    """
    def tail(m: int, x: float) -> float:
        return sum(math.comb(compared + 1, i) * x**i * (1 - x) ** (compared + 1 - i) for i in range(m + 1))

    x = threshold + (1 - threshold) * chance
    return next((m for m in range(compared + 1) if tail(m, x) / tail(m, chance) >= tolerance), compared + 1)


def bayes_keep(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 16) -> np.ndarray:
    """Which rows of two matrices of short minima stay.

    ``step`` functions are compared at a time; a pair is dropped as soon as the
    posterior probability that it reaches the threshold is below the tolerance,
    and is not compared further.
    """
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    k = a.shape[1] if len(a) else 0
    for at in range(0, k, step):
        upto = min(k, at + step)
        matches[alive] += (a[alive, at:upto] == b[alive, at:upto]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least_matches(upto, threshold, tolerance)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of each node of an undirected graph; root is its
    component's smallest node.

    Alternating large-star and small-star steps, each one shuffle of the
    edges, written to the shared folder.
    """
    now = staged(edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        # minima are combined before the shuffle and joined back: a hub that a third of
        # the nodes are linked to is no single task's window
        large = both.join(both.groupBy("x").agg(F.min("y").alias("m")), "x").where("y > x").select(F.col("y").alias("hi"), F.least("x", "m").alias("lo")).distinct()
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        before, now = now, staged(
            small.select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        drop(before)
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if stamp == seen:
            break
        seen = stamp
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo"), F.col("lo")).distinct())
