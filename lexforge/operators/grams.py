"""Word n-grams by hash, in Arrow batches: which ones are frequent, which texts have given ones.

The n-grams are those of ``functions.text.ngrams``: a text in lower case with its whitespace
collapsed has each as one run of bytes, so that they are hashed and cut out where they stand.
Hashes only pass over what can't matter; what is left is compared as strings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import collapse
from lexforge.sources.staging import drop, staged

#: Bits of a hash, and how many of them name its bucket, which is one group's work.
_BITS, _BUCKET = 34, 8
_LOW = _BITS - _BUCKET
#: Bytes of text hashed at once; hashes sorted at once.
_SLICE, _RUN = 1 << 20, 1 << 22
#: A map of marks has 64 bits for each hash in it, within 2 to these powers (1 to 128 MB).
_LEAST, _MOST = 23, 30
#: The gap between hashes that means so much and no hash yet.
_FAR = 65535


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 to the 64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, their bytes, where each begins and the last ends)."""
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(wide):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _SLICE, "right")) - 1)
        at = offsets[low : high + 1]
        yield low, high, data[at[0] : at[-1]], at - at[0]
        low = high


def _hashed(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end, hash) of each n-gram of the rows that begin at ``at``."""
    space = flat == 32
    full = np.flatnonzero(at[1:] > at[:-1])
    begins, ends = np.zeros(len(flat) + 1, bool), np.zeros(len(flat) + 1, bool)
    begins[1:], ends[:-1] = space, space
    begins[at[full]], ends[at[full + 1]] = True, True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(at, begin, "right") - 1  # the last of rows that begin there: others are empty
    many = max(0, len(begin) - n + 1)
    own = np.flatnonzero(row[:many] == row[n - 1 : n - 1 + many])
    row, begin, end = row[own], begin[own], end[own + n - 1]
    if not len(own):
        return row, begin, end, np.zeros(0, np.uint64)
    power, inverse = _powers(max(len(flat), _SLICE))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat + np.uint64(1)) * power[: len(flat)], out=sums[1:])
    return row, begin, end, _mixed((sums[end] - sums[begin]) * inverse[begin])


def _packed(h: np.ndarray, most: int) -> pa.RecordBatch:
    """(bucket, gaps) of hashes: sorted, each at most ``most`` times, as 16-bit gaps."""
    h = np.sort(h)
    if len(h) > most:
        h = h[np.concatenate([np.ones(most, bool), h[most:] != h[:-most]])]
    bounds = np.searchsorted(h, np.arange((1 << _BUCKET) + 1, dtype=np.int64) << _LOW)
    gaps = np.diff(h, prepend=0)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    gaps[bounds[some]] = h[bounds[some]] - (some << _LOW)
    ends = np.cumsum(gaps // _FAR + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, _FAR, np.uint16)
    out[ends - 1] = gaps % _FAR
    cuts = np.concatenate([[0], ends])[np.concatenate([bounds[some], bounds[-1:]])] * 2
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), data.cast(pa.binary())], names=["bucket", "gaps"])


def _sent(n: int, most: int):
    """mapInArrow over (text): its n-grams' hashes, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            for _, _, flat, at in _slices(b.column(0)):
                h = _hashed(flat, at, n)[3]
                held.append((h >> np.uint64(64 - _BITS)).astype(np.int64))
                many += len(h)
                if many >= _RUN:
                    yield _packed(np.concatenate(held), most)
                    held, many = [], 0
        if many:
            yield _packed(np.concatenate(held), most)

    return run


def _frequent(least: int):
    """Of one bucket's packed hashes, those that stand there ``least`` times."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        all_ = []
        for gaps in table.column("gaps"):
            g = np.frombuffer(gaps.as_buffer(), np.uint16)
            all_.append(np.cumsum(g, dtype=np.uint32)[g != _FAR])
        h = np.sort(np.concatenate(all_))
        h = np.unique(h[least - 1 :][h[least - 1 :] == h[: len(h) - least + 1]]) if len(h) >= least else h[:0]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(h)], pa.int64()), "h": pa.array([h.tobytes()], pa.binary())})

    return run


def _piece(bits: int):
    """mapInArrow over (bucket, h): the bucket's part of a map of 2 to the ``bits`` marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = []
            for h in b.column(1):
                marks = np.zeros(1 << (bits - _BUCKET), bool)
                marks[np.frombuffer(h.as_buffer(), np.uint32) >> np.uint32(_BITS - bits)] = True
                pieces.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.binary())], names=["bucket", "piece"])

    return run


def _plain(text: str) -> Column:
    return F.coalesce(collapse(F.lower(text)), F.lit(""))


def marks(df: DataFrame, n: int, least: int = 1, text: str = "text") -> np.ndarray:
    """A map with a mark for every n-gram that stands ``least`` times in the texts, and for
    few others.

    Only hashes are shuffled, sorted and as gaps: about two bytes for each n-gram of a run,
    none more than ``least`` times. The map has at most 128 MB, in which more than 16
    million n-grams leave more than one of 64 others marked.
    """
    least = max(1, least)
    sent = df.select(_plain(text).alias("t")).mapInArrow(_sent(n, least), "bucket int, gaps binary")
    found = staged(sent.groupBy("bucket").applyInArrow(_frequent(least), "bucket int, n long, h binary").where("n > 0"))
    many = found.agg(F.sum("n")).first()[0] or 0
    bits = min(_MOST, max(_LEAST, (64 * many - 1).bit_length()))
    out = np.zeros((1 << _BUCKET, 1 << (bits - _BUCKET - 3)), np.uint8)
    for b in found.select("bucket", "h").mapInArrow(_piece(bits), "bucket int, piece binary").toArrow().to_batches():
        for bucket, piece in zip(b.column(0).to_pylist(), b.column(1)):
            out[bucket] = np.frombuffer(piece.as_buffer(), np.uint8)
    drop(found)
    return out.reshape(-1)


def _cut(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings that stand there."""
    sizes = end - begin
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = flat[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _marked(shared, n: int):
    """mapInArrow over (text, key): key, n-grams that have a mark, for texts with such ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        shift = np.uint64(64 - (len(held).bit_length() + 2))
        for b in batches:
            for low, high, flat, at in _slices(b.column(0)):
                row, begin, end, h = _hashed(flat, at, n)
                place = (h >> shift).astype(np.int64)
                hit = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                grams = _cut(flat, begin[hit], end[hit])
                rows, sizes = np.unique(row[hit], return_counts=True)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), grams)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(low, high - low).take(pa.array(rows)), lists], names=["key", "grams"])

    return run


def marked(df: DataFrame, held: np.ndarray, n: int, text: str = "text", key: str | None = None) -> DataFrame:
    """(key, g): the distinct n-grams of each text that have a mark in ``held``."""
    rows = df.select(_plain(text).alias("t"), (F.col(key) if key else F.lit(True)).alias("key"))
    found = rows.mapInArrow(_marked(df.sparkSession.sparkContext.broadcast(held), n), f"key {rows.schema['key'].dataType.simpleString()}, grams array<string>")
    return found.select("key", F.explode(F.array_distinct("grams")).alias("g"))
