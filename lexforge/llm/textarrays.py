"""Vectorised text to token-hash arrays, shared by the hashing operators.

A *word* is a maximal run of UTF-8 bytes that are ASCII letters, ASCII digits
or part of a non-ASCII character, taken from the lower-cased text. Many texts
are laid end to end in one buffer and all their words are hashed with a dozen
numpy passes, so no Python code runs per word.

The hash of a word with bytes b_0..b_k is sum(T[b_i] * M**i) mod 2**64, mixed;
T is a fixed random table and M a fixed odd number. It is the same in every
process, which builtin ``hash`` isn't.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 2**64)
_IS_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
_IS_WORD[0x80:] = True

#: Bytes of text hashed in one go; bounds a Python worker's memory. A longer
#: text is still hashed whole, on its own.
BLOCK_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for k, m in enumerate((_M, _M_INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in a buffer of lower-case UTF-8."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _IS_WORD[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, hash_spans(buf, start, end)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a buffer; equal bytes have equal hashes wherever they are."""
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def blocks(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together have at most ``limit`` bytes
    (or are one single text)."""
    limit = limit or BLOCK_BYTES
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block of texts: ``(hashes, first, start, end)``.

    Words of text i are ``hashes[first[i]:first[i + 1]]``; start and end are byte
    places in that lower-cased text. Null and empty texts have no words.
    """
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    # one space between texts keeps their words apart
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(low)], pa.int64()), low), pa.scalar(" ", pa.large_string()))
    buf = np.frombuffer(joined.buffers()[2], np.uint8, count=pc.sum(pc.binary_length(joined)).as_py() or 0)
    sizes = np.asarray(pc.binary_length(low).to_numpy(zero_copy_only=False), dtype=np.int64)
    base = np.zeros(len(low) + 1, np.int64)
    np.cumsum(sizes + 1, out=base[1:])
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64), none, none
    start, end, h = words_of(buf)
    first = np.searchsorted(start, base)
    owner = np.repeat(np.arange(len(low)), np.diff(first))
    return h, first, start - base[owner], end - base[owner]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams of one text; a shorter text that has words is one gram."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = mix(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix(out * _U(_M) + h[k : len(h) - n + 1 + k])
    return out


def py_words(text: str | None) -> list[str]:
    """The words of one text by plain Python, for tests and small inputs."""
    import re

    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def iter_texts(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches, each with at most ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = column(batch, text)
        for a, b in blocks(col, limit):
            yield batch.slice(a, b - a), col.slice(a, b - a)
