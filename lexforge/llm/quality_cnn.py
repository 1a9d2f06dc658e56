"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters of ``KERNEL`` bytes run over the
document at steps of ``STEP`` bytes. The document is covered by overlapping
chunks; in each the filters' outputs are max-pooled (and rectified). The largest
and the mean of a document's chunk values are combined by a logistic unit into
the probability that its quality is good. A second network of the same kind, with
steps of ``FINE`` bytes, gives the probability that it isn't toxic; a document must
pass both, and its probability is their product. Whole documents are read, whatever
their length: chunks stream through a running maximum and sum.

The networks are trained here on labelled rows, at most ``MAX_LABELLED`` of them
for each network (of those known to it, the ones with the smallest hash of their id;
for the second as many toxic and as many other ones): a documented bound for fitting
only. The cut-off is set on a part of them that training didn't see, so that at
most ``GOOD_LOST`` of the good ones fall below it.

Defined cases: a null text counts as empty; an empty text has the probability of
a document of padding only, and is accepted or not by it; if
there are fewer than ``LEAST_PER_CLASS`` labelled rows of either class, nothing
can be learned and every document is accepted with a null probability; so too for
toxic ones alone, if either kind is too rare or there is no column ``toxic``. A
toxic row, or one of which that isn't known, is no example of good quality. A null
label or doc_id trains nothing. Rows with equal hashes of their id are picked by id,
then label. A probability equal to the cut-off is accepted. Repeated rows are scored
alike. An empty table gives no rows. Other columns pass through ``keep_good`` unchanged,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import table

EMBED, FILTERS, STEP, KERNEL = 8, 24, 4, 16
CHUNK, HOP = 512, 256  # bytes; neighbours overlap by half
MAX_LABELLED = 1500
LEAST_PER_CLASS = 8
EPOCHS = 14
RATE = 0.01
GOOD_LOST = 0.01
#: Documents that are laid out together while scoring.
_BLOCK = 1 << 18
#: Places of the filters that are laid out at once: half a million numbers stay in the cache.
_ROWS = 2048
#: Maxima whose gradients are worked out at once.
_BACK = 8192
#: Bytes of one document held at once; a longer one is read in several parts.
_PART = 1 << 18

#: Steps of the network that tells toxic texts: single words, wherever they start.
FINE = 1


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # KERNEL * EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # 2 * FILTERS
    base: float
    cut: float = 0.5
    step: int = STEP


def _padded(n: int, step: int) -> int:
    """Filter places of a text of n bytes: whole hops, at least one chunk."""
    pos, hop = CHUNK // step, HOP // step
    places = max(1, -(-n // step))
    return max(pos, -(-max(0, places - pos) // hop) * hop + pos)


def _responses(net: Net, data: np.ndarray) -> np.ndarray:
    """Filter outputs (without bias) at each step; the last ones see zero bytes.

    What a filter sees at each place is laid out in rows, some thousands at a time, so
    that all filters and bytes are one matrix product.
    """
    wide = KERNEL * EMBED
    x = np.concatenate([net.embed[data].ravel(), np.zeros(wide - net.step * EMBED, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(x, wide)[:: net.step * EMBED]
    y = np.empty((len(seen), FILTERS), np.float32)
    for a in range(0, len(seen), _ROWS):
        np.matmul(np.ascontiguousarray(seen[a : a + _ROWS]), net.filters, out=y[a : a + _ROWS])
    return y


def _hop_max(net: Net, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest output of each filter in each hop, and its place; the outputs of
    some thousand places are held at once, however long the data."""
    hop = HOP // net.step
    rows = max(hop, _ROWS // hop * hop)
    n = len(data) // net.step
    padded = np.concatenate([data, np.zeros(KERNEL, np.uint8)])
    half, place = np.empty((n // hop, FILTERS), np.float32), np.empty((n // hop, FILTERS), np.int64)
    for a in range(0, n, rows):
        b = min(n, a + rows)
        x = net.embed[padded[a * net.step : (b - 1) * net.step + KERNEL]].ravel()
        seen = np.lib.stride_tricks.sliding_window_view(x, KERNEL * EMBED)[:: net.step * EMBED]
        own = (np.ascontiguousarray(seen) @ net.filters).reshape(-1, hop, FILTERS)
        at = own.argmax(axis=1)
        half[a // hop : b // hop] = np.take_along_axis(own, at[:, None], axis=1)[:, 0]
        place[a // hop : b // hop] = at + np.arange(a, b, hop)[:, None]
    return half, place


def _chunk_max(y: np.ndarray, step: int) -> np.ndarray:
    """Maxima over the overlapping chunks of one document's places."""
    half = y.reshape(-1, HOP // step, FILTERS).max(axis=1)
    return np.maximum(half[:-1], half[1:]) if len(half) > 1 else half


def _layout(texts: list[bytes], step: int, gap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each padded with zero bytes and a kernel's width apart, and their places."""
    gap = gap or KERNEL // step
    places = np.array([_padded(len(t), step) for t in texts])
    first = np.concatenate(([0], np.cumsum(places + gap)))
    data = np.zeros(first[-1] * step, np.uint8)
    for t, at in zip(texts, first.tolist()):
        data[at * step : at * step + len(t)] = np.frombuffer(t, np.uint8)
    return data, np.stack([first[:-1], first[:-1] + places], axis=1)


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """Two features for each filter and text: the largest and the mean chunk value."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    small = [i for i, t in enumerate(texts) if len(t) <= _PART]
    block: list[int] = []
    size = 0
    for i in [*small, None]:
        if i is None or (size and size + len(texts[i]) > _BLOCK):
            if block:
                data, places = _layout([texts[k] for k in block], net.step)
                y = _responses(net, data)
                for k, (a, b) in zip(block, places.tolist()):
                    c = np.maximum(_chunk_max(y[a:b], net.step) + net.bias, 0)
                    out[k, :FILTERS], out[k, FILTERS:] = c.max(axis=0), c.mean(axis=0)
            block, size = [], 0
        if i is not None:
            block.append(i)
            size += len(texts[i])
    for i, t in enumerate(texts):
        if len(t) > _PART:
            out[i] = _long(net, t)
    return out


def _long(net: Net, text: bytes) -> np.ndarray:
    """As ``pooled``, in parts that overlap by a hop so that every chunk is seen once."""
    total = _padded(len(text), net.step) * net.step
    text = text + bytes(total + KERNEL - len(text))
    best, added, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
    for at in range(0, total - HOP, _PART):
        upto = min(total, at + _PART + HOP)
        y = _responses(net, np.frombuffer(text, np.uint8, count=upto + KERNEL - at, offset=at))[: (upto - at) // net.step]
        c = np.maximum(_chunk_max(y, net.step) + net.bias, 0)
        best, added, n = np.maximum(best, c.max(axis=0)), added + c.sum(axis=0), n + len(c)
    return np.concatenate([best, added / n])


def probability(net: Net, texts: list[bytes]) -> np.ndarray:
    z = pooled(net, texts) @ net.weight + net.base
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], good: np.ndarray, seed: int = 5, epochs: int = EPOCHS, step: int = STEP) -> Net:
    """Adam on weighted log loss; both classes weigh the same. A max-pool passes
    its gradient to the places of the maxima only, so the backward step is small."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Net(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, (KERNEL * EMBED) ** -0.5, (KERNEL * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0, step=step,
    )
    hop = HOP // step
    base = np.zeros(1, np.float32)
    params = [net.embed, net.filters, net.bias, net.weight, base]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = good.mean()
    weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    every = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 16):
            batch = order[a : a + 16]
            # a hop of zeros after each text: all texts' hops are rows of one array
            data, places = _layout([texts[i] for i in batch], step, hop)
            half, place = _hop_max(net, data)
            text = np.repeat(np.arange(len(batch)), np.diff(places // hop, axis=1)[:, 0] - 1)
            left = np.concatenate([np.arange(x, y - 1) for x, y in (places // hop).tolist()])
            first = half[left] >= half[left + 1]
            c = np.maximum(np.where(first, half[left], half[left + 1]) + net.bias, 0)
            arg = np.where(first, place[left], place[left + 1])
            begin = np.searchsorted(text, np.arange(len(batch)))
            many = np.bincount(text)[:, None]
            best = np.maximum.reduceat(c, begin)
            f = np.concatenate([best, np.add.reduceat(c, begin) / many], axis=1)
            z = np.clip(f @ net.weight + base[0], -30, 30)
            d = ((1 / (1 + np.exp(-z)) - good[batch]) * weight[batch] / len(batch)).astype(np.float32)[:, None]
            dc = (d * net.weight[FILTERS:] / many)[text].astype(np.float32)
            top = np.minimum.reduceat(np.where(c == best[text], np.arange(len(c))[:, None], len(c)), begin)
            dc[top, every] += d * net.weight[:FILTERS]
            dc[c <= 0] = 0
            grads = [np.zeros_like(net.embed), np.zeros_like(net.filters), dc.sum(axis=0), (f * d).sum(axis=0), d.sum(keepdims=True)[0]]
            chunk, filt = np.nonzero(dc)
            padded = np.concatenate([data, np.zeros(KERNEL, np.uint8)])
            for i in range(0, len(chunk), _BACK):  # a long text has many maxima
                at, of = chunk[i : i + _BACK], filt[i : i + _BACK]
                g = dc[at, of]
                seen = padded[(arg[at, of] * step)[:, None] + np.arange(KERNEL)]
                hot = np.zeros((len(g), FILTERS), np.float32)
                hot[np.arange(len(g)), of] = g
                grads[1] += net.embed[seen].reshape(len(g), -1).T @ hot
                back = (net.filters[:, of].T * g[:, None]).reshape(-1, EMBED)
                flat = seen.ravel()
                grads[0] += np.stack([np.bincount(flat, back[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(np.float32)
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.base = float(base[0])
    return net


def fit(labelled: list[tuple[str, int]], seed: int = 5, step: int = STEP) -> Net | None:
    """The network for (text, 1 if good else 0) rows, or None if a class is too rare."""
    texts = [t.encode() for t, _ in labelled]
    good = np.array([q for _, q in labelled], np.float32)
    if min((good == 1).sum(), (good == 0).sum()) < LEAST_PER_CLASS:
        return None
    held = np.arange(len(texts)) % 5 == 4
    net = train([t for t, h in zip(texts, held) if not h], good[~held], seed, step=step)
    p = probability(net, [t for t, h in zip(texts, held) if h])
    of = good[held]
    if (of == 1).any():
        low = float(np.quantile(p[of == 1], GOOD_LOST))
        high = float(p[of == 0].max()) if (of == 0).any() else 0.0
        # between the classes if they are apart, else where few good ones are lost
        net.cut = min(0.5, (low + high) / 2 if high < low else low)
    return net


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """(text, quality); toxic rows are no examples of good quality."""
    quality = F.col("quality").cast("int")
    if "toxic" in labels.columns:
        quality = F.when((quality == 0) | (F.col("toxic").cast("int") == 0), quality)
    return _picked(docs, labels.select(F.col("doc_id").cast("long").alias("k"), quality.alias("q")), limit)


def toxic_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """(text, 0 if toxic else 1), at most ``limit`` of each: toxic ones are rare."""
    if "toxic" not in labels.columns:
        return []
    known = labels.select(F.col("doc_id").cast("long").alias("k"), (1 - F.col("toxic").cast("int")).alias("q"))
    return _mixed([(k, t, q) for value in (0, 1) for k, t, q in _fetched(docs, known.where(F.col("q") == value), limit)])


def _picked(docs: DataFrame, known: DataFrame, limit: int) -> list[tuple[str, int]]:
    return _mixed(_fetched(docs, known, limit))[:limit]


def _fetched(docs: DataFrame, known: DataFrame, limit: int) -> list[tuple[int, str, int]]:
    # the rows are picked by id alone, and only their texts are fetched
    picked = known.where("k is not null and q in (0, 1)").distinct().orderBy(F.xxhash64("k"), "k", "q").limit(limit)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("t")).join(F.broadcast(picked), "k").select("k", "t", "q")
        .where("t is not null").collect()
    )
    return sorted({(r.k, r.t, r.q) for r in rows})


def _mixed(rows: list[tuple[int, str, int]]) -> list[tuple[str, int]]:
    return [(t, q) for _, t, q in sorted(rows, key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % 2**64, r[1], r[2]))]


def fit_all(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Net]:
    """The networks that a document must pass: of quality, and of not being toxic.

    Each is one task's work, beside the other; a lost one is fitted again, to the same.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([(labelled_rows(docs, labels, limit), STEP), (toxic_rows(docs, labels, limit), FINE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                known, step = shared.value[i]
                net = fit(known, step=step)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(net)])], names=["id", "net"])

    rows = spark.range(0, 2, 1, 2).mapInArrow(run, "id long, net binary").collect()
    nets = [pickle.loads(r["net"]) for r in sorted(rows, key=lambda r: r["id"])]
    return [net for net in nets if net is not None]


def _score(shared, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            col = pc.fill_null(ta.column(batch, "text").cast(pa.large_string()), "")
            p, good = [], []
            for a, b in ta.blocks(col):
                texts = [s.as_buffer().to_pybytes() for s in col.slice(a, b - a)]
                each = [probability(net, texts) for net in nets]
                p += np.prod(each, axis=0).tolist()
                good += np.all([x >= net.cut for x, net in zip(each, nets)], axis=0).tolist()
            good = pa.array(good, pa.bool_())
            if mode == "keep":
                yield batch.filter(good)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), good], names=["doc_id", "probability", "accepted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, probability of good quality and not being toxic, and whether it is accepted."""
    nets = fit_all(training if training is not None else docs, labels, limit)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not nets:
        return plain.select("doc_id", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("accepted"))
    return plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(nets), "score"), "doc_id long, probability double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    nets = fit_all(docs, labels, limit)
    if not nets:
        return docs
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(nets), "keep"), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
