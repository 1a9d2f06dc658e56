"""The pipeline's stages and the whole of it against brute force, and their defined cases."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import packing, quality_cnn, secret_scan
from tests.llm.test_operators import AWS, DOCS, b64, groups_of, jaccard_truth, leak_truth, pack_truth, prose

BY_NAME = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and their rows."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    items = [prose(rng, n) for n in (30, 20, 12)]
    texts = [prose(rng, rng.randrange(40, 120)) for _ in range(70)]
    texts += [" ".join(rng.choice(["$$$", "BUY", "!!!", "0x00", "click"]) for _ in range(60)) for _ in range(40)]
    for k in range(8):
        w = texts[k].split()
        w[5] = "otherword"
        texts.append(" ".join(w))
    texts += [texts[20], texts[20], prose(rng, 30) + " " + items[0] + " " + prose(rng, 10), f"{prose(rng, 30)} {AWS} and {b64('key is ' + AWS)} {prose(rng, 5)}", None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 70), 0) for i in range(110) if i % 10 != 9]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, labels, items


def test_the_whole_is_its_stages_by_brute_force(spark, tables):
    folder, rows, labels, items = tables
    quality = dict((i, q) for i, q, _ in labels)
    known = quality_cnn._mixed(sorted((i, t, quality[i]) for i, t, *_ in rows if i in quality and t is not None))
    net = quality_cnn.fit(known)
    kept = [r for r in rows if quality_cnn.probability(net, [(r[1] or "").encode()])[0] >= net.cut]
    assert 60 < len(kept) < 100
    root = groups_of(jaccard_truth([t for _, t, *_ in kept]))
    kept = [r for k, r in enumerate(kept) if root.get(k, k) == k]
    kept = [r for r in kept if not any(leak_truth(r[1], x) for x in items)]
    stream = pack_truth([(r[0], secret_scan.redacted(r[1])) for r in kept], packing.WINDOW)
    got = corpus_pipeline.run(spark, folder).orderBy("window_id").collect()
    assert [(r["window_id"], r["tokens"]) for r in got] == [w[:2] for w in stream]
    assert AWS not in "".join(r["tokens"] for r in got) and items[0] not in "".join(r["tokens"] for r in got)
    assert "[AWS_ACCESS_KEY]" in "".join(r["tokens"] for r in got)


@pytest.mark.parametrize("name", list(BY_NAME))
def test_a_stage_of_no_rows(spark, tables, name):
    docs = spark.createDataFrame([], DOCS)
    out = BY_NAME[name](spark, docs, tables[0])
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", list(BY_NAME))
def test_a_stage_of_odd_rows(spark, tables, name):
    """Nulls in every column, empty and long texts, repeated rows, other columns."""
    folder, rows, *_ = tables
    odd = [(None, None, None, None, None), (None, "", None, "s", 0), (3, rows[3][1], "en", None, 7), (3, rows[3][1], "en", None, 7), (900, prose(random.Random(1), 30_000), "en", "s", 1)]
    docs = spark.createDataFrame([*rows[:20], *odd], DOCS)
    clash = docs.withColumns({c: F.lit(1) for c in ("node", "key", "range", "leak", "label", "n", "sig", "root", "c0", "row")})
    out = BY_NAME[name](spark, clash, folder).collect()
    if name == "packing":
        assert sum(len(r["tokens"]) for r in out) == sum(len(r[1] or "") + 1 for r in [*rows[:20], *odd])
        return
    plain = BY_NAME[name](spark, docs, folder).collect()
    key = lambda r: str((r["doc_id"], (r["text"] or "")[:50], r["text"] is None))
    assert sorted(map(key, out)) == sorted(map(key, plain)) and out[0].asDict().keys() == dict.fromkeys(clash.columns).keys()
    assert all(r["node"] == r["row"] == 1 for r in out)
    ids = [r["doc_id"] for r in out]
    assert ids.count(900) == 1 and ids.count(3) == {"n-gram Jaccard join": 1}.get(name, 3)
    assert name == "quality classifier" or ids.count(None) == 2


def test_forward_pass_against_plain_sums():
    rng = np.random.default_rng(8)
    net = quality_cnn.train([bytes(rng.integers(97, 120, 700, dtype=np.uint8)) for _ in range(8)], np.array([0, 1] * 4, np.float32), epochs=1)
    for step in (quality_cnn.STEP, quality_cnn.FINE):
        net.step = step
        for n in (0, 5, 511, 513, 1400):
            text = bytes(rng.integers(97, 120, n, dtype=np.uint8))
            places = quality_cnn._padded(n, step)
            data = text + bytes(places * step + quality_cnn.KERNEL - n)
            y = np.stack([net.embed[np.frombuffer(data[p * step : p * step + quality_cnn.KERNEL], np.uint8)].ravel() @ net.filters for p in range(places)])
            per, hop = quality_cnn.CHUNK // step, quality_cnn.HOP // step
            chunks = [np.maximum(y[a : a + per].max(axis=0) + net.bias, 0) for a in range(0, places - per + 1, hop)]
            want = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
            assert np.allclose(quality_cnn.pooled(net, [text])[0], want, atol=1e-4)
            p = 1 / (1 + np.exp(-(want @ net.weight + net.base)))
            assert abs(quality_cnn.probability(net, [text])[0] - p) < 1e-4


def test_training_follows_the_gradient():
    """Adam's first step moves each parameter against the slope of the loss."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 120, 300, dtype=np.uint8)) for _ in range(16)]
    good = np.array([0, 1] * 8, np.float32)
    before, after = quality_cnn.train(texts, good, epochs=0), quality_cnn.train(texts, good, epochs=1)

    def loss(net):
        p = quality_cnn.probability(net, texts)
        return -np.mean(good * np.log(p) + (1 - good) * np.log(1 - p))

    for name in ("filters", "embed", "weight", "bias"):
        value, moved = getattr(before, name), getattr(after, name) - getattr(before, name)
        right = seen = 0
        for at in zip(*np.unravel_index(rng.permutation(value.size)[:80], value.shape)):
            kept = value[at]
            slope = []
            for d in (1e-2, -1e-2):
                value[at] = kept + d
                slope.append(loss(before))
            value[at] = kept
            if abs(slope[0] - slope[1]) > 1e-6 and abs(moved[at]) > 1e-9:
                seen += 1
                right += (slope[0] > slope[1]) == (moved[at] < 0)
        assert right >= 0.9 * seen and seen >= 5, (name, right, seen)
