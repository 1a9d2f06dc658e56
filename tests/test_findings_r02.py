"""One test or more for each finding of round 2."""

import pytest

from lexforge.model import Dataset
from lexforge.plans import pipeline as pl

LABELS = ["a", " ", None, "b", "A "]


def labelled(spark):
    return Dataset(spark.createDataFrame(list(enumerate(LABELS)), "_seq long, label string").withColumnRenamed("label", "text").selectExpr("_seq", "text", "text as label"))


def stages():
    return [pl.Loading(), pl.Cleaning(), pl.Requirement(), pl.Routing({"label_mapping": {"A": 1}}), pl.Routing(), pl.LabelRange(), pl.Normalizing(), pl.TextCleaning(), pl.ExactDedup()]


@pytest.mark.parametrize("rows", [True, False])
def test_f1_f2_messages_are_a_table_and_are_counted_where_they_are(spark, rows):
    given = labelled(spark)
    if not rows:
        given = Dataset(given.df.limit(0))
    for stage, (valid, errors, warnings) in zip(stages(), pl.Pipeline(stages()).tally_all(given)):
        found = stage.validate(given)
        assert (found.is_valid, len(found.errors), len(found.warnings)) == (valid, errors, warnings), stage.name
        listed = sorted((r["severity"], f"Item at index {r['index']}: {r['message']}") for r in stage.messages(given).collect())
        if rows:
            own = [("error", e) for e in found.errors] + [("warning", w) for w in found.warnings if w.startswith("Item")]
            assert listed == sorted(own), stage.name


def test_f1_diagnostics_run_no_job_on_the_driver(spark, tmp_path):
    from lexforge.plans.queries import QUERIES

    spark.range(50).selectExpr("id as event_id", "'other' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["routing_diagnostics"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" in plan or "event_id" in plan  # it reads the table, not rows that came from the driver
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan


def test_f3_copies_are_classes_and_all_pairs_follow(spark):
    from lexforge.operators import leakage

    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] * 40 + [" ".join([*words, "x"])] * 3 + [" ".join(words).upper(), "few words", None, " ".join(f"v{k}" for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "_seq long, text string")
    members, links = leakage.near_duplicate_classes(df)
    assert {r["i"]: r["rep"] for r in members.collect()} == {**dict.fromkeys([*range(40), 43], 0), 40: 40, 41: 40, 42: 40, 46: 46}
    assert [(r["i"], r["j"], round(r["similarity"], 6)) for r in links.collect()] == [(0, 40, round(56 / 57, 6))]
    # 40 copies and their links to others, not their 820 pairs
    assert leakage.near_duplicates(df, expand=False).count() == 40 + 2 + 1
    every = {(r["i"], r["j"]): r["similarity"] for r in leakage.near_duplicates(df).collect()}
    assert len(every) == 44 * 43 // 2 and leakage.near_duplicate_report(df)["near_duplicate_pairs"] == len(every)
    assert {round(v, 6) for k, v in every.items() if k[0] < 40 <= k[1] < 43} == {round(56 / 57, 6)}


def _choice(spark, n, threshold, block):
    import numpy as np

    from lexforge.operators import dedup

    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 8))
    v[rng.random(n) < 0.05] = 0
    df = spark.createDataFrame([(int(i) * 3, [float(x) for x in r]) for i, r in zip(rng.permutation(n), v)], "_seq long, embedding array<float>")
    by_pairs = dedup.greedy_removals(dedup.similar_pairs(df, threshold, block=50))
    in_order = dedup.ordered_removals(df, threshold, block=block)
    return {tuple(r) for r in by_pairs.collect()}, {tuple(r) for r in in_order.collect()}, in_order.count()


def test_f4_choice_in_order_is_that_of_all_pairs(spark):
    for n, threshold, block in ((300, 0.7, 64), (120, 0.999, 32), (0, 0.5, 8)):
        by_pairs, in_order, many = _choice(spark, n, threshold, block)
        assert by_pairs == in_order and many == len(in_order)


def test_f9_blocks_give_the_same_pairs_and_move_floats(spark):
    import numpy as np

    from lexforge.operators import dedup

    v = np.random.default_rng(1).standard_normal((200, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "_seq long, embedding array<float>")
    m = v.astype(np.float32).astype(float)
    m /= np.sqrt((m * m).sum(1))[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(m @ m.T >= 0.8)) if i < j}
    for block in (8192, 64):
        pairs = dedup.similar_pairs(df, 0.8, block=block)
        assert {(r["i"], r["j"]) for r in pairs.collect()} == want
        assert "as array<double>" not in pairs._jdf.queryExecution().analyzed().toString()


class Moved:
    """MB that tasks write for shuffles meanwhile."""

    def __init__(self, spark):
        self.sc = spark.sparkContext._jsc.sc()

    def _so_far(self) -> float:
        import time

        self.sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        return self.sc.statusStore().executorList(False).head().totalShuffleWrite() / 1e6

    def __enter__(self):
        self.before = self._so_far()
        return self

    def __exit__(self, *_):
        self.mb = self._so_far() - self.before


def _prose(n, seed=0):
    """Texts of unlike n-grams, with odd ones and passages that many have among them."""
    import random

    rng = random.Random(seed)
    often = [" ".join(f"often{k}x{i}" for i in range(9)) for k in range(4)]
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß日", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 120))]
        if i % 5 == 0:
            words[3:3] = (often[i % 4] + " ").split() * (i % 3)
        out.append(rng.choice([" ", "  ", "　", "\n\t"]).join(words))
    return [*out, None, "", "   ", "few words", "one two three four five", "ONE two  three four FIVE\n", "İ ſ ı K five six", *["x " * 40] * 12, *["ends the row"] * 3]


@pytest.mark.parametrize(("n", "least"), [(5, 10), (5, 1), (1, 3), (2, 2), (5, 13)])
def test_f5_frequent_ngrams_are_those_of_brute_force(spark, n, least):
    from lexforge.functions import text as tx
    from lexforge.operators import leakage
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in _prose(300)], "text string").repartition(3)
    brute = df.select(F.explode(tx.ngrams("text", n)).alias("g")).groupBy("g").count().where(f"count >= {least}")
    want = {(r["g"], r["count"]) for r in brute.collect()}
    found = [tuple(r) for r in leakage.frequent_ngrams(df, n, least).collect()]
    assert set(found) == want and len(found) == len(want)


def test_f5_rare_ngrams_move_as_gaps_of_hashes(spark):
    from lexforge.operators import leakage

    texts = [t for k in range(8) for t in _prose(500, k)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2).cache()
    df.count()
    with Moved(spark) as moved:
        assert leakage.frequent_ngrams(df).count() > 10
    grams = sum(max(0, len((t or "").split()) - 4) for t in texts)
    assert grams > 200_000 and moved.mb < 8e-6 * grams  # as strings each takes 20 bytes or more
    df.unpersist()


def test_f5_runs_and_buckets_lose_no_hash():
    import numpy as np
    import pyarrow as pa

    from lexforge.operators import grams

    rng = np.random.default_rng(3)
    h = np.concatenate([rng.integers(0, 1 << 34, 5000), [0, 0, 0, (1 << 34) - 1, (1 << 34) - 1, 1 << 26, (1 << 26) - 1], np.repeat(rng.integers(0, 1 << 34, 50), 7)])
    parts = [grams._packed(p, 4) for p in np.array_split(rng.permutation(h), 3)]
    table = pa.Table.from_batches(parts)
    for least in (1, 2, 4):
        got = []
        for bucket in table.column("bucket").unique():
            one = table.filter(pa.compute.equal(table.column("bucket"), bucket))
            held = grams._frequent(least)((bucket,), one).column("h")[0].as_py()
            got += (np.frombuffer(held, np.uint32).astype(np.int64) + (bucket.as_py() << 26)).tolist()
        value, many = np.unique(h, return_counts=True)
        assert sorted(got) == value[many >= least].tolist()


def test_f6_memorized_are_the_most_frequent_in_order(spark):
    from lexforge.operators import leakage

    df = spark.createDataFrame([(t,) for t in _prose(4000)], "text string").repartition(2).cache()
    grams = sum(max(0, len((r["text"] or "").split()) - 4) for r in df.collect())
    every = sorted(((-r["frequency"], r["ngram"]) for r in leakage.frequent_ngrams(df, 5, 2).collect()))
    with Moved(spark) as moved:
        assert [(-r["frequency"], r["ngram"]) for r in leakage.memorization(df, 5, 2, top=7).collect()] == every[:7]
    assert moved.mb < 8e-6 * grams
    assert leakage.memorization(df.limit(0)).collect() == [] and leakage.memorization_report(df, 5, 2)["high_frequency_patterns"] == len(every)
    df.unpersist()


def test_f8_lines_are_numbered_where_they_lie(spark, tmp_path):
    import json

    from lexforge.sources import jsonl

    want = []
    for name, many in (("b/2.jsonl", 40), ("a.jsonl", 3000), ("b/10.jsonl", 500), ("c.jsonl", 0), ("d.jsonl", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [json.dumps({"text": f"{name} {i} " + "word " * (i % 400)}) for i in range(many)]
        (tmp_path / name).write_text("\n\n  \n".join(lines) + "\n[1]\n" * (many == 40))
        want += [((*tmp_path.parts[1:], *name.split("/")), lines)]
    want = [json.loads(x)["text"] for _, lines in sorted(want) for x in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # several blocks of a file, several files in a task
    try:
        with Moved(spark) as moved:
            rows = jsonl.read_jsonl(spark, str(tmp_path))
            got = sorted((r["_seq"], r["text"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows.rdd.getNumPartitions() > 2
    assert [t for _, t in got] == want
    # the line that is no object has a number too; it stands at the end of b/2.jsonl, before d.jsonl
    assert [s for s, _ in got] == [*range(3540), 3541]
    assert moved.mb < 0.1
    assert sorted(r["text"] for r in jsonl.read_jsonl(spark, str(tmp_path), numbered=False).collect()) == sorted(want)
    (tmp_path / "e.jsonl").write_text("{broken\n")
    with pytest.raises(ValueError, match="e.jsonl is not JSON"):
        jsonl.read_jsonl(spark, str(tmp_path), numbered=False)


@pytest.mark.parametrize("limit", [1_000_000, 60, 0])
def test_f8_deduplication_moves_digests(spark, limit):
    from lexforge.operators import dedup

    texts = [None, "None", "", "null", *[f"text {i % 50} " + "".join(chr(97 + (i % 50) * k % 26) for k in range(3000)) for i in range(400)], None]
    df = spark.createDataFrame([((i * 7) % len(texts), t) for i, t in enumerate(texts)], "_seq long, text string").repartition(4).cache()
    want = {tuple(r) for r in dedup.exact_filter(df).collect()}
    with Moved(spark) as moved:
        rows, n = dedup.first_rows(df, dedup.exact_key(), limit=limit)
        found = [tuple(r) for r in rows.collect()]
    assert set(found) == want and n == len(found) == len(want) and rows.columns == df.columns
    assert limit == 0 or moved.mb < 0.1  # the texts are 1.2 MB
    # numbers that are missing or given twice: still one row of each text, a numbered one before others
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (3, "b"), (3, "b"), (None, "c"), (None, "c")], "_seq long, text string")
    rows, n = dedup.first_rows(odd, dedup.exact_key(), limit=limit)
    assert sorted(map(str, rows.collect())) == ["Row(_seq=3, text='a')", "Row(_seq=3, text='b')", "Row(_seq=None, text='c')"] and n == 3
    df.unpersist()


def test_f11_chunks_move_digests_and_keep_their_first_rows(spark, tmp_path):
    import json
    import random

    kinds = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for k in range(600)]
    rows = [kinds[i - i % 3] for i in range(600)]
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in rows))
    chain = pl.Pipeline([pl.TextCleaning(), pl.ExactDedup()])
    with Moved(spark) as moved:
        result = chain.run_file(spark, str(tmp_path / "d.jsonl"), chunk_size=25)
        found = sorted((r["_seq"], r["text"]) for r in result.data.df.collect())
    first = {}
    for i, t in enumerate(rows):
        first.setdefault((i // 25, t), i)
    assert [s for s, _ in found] == sorted(first.values()) and all(rows[s] == t for s, t in found)
    assert result.data.df.columns == ["_seq", "text"] and result.metadata["exact_dedup_removed"] == len(rows) - len(first)
    assert moved.mb < 0.2  # the texts are 1.2 MB


@pytest.mark.parametrize("n", [5, 2])
def test_f10_training_ngrams_are_looked_up_where_they_stand(spark, n):
    from lexforge.functions import text as tx
    from lexforge.operators import leakage
    from pyspark.sql import functions as F

    texts = _prose(200)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    held = [*texts[:20], *_prose(20, 9), None, "", "few words", texts[5] + " and more", "x x x x x", "one two three FOUR five six"]
    items = spark.createDataFrame(list(enumerate(held)), "_seq long, text string")
    seen = {r["g"] for r in train.select(F.explode(tx.ngrams("text", n)).alias("g")).collect()}
    own = {r["_seq"]: r["g"] for r in items.select("_seq", tx.ngrams("text", n).alias("g")).collect() if r["g"]}
    found = leakage.contamination(train, items, n)
    assert {r["index"]: (r["n_grams"], r["n_shared"]) for r in found.collect()} == {k: (len(g), len(seen & set(g))) for k, g in own.items()}
    # only the evaluation's texts, for each of the two sides of the last join, are made into strings of n words
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("concat_ws" in line for line in plan.splitlines()) <= 2 and "MapInArrow" in plan
    assert leakage.contamination(train, items.limit(0)).collect() == []
    assert {r["n_shared"] for r in leakage.contamination(train.limit(0), items, n).collect()} == {0}
