from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import dedup, leakage


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "_seq long, text string")
    return [r[0] for r in df.orderBy("_seq").select(column).collect()]


def test_clean_collapses_and_rejects(spark):
    texts = ["  hello   world  ", "short", "", None, " \t ", "a  b\x1cc long enough"]
    assert values(spark, texts, tx.clean("text", 10)) == ["hello world", None, None, None, None, "a b c long enough"]


def test_clean_lower_cases_and_removes_boilerplate_in_order(spark):
    texts = ["Some TEXT. Click here! Page 3 of 12 © 2024 END", "click  here stays as it is"]
    assert values(spark, texts, tx.clean("text", 1)) == ["some text. ! end", "click here stays as it is"]


def test_clean_counts_urls(spark):
    few, many = "http://a.b " * 5 + "x" * 50, "http://a.b " * 6 + "x" * 50
    assert [v is None for v in values(spark, [few, many], tx.clean("text"))] == [False, True]


def test_a_very_long_url_is_one(spark):
    assert values(spark, ["http://" + "a" * 200_000], tx.url_count("text")) == [1]


def test_ngrams(spark):
    grams = values(spark, ["the quick brown fox", "The  QUICK", "one", "", None, "a b a b"], tx.ngrams("text", 2))
    assert grams == [["the quick", "quick brown", "brown fox"], ["the quick"], [], [], [], ["a b", "b a"]]


def test_ngrams_of_a_long_text_take_little_time(spark):
    assert len(values(spark, [" ".join(map(str, range(30_000)))], tx.ngrams("text", 5))[0]) == 29_996


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "_seq long, text string")


def test_exact_duplicates(spark):
    df = corpus(spark, ["hello", "world", "hello", "foo", "world"])
    report = dedup.exact_report(df).first().asDict()
    assert report == {"duplicates_detected": True, "duplicate_groups": 2, "total_duplicate_instances": 2, "duplicate_rate": 0.4}
    assert [r["text"] for r in dedup.exact_filter(df).orderBy("_seq").collect()] == ["hello", "world", "foo"]
    assert sorted(r["seqs"] for r in dedup.exact_groups(df).collect()) == [[0, 2], [1, 4]]


def test_exact_duplicates_of_nothing(spark):
    assert dedup.exact_report(corpus(spark, [])).first()["duplicate_rate"] == 0.0
    assert dedup.exact_report(corpus(spark, ["a"])).first()["duplicate_groups"] == 0
    assert dedup.exact_report(corpus(spark, ["a", "b", "a", "b"])).first()["duplicate_rate"] == 0.5


def test_order_and_case(spark):
    df = corpus(spark, ["c", "b", "a", "b", "C "])
    assert [r["text"] for r in dedup.exact_filter(df).orderBy("_seq").collect()] == ["c", "b", "a", "C "]
    assert [r["text"] for r in dedup.casefold_filter(df).orderBy("_seq").collect()] == ["c", "b", "a"]


def test_record_distinct_with_nested_values(spark):
    df = spark.createDataFrame([(0, [1, 2], {"a": 1}), (1, [1, 2], {"a": 1}), (2, [1], {"a": 1})], "_seq long, x array<int>, m map<string,int>")
    assert [r["_seq"] for r in dedup.record_distinct(df).orderBy("_seq").collect()] == [0, 2]


def vectors(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "_seq long, embedding array<float>")


def test_semantic_chain_is_greedy_not_transitive(spark):
    from math import cos, sin

    df = vectors(spark, [[cos(a), sin(a)] for a in (0.0, 0.5, 1.0)])
    gone = dedup.semantic_removals(df, 0.85, use_lsh=False).collect()
    assert [(r["dup_seq"], r["rep_seq"]) for r in gone] == [(1, 0)]


def test_zero_vectors_are_like_nothing(spark):
    df = vectors(spark, [[1.0, 1.0], [1.0, 1.0], [0.0, 0.0], [0.0, 0.0]])
    assert [r["_seq"] for r in dedup.semantic_filter(df, 0.99, False).orderBy("_seq").collect()] == [0, 2, 3]


def test_contamination_is_above_the_threshold(spark):
    train = corpus(spark, ["a b c d e f"])
    held = corpus(spark, ["a b c x y", "z", "a b q", "a b c d e f"])
    rows = {r["index"]: (r["n_grams"], r["n_shared"], r["contaminated"]) for r in leakage.contamination(train, held, 2, 0.5).collect()}
    assert rows == {0: (4, 2, False), 2: (2, 1, False), 3: (5, 5, True)}
    report = leakage.contamination_report(train, held, 2, 0.5)
    assert (report["contamination_count"], report["contamination_rate"], report["contaminated_texts"][0]["index"]) == (1, 0.25, 3)


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefgh") * 2 for _ in range(30)]
        for _ in range(3):
            own = list(base)
            own[rng.randrange(30)] = "zz"
            texts.append(" ".join(own))
    texts += ["", "one two"]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    for threshold in (0.5, 0.8, 1.0):
        want = {
            (i, j)
            for i, a in enumerate(map(grams, texts))
            for j, b in enumerate(map(grams, texts))
            if i < j and a and b and len(a & b) / len(a | b) >= threshold
        }
        got = leakage.near_duplicates(corpus(spark, texts), 2, threshold).collect()
        assert {(r["i"], r["j"]) for r in got} == want


def test_memorization(spark):
    df = corpus(spark, ["hello world test"] * 15 + ["other"])
    report = leakage.memorization_report(df, 2, 10)
    assert report == {"patterns_detected": True, "high_frequency_patterns": 2, "top_patterns": {"hello world": 15, "world test": 15}}


def test_lsh_bucket(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],)], "embedding array<float>")
    assert df.select(dedup.lsh_bucket(F.col("embedding"), 4)).first()[0] == 0b1001
