from lexforge.streaming import jsonl_stream as js

LONG = "This document is surely longer than fifty characters, number "


def test_stream_cleans_and_deduplicates_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (source / f"{name}.jsonl").write_text(f'{{"text": "{LONG}{text}"}}\n[1]\n{{"text": "short"}}\n')
    stream = js.distinct_texts(js.cleaned(js.read_stream(spark, str(source), files_per_trigger=1)))
    js.run_to_end(stream, str(tmp_path / "checkpoint"), lambda df, _: df.select("text").write.mode("append").parquet(str(out)))
    assert sorted(r["text"][-3:] for r in spark.read.parquet(str(out)).collect()) == ["one", "two"]
