"""The public names, each over lists and DataFrames."""

import lexforge

LONG = "This document is surely longer than fifty characters, number "


class Lengths:
    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_names():
    from lexforge import api

    assert all(hasattr(lexforge, n) for n in api.__all__) and set(api.__all__) <= set(dir(lexforge))


def test_engines_over_lists(spark):
    cleaner = lexforge.TextCleaner(min_length=5)
    assert cleaner.clean("  Hello   World ") == "hello world" and cleaner.clean("x") is None and lexforge.clean_text_document("short") is None
    assert cleaner.clean_batch([" Hello there ", "x", "Click here my friend"]) == ["hello there", "my friend"]
    assert cleaner.remove_duplicates(["A", "b", " a "]) == ["A", "b"]
    exact = lexforge.ExactDeduplicator()
    report = exact.find_duplicates(["a", "b", "a"])
    assert report["duplicate_groups"] == 1 and list(report["groups"].values()) == [[0, 2]] and exact.filter_duplicates(["a", "b", "a"]) == ["a", "b"]
    leaks = lexforge.DataLeakageDetector(2, 0.5)
    assert leaks.extract_ngrams("a b C") == {"a b", "b c"}
    assert leaks.detect_train_eval_contamination(["a b c d"], ["a b c", "x y z"])["contamination_count"] == 1
    assert leaks.detect_exact_duplicates(["a", "a"])["duplicate_rate"] == 0.5
    assert leaks.detect_near_duplicates(["a b c", "a b c"])["near_duplicate_pairs"] == 1
    assert leaks.detect_memorization_patterns(["a b"] * 3, 3)["top_patterns"] == {"a b": 3}


def test_semantic_engine(spark):
    engine = lexforge.SemanticDeduplicationEngine(0.9999, Lengths())
    assert engine.compute_embedding("abc").tolist() == [3.0, 1.0] and engine.compute_similarity([0, 0], [1, 1]) == 0.0
    texts = ["a", "b", "c" * 40, "d"]
    assert engine.find_duplicates(texts) == {0: [1, 3]} and engine.filter_duplicates(texts) == ["a", "c" * 40]
    frame = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [1.0, 0.0]), (2, "z", [0.0, 1.0])], "_seq long, text string, embedding array<float>")
    assert sorted(r["text"] for r in lexforge.SemanticDeduplicationEngine(0.9).filter_duplicates(frame).collect()) == ["x", "z"]


def test_files_and_pipelines(spark, tmp_path):
    rows = [{"text": LONG + "one", "n": 1}, {"text": LONG + "one", "n": None}, {"text": LONG + "two", "n": 3}]
    path = lexforge.write_jsonl_records(tmp_path / "rows", rows)
    assert lexforge.load_jsonl_records(path) == rows
    assert [len(c) for c in lexforge.iter_jsonl_chunks(path, chunk_size=2)] == [2, 1]
    chain = lexforge.DatasetPipeline([lexforge.TextCleaningStage(), lexforge.ExactDedupStage()])
    result = chain.run_streaming(path, chunk_size=2)
    assert result.success and result.data.df.count() == 2 and chain.get_stage_names() == ["text_cleaning", "exact_dedup"]
    graph = lexforge.PipelineOrchestrator([lexforge.DataLoadingStage(), lexforge.DataCleaningStage()])
    graph.build_dag()
    assert graph.execute([{"text": "a"}, {"text": "a"}]).data.df.count() == 1
    store = lexforge.DatasetVersioningSystem(tmp_path / "meta")
    record = store.create_dataset_version(path, "d")
    assert record["sample_count"] == 3 and store.verify_dataset_integrity(path, record["checksum"]) and len(store.get_dataset_lineage("d")) == 1
    assert lexforge.build_manifest(path)["row_count"] == 3
    assert lexforge.check_data_quality(rows).overall_score > 0
