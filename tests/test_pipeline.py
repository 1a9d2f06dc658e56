import json
from datetime import datetime, timezone
from pathlib import Path

import pytest

from lexforge.model import Dataset
from lexforge.operators import quality
from lexforge.plans import pipeline as pl
from lexforge.sources import jsonl, manifest, registry

LONG = "This document is surely longer than fifty characters, number "


def rows(spark, *texts, **columns):
    return [{"text": t} | {k: v[i] for k, v in columns.items()} for i, t in enumerate(texts)]


def texts(result):
    return [r["text"] for r in result.data.df.orderBy("_seq").collect()]


def test_training_preset(spark):
    result = pl.training().run(rows(spark, LONG + "one", LONG + "one", LONG + "two"))
    assert result.success, result.error
    assert texts(result) == [(LONG + "one").lower(), (LONG + "two").lower()]
    assert result.metadata["manifest"]["row_count"] == 2


def test_feedback_preset(spark):
    assert texts(pl.feedback().run(rows(spark, "correction one", "correction one", "two"))) == ["correction one", "two"]


def test_production_preset(spark):
    encode = lambda batch: [[float(len(t)), 1.0] for t in batch]
    result = pl.production(embedder=encode, eval_texts=["nothing of this is in there at all"], quality_threshold=0.1).run(rows(spark, LONG + "one", LONG + "three"))
    assert result.success, result.error
    assert {"manifest", "version", "leakage_report", "quality_report"} <= set(result.metadata)
    leak = pl.production(eval_texts=[LONG + "one"], semantic_dedup=False).run(rows(spark, LONG + "one", LONG + "three"))
    assert not leak.success and "leakage" in leak.error


def test_semantic_dedup_needs_vectors(spark):
    assert not pl.SemanticDedup().process(rows(spark, "a", "b")).success


def test_cleaning_and_validation(spark):
    chain = pl.Pipeline([pl.Cleaning(), pl.Requirement()])
    good = chain.run(rows(spark, "hello   world", "b", label=[1, 2]))
    assert texts(good) == ["hello world", "b"]
    bad = chain.run(rows(spark, "hello"))
    assert not bad.success and "label" in bad.error and bad.stage_name == "data_validation"
    assert chain.stage_names() == ["data_cleaning", "data_validation"] and len(chain.validate_all(rows(spark, "x"))) == 2
    assert not pl.Cleaning().validate(None).is_valid
    assert texts(pl.Cleaning().process(rows(spark, "hello", "hello"))) == ["hello"]


def test_empty_input_fails_where_rows_are_needed(spark):
    for stage in (pl.Cleaning(), pl.Requirement(), pl.Routing(), pl.LabelRange(), pl.Normalizing()):
        assert not stage.process([]).success
        assert not stage.process(None).success


def test_quarantine(spark):
    result = pl.Requirement({"required_fields": ["text"], "quarantine": True}).process([{"text": "a"}, {"text": " "}, {"text": None}])
    assert texts(result) == ["a"] and result.metadata["quarantined"].count() == 2


def test_routing_and_ranges(spark):
    stage = pl.Routing({"label_mapping": {"foo": 3}})
    assert [r["label_id"] for r in stage.process(rows(spark, "a", label=["  Foo "])).data.df.collect()] == [3]
    assert not stage.process(rows(spark, "a", label=["bar"])).success
    for label, good in ((30, True), (31, False), (-1, False), (2.9, True)):
        assert stage.process(rows(spark, "a", label=[label])).success is good
        assert pl.LabelRange().process(rows(spark, "a", label_id=[label])).success is good


def test_normalizing(spark):
    assert texts(pl.Normalizing().process(rows(spark, "Hello World", "  hello  "))) == ["hello world", "hello"]


def test_graph(spark):
    graph = pl.Graph()
    for stage in (pl.Cleaning(), pl.Loading()):
        graph.add_stage(stage)
    assert graph.build() == ["data_loading", "data_cleaning"]
    assert graph.execute(rows(spark, "a", "a")).success and set(graph.results) == {"data_loading", "data_cleaning"}
    with pytest.raises(ValueError):
        graph.add_stage(pl.Cleaning())
    lonely = pl.Graph()
    lonely.add_stage(pl.Cleaning())
    with pytest.raises(ValueError):
        lonely.build()


def test_jsonl(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"text": "é", "n": null}\n\n[1]\n{"text": null}\n')
    (tmp_path / "in" / "b.jsonl").write_text('{"text": "z", "n": 2}\n')
    df = jsonl.read_jsonl(spark, str(tmp_path / "in"), keep_keys=True).orderBy("_seq")
    assert {(r["text"], r["n"], tuple(r["_keys"])) for r in df.collect()} == {("z", 2, ("text", "n")), ("é", None, ("text", "n")), (None, None, ("text",))}
    (folder / "c.jsonl").write_text("{broken\n")
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(tmp_path / "in"))
    with pytest.raises(FileNotFoundError):
        jsonl.read_jsonl(spark, str(tmp_path / "absent"))
    out = jsonl.write_jsonl(spark.createDataFrame([(0, "a", None)], "_seq long, text string, n int"), str(tmp_path / "out"))
    (line,) = [x for part in Path(out).glob("*.jsonl") for x in part.read_text().splitlines()]
    assert json.loads(line) == {"text": "a", "n": None}


def test_chunks_deduplicate_apart(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": LONG + t}) + "\n" for t in "aaba"))
    run = lambda **k: texts(pl.training().run_file(spark, str(tmp_path / "d.jsonl"), **k))
    assert [t[-1] for t in run()] == ["a", "b"]
    assert [t[-1] for t in run(chunk_size=2)] == ["a", "b", "a"]


def test_manifest(spark, tmp_path):
    (tmp_path / "data.jsonl").write_text('{"text": "a", "label": 1}\n{"text": "bcd", "label": 2.5}\n')
    m = manifest.build_manifest(spark, str(tmp_path), now=datetime(2026, 1, 2, tzinfo=timezone.utc))
    assert (m["row_count"], len(m["content_hash"]), m["schema"]["format"], m["version"]) == (2, 64, "jsonl", "2026.01.02")
    assert m["schema"]["fields"] == {"text": ["str"], "label": ["float", "int"]}
    assert m["metadata"]["column_stats"]["text_length"] == {"min": 1, "max": 3, "mean": 2}
    with pytest.raises(FileNotFoundError):
        manifest.build_manifest(spark, str(tmp_path / "absent"))


def test_file_versions(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "x.jsonl").write_text('{"text": "a b"}\n{"text": "c"}\nbroken\n')
    store = manifest.FileVersions(spark, str(tmp_path / "meta"))
    record = store.create(str(data), "d", encode=str.split)
    assert (record["sample_count"], record["token_count"]) == (2, 3)
    assert len(store.lineage("d")) == 1 and store.lineage("other") == []
    assert store.verify(str(data), record["checksum"])
    (data / "x.jsonl").write_text("changed")
    assert not store.verify(str(data), record["checksum"])


def test_registry(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "x.jsonl").write_text("{}\n" * 10)
    reg = registry.VersionRegistry(spark, str(tmp_path / "reg"))
    kind = list(registry.DatasetType)[0]
    assert reg.create("ds", kind, str(data))["version"] == "1.0.0"
    for lines, change in ((11, "PATCH"), (13, "MINOR"), (20, "MAJOR")):
        (data / "x.jsonl").write_text("{}\n" * lines)
        last = reg.latest("ds")["version"]
        assert reg.create("ds", kind, str(data), parent_version="1.0.0")["change_type"] == change
        assert reg.latest("ds")["version"] != last
    assert reg.compare("ds", "1.0.0", "1.0.3")["sample_difference"] == 10
    assert reg.get("ds", "9.9.9") is None and reg.latest("none") is None and reg.validate("ds", "1.0.0")
    for backend in ("tape", "s3"):
        with pytest.raises(ValueError):
            reg.create("ds", kind, str(data), storage_backend=backend)


def test_registry_of_folders_and_uris(spark, tmp_path):
    data = tmp_path / "data"
    (data / "deep").mkdir(parents=True)
    (data / "deep" / "x.jsonl").write_text("{}\n\n{}\n")
    (data / "list.json").write_text('[1, {"a": 2}, 3]')
    (data / "one.json").write_text('{"a": [1, 2]}')
    reg = registry.VersionRegistry(spark, f"file://{tmp_path}/reg")
    row = reg.create("ds", registry.DatasetType.LEASE_ABSTRACTION, str(data), storage_backend="hadoop", tags=["t"], metadata={"a": 1})
    assert (row["total_samples"], row["file_count"]) == (3 + 3 + 1, 3) and reg.validate("ds", "1.0.0")
    assert (tmp_path / "reg/datasets/ds/1.0.0/deep/x.jsonl").read_text() == "{}\n\n{}\n"
    assert [r["tags"] for r in reg.list("ds")] == [["t"]] and len(row["metadata_checksum"]) == 64
    (tmp_path / "reg/datasets/ds/1.0.0/list.json").write_text("[]")
    assert not reg.validate("ds", "1.0.0")


def test_quality(spark):
    now = datetime(2026, 6, 1, tzinfo=timezone.utc)
    data = [{"text": "hello", "label": 1, "id": str(i), "created_at": f"2026-0{i}-01"} for i in range(1, 6)]
    report = quality.check(data, as_of=now)
    assert {"completeness", "timeliness", "accuracy", "integrity", "consistency", "uniqueness"} <= set(report.dimension_scores)
    assert report.dimension_scores["timeliness"] == 1.0 and 0 <= report.overall_score <= 1
    dated = [{k if k != "created_at" else "created_date": v for k, v in r.items()} for r in data]
    assert quality.check(dated, as_of=now).dimension_scores["timeliness"] == 0.0
    future = quality.check([{"updated": "2026-06-16"}], as_of=now).dimension_scores["timeliness"]
    assert future == 1.5
    assert quality.check([{"updated": "never"}], as_of=now).dimension_scores["timeliness"] == 0.0
    assert quality.check([]).overall_score == 0.0
    twice = quality.check([{"a": 1}, {"a": 1}, {"a": 2}])
    assert round(twice.dimension_scores["uniqueness"], 4) == 0.6667
    schema = {"required_fields": ["text", "label"], "fields": {"label": {"constraints": {"min": 0, "max": 1}}}}
    assert quality.check([{"text": "a", "label": 1}], schema=schema).dimension_scores["validity"] == 1.0
    assert quality.check([{"text": "a", "label": 7}], schema=schema).dimension_scores["validity"] == 0.95
    assert not quality.check([{"text": "a"}], schema=schema).to_validation().is_valid


def test_quartiles_are_exact_at_any_size(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    columns = {"even": rng.random(30_000), "ties": rng.integers(0, 9, 30_000).astype(float), "long": rng.pareto(1.0, 30_000), "one": np.ones(30_000)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in columns.values()))), ", ".join(f"{c} double" for c in columns))
    for held in (10**6, 1000, 40):
        got = quality.quartiles(df, {c: df[c] for c in columns}, dict.fromkeys(columns, 30_000), held)
        for c, v in columns.items():
            assert np.allclose(got[c], np.quantile(v, [0.25, 0.75]), rtol=1e-12)


def test_distinct_rows_of_any_types(spark):
    df = spark.createDataFrame([(None, "a", {"x": 1}), ("a", None, {"x": 1}), ("a", None, {"x": 1})], "p string, q string, m map<string,int>")
    assert quality.distinct_rows(df) == 2


def test_dataset_forms(spark, tmp_path):
    df = spark.createDataFrame([(0, "a")], "_seq long, text string")
    for form in (Dataset(df), df, [{"text": "a"}], {"data": [{"text": "a"}]}, {"text": "a"}):
        assert [r["text"] for r in jsonl.to_dataset(form).df.collect()] == ["a"]
    with pytest.raises(ValueError):
        jsonl.to_dataset("a path as text")
