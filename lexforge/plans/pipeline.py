"""Stages, pipelines of them, and presets.

A stage turns a Dataset into another one lazily; only gates (validation, leakage,
quality) run a job, for one aggregate. A failing stage gives a result with the
reason rather than raising, and keeps the metadata so far.
"""

from __future__ import annotations

import functools
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import ngrams
from lexforge.model import MAX_LABEL, MIN_LABEL, Dataset, QualityConfig, StageResult, Validation
from lexforge.operators import dedup, leakage, quality, transform, validate
from lexforge.sources import jsonl, manifest
from lexforge.sources.jsonl import to_dataset
from lexforge.sources.staging import shared_dir, staged


class StageError(Exception):
    """Why a stage fails."""


class Stage(ABC):
    name = "stage"
    dependencies: list[str] = []
    #: Whether a table without rows makes the stage fail.
    needs_rows = False

    def __init__(self, config: dict[str, Any] | None = None, name: str | None = None):
        self.config = dict(config or {})
        self.name = name or type(self).name

    @abstractmethod
    def transform(self, data: Dataset) -> Dataset:
        """The stage's work; StageError if it fails."""

    def rules(self, data: Dataset) -> tuple[Column, Column] | None:
        """(errors, warnings) of each row, as columns; None if the stage has none."""
        return None

    def notes(self) -> list[str]:
        """Warnings that aren't on a row."""
        return []

    def check(self, data: Dataset) -> Validation:
        rules = self.rules(data)
        out = validate.collect_messages(data.df, *rules, data.seq) if rules else Validation.of([])
        out.warnings[:0] = self.notes()
        return out

    def messages(self, data) -> DataFrame:
        """index, severity, message: what ``validate`` says of the rows, as a table of
        any size; nothing of it passes the driver."""
        given = to_dataset(data)
        none = F.array().cast("array<string>")
        return validate.messages(given.df, *(self.rules(given) or (none, none)), given.seq)

    def tally(self, data) -> tuple[bool, int, int]:
        """(is_valid, errors, warnings): what ``validate`` would list, counted where the
        rows are; a stage without rules for rows is asked as it is."""
        given = to_dataset(data) if data is not None else None
        try:
            rules = self.rules(given) if given is not None else None
        except ValueError:
            rules = None
        if rules is None:
            found = self.validate(data)
            return found.is_valid, len(found.errors), len(found.warnings)
        rows, errors, warnings = validate.count_messages(given.df, *rules)
        errors = errors if rows else 1
        return errors == 0, errors, warnings + len(self.notes())

    def process(self, data) -> StageResult:
        begun = time.perf_counter()
        noted: dict[str, Any] = {}
        try:
            if data is None:
                raise StageError(f"stage '{self.name}' got no data")
            given = to_dataset(data)
            noted = dict(given.metadata)
            if self.needs_rows and given.df.isEmpty():
                raise StageError(f"stage '{self.name}' got no rows")
            out = self.transform(given)
            out.metadata = noted | out.metadata
            return StageResult(True, out, None, time.perf_counter() - begun, None, self.name, out.metadata)
        except (StageError, ValueError, OSError) as e:
            return StageResult(False, None, None, time.perf_counter() - begun, f"{self.name}: {e}", self.name, noted)

    def validate(self, data) -> Validation:
        if data is None:
            return Validation.of(["there is no data to validate"])
        try:
            return self.check(to_dataset(data))
        except ValueError as e:
            return Validation.of([str(e)])

    def get_dependencies(self) -> list[str]:
        return list(self.dependencies)

    def get_name(self) -> str:
        return self.name

    def _of(self, data: Dataset, df: DataFrame, **metadata) -> Dataset:
        return Dataset(df, data.metadata | metadata, dict(data.quality_metrics), data.schema_version, data.seq)


class Loading(Stage):
    """Reads ``source`` in ``format``; data that is given passes through."""

    name = "data_loading"

    def transform(self, data: Dataset) -> Dataset:
        return self._of(data, data.df, source=self.config.get("source"), format=self.config.get("format", "jsonl"))

    def process(self, data) -> StageResult:
        if data is not None or not self.config.get("source"):
            return super().process(data)
        begun = time.perf_counter()
        try:
            spark = SparkSession.getActiveSession()
            out = to_dataset(jsonl.load(spark, self.config["source"], self.config.get("format", "jsonl")))
            out.metadata |= {"source": self.config["source"], "format": self.config.get("format", "jsonl")}
            return StageResult(True, out, None, time.perf_counter() - begun, None, self.name, out.metadata)
        except (ValueError, OSError) as e:
            return StageResult(False, None, None, time.perf_counter() - begun, f"{self.name}: {e}", self.name)

    def validate(self, data=None) -> Validation:
        fmt = self.config.get("format", "jsonl")
        errors = [] if fmt in jsonl.FORMATS else [f"unsupported format {fmt!r}; one of {', '.join(jsonl.FORMATS)}"]
        return Validation.of(errors, [] if self.config.get("source") else ["no source is configured"])


class Cleaning(Stage):
    """Collapses whitespace, drops empty values, then whole-record duplicates."""

    name = "data_cleaning"
    dependencies = ["data_loading"]
    needs_rows = True

    def transform(self, data: Dataset) -> Dataset:
        df = transform.clean_records(data.df)
        return self._of(data, dedup.record_distinct(df, data.seq))

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return F.array().cast("array<string>"), validate.cleaning_warnings(data.df)


class Requirement(Stage):
    """Fails at the first record (in order) that lacks a field or has no text; with
    ``quarantine`` such records go aside instead."""

    name = "data_validation"
    dependencies = ["data_cleaning"]
    needs_rows = True

    @property
    def required(self) -> list[str]:
        return self.config.get("required_fields", ["text", "label"])

    def transform(self, data: Dataset) -> Dataset:
        error = validate.record_error(data.df, self.required)
        if self.config.get("quarantine"):
            good, bad = validate.quarantine(data.df, error)
            return self._of(data, good, quarantined=bad)
        if (first := validate.first_error(data.df, error, data.seq)) is not None:
            raise StageError(first)
        return self._of(data, data.df)

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return validate.record_messages(data.df, self.required)


class Routing(Stage):
    """Adds ``label_id``; fails at the first label without one."""

    name = "data_routing"
    dependencies = ["data_validation"]
    needs_rows = True

    @functools.cached_property
    def mapping(self) -> dict[str, int]:
        """From a dict, or a table of label and label_id: one of names for 31 ids is small."""
        given = self.config.get("label_mapping", {})
        pairs = given.select("label", "label_id").collect() if isinstance(given, DataFrame) else given.items()
        return {str(k).strip().lower(): v for k, v in pairs}

    def transform(self, data: Dataset) -> Dataset:
        if (first := validate.first_error(data.df, validate.routing_error(data.df, self.mapping), data.seq)) is not None:
            raise StageError(first)
        return self._of(data, data.df.withColumn("label_id", validate.label_id(data.df, self.mapping)))

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return validate.routing_messages(data.df, self.mapping)

    def notes(self) -> list[str]:
        return [] if self.mapping else ["the label mapping is empty; labels that are strings have no id"]


class LabelRange(Stage):
    name = "label_validation"
    dependencies = ["data_routing"]
    needs_rows = True

    def _error(self, data: Dataset):
        return validate.label_range_error(data.df, self.config.get("min_label_id", MIN_LABEL), self.config.get("max_label_id", MAX_LABEL))

    def transform(self, data: Dataset) -> Dataset:
        if (first := validate.first_error(data.df, self._error(data), data.seq)) is not None:
            raise StageError(first)
        return self._of(data, data.df)

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return F.array_compact(F.array(self._error(data))), F.array().cast("array<string>")


class Normalizing(Stage):
    name = "data_transformation"
    dependencies = ["label_validation"]
    needs_rows = True

    def transform(self, data: Dataset) -> Dataset:
        return self._of(data, transform.normalize(data.df, "text", self.config.get("normalize_lowercase", True), self.config.get("normalize_trim", True)))

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return F.array().cast("array<string>"), validate.transform_warnings(data.df)


class TextCleaning(Stage):
    name = "text_cleaning"

    @property
    def field(self) -> str:
        return self.config.get("text_field", "text")

    def transform(self, data: Dataset) -> Dataset:
        return self._of(data, transform.clean_text(data.df, self.field, self.config.get("min_length", 50), self.config.get("max_urls", 5), self.config.get("remove_boilerplate", True)))

    def rules(self, data: Dataset) -> tuple[Column, Column]:
        return validate.record_messages(data.df, [self.field], self.field)


class ExactDedup(Stage):
    """Writes its rows, once, so that no later stage or gate computes them anew, and
    which of them go; it notes how many went: they are counted as they pass."""

    name = "exact_dedup"

    def _key(self, field: str) -> Column | list[Column]:
        return dedup.exact_key(field)

    def transform(self, data: Dataset) -> Dataset:
        field = self.config.get("text_field", "text")
        if field not in data.df.columns:
            return self._of(data, data.df.limit(0), exact_dedup_removed=data.df.count())
        seen = Observation()
        df = data.df.observe(seen, F.count(F.lit(1)).alias("n"))
        if "_keys" in df.columns:
            df = df.where(F.array_contains("_keys", field))
        out, n = dedup.first_rows(df, self._key(field), data.seq)
        return self._of(data, out, exact_dedup_removed=seen.get["n"] - n)


class SemanticDedup(Stage):
    """Uses the column ``embedding_field`` if there is one, else ``embedder``: a
    function from texts to vectors, an object with ``encode``, or a model's name,
    which each Python worker loads once. Without either it fails."""

    name = "semantic_dedup"

    def transform(self, data: Dataset) -> Dataset:
        text, vector = self.config.get("text_field", "text"), self.config.get("embedding_field", "embedding")
        df = data.df
        own = vector not in df.columns
        if own:
            encode = self.config.get("embedder") or self.config.get("embedding_model")
            if encode is None:
                raise StageError(f"no column '{vector}' and no embedder")
            df = dedup.embed(df, encode, text, vector)
        given = staged(df)  # the vectors are read several times
        kept = dedup.semantic_filter(given, self.config.get("similarity_threshold", 0.95), self.config.get("use_lsh", True), self.config.get("lsh_bands", 20), vector, data.seq)
        if text in kept.columns:
            kept = dedup.keep_first(kept, F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))), data.seq)
        out = staged(kept.drop(vector) if own else kept)
        return self._of(data, out, semantic_dedup_removed=given.count() - out.count())


class LeakageCheck(Stage):
    """Fails if an evaluation text is contaminated; with mode "filter" the training
    rows that share an n-gram with such a text are dropped instead."""

    name = "leakage_check"

    def transform(self, data: Dataset) -> Dataset:
        texts = self.config.get("eval_texts") or []
        field = self.config.get("text_field", "text")
        spark = data.df.sparkSession
        held = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(enumerate(texts)), f"_seq long, {field} string")
        threshold = self.config.get("overlap_threshold", 0.8)
        if self.config.get("mode") == "filter":
            bad = leakage.contamination(data.df, held, 5, threshold, field).where("contaminated").select(F.col("index").alias("_seq"))
            theirs = held.join(bad, "_seq", "left_semi").select(F.explode(ngrams(field, 5)).alias("g")).distinct()
            hit = data.df.select(F.col(data.seq).alias("__hit"), F.explode(ngrams(field, 5)).alias("g")).join(theirs, "g", "left_semi").select("__hit").distinct()
            return self._of(data, data.df.join(hit, F.col(data.seq) == F.col("__hit"), "left_anti"))
        report = leakage.contamination_report(data.df, held, 5, threshold, field)
        if report["contamination_detected"]:
            raise StageError(f"leakage: {report}")
        return self._of(data, data.df, leakage_report=report)


class QualityCheck(Stage):
    """Notes the quality report; never fails for a low score."""

    name = "quality_check"

    def transform(self, data: Dataset) -> Dataset:
        known = {k: v for k, v in self.config.items() if k in QualityConfig.__dataclass_fields__}
        schema = self.config.get("schema") or data.metadata.get("schema")
        report = quality.check(data.df, self.config.get("dataset_id", "dataset"), schema, QualityConfig(**known), self.config.get("as_of"))
        out = self._of(data, data.df, quality_report=report.to_dict())
        out.quality_metrics |= report.dimension_scores | {"overall": report.overall_score}
        return out


class QualityGate(Stage):
    name = "quality_scoring"

    def transform(self, data: Dataset) -> Dataset:
        report = quality.check(data.df, self.config.get("dataset_id", "dataset"), as_of=self.config.get("as_of"))
        threshold = self.config.get("quality_threshold", 0.8)
        if report.overall_score < threshold:
            raise StageError(f"quality {report.overall_score:.2f} is below {threshold}")
        out = self._of(data, data.df, quality_report=report.to_dict())
        out.quality_metrics |= report.dimension_scores
        return out


class _Writing(Stage):
    """Rows that were written already, by the stage before, aren't written again. Without
    ``output_path`` they go to a folder that is deleted when the session ends; so does
    the record of a version without ``metadata_dir``."""

    def _written(self, data: Dataset, **metadata) -> tuple[str, Dataset]:
        path = self.config.get("output_path")
        if not path and data.written is not None and data.written[0] is data.df:
            path = data.written[1]
        else:
            path = jsonl.write_jsonl(data.df, str(path or shared_dir(data.df.sparkSession)))
        out = self._of(data, data.df)
        out.written = (data.df, path)
        return path, out


class ManifestStage(_Writing):
    name = "manifest"

    def transform(self, data: Dataset) -> Dataset:
        spark = data.df.sparkSession
        path, out = self._written(data)
        extra = {"quality_report": data.metadata["quality_report"]} if "quality_report" in data.metadata else {}
        made = manifest.build_manifest(
            spark, path, self.config.get("dataset_id"), self.config.get("version"), self.config.get("produced_by", "lexforge"),
            extra | self.config.get("metadata", {}), self.config.get("license_info"), self.config.get("provenance"),
        )
        out.metadata["manifest"] = made
        return out


class VersionStage(_Writing):
    name = "versioning"

    def transform(self, data: Dataset) -> Dataset:
        spark = data.df.sparkSession
        store = manifest.FileVersions(spark, self.config.get("metadata_dir") or shared_dir(spark))
        path, out = self._written(data)
        out.metadata["version"] = store.create(
            path, self.config.get("dataset_name") or "dataset", self.config.get("parent_versions"), self.config.get("encode"), self.config.get("metadata")
        )
        return out


class Pipeline:
    """Stages one after another, up to the first failure."""

    def __init__(self, stages: list[Stage]):
        self.stages = list(stages)

    def run(self, data) -> StageResult:
        begun = time.perf_counter()
        if not self.stages:
            return StageResult(True)
        result = StageResult(True)
        for stage in self.stages:
            result = stage.process(data)
            if not result.success:
                break
            data = result.data
        result.seconds = time.perf_counter() - begun
        return result

    def validate_all(self, data) -> list[Validation]:
        return [s.validate(data) for s in self.stages]

    def tally_all(self, data) -> list[tuple[bool, int, int]]:
        """(is_valid, errors, warnings) of each stage: ``validate_all`` in numbers."""
        return [s.tally(data) for s in self.stages]

    def stage_names(self) -> list[str]:
        return [s.name for s in self.stages]

    def run_file(self, spark: SparkSession, path: str, chunk_size: int | None = None, output_path: str | None = None) -> StageResult:
        """Runs over a JSONL file or folder as one plan. With ``chunk_size`` exact
        deduplication is within chunks of so many rows only."""
        df = jsonl.read_jsonl(spark, path)
        if chunk_size:
            df = jsonl.chunked(df, chunk_size)
            pipeline = Pipeline([_ChunkDedup(s.config) if isinstance(s, ExactDedup) else s for s in self.stages])
        else:
            pipeline = self
        result = pipeline.run(Dataset(df))
        if result.success and result.data is not None:
            result.data.df = result.data.df.drop("chunk_id")
            if output_path:
                jsonl.write_jsonl(result.data.df.orderBy("_seq"), output_path)
        return result


class _ChunkDedup(ExactDedup):
    def _key(self, field: str) -> Column | list[Column]:
        return [F.col("chunk_id"), dedup.exact_key(field)]


class Graph:
    """Stages in the order of their dependencies, whatever order they were added in."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}
        self.order: list[str] | None = None
        self.results: dict[str, StageResult] = {}

    def add_stage(self, stage: Stage) -> None:
        if stage.name in self.stages:
            raise ValueError(f"there is a stage '{stage.name}' already")
        self.stages[stage.name] = stage
        self.order = None

    def build(self) -> list[str]:
        for name, stage in self.stages.items():
            for needed in stage.get_dependencies():
                if needed not in self.stages:
                    raise ValueError(f"'{name}' needs '{needed}', which wasn't added")
        try:
            self.order = list(TopologicalSorter({n: s.get_dependencies() for n, s in self.stages.items()}).static_order())
        except CycleError as e:
            raise ValueError(f"the stages depend on each other in a circle: {e.args[1]}") from None
        return self.order

    def execute(self, data) -> StageResult:
        if self.order is None:
            raise ValueError("build() comes first")
        result = StageResult(True)
        for name in self.order:
            result = self.results[name] = self.stages[name].process(data)
            if not result.success:
                break
            data = result.data
        return result


def training(required_fields: list[str] | None = None, text_field: str = "text", dataset_id: str = "training") -> Pipeline:
    return Pipeline([
        TextCleaning({"text_field": text_field}), ExactDedup({"text_field": text_field}),
        Requirement({"required_fields": required_fields or [text_field]}), ManifestStage({"dataset_id": dataset_id}),
    ])


def feedback(text_field: str = "text", dataset_id: str = "feedback") -> Pipeline:
    return Pipeline([TextCleaning({"text_field": text_field, "min_length": 1}), ExactDedup({"text_field": text_field}), ManifestStage({"dataset_id": dataset_id})])


def production(
    required_fields: list[str] | None = None, text_field: str = "text", eval_texts=None, dataset_id: str = "production", dataset_name: str | None = None,
    quality_threshold: float = 0.8, semantic_dedup: bool = True, embedder: Callable | str | None = None, metadata_dir: str | None = None,
    similarity_threshold: float = 0.95, use_lsh: bool = True,
) -> Pipeline:
    stages: list[Stage] = [TextCleaning({"text_field": text_field}), ExactDedup({"text_field": text_field})]
    if semantic_dedup:
        stages.append(SemanticDedup({"text_field": text_field, "embedder": embedder, "similarity_threshold": similarity_threshold, "use_lsh": use_lsh}))
    if eval_texts is not None:
        stages.append(LeakageCheck({"eval_texts": eval_texts, "text_field": text_field}))
    stages += [
        Requirement({"required_fields": required_fields or [text_field]}), QualityGate({"quality_threshold": quality_threshold, "dataset_id": dataset_id}),
        ManifestStage({"dataset_id": dataset_id}), VersionStage({"dataset_name": dataset_name or dataset_id, "metadata_dir": metadata_dir}),
    ]
    return Pipeline(stages)
