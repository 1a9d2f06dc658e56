"""The public interface: engines over texts, stages, pipelines, presets, files.

Engines take a list of texts or a DataFrame with a column ``text`` (and ``_seq``, if
its rows have an order); lists come back as lists, DataFrames as DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.model import Dataset as ProcessedData
from lexforge.model import QualityConfig, QualityReport, StageResult
from lexforge.model import Validation as ValidationResult
from lexforge.operators import dedup, leakage, quality
from lexforge.plans import pipeline as pl
from lexforge.plans.pipeline import Cleaning as DataCleaningStage
from lexforge.plans.pipeline import ExactDedup as ExactDedupStage
from lexforge.plans.pipeline import LabelRange as LabelValidationStage
from lexforge.plans.pipeline import LeakageCheck as LeakageCheckStage
from lexforge.plans.pipeline import Loading as DataLoadingStage
from lexforge.plans.pipeline import ManifestStage
from lexforge.plans.pipeline import Normalizing as DataTransformationStage
from lexforge.plans.pipeline import QualityCheck as QualityCheckStage
from lexforge.plans.pipeline import QualityGate as QualityScoringStage
from lexforge.plans.pipeline import Requirement as DataValidationStage
from lexforge.plans.pipeline import Routing as DataRoutingStage
from lexforge.plans.pipeline import SemanticDedup as SemanticDedupStage
from lexforge.plans.pipeline import Stage as PreprocessingStage
from lexforge.plans.pipeline import TextCleaning as TextCleaningStage
from lexforge.plans.pipeline import VersionStage as VersioningStage
from lexforge.plans.pipeline import feedback as feedback_preset
from lexforge.plans.pipeline import production as production_preset
from lexforge.plans.pipeline import training as training_preset
from lexforge.sources import jsonl, manifest
from lexforge.sources.jsonl import to_dataset
from lexforge.sources.registry import DatasetType, VersionRegistry

__all__ = [
    "DataCleaningStage", "DataLeakageDetector", "DataLoadingStage", "DataRoutingStage", "DataTransformationStage", "DataValidationStage", "DatasetPipeline", "DatasetType",
    "DatasetVersioningSystem", "ExactDedupStage", "ExactDeduplicator", "LabelValidationStage", "LeakageCheckStage", "ManifestStage", "PipelineOrchestrator", "PreprocessingStage",
    "ProcessedData", "QualityCheckStage", "QualityChecker", "QualityConfig", "QualityReport", "QualityScoringStage", "SemanticDedupStage", "SemanticDeduplicationEngine",
    "StageResult", "TextCleaner", "TextCleaningStage", "ValidationResult", "VersionRegistry", "VersioningStage", "build_manifest", "check_data_quality", "clean_text_document",
    "feedback_preset", "iter_jsonl_chunks", "load_jsonl_records", "production_preset", "training_preset", "write_jsonl_records",
]

Texts = list[str] | DataFrame


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _corpus(texts: Texts) -> DataFrame:
    if isinstance(texts, DataFrame):
        return to_dataset(texts).df
    return _session().createDataFrame(list(enumerate(texts)), "_seq long, text string")


def _given(texts: Texts, kept: DataFrame) -> Any:
    """``kept`` in the form in which the texts came."""
    return kept if isinstance(texts, DataFrame) else [r["text"] for r in kept.orderBy("_seq").collect()]


class TextCleaner:
    def __init__(self, min_length: int = 50, max_urls: int = 5, remove_boilerplate: bool = True):
        self.min_length, self.max_urls, self.remove_boilerplate = min_length, max_urls, remove_boilerplate

    def column(self, text: str = "text"):
        """The cleaned text as a column, null where it is rejected."""
        return tx.clean(text, self.min_length, self.max_urls, self.remove_boilerplate)

    def clean(self, text: str) -> str | None:
        return next(iter(self.clean_batch([text])), None)

    def clean_batch(self, texts: Texts) -> Any:
        return _given(texts, tx.kept(_corpus(texts), self.column(), "text"))

    def remove_duplicates(self, texts: Texts) -> Any:
        return _given(texts, dedup.casefold_filter(_corpus(texts)))


def clean_text_document(text: str, min_length: int = 50, max_urls: int = 5) -> str | None:
    return TextCleaner(min_length, max_urls).clean(text)


class ExactDeduplicator:
    def find_duplicates(self, texts: Texts) -> dict[str, Any]:
        """The report, with each group's places by the md5 of its text."""
        df = _corpus(texts)
        report = dedup.exact_report(df).first().asDict()
        return report | {"groups": {r["md5"]: r["seqs"] for r in dedup.exact_groups(df).collect()}}

    def filter_duplicates(self, texts: Texts) -> Any:
        return _given(texts, dedup.exact_filter(_corpus(texts)))


class SemanticDeduplicationEngine:
    """``embedding_model`` is a function from texts to vectors, an object with
    ``encode``, or a model's name; DataFrames may bring a column ``embedding``."""

    def __init__(self, similarity_threshold: float = 0.95, embedding_model: Any = None, *, model_name: str = "sentence-transformers/all-MiniLM-L6-v2", use_lsh: bool = True, lsh_bands: int = 20):
        self.similarity_threshold, self.use_lsh, self.lsh_bands = similarity_threshold, use_lsh, lsh_bands
        self.embedding_model = embedding_model if embedding_model is not None else model_name

    def compute_embedding(self, text: str) -> np.ndarray:
        return np.asarray(dedup.encoder(self.embedding_model)([text])[0], dtype=np.float32)

    @staticmethod
    def compute_similarity(embedding1: np.ndarray, embedding2: np.ndarray) -> float:
        a, b = np.asarray(embedding1, float), np.asarray(embedding2, float)
        length = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / length if length else 0.0

    def _embedded(self, texts: Texts) -> DataFrame:
        df = _corpus(texts)
        return df if "embedding" in df.columns else dedup.embed(df, self.embedding_model)

    def find_duplicates(self, texts: Texts) -> dict[int, list[int]]:
        """Each kept row that others are duplicates of, with these."""
        gone = dedup.semantic_removals(self._embedded(texts), self.similarity_threshold, self.use_lsh, self.lsh_bands)
        return {r["rep_seq"]: r["dups"] for r in gone.groupBy("rep_seq").agg(F.sort_array(F.collect_list("dup_seq")).alias("dups")).orderBy("rep_seq").collect()}

    def filter_duplicates(self, texts: Texts) -> Any:
        return _given(texts, dedup.semantic_filter(self._embedded(texts), self.similarity_threshold, self.use_lsh, self.lsh_bands))


class DataLeakageDetector:
    def __init__(self, ngram_size: int = 5, overlap_threshold: float = 0.8):
        self.ngram_size, self.overlap_threshold = ngram_size, overlap_threshold

    def extract_ngrams(self, text: str) -> set[str]:
        return set(_corpus([text]).select(tx.ngrams("text", self.ngram_size)).first()[0])

    def detect_train_eval_contamination(self, train_texts: Texts, eval_texts: Texts) -> dict[str, Any]:
        return leakage.contamination_report(_corpus(train_texts), _corpus(eval_texts), self.ngram_size, self.overlap_threshold)

    def detect_exact_duplicates(self, texts: Texts) -> dict[str, Any]:
        return dedup.exact_report(_corpus(texts)).first().asDict()

    def detect_near_duplicates(self, texts: Texts, similarity_threshold: float = 0.9) -> dict[str, Any]:
        return leakage.near_duplicate_report(_corpus(texts), self.ngram_size, similarity_threshold)

    def detect_memorization_patterns(self, texts: Texts, min_frequency: int = 10) -> dict[str, Any]:
        return leakage.memorization_report(_corpus(texts), self.ngram_size, min_frequency)


class QualityChecker:
    def __init__(self, config: QualityConfig | None = None):
        self.config = config or QualityConfig()

    def check_quality(self, data: Any, dataset_id: str = "dataset", schema: dict | None = None) -> QualityReport:
        return quality.check(data, dataset_id, schema, self.config)


def check_data_quality(data: Any, dataset_id: str = "dataset", schema: dict | None = None, config: QualityConfig | None = None) -> QualityReport:
    return QualityChecker(config).check_quality(data, dataset_id, schema)


class DatasetPipeline(pl.Pipeline):
    def get_stage_names(self) -> list[str]:
        return self.stage_names()

    def run_streaming(self, path: str | Path, *, chunk_size: int = 1000, output_path: str | Path | None = None) -> StageResult:
        """As one plan over all chunks; deduplication of texts is within each."""
        return self.run_file(_session(), str(path), chunk_size, str(output_path) if output_path else None)


class PipelineOrchestrator(pl.Graph):
    def __init__(self, stages: list[PreprocessingStage] | None = None):
        super().__init__()
        for stage in stages or []:
            self.add_stage(stage)

    def build_dag(self) -> None:
        self.build()


class DatasetVersioningSystem:
    def __init__(self, metadata_dir: str | Path = "data/metadata"):
        self._store = manifest.FileVersions(_session(), str(metadata_dir))

    @staticmethod
    def compute_dataset_checksum(dataset_path: str | Path) -> str:
        if not manifest.exists(str(dataset_path)):
            raise ValueError(f"there is no dataset at {dataset_path}")
        return manifest.checksum(str(dataset_path))

    @staticmethod
    def count_samples_and_tokens(dataset_path: str | Path, tokenizer_manager: Any = None) -> dict[str, int]:
        rows, tokens = manifest.count_rows(_session(), str(dataset_path), getattr(tokenizer_manager, "encode", tokenizer_manager))
        return {"sample_count": rows, "token_count": tokens}

    def create_dataset_version(self, dataset_path: str | Path, dataset_id: str, parent_versions: list[str] | None = None, tokenizer_manager: Any = None, metadata: dict | None = None) -> dict[str, Any]:
        return self._store.create(str(dataset_path), dataset_id, parent_versions, getattr(tokenizer_manager, "encode", tokenizer_manager), metadata)

    def verify_dataset_integrity(self, dataset_path: str | Path, expected_checksum: str) -> bool:
        return self._store.verify(str(dataset_path), expected_checksum)

    def get_dataset_lineage(self, dataset_id: str) -> list[dict[str, Any]]:
        return self._store.lineage(dataset_id)


def build_manifest(path: str | Path, **how) -> dict[str, Any]:
    return manifest.build_manifest(_session(), str(path), **how)


def iter_jsonl_chunks(path: str | Path, *, chunk_size: int = 1000) -> Iterator[list[dict[str, Any]]]:
    """The objects of a file or folder in order, as lists of ``chunk_size``; rows come
    to the driver a partition at a time."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    held: list[dict[str, Any]] = []
    for row in jsonl.read_jsonl(_session(), str(path), keep_keys=True).orderBy("_seq").toLocalIterator():
        there = row["_keys"]
        held.append({k: v for k, v in row.asDict(recursive=True).items() if k in there})
        if len(held) == chunk_size:
            yield held
            held = []
    if held:
        yield held


def load_jsonl_records(path: str | Path) -> list[dict[str, Any]]:
    return [r for chunk in iter_jsonl_chunks(path, chunk_size=5000) for r in chunk]


def write_jsonl_records(path: str | Path, records: list[dict[str, Any]] | DataFrame) -> Path:
    """A folder of JSONL files."""
    jsonl.write_jsonl(to_dataset(records, _session()).df, str(path))
    return Path(path)
