"""Containers that travel between stages, and configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

#: Bounds of label ids.
MIN_LABEL, MAX_LABEL = 0, 30


@dataclass
class Dataset:
    """A lazy DataFrame with what the stages noted on it. ``seq`` names the column
    that gives rows their order (keep-first needs one)."""

    df: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    quality_metrics: dict[str, float] = field(default_factory=dict)
    schema_version: str | None = None
    seq: str = "_seq"
    #: The rows (this very frame) and the folder where they stand as JSONL.
    written: tuple[DataFrame, str] | None = None


@dataclass
class Validation:
    is_valid: bool
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    quality_scores: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, errors: list[str], warnings: list[str] | None = None) -> Validation:
        return cls(not errors, errors, warnings or [])


@dataclass
class StageResult:
    success: bool
    data: Dataset | None = None
    validation: Validation | None = None
    seconds: float = 0.0
    error: str | None = None
    stage_name: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class QualityConfig:
    completeness_threshold: float = 0.95
    consistency_threshold: float = 0.90
    validity_threshold: float = 1.0
    uniqueness_threshold: float = 0.98
    timeliness_threshold: float = 0.70
    accuracy_threshold: float = 0.90
    integrity_threshold: float = 1.0
    iqr_multiplier: float = 1.5
    freshness_decay_days: float = 30.0
    recommendation_threshold: float = 0.8
    validity_error_penalty: float = 0.1
    min_samples_for_outlier_detection: int = 4


@dataclass
class Metric:
    dimension: str
    metric_name: str
    value: float
    threshold: float | None = None
    passed: bool = True
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class QualityReport:
    dataset_id: str
    timestamp: datetime
    overall_score: float
    dimension_scores: dict[str, float]
    metrics: list[Metric]
    summary: dict[str, Any] = field(default_factory=dict)
    recommendations: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        out = {k: v for k, v in vars(self).items() if k not in ("timestamp", "metrics")}
        return out | {"timestamp": self.timestamp.isoformat(), "metrics": [vars(m) for m in self.metrics]}

    def to_validation(self) -> Validation:
        """Valid if no metric failed and the overall score is at least 0.8."""
        failed = [f"{m.dimension}.{m.metric_name}: {m.value:.2f} < {m.threshold}" for m in self.metrics if not m.passed]
        scores = self.dimension_scores | {"overall": self.overall_score}
        return Validation(not failed and self.overall_score >= 0.8, failed, list(self.recommendations), scores)
