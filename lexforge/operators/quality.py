"""Quality metrics over any table, along seven dimensions.

``metrics_frame`` needs a few passes over the data whatever its width: one wide
aggregate, one for distinct rows (by digests of sixteen bytes), one for quartiles and
one for outliers (with the fences that they give), one for labels.
"""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.model import Metric, QualityConfig, QualityReport

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
ID_COLUMNS = ("id", "document_id", "uuid")


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


#: Values of a column whose exact quartiles one aggregate gives; of more, those that
#: surely aren't a quartile are counted away first.
HELD = 1_000_000


def distinct_rows(df: DataFrame) -> int:
    """Distinct rows, of any types; digests move, not rows."""
    digest = F.unhex(F.md5(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"})))
    return df.select(digest.alias("digest")).distinct().count()


def quartiles(df: DataFrame, columns: dict[str, Any], counts: dict[str, int], held: int | None = None) -> dict[str, tuple[float, float]]:
    """The exact first and third quartile, interpolated, of each column (a value, or null).

    An aggregate that sorts all values of a column isn't distributed. While more than
    ``held`` values may be a quartile, approximate ones close in on it from both sides,
    and the values below are counted; the rest is small enough to be exact about.
    """
    held = HELD if held is None else held
    # (column, quartile) -> lower end, upper end, values below, values within
    open_ = {(c, q): (None, None, 0, counts[c]) for c in columns for q in (0.25, 0.75)}
    rank = {(c, q): q * (counts[c] - 1) for c, q in open_}

    def within(key: tuple[str, float]):
        v, (low, high, *_) = columns[key[0]], open_[key]
        return v if low is None else F.when(v.between(low, high), v)

    narrow = set()  # many equal values: these get no narrower
    while wide := [k for k, (low, high, _, n) in open_.items() if n > held and k not in narrow and (low is None or low < high)]:
        ends = {}
        for i, k in enumerate(wide):
            *_, below, n = open_[k]
            at = (rank[k] - below) / n
            ends[k] = F.percentile_approx(within(k), F.array(F.lit(max(0.0, at - 2e-4)), F.lit(min(1.0, at + 2e-4))), F.lit(10_000)).alias(f"e{i}")
        found = df.agg(*ends.values()).first()
        sizes = []
        for i, k in enumerate(wide):
            low, high = found[i]
            sizes += [F.count_if(columns[k[0]] < low).alias(f"b{i}"), F.count_if(columns[k[0]].between(low, high)).alias(f"n{i}")]
        counted = df.agg(*sizes).first()
        for i, k in enumerate(wide):
            (low, high), below, n = found[i], counted[2 * i], counted[2 * i + 1]
            if not (below <= math.floor(rank[k]) and math.ceil(rank[k]) < below + n):
                raise ValueError("an approximate quartile is further off than its bound")
            if n == open_[k][3]:
                narrow.add(k)
            open_[k] = (low, high, below, n)
    exact = []
    for k, (low, _, below, n) in open_.items():
        exact.append(F.percentile(within(k), F.lit((rank[k] - below) / (n - 1) if n > 1 else 0.0)).alias(f"{len(exact)}"))
    row = df.agg(*exact).first()
    value = dict(zip(open_, row))
    return {c: (value[c, 0.25], value[c, 0.75]) for c in columns}


def _moment(df: DataFrame, name: str):
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(c)
    if isinstance(kind, _NUMERIC):  # nanoseconds since 1970
        return F.timestamp_micros((c / 1000).cast("bigint"))
    return F.lit(None).cast("timestamp")


def metrics(df: DataFrame, schema: dict[str, Any] | None = None, config: QualityConfig | None = None, as_of: datetime | None = None) -> list[Metric]:
    """All metrics, in the order completeness, consistency, validity, uniqueness,
    timeliness, accuracy, integrity, distribution."""
    cfg, schema = config or QualityConfig(), schema or {}
    names = df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    dated = next((c for c in names if "time" in c.lower() or "date" in c.lower()), None)
    numeric = [c for c in names if isinstance(kinds[c], _NUMERIC)]
    wanted = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        wanted.append(F.count_if(_missing(df, c)).alias(f"null_{i}"))
    bounded = {n: s["constraints"] for n, s in schema.get("fields", {}).items() if n in names and "constraints" in s}
    for n in bounded:
        there = F.when(~_missing(df, n), F.col(f"`{n}`"))
        wanted += [F.min(there).alias(f"min_{n}"), F.max(there).alias(f"max_{n}")]
    if dated:
        wanted.append(F.unix_micros(F.max(_moment(df, dated))).alias("latest"))
    if "text" in names:
        length = F.length(F.coalesce(F.col("text").cast("string"), F.lit("None")))
        wanted += [F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean_length")]
    one = df.agg(*wanted).first().asDict()
    rows = one["rows"]
    if not rows or not names:
        return [Metric("completeness", "empty_dataset", 0.0, cfg.completeness_threshold, False, {"message": "no rows"})]

    out: list[Metric] = []

    def add(dimension: str, name: str, value: float, threshold: float | None, details: dict, tested: float | None = None) -> None:
        shown = value if tested is None else tested
        out.append(Metric(dimension, name, float(value), threshold, threshold is None or shown >= threshold, details))

    nulls = {c: one[f"null_{i}"] for i, c in enumerate(names)}
    cells, gone = rows * len(names), sum(nulls.values())
    add("completeness", "overall_completeness", 1.0 - gone / cells, cfg.completeness_threshold, {"total_cells": cells, "missing_cells": gone, "missing_percentage": gone / cells * 100})
    for c in names:
        add("completeness", f"column_{c}_completeness", 1.0 - nulls[c] / rows, cfg.completeness_threshold, {"column": c})

    # a column of one type that also has nulls is of two types, but for numbers
    mixed = [c for c in names if not isinstance(kinds[c], _NUMERIC) and 0 < nulls[c] < rows]
    score = 1.0
    for _ in mixed:
        score -= 0.1
    add("consistency", "type_consistency", max(0.0, score), cfg.consistency_threshold, {"type_issues": mixed}, score)

    if "required_fields" in schema:
        lacking = sorted(set(schema["required_fields"]) - set(names))
        add("validity", "required_fields_check", 0.0 if lacking else 1.0, cfg.validity_threshold, {"missing_required_fields": lacking} if lacking else {"required_fields": list(schema["required_fields"])})
    if "fields" in schema:
        errors = []
        for n in schema["fields"]:
            if n not in names:
                errors.append(f"no field {n}")
                continue
            c = bounded.get(n, {})
            if "min" in c and one[f"min_{n}"] is not None and one[f"min_{n}"] < c["min"]:
                errors.append(f"{n} goes below {c['min']}")
            if "max" in c and one[f"max_{n}"] is not None and one[f"max_{n}"] > c["max"]:
                errors.append(f"{n} goes above {c['max']}")
        add("validity", "schema_validation", max(0.0, 1.0 - len(errors) * cfg.validity_error_penalty) if errors else 1.0, cfg.validity_threshold, {"errors": errors} if errors else {"status": "valid"})

    copies = rows - distinct_rows(df)
    add("uniqueness", "row_uniqueness", 1.0 - copies / rows, cfg.uniqueness_threshold, {"duplicate_rows": copies, "unique_rows": rows - copies, "duplicate_percentage": copies / rows * 100})

    if dated is None:
        add("timeliness", "freshness_proxy", 1.0, cfg.timeliness_threshold, {"message": "no column of times"})
    elif one["latest"] is None:
        add("timeliness", "data_freshness", 0.0, cfg.timeliness_threshold, {"column": dated, "age_days": None})
    else:
        now = as_of or datetime.now(timezone.utc)
        now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
        days = int((now.timestamp() - one["latest"] / 1e6) // 86400)
        add("timeliness", "data_freshness", max(0.0, 1.0 - days / max(cfg.freshness_decay_days, 1)), cfg.timeliness_threshold, {"column": dated, "age_days": days})

    if rows >= cfg.min_samples_for_outlier_detection:
        if not numeric:
            add("accuracy", "numeric_outliers", 1.0, cfg.accuracy_threshold, {"message": "no column of numbers"})
        else:
            checks, sizes = [], {}
            full = {c: rows - nulls[c] for c in numeric if rows - nulls[c] >= 4}
            fences = quartiles(df, {c: F.when(~_missing(df, c), F.col(f"`{c}`").cast("double")) for c in full}, full) if full else {}
            for i, (c, there) in enumerate(full.items()):
                low, high = fences[c]
                reach = cfg.iqr_multiplier * (high - low)
                v = F.col(f"`{c}`").cast("double")
                checks.append(F.count_if(~_missing(df, c) & ((v < low - reach) | (v > high + reach))).alias(f"o_{i}"))
                sizes[f"o_{i}"] = there
            rate = 0.0
            if checks:
                outside = df.agg(*checks).first().asDict()
                rate = sum(outside[k] / n for k, n in sizes.items()) / len(sizes)
            add("accuracy", "numeric_outlier_rate", max(0.0, 1.0 - rate), cfg.accuracy_threshold, {"avg_outlier_rate": rate})

    key = next((c for c in names if c in ID_COLUMNS), None)
    if key:
        add("integrity", "id_completeness", 1.0 - nulls[key] / rows, cfg.integrity_threshold, {"column": key, "null_ids": nulls[key]})
    else:
        add("integrity", "referential_proxy", 1.0, cfg.integrity_threshold, {"message": "no column of ids"})

    if "label" in names:
        counted = df.where(~_missing(df, "label")).groupBy("label").agg(F.count("*").alias("n"))
        share = counted.agg((F.min("n") / F.max("n")).alias("b"), F.count("*").alias("labels")).first()
        add("consistency", "label_balance", 1.0 if share["b"] is None else share["b"], 0.1, {"labels": share["labels"]})
    if "text" in names:
        add("summary", "text_length_mean", 1.0, None, {"min": one["shortest"], "max": one["longest"], "mean": one["mean_length"]})
    return out


_METRIC = "dimension string, metric_name string, value double, threshold double, passed boolean, details string"


def metrics_frame(df: DataFrame, schema: dict | None = None, config: QualityConfig | None = None, as_of: datetime | None = None) -> DataFrame:
    rows = [(m.dimension, m.metric_name, m.value, m.threshold, m.passed, json.dumps(m.details, default=str)) for m in metrics(df, schema, config, as_of)]
    return df.sparkSession.createDataFrame(rows, _METRIC)


def dimension_scores(found: list[Metric]) -> dict[str, float]:
    """The mean value of each dimension; the summary is none."""
    by: dict[str, list[float]] = {}
    for m in found:
        if m.dimension != "summary":
            by.setdefault(m.dimension, []).append(m.value)
    return {k: sum(v) / len(v) for k, v in by.items()}


def recommendations(scores: dict[str, float], found: list[Metric], threshold: float = 0.8) -> list[str]:
    """For low dimensions, then for the first five metrics that failed."""
    low = [f"Improve {d}: score {s:.2f} is below {threshold:.2f}" for d, s in scores.items() if s < threshold]
    return low + [f"Fix {m.dimension}.{m.metric_name}: {m.value:.2f} is below {m.threshold}" for m in [m for m in found if not m.passed][:5]]


def check(data, dataset_id: str = "dataset", schema: dict | None = None, config: QualityConfig | None = None, as_of: datetime | None = None) -> QualityReport:
    """The report on a DataFrame, a list of dicts, one dict or a pandas frame."""
    from lexforge.sources.jsonl import to_dataset

    cfg = config or QualityConfig()
    when = as_of or datetime.now(timezone.utc)
    try:
        if hasattr(data, "to_dict") and hasattr(data, "iloc"):
            from pyspark.sql import SparkSession

            df = SparkSession.getActiveSession().createDataFrame(data)
        elif isinstance(data, DataFrame):
            df = data
        else:
            if not isinstance(data, (list, dict)) and not hasattr(data, "df"):
                raise ValueError(f"unsupported data: {type(data).__name__}")
            if isinstance(data, list) and data and not isinstance(data[0], dict):
                raise ValueError("a list must hold dicts")
            df = to_dataset([data] if isinstance(data, dict) else data).df
        df = df.drop("_seq", "_keys")
    except (ValueError, TypeError) as e:
        bad = Metric("validity", "data_conversion_error", 0.0, cfg.validity_threshold, False, {"error": str(e)})
        return QualityReport(dataset_id, when, 0.0, {"validity": 0.0}, [bad], {"error": str(e)}, ["Provide rows that can be read as a table"])
    found = metrics(df, schema, cfg, as_of)
    scores = dimension_scores(found)
    overall = sum(scores.values()) / len(scores) if scores else 0.0
    passed = sum(m.passed for m in found)
    summary = {"total_metrics": len(found), "passed_metrics": passed, "failed_metrics": len(found) - passed, "total_columns": len(df.columns)}
    return QualityReport(dataset_id, when, overall, scores, found, summary, recommendations(scores, found, cfg.recommendation_threshold))
