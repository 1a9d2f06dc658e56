"""Row checks as columns: the first error of a row, all its messages, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.text import strip
from lexforge.model import MAX_LABEL, MIN_LABEL, Validation

_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def _has(df: DataFrame, name: str) -> Column:
    """Whether a row has a field: by its keys if they are known, else by the columns."""
    if "_keys" in df.columns:
        return F.array_contains("_keys", name)
    return F.lit(name in df.columns)


def _is(df: DataFrame, name: str, kinds) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, kinds)


def _first(*rules: tuple[Column, str | Column]) -> Column:
    out = F.lit(None).cast("string")
    for when, message in reversed(rules):
        out = F.when(when, F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def _all(*rules: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(w, F.lit(m) if isinstance(m, str) else m) for w, m in rules])) if rules else F.array().cast("array<string>")


def blank(df: DataFrame, name: str) -> Column:
    return F.length(strip(F.col(name))) == 0 if _is(df, name, T.StringType) else F.lit(False)


def record_error(df: DataFrame, required: list[str] | tuple[str, ...] = ("text", "label"), text: str = "text") -> Column:
    """The first thing wrong with a record, or null: a required field missing, a
    text that isn't a string (null isn't), a blank text."""
    rules = [(~_has(df, f), f"Required field '{f}' is missing") for f in required]
    if text in df.columns:
        rules.append((_has(df, text) & (F.col(text).isNull() if _is(df, text, T.StringType) else F.lit(True)), f"'{text}' must be a string"))
        rules.append((_has(df, text) & blank(df, text), f"'{text}' is empty"))
    return _first(*rules)


def record_messages(df: DataFrame, required: list[str] | tuple[str, ...] = ("text", "label"), text: str = "text") -> tuple[Column, Column]:
    """(errors, warnings): all messages on a record."""
    errors = [(~_has(df, f), f"Required field '{f}' is missing") for f in required]
    warnings = []
    if text in df.columns:
        errors += [(_has(df, text) & (F.col(text).isNull() if _is(df, text, T.StringType) else F.lit(True)), f"'{text}' must be a string"), (blank(df, text), f"'{text}' is empty")]
        if _is(df, text, T.StringType):
            short = F.length(strip(F.col(text)))
            warnings.append(((short > 0) & (short < 3), f"'{text}' has fewer than 3 characters"))
    if "label" in df.columns:
        warnings += [(_has(df, "label") & F.col("label").isNull(), "'label' is null"), (blank(df, "label"), "'label' is empty")]
    return _all(*errors), _all(*warnings)


def cleaning_warnings(df: DataFrame, text: str = "text") -> Column:
    if text not in df.columns:
        return F.array(F.lit(f"no '{text}' field"))
    other = F.col(text).isNull() if _is(df, text, T.StringType) else F.lit(True)
    return _all((~_has(df, text), f"no '{text}' field"), (_has(df, text) & other, f"'{text}' is not a string"), (blank(df, text), f"'{text}' is empty"))


def label_id(df: DataFrame, mapping: dict[str, int], label: str = "label") -> Column:
    """The id of a label: a string's by the mapping after strip and lower-casing, a
    number's by truncation within [0, 30]; null where there is none."""
    if label not in df.columns:
        return F.lit(None).cast("bigint")
    if _is(df, label, T.StringType):
        if not mapping:
            return F.lit(None).cast("bigint")
        table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, int(v))])
        return F.try_element_at(table, F.lower(strip(F.col(label)))).cast("bigint")
    if _is(df, label, _NUMBER):
        number = F.col(label).cast("double")
        n = F.when(F.isnan(number), None).otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
        return F.when(n.between(MIN_LABEL, MAX_LABEL), n.cast("bigint"))
    return F.lit(None).cast("bigint")


def routing_error(df: DataFrame, mapping: dict[str, int], label: str = "label") -> Column:
    """Why a label has no id, or null."""
    if label not in df.columns:
        return F.lit("Required field 'label' is missing")
    known = label_id(df, mapping, label).isNotNull()
    shown = F.col(label).cast("string")
    if _is(df, label, T.StringType):
        why = F.concat(F.lit("Unknown label '"), F.lower(strip(F.col(label))), F.lit("'"))
    elif _is(df, label, _NUMBER):
        why = F.concat(F.lit("Label id "), shown, F.lit(f" is outside [{MIN_LABEL}, {MAX_LABEL}]"))
    else:
        return F.lit("Label must be a string or a number")
    return _first((~_has(df, label), "Required field 'label' is missing"), (F.col(label).isNull(), "Label is null"), (~known, why))


def routing_messages(df: DataFrame, mapping: dict[str, int], label: str = "label") -> tuple[Column, Column]:
    error = F.when(blank(df, label), F.lit("Label is empty")).otherwise(routing_error(df, mapping, label))
    numeric = _is(df, label, _NUMBER)
    warn = _all((label_id(df, mapping, label).isNotNull(), "Label is a number already")) if numeric else F.array().cast("array<string>")
    return F.array_compact(F.array(error)), warn


def label_range_error(df: DataFrame, low: int = MIN_LABEL, high: int = MAX_LABEL, name: str = "label_id") -> Column:
    """Why a label id doesn't stand, or null."""
    if name not in df.columns:
        return F.lit(f"'{name}' is missing")
    if not _is(df, name, _NUMBER):
        return F.lit(f"'{name}' must be numeric")
    number = F.col(name).cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    inside = ~F.isnan(number) & whole.between(low, high)
    return _first((~_has(df, name), f"'{name}' is missing"), (number.isNull(), f"'{name}' must be numeric"), (~inside, F.concat(F.lit("Label id "), F.col(name).cast("string"), F.lit(f" is outside [{low}, {high}]"))))


def transform_warnings(df: DataFrame, text: str = "text") -> Column:
    return cleaning_warnings(df, text)


def first_error(df: DataFrame, error: Column, seq: str = "_seq") -> str | None:
    """The message of the first row in order that has one: a single aggregate."""
    e = df.select(F.col(seq).alias("s"), error.alias("e")).where("e is not null").agg(F.min_by("e", "s").alias("e")).first()
    return e["e"]


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, others with their ``_error``)."""
    marked = df.withColumn("_error", error)
    return marked.where("_error is null").drop("_error"), marked.where("_error is not null")


def collect_messages(df: DataFrame, errors: Column, warnings: Column, seq: str = "_seq") -> Validation:
    """All messages with their rows' places, as a list on the driver, which the result's
    form demands; ``messages`` gives the same as a table."""
    if df.isEmpty():
        return Validation.of(["there are no rows to validate"])
    found = messages(df, errors, warnings, seq).orderBy("index", "severity", "message").collect()
    by = {kind: [f"Item at index {r['index']}: {r['message']}" for r in found if r["severity"] == kind] for kind in ("error", "warning")}
    return Validation.of(by["error"], by["warning"])


def messages(df: DataFrame, errors: Column, warnings: Column, seq: str = "_seq") -> DataFrame:
    """index, severity, message: one row for each message on a row."""
    kinds = F.array(*[F.struct(F.lit(k).alias("severity"), m.alias("m")) for k, m in (("error", errors), ("warning", warnings))])
    one = df.select(F.col(seq).alias("index"), F.explode(kinds).alias("x"))
    return one.select("index", "x.severity", F.explode("x.m").alias("message"))


def count_messages(df: DataFrame, errors: Column, warnings: Column) -> tuple[int, int, int]:
    """(rows, errors, warnings): how many ``messages`` gives, as one aggregate."""
    many = [F.coalesce(F.sum(F.size(m).cast("bigint")), F.lit(0)) for m in (errors, warnings)]
    return tuple(df.agg(F.count(F.lit(1)), *many).first())
