"""JSON lines in and out, with an explicit row order.

``read_lines`` keeps files' order: by path (part by part), then by line.
Blank lines are skipped. Text that isn't JSON raises; JSON that isn't an object
is dropped (or kept as text, see ``lines_of``).
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.functions.text import strip
from lexforge.model import Dataset
from lexforge.sources.staging import staged

FORMATS = ("jsonl", "json", "csv", "parquet")


def with_seq(df: DataFrame, *order: str, seq: str = "_seq") -> DataFrame:
    """Adds a dense row number from 0 by the given columns.

    One global order needs no single partition: rows are range-sorted, counted
    by partition, and numbered from their partition's offset.
    """
    marked = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = marked.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % F.lit(1 << 33))
    held = staged(marked)
    sizes = held.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__low"))
    starts = sizes.select("__part", "__low", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return held.join(F.broadcast(starts), "__part").withColumn(seq, F.col("__start") + F.col("__at") - F.col("__low")).drop("__part", "__at", "__low", "__start")


#: Files' blocks whose first numbers are broadcast; more of them are joined by a shuffle.
_BLOCKS = 100_000


def _in_order(lines: DataFrame) -> DataFrame:
    """``lines`` with a dense ``_seq`` from 0 in files' order, without a shuffle: a block
    of a file is read in order by one task, so that its first number is enough."""
    held = staged(lines.withColumn("__at", F.monotonically_increasing_id()), "zstd")
    sizes = staged(held.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("__at").alias("__low")))
    starts = sizes.select("_file", "_block", (F.sum("n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))).alias("__start"), "__low")
    known = F.broadcast(starts) if sizes.count() <= _BLOCKS else starts
    numbered = held.join(known, ["_file", "_block"]).withColumn("_seq", F.coalesce("__start", F.lit(0)) + F.col("__at") - F.col("__low"))
    return numbered.drop("__at", "__low", "__start")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _line, value) of a file of any name, or of a folder's ``*.jsonl``."""
    where = str(path)
    if ":/" not in where and not Path(where).exists():
        raise FileNotFoundError(where)
    reader = spark.read
    if ":/" in where or Path(where).is_dir():
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        if ":/" not in where and not any(Path(where).rglob("*.jsonl")):
            return spark.createDataFrame([], "_file array<string>, _block long, _line long, value string")
    return _lines(reader.text(where))


def lines_in(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``lines_of``, of the files given."""
    return _lines(spark.read.text(paths))


def _lines(text: DataFrame) -> DataFrame:
    rows = text.select(
        F.split("_metadata.file_path", "/").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), strip("value").alias("value"),
    )
    return rows.where("value <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, keep_keys: bool = False, numbered: bool = True) -> DataFrame:
    """The objects of a JSONL file or folder, with ``_seq``.

    With ``keep_keys`` the column ``_keys`` has the keys that each object has, so
    that a null value and a missing key can be told apart. Not ``numbered``, where the
    order doesn't matter, the files are read as they lie and nothing is written.
    """
    lines = _in_order(lines_of(spark, path)) if numbered else lines_of(spark, path)
    order = ["_seq"] if numbered else ["_file", "_block", "_line"]
    bad = lines.where(F.try_parse_json("value").isNull()).orderBy(*order).select(*order, "value").first()
    if bad:
        where = f"line {bad['_seq']}" if numbered else f"a line of {bad['_file'][-1]}"
        raise ValueError(f"{where} is not JSON: {bad['value'][:80]!r}")
    objects = lines.where(F.json_object_keys("value").isNotNull())
    if schema is None:
        schema = _infer(spark, objects)
    seq = ["_seq"] if numbered else []
    keys = [F.json_object_keys("value").alias("_keys")] if keep_keys else []
    if not (schema.fields if isinstance(schema, StructType) else schema):
        return objects.select(*seq, *keys)
    return objects.select(*seq, *keys, F.from_json("value", schema).alias("r")).select(*seq, *(["_keys"] if keep_keys else []), "r.*")


def _infer(spark: SparkSession, objects: DataFrame) -> StructType:
    """The schema of all objects, merged by the engine's own aggregate."""
    ddl = objects.select(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"]
    if not ddl or not ddl.startswith("OBJECT<"):
        return StructType()
    return spark.sql(f"SELECT from_json('{{}}', '{_plain(ddl)}') AS r").schema["r"].dataType


def _plain(ddl: str) -> str:
    """A variant's schema as a type that JSON can be read into."""
    out = ddl.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    out = re.sub(r"DECIMAL\(\d+,\s?\d+\)", "DOUBLE", out)
    inner = out[len("STRUCT<") : -1]
    return f"STRUCT<{inner}>"


def chunked(df: DataFrame, chunk_size: int = 1000, seq: str = "_seq") -> DataFrame:
    """Adds ``chunk_id``: rows in order, ``chunk_size`` to a chunk."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    return df.withColumn("chunk_id", F.floor(F.col(seq) / chunk_size))


def write_jsonl(df: DataFrame, path: str) -> str:
    """A folder of ``*.jsonl`` files, one JSON object a line, nulls kept; replaces what is there."""
    rows = df.drop("_seq", "_keys")
    line = F.to_json(F.struct(*[f"`{c}`" for c in rows.columns]), {"ignoreNullFields": "false"}) if rows.columns else F.lit("{}")
    # The one text format whose files' ending can be chosen, with nothing quoted or
    # escaped (JSON text has no control characters): no file is renamed afterwards.
    (
        rows.select(line.alias("value")).write.mode("overwrite").format("csv")
        .options(extension="jsonl", sep="\u0001", quote="", escape="\u0002", header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).save(str(path))
    )
    return str(path)


def load(spark: SparkSession, source: str, fmt: str = "jsonl") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "jsonl":
        return read_jsonl(spark, source)
    if fmt == "csv":
        return spark.read.option("header", "true").csv(source)
    if fmt == "json":
        return spark.read.option("multiLine", "true").json(source)
    return spark.read.parquet(source)


def to_dataset(data, spark: SparkSession | None = None) -> Dataset:
    """A Dataset from one, a DataFrame, a list of dicts, ``{"data": ...}``, any
    object with ``.data`` or ``.df``, or a ``Path`` to JSONL."""
    if isinstance(data, Dataset):
        return data
    if isinstance(data, DataFrame):
        # numbered once and written: numbers given anew could change after a shuffle
        return Dataset(data if "_seq" in data.columns else staged(data.withColumn("_seq", F.monotonically_increasing_id())))
    if hasattr(data, "data"):
        return to_dataset(data.data, spark)
    if isinstance(data, dict):
        return to_dataset(data["data"] if "data" in data else [data], spark)
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, list):
        rows = [r for r in data if isinstance(r, dict)]
        names = list(dict.fromkeys(k for r in rows for k in r))
        if not rows or not names:
            return Dataset(spark.createDataFrame([], "_seq long"))
        order = [Row(**{n: r.get(n) for n in names}, _seq=i) for i, r in enumerate(rows)]
        void = [n for n in names if all(r.get(n) is None for r in rows)]
        if not void:
            return Dataset(spark.createDataFrame(order, samplingRatio=1.0))
        some = spark.createDataFrame([Row(**{k: v for k, v in r.asDict().items() if k not in void}) for r in order], samplingRatio=1.0)
        return Dataset(some.select(*[F.lit(None).cast("string").alias(n) if n in void else F.col(n) for n in [*names, "_seq"]]))
    if isinstance(data, Path) and (data.suffix == ".jsonl" or data.is_dir()):
        return Dataset(read_jsonl(spark, str(data)))
    raise ValueError(f"can't read a dataset from {type(data).__name__}")
