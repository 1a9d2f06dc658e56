"""Cleaning and deduplication of arriving JSONL files, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.functions import text as tx


def read_stream(spark: SparkSession, folder: str, schema: str = "text string", files_per_trigger: int | None = None) -> DataFrame:
    """Objects of the JSONL files that arrive in a folder; other JSON is dropped."""
    reader = spark.readStream.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))
    objects = lines.where(F.json_object_keys("value").isNotNull())
    return objects.select(F.from_json("value", schema).alias("r"), "arrived").select("r.*", "arrived")


def cleaned(stream: DataFrame, text: str = "text", min_length: int = 50, max_urls: int = 5) -> DataFrame:
    return tx.kept(stream, tx.clean(text, min_length, max_urls), text)


def distinct_texts(stream: DataFrame, text: str = "text", within: str | None = None) -> DataFrame:
    """The first of each text that arrives; ``within`` bounds how long one is remembered."""
    keyed = stream.withColumn("text_md5", F.md5(text))
    if within is None:
        return keyed.dropDuplicates(["text_md5"])
    return keyed.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["text_md5"])


def windowed_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour", text: str = "text", time: str = "arrived") -> DataFrame:
    """Rows and characters by window of arrival, or of another ``time``; what comes more
    than ``late`` after the latest is left out, so that the state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Gives every micro-batch to ``each`` until no file is left, then stops."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query
