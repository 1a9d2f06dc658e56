"""What the operators of this subpackage share: tables, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources.staging import drop, shared_dir, staged, unused

__all__ = ["BROADCAST_ROWS", "drop", "shared_dir", "sized", "staged", "table", "unused"]

#: Rows up to which a table of ids is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(ids: DataFrame, limit: int | None = None) -> DataFrame:
    """``ids`` (a staged table), with a broadcast hint if it is small."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_ROWS if limit is None else limit) else ids
