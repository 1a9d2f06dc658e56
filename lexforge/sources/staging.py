"""Tables written in between, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, deleted when the session's
    process ends.

    Only where that setting is absent, in a local session as in tests, does a
    temporary folder of this machine stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="shared-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    system, where = _hadoop(spark, path)
    system.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again: lineage
    is cut, and a lost executor costs nothing that was computed before. For texts
    the codec "zstd" takes about a third less than the session's usual one."""
    path = shared_dir(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for t in tables:
        system, where = _hadoop(t.sparkSession, t.staged_at)
        system.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A large table has more splits than that and is left alone; a file of a few
    row groups would else be worked on by a few cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
