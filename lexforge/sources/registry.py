"""A registry of dataset versions: an append-only Parquet table, and data copies."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from enum import Enum
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.sources.manifest import _at, checksum, exists, files_of


class DatasetType(str, Enum):
    """The domain of ``dataset_type``."""

    LEASE_ABSTRACTION = "lease_abstraction"
    CONTRACT_INTELLIGENCE = "contract_intelligence"
    OBLIGATION_DEPENDENCY = "obligation_dependency"
    REGULATORY_LANGUAGE = "regulatory_language"
    CLAUSE_EVOLUTION = "clause_evolution"


SCHEMA = (
    "id long, dataset_name string, version string, dataset_type string, storage_path string, storage_backend string, total_samples long, "
    "file_count long, total_size_bytes long, data_checksum string, metadata_checksum string, parent_version string, change_summary string, "
    "change_type string, quality_score double, validation_status string, validation_errors string, tags array<string>, dataset_metadata string, "
    "created_at timestamp, created_by string"
)


def change_type(samples: Column, parent_samples: Column, has_parent: Column) -> Column:
    """MAJOR without a parent or beyond half of its samples, MINOR beyond a tenth."""
    share = F.when(parent_samples > 0, F.abs(samples - parent_samples) / parent_samples).otherwise(0.0)
    return F.when(~has_parent | parent_samples.isNull(), "MAJOR").when(share > 0.5, "MAJOR").when(share > 0.1, "MINOR").otherwise("PATCH")


def next_version(version: str | None) -> str:
    """The patch number one higher; 1.0.0 after nothing or what isn't a version."""
    if version is None:
        return "1.0.0"
    parts = version.strip().lstrip("v").split(".")
    try:
        major, minor, patch = (int(parts[i]) if i < len(parts) else 0 for i in range(3))
    except ValueError:
        return "1.0.0"
    return f"{major}.{minor}.{patch + 1}"


def next_version_column(version: Column) -> Column:
    parts = F.split(F.regexp_replace(F.trim(version), "^v+", ""), r"\.")
    n = [F.when(F.size(parts) > i, F.get(parts, F.lit(i)).try_cast("int")).otherwise(0) for i in range(3)]
    good = n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull()
    return F.when(good, F.concat_ws(".", n[0].cast("string"), n[1].cast("string"), (n[2] + 1).cast("string"))).otherwise("1.0.0")


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each dataset; equal times go to the larger id."""
    order = Window.partitionBy("dataset_name").orderBy(F.desc("created_at"), F.desc("id"))
    return versions.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def compared(versions: DataFrame, name: str = "dataset_name", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Each version with its differences from the one before it."""
    w = Window.partitionBy(name).orderBy(*order)
    out = versions
    for c, d in (("total_samples", "sample_difference"), ("file_count", "file_difference"), ("total_size_bytes", "size_difference_bytes")):
        out = out.withColumn(d, F.col(c) - F.lag(c).over(w))
    return out


#: Where stored copies may go: ``root`` names the place, on any filesystem for "hadoop".
BACKENDS = ("local", "filesystem", "hadoop", "s3")


class VersionRegistry:
    """Versions below ``root``, a path or URI; their table is a Parquet folder there, or
    ``catalog_table`` of the session's catalog (Hive, JDBC and others)."""

    def __init__(self, spark: SparkSession, root: str, catalog_table: str | None = None):
        self.spark, self.root, self.catalog_table = spark, str(root).rstrip("/"), catalog_table
        self.table = f"{self.root}/versions"

    def frame(self) -> DataFrame:
        if self.catalog_table:
            there = self.spark.catalog.tableExists(self.catalog_table)
            return self.spark.table(self.catalog_table) if there else self.spark.createDataFrame([], SCHEMA)
        if not files_of(self.table):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.table)

    def create(
        self, name: str, kind: DatasetType | str, data_path: str, version: str | None = None, parent_version: str | None = None,
        change_summary: str | None = None, tags: list[str] | None = None, metadata: dict | None = None, created_by: str | None = None,
        storage_backend: str = "local", quality_score: float | None = None, now: datetime | None = None,
    ) -> dict[str, Any]:
        if storage_backend not in BACKENDS:
            raise ValueError(f"unknown storage backend {storage_backend!r}")
        if storage_backend == "s3" and not self.root.startswith("s3"):
            raise ValueError("the backend s3 needs a root on s3")
        if not exists(data_path):
            raise FileNotFoundError(str(data_path))
        kind = DatasetType(kind)
        newest = self.latest(name, kind)
        version = version or next_version(newest["version"] if newest else None)
        stats = self.statistics(data_path)
        parent = self.get(name, parent_version, kind) if parent_version else None
        target = f"{self.root}/datasets/{name}/{version}"
        self._copy(data_path, target)
        last = self.frame().agg(F.max("id")).first()[0]
        row = {
            "id": (last or 0) + 1, "dataset_name": name, "version": version, "dataset_type": kind.value, "storage_path": target,
            "storage_backend": storage_backend, **stats, "data_checksum": self._folder_checksum(target),
            "metadata_checksum": hashlib.sha256(json.dumps({"dataset_name": name, "version": version, "stats": stats, "metadata": metadata or {}}, sort_keys=True).encode()).hexdigest(),
            "parent_version": parent_version, "change_summary": change_summary, "change_type": self._change(stats["total_samples"], parent),
            "quality_score": quality_score, "validation_status": "PENDING", "validation_errors": None, "tags": list(tags or []),
            "dataset_metadata": json.dumps(metadata or {}), "created_at": now or datetime.now(timezone.utc), "created_by": created_by,
        }
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        made = self.spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA).write.mode("append")
        if self.catalog_table:
            made.saveAsTable(self.catalog_table)
        else:
            made.parquet(self.table)
        return row

    @staticmethod
    def _change(samples: int, parent: dict | None) -> str:
        if parent is None:
            return "MAJOR"
        before = parent["total_samples"]
        share = abs(samples - before) / before if before > 0 else 0
        return "MAJOR" if share > 0.5 else "MINOR" if share > 0.1 else "PATCH"

    def statistics(self, path: str) -> dict[str, int]:
        """Lines of .jsonl files (blank ones too), entries of .json files, files, bytes."""
        files = files_of(path)
        scheme = f"{str(path).split('://')[0]}://" if "://" in str(path) else ""
        lines, whole = ([scheme + f.path for f in files if f.path.endswith(end)] for end in (".jsonl", ".json"))
        samples = self.spark.read.text(lines).count() if lines else 0
        if whole:
            value = F.parse_json("value")
            is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
            entries = F.when(is_list, F.size(F.try_variant_get(value, "$", "array<variant>"))).otherwise(1)
            samples += self.spark.read.text(whole, wholetext=True).agg(F.sum(entries)).first()[0] or 0
        return {"total_samples": samples, "file_count": len(files), "total_size_bytes": sum(f.size for f in files)}

    def _copy(self, source: str, target: str) -> None:
        """Each file is copied by a task, not through the driver."""
        system, root = _at(source)
        to, base = _at(target)
        to.create_dir(base, recursive=True)
        one = system.get_file_info(root).type == fs.FileType.File
        pairs = [(f.path, f"{base}/{f.base_name if one else f.path[len(root.rstrip('/')) + 1 :]}") for f in files_of(source)]
        if not pairs:
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, there = _at(source)[0], _at(target)[0]
            for b in batches:
                for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    there.create_dir(new.rsplit("/", 1)[0], recursive=True)
                    fs.copy_files(old, new, source_filesystem=here, destination_filesystem=there)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        tasks = min(len(pairs), 4 * self.spark.sparkContext.defaultParallelism)
        copied = self.spark.createDataFrame(pairs, "old string, new string").repartition(tasks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
        if copied != len(pairs):
            raise OSError(f"{copied} of {len(pairs)} files were copied")

    @staticmethod
    def _folder_checksum(path: str) -> str:
        return checksum(path)

    def _where(self, name: str | None, kind: DatasetType | str | None) -> DataFrame:
        out = self.frame()
        if name is not None:
            out = out.where(F.col("dataset_name") == name)
        if kind is not None:
            out = out.where(F.col("dataset_type") == DatasetType(kind).value)
        return out

    def get(self, name: str, version: str, kind: DatasetType | str | None = None) -> dict[str, Any] | None:
        r = self._where(name, kind).where(F.col("version") == version).orderBy("id").first()
        return r.asDict() if r else None

    def list(self, name: str | None = None, kind: DatasetType | str | None = None, limit: int = 100) -> list[dict[str, Any]]:
        return [r.asDict() for r in self._where(name, kind).orderBy(F.desc("created_at"), F.desc("id")).limit(limit).collect()]

    def latest(self, name: str, kind: DatasetType | str | None = None) -> dict[str, Any] | None:
        found = self.list(name, kind, 1)
        return found[0] if found else None

    def compare(self, name: str, first: str, second: str) -> dict[str, Any]:
        a, b = self.get(name, first), self.get(name, second)
        if a is None or b is None:
            raise ValueError(f"{name} has no version {first if a is None else second}")
        return {
            "version1": first, "version2": second, "sample_difference": b["total_samples"] - a["total_samples"], "file_difference": b["file_count"] - a["file_count"],
            "size_difference_bytes": b["total_size_bytes"] - a["total_size_bytes"], "change_type": b["change_type"], "change_summary": b["change_summary"],
        }

    def validate(self, name: str, version: str) -> bool:
        """Whether the stored copy still has its checksum."""
        row = self.get(name, version)
        return row is not None and self._folder_checksum(row["storage_path"]) == row["data_checksum"]
