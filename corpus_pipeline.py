"""From raw documents to packed training windows, in named stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontaminate, jaccard_join, packing, quality_cnn, secret_scan
from lexforge.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text counts as empty, and is accepted or not as an empty one is. Rows are
    judged each by their own text, whatever their ids; repeated rows alike; a
    probability equal to the cut-off stays. Long texts are read whole. With too few
    labels of either class, or no documents, nothing goes. Other columns stay.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    The one with the smallest doc_id (null last), then the smallest hash of its text.
    Null texts and texts without words are in no group, and stay, each row of them.
    Repeated rows are copies: one stays. Long texts are hashed whole. No documents
    give no rows. Other columns stay, whatever their names.
    """
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Each row is judged by its own text; null and empty texts stay, and repeated rows
    stay or go alike, with null ids or not. Long texts are read whole. An empty
    benchmark removes nothing; no documents give no rows. Other columns stay.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes.

    Null and empty texts stay as they are. n_chars follows the text where it was its
    length. Overlapping secrets are replaced as one, by the kind of the first. Long
    texts are read whole; repeated rows alike. No documents give no rows. Other columns
    stay.
    """
    return secret_scan.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, concatenated and cut into windows.

    In order of doc_id, nulls last, then by a hash of the text; a null text is an empty
    document. Repeated rows are packed each time; long texts fill several windows. No
    documents give no windows. Other columns aren't carried.
    """
    return packing.flat(packing.pack(docs))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("packing", windows),
]

#: A convolutional network and minhash candidates aren't SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
