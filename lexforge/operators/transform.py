"""Record transforms: cleaning, normalising, text filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions import text as tx


def clean_text(df: DataFrame, text: str = "text", min_length: int = 50, max_urls: int = 5, remove_boilerplate: bool = True) -> DataFrame:
    """Cleans ``text`` and drops rows it rejects; rows whose text is null pass."""
    if text not in df.columns or not isinstance(df.schema[text].dataType, T.StringType):
        return df
    return tx.kept(df, tx.clean(text, min_length, max_urls, remove_boilerplate), text, also=F.col(text).isNull())


def clean_records(df: DataFrame, text: str = "text") -> DataFrame:
    """Collapses whitespace in ``text``; empty strings become null (no value)."""
    out = df
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            c = tx.collapse(F.col(f.name)) if f.name == text else F.col(f.name)
            out = out.withColumn(f.name, F.nullif(c, F.lit("")))
    return out


def normalize(df: DataFrame, text: str = "text", lowercase: bool = True, trim: bool = True) -> DataFrame:
    """Strips, then lower-cases ``text``, if it is a string."""
    if text not in df.columns or not isinstance(df.schema[text].dataType, T.StringType):
        return df
    c = F.col(text)
    c = tx.strip(c) if trim else c
    return df.withColumn(text, F.lower(c) if lowercase else c)
