"""What the training-data operators share: reading, shared folders, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.sources.shared import fresh_path, in_order, qualified, ranked, shared_dir, with_previous, written

__all__ = ["WORD", "fresh_path", "in_order", "qualified", "ranked", "shared_dir", "table", "with_previous", "word_count", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read with Spark's own reader so that any path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
