"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with the scheme that Spark would use; a path without one belongs to the default file system."""
    if "://" in path:
        return path.rstrip("/")
    system, at = hadoop_path(spark, path)
    return system.makeQualified(at).toString().rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path object) of a path with or without a scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def found(spark: SparkSession, path: str) -> str | None:
    """What stands at a path of whatever file system: ``folder``, ``file`` or nothing."""
    system, at = hadoop_path(spark, path)
    if not system.exists(at):
        return None
    return "folder" if system.getFileStatus(at).isDirectory() else "file"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and
    only on a local master (tests), a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return qualified(spark, found)
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rangeloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def application_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/rangeloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the application's folder."""
    return f"{application_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder; DataFrames that read it can no longer be used."""
    system, at = hadoop_path(spark, application_dir(spark))
    system.delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: whatever executor is lost later, the table stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written, with the number of its range as ``__part``.

    What needs a row's neighbours or rank in the whole order can then work inside
    each range, however many rows one key has, and correct by the few ranges' totals.
    """
    return written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), tag)


def ranked(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """Adds ``name``, the 0-based rank of each row in ``order``, without gathering all rows in one task."""
    dealt = in_order(df, order, tag)
    within = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    # one row for each range: as many as there are shuffle partitions
    sizes = dealt.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return within.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__r") - 1).drop("__part", "__r", "__before")


def with_previous(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Adds ``previous``, a struct of the ``order`` columns of the row before in their order, without gathering all rows in one task."""
    dealt = in_order(df, [F.col(c) for c in order], tag)
    within = dealt.withColumn("__own", F.lag(F.struct(*order)).over(Window.partitionBy("__part").orderBy(*order)))
    # one row for each range: as many as there are shuffle partitions
    ends = dealt.groupBy("__part").agg(F.max(F.struct(*order)).alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(Window.orderBy("__part")).alias("__before"))
    return within.join(F.broadcast(ends), "__part").withColumn("previous", F.coalesce("__own", "__before")).drop("__part", "__own", "__before")
