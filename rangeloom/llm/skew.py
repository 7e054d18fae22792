"""Joins to a table with one row for each key, when some keys hold much of the left side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: A key is hot if it holds more than 1 / HOT_SHARE of the left rows; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 256


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, rows: Callable[[], int], salt: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Left join of ``left`` with ``right`` (unique in ``key``) that spreads hot keys.

    ``right[weight]`` is the number of left rows of the key (that column goes) and
    ``rows`` counts the left rows. Keys above ``rows / share``, fewer than
    ``share`` by arithmetic, are broadcast; their left rows, and those with a null
    key, get a key of their own, made from the ``salt`` columns, for the shuffle, so that
    no partition gathers them.
    """
    more = [c for c in right.columns if c not in (key, weight)]
    limit = max(1, rows() // share)
    hot = right.filter(F.col(weight) > limit).select(F.col(key).alias("__hot"), F.struct(*more).alias("__hot_values"))
    cold = right.filter(F.col(weight) <= limit).select(F.col(key).alias("__cold"), F.struct(*more).alias("__cold_values"))
    spread = F.concat(F.lit("\x00"), F.xxhash64(*salt).cast("string"))
    named = lambda c: F.hex(c) if isinstance(left.schema[key].dataType, BinaryType) else F.col(c).cast("string")
    text = named(key)
    out = (
        left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__key", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), spread).otherwise(text))
        .join(cold.withColumn("__cold", named("__cold")), F.col("__key") == F.col("__cold"), "left")
    )
    found = [F.coalesce(F.col(f"__hot_values.{c}"), F.col(f"__cold_values.{c}")).alias(c) for c in more]
    return out.select(*[F.col(c) for c in left.columns], *found)


def matched(left: DataFrame, right: DataFrame, key: str, weight: str, rows: Callable[[], int], share: int = HOT_SHARE) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique in ``key``, which is not null) that spreads hot keys: their rows stay where they are.

    ``right[weight]`` is the number of left rows of the key, as in ``lookup``. The cold keys grow with the data, so
    they are merged at every size and never broadcast for being few.
    """
    limit = max(1, rows() // share)
    hot = F.broadcast(right.filter(F.col(weight) > limit).drop(weight))
    cold = right.filter(F.col(weight) <= limit).drop(weight)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return left.join(hot, key).select(*rest.columns).unionByName(rest)
