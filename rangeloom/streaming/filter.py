"""The range filter over a stream of decisions (an extension: the batch engine has no streams).

Log-likelihoods add up, so the state of a hand and target is a sum for each class,
kept by Structured Streaming's own aggregation; no custom state is needed. With a
watermark on ``time_col`` the states of finished hands are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_likelihoods(decisions: DataFrame, table: DataFrame, time_col: str | None = None, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(path, target, class_id, log_lik, n) of a stream of (path, target, state_key, bucket) decisions and a static action table."""
    narrow = table.select("state_key", "bucket", "class_id", F.log("lik").alias("ln"))
    keys: list = ["path", "target", "class_id"]
    if time_col:
        decisions = decisions.withWatermark(time_col, late)
        keys = [F.window(time_col, window), *keys]
    joined = decisions.join(F.broadcast(narrow), ["state_key", "bucket"])
    return joined.groupBy(*keys).agg(F.sum("ln").alias("log_lik"), F.count("*").alias("n"))
