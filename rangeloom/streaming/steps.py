"""The range filter over a stream of decisions, step by step in event time (an extension: the batch engine has no streams).

Decisions arrive in any order. Each (path, observer, target) keeps its
log-likelihoods of the 169 classes and the decisions that wait; when the
watermark passes a decision's time, it is applied in the order of (time, action
index) and its telemetry goes out, as ``filter_steps`` gives it for a table. What
comes later than the watermark allows is dropped, as in Spark's own event-time
operators. A pair without decisions for longer than ``idle_seconds`` is taken as
ended and its state is removed, so the state is that of the hands being played;
a later decision starts anew from the prior, whenever it arrives.

Likelihoods and priors are columns, joined or made before the keyed operator;
Python only adds vectors. Keyed state needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rangeloom.functions.cards import bad, text_bits
from rangeloom.functions.keys import SEATS
from rangeloom.functions.likelihood import FLOOR, action_table, class_names
from rangeloom.operators.ranges import action_vectors, counts_left

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "path string, observer string, target string, step bigint, action_index int, state_key string, action_bucket int, effective_size double, top_class string, top_probability double, evidence double"


def every_state_key(spark: SparkSession) -> DataFrame:
    """(state_key): the product of the key's five categories, 378 rows."""
    parts = [(*SEATS, "unknown"), ("heads_up", "three_way", "multiway"), ("facing_bet", "no_bet"), ("raises_0", "raises_1", "raises_2plus"), ("deep", "medium", "shallow")]
    rows = spark.range(1)
    for i, names in enumerate(parts):
        rows = rows.withColumn(f"k{i}", F.explode(F.array(*map(F.lit, names))))
    return rows.select(F.concat_ws("|", *[f"k{i}" for i in range(len(parts))]).alias("state_key"))


class _Steps(StatefulProcessor):
    """One pair's filter: ``told`` holds what has been applied, ``waiting`` what the watermark has not passed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "n bigint, log_z double, last bigint, log_lik array<double>, prior array<double>")
        self.waiting = handle.getListState("waiting", "at bigint, action_index int, state_key string, bucket int, ln array<double>")
        self.names = np.array(class_names())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            if not self.told.exists():
                prior = [float(x) for x in batch["prior"].iloc[0]]
                self.told.update((0, 0.0, 0, [0.0] * len(prior), prior))
            kept = [(int(r.at), int(r.action_index), r.state_key, int(r.bucket), [float(x) for x in r.ln]) for r in batch.itertuples()]
            self.waiting.appendList(kept)
            times.update(k[0] for k in kept)
        for t in times:
            self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if not self.told.exists():
            yield pd.DataFrame()
            return
        n, log_z, last, log_lik, prior = self.told.get()
        listed = sorted(self.waiting.get(), key=lambda w: (w[0], w[1])) if self.waiting.exists() else []
        due, rest = [w for w in listed if w[0] <= now], [w for w in listed if w[0] > now]
        if not listed and last + self.idle_ms <= now:
            self.told.clear()
        if due:
            out = []
            sums, prior = np.array(log_lik), np.array(prior)
            live = prior > 0
            for at, action_index, state_key, bucket, ln in due:
                if n and at - last > self.idle_ms:
                    n, log_z, sums = 0, 0.0, np.zeros(len(prior))
                last = at
                sums = sums + np.array(ln)
                top = sums[live].max()
                w = np.where(live, prior * np.exp(sums - top), 0.0)
                z = w.sum()
                p = w / z
                # ties at twelve places keep class order
                best, before, n = int(np.argmax(np.round(p, 12))), log_z, n + 1
                log_z = float(np.log(z) + top)
                out.append((*key, n, action_index, state_key, bucket, float(1 / (p * p).sum()), str(self.names[best]), float(p[best]), float(np.exp(log_z - before))))
            self.told.update((n, log_z, last, [float(x) for x in sums], [float(x) for x in prior]))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.handle.registerTimer(last + self.idle_ms)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def streaming_steps(decisions: DataFrame, time_col: str, late: str = "1 hour", idle_seconds: int = 86_400, phi: float = 0.0, floor: float = FLOOR) -> DataFrame:
    """``STEPS`` of a stream of (path, observer, target, dead, action_index, state_key, bucket, ``time_col``).

    ``late`` is how far behind the newest row a row may come. An unknown state key or bucket, and dead cards that leave no combo, are errors.
    """
    spark = decisions.sparkSession
    # at most 1,890 rows of 1.4 KB
    vectors = action_vectors(action_table(every_state_key(spark), phi, floor))
    counts = counts_left(text_bits(F.col("dead")))
    rows = decisions.withWatermark(time_col, late).join(F.broadcast(vectors), ["state_key", "bucket"], "left")
    rows = rows.withColumn("ln", F.when(F.col("ln").isNull(), bad("Invalid state key: ", F.col("state_key")).cast("array<double>")).otherwise(F.col("ln")))
    rows = rows.withColumn("counts", counts).withColumn("total", F.aggregate("counts", F.lit(0), lambda a, x: a + x))
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(bad("no legal combos: ", F.col("dead")).cast("int"))
    made = rows.select("path", "observer", "target", time_col, F.unix_millis(F.col(time_col).cast("timestamp")).alias("at"), "action_index", "state_key", "bucket", "ln", F.transform("counts", lambda n: n / total).alias("prior"))
    return made.groupBy("path", "observer", "target").transformWithStateInPandas(_Steps(idle_seconds * 1000), STEPS, "Append", "EventTime")
