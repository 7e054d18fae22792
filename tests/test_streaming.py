"""The keyed filter over a replayed stream against the batch filter."""

import os

import pytest
from pyspark.sql import functions as F
from rangeloom.operators import ranges as R
from rangeloom.plans import queries
from rangeloom.streaming.steps import PROVIDER, every_state_key, streaming_steps

D = "/root/testdata/sf0.001"
ROW = "path string, observer string, target string, dead string, action_index int, state_key string, bucket int, ts timestamp"
END = "2100-01-01 00:00:00"


@pytest.fixture
def keyed(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, parts, tmp_path, **options):
    """Rows of each part in a batch of their own, in the parts' order, then a row that closes the time."""
    folder = tmp_path / "in"
    for i, part in enumerate([*parts, [("end", "o", "t", "", 0, "sb|heads_up|no_bet|raises_0|deep", 1, END)]]):
        rows = spark.createDataFrame([tuple(r[:7]) + (str(r[7]),) for r in part], ROW.replace("timestamp", "string"))
        rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder / f"b={i}"))
        for f in (folder / f"b={i}").glob("part-*"):
            f.rename(folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))
    q = streaming_steps(stream, "ts", **options).writeStream.outputMode("append").format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table("steps").filter("path <> 'end'")


def test_keys(spark):
    keys = every_state_key(spark)
    assert keys.count() == keys.distinct().count() == 378
    assert queries.event_states(spark, D).select("state_key").distinct().join(keys, "state_key", "left_anti").count() == 0


def test_steps_of_a_shuffled_stream(keyed, tmp_path):
    spark = keyed
    made = queries.event_states(spark, D).filter("path < '2'").select("path", "target", F.col("seq").alias("action_index"), "state_key", "bucket")
    observed = made.select("path", "target").distinct().select("path", "target", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("observer")).withColumn("dead", F.when(F.col("observer") == "x", "AhKh").otherwise(""))
    clock = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(mins="action_index")
    rows = made.join(observed, ["path", "target"]).select("path", "observer", "target", "dead", F.col("action_index").cast("int"), "state_key", "bucket", clock.alias("ts")).collect()
    assert len(rows) > 100
    # dealt without regard to time: every batch holds rows older than those of the one before
    parts = [[r for r in rows if hash((r.path, r.action_index)) % 3 == i] for i in range(3)]
    names = ["path", "observer", "target", "step", "state_key", "action_bucket", "top_class"]
    numbers = [F.round(c, 8).alias(c) for c in ("effective_size", "top_probability", "evidence")]
    got = streamed(spark, parts, tmp_path, late="1 day").select(*names, *numbers).collect()
    want = R.filter_steps(made, observed).select(*names, *numbers).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_rows_and_ended_hands(keyed, tmp_path):
    key = "btn|three_way|facing_bet|raises_0|deep"
    row = lambda path, i, ts: (path, "o", "t", "", i, key, 1, ts)
    parts = [
        [row("a", 1, "2024-01-01 10:00:00"), row("a", 3, "2024-01-01 10:20:00"), row("b", 0, "2024-01-01 12:00:00")],
        [row("a", 2, "2024-01-01 11:10:00"), row("b", 1, "2024-01-03 12:00:00")],
        [row("a", 0, "2024-01-01 10:10:00"), row("b", 2, "2024-01-03 12:10:00")],
    ]
    got = {}
    for r in streamed(keyed, parts, tmp_path, late="30 minutes", idle_seconds=3600).orderBy("path", "action_index").collect():
        got.setdefault(r.path, []).append((r.action_index, r.step))
    # 10:10 comes when the time up to 11:30 has been passed; the others are in the order of their times
    assert got["a"] == [(1, 1), (2, 3), (3, 2)]
    # two days without a decision end a hand: its filter starts again
    assert got["b"] == [(0, 1), (1, 1), (2, 2)]
