"""The driver's contract, and the streaming filter against the batch one."""

from pathlib import Path

import __spark_entry__ as driver
import pytest
from pyspark.sql import functions as F
from rangeloom.functions.likelihood import action_table
from rangeloom.operators.ranges import class_likelihoods
from rangeloom.plans import oracles, queries
from rangeloom.streaming.filter import streaming_likelihoods

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(oracles.oracle_sql()) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    cur = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, D)
    assert sorted(df.columns) == sorted(columns)
    text = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(text, r)) for r in cur.fetchall())


def test_stream_equals_batch(spark, tmp_path):
    made = queries.event_states(spark, D).select("path", "target", "state_key", "bucket").limit(300)
    made.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    table = action_table(batch).cache()
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_likelihoods(stream, table).writeStream.outputMode("complete").format("memory").queryName("likes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("likes").select("path", "target", "class_id", F.round("log_lik", 9).alias("l"), "n")
    want = class_likelihoods(batch, table, ["path", "target"]).select("path", "target", "class_id", F.round("log_lik", 9).alias("l"), "n")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
