"""Long days, and work that must grow with the input: shuffled and written bytes are counted by what plans hold."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from rangeloom.plans import oracles, queries


def against_sql(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    for t in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t if t.is_file() else t / '*.parquet'}')")
    cur = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    text = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(text, r)) for r in cur.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in queries.queries()[name](spark, str(folder)).collect()) == want
    return want


@pytest.fixture(scope="module")
def long_days(spark, tmp_path_factory):
    """Days of 1 to 24 events."""
    out, rows = tmp_path_factory.mktemp("long"), []
    for user in range(24):
        for k in range(user + 1):
            rows.append((len(rows), datetime(2024, 1, 1) + timedelta(minutes=k), user, ("view", "click", "signup", "purchase")[(user + k) % 4], 10.0 * k))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(out / "events.parquet"))
    return out


@pytest.mark.parametrize("name", ["hand_boards", "hand_replay", "violations", "hand_files", "hand_holes", "hand_states"])
def test_days_longer_than_a_deck(spark, long_days, name):
    want = against_sql(spark, name, long_days)
    assert name != "hand_boards" or max(r[1] for r in want) == "4"


def test_dead_cards_share_patterns_of_suits(spark):
    from itertools import combinations

    from pyspark.sql import functions as F
    from rangeloom.functions.cards import RANKS, SUITS, text_bits
    from rangeloom.operators import ranges as R

    deck = [r + s for r in RANKS for s in SUITS]
    two = spark.createDataFrame([(a + b,) for a, b in combinations(deck, 2)], "dead string")
    assert R.with_pattern(two).select("pattern").distinct().count() == 169
    dead = two.limit(200).union(spark.createDataFrame([("",), ("ahKd",), ("".join(deck[3:40:4]),), ("".join(deck[:50]),)], "dead string"))
    rows = R.prior_counts(dead).withColumn("want", R.counts_left(text_bits(F.col("dead")))).collect()
    assert len(rows) == 204 and all(r.counts == r.want and r.total == sum(r.want) for r in rows)


def test_classes_of_texts(spark):
    from pyspark.sql import functions as F
    from rangeloom.functions.cards import RANKS, SUITS, cards, hand_class, text_class

    deck = [r + s for r in RANKS for s in SUITS]
    rows = spark.createDataFrame([(a + b,) for a in deck for b in deck if a != b] + [("ahKd",), (" 2C2d",)], "c string")
    assert rows.filter(text_class(F.col("c")) != hand_class(cards(F.col("c")))).count() == 0
    with pytest.raises(Exception, match="Duplicate cards"):
        spark.createDataFrame([("AhAh",), ("AHAH",)], "c string").select(text_class(F.col("c"))).collect()


def test_documents_hold_each_range_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from rangeloom.plans.derived import hands
    from rangeloom.plans.documents import read_documents, write_documents

    out = tmp_path / "out"
    told = write_documents(hands(spark, "/root/testdata/sf0.001"), str(out), phi=0.5, k=3, quarantine=True)
    ranges = spark.read.json(str(out / told["run"] / "ranges"))
    rows = read_documents(spark, str(out))[2]
    moves = F.array_sort(F.transform("decisions", lambda d: F.concat_ws(":", d["state_key"], d["action_bucket"])))
    assert told["rows"] == rows.count() > ranges.count() == rows.select("observer_hole_cards", moves).distinct().count()
    assert rows.filter(F.size("range_vector") != 169).count() == 0
    size = sum(f.stat().st_size for f in (out / told["run"] / "rows").glob("part-*"))
    assert size < 800 * told["rows"]


def test_ranges_settled_once_are_those_of_every_pair(spark):
    from pyspark.sql import functions as F
    from rangeloom.operators import postflop as P
    from rangeloom.operators import ranges as R
    from rangeloom.operators.replay import boards

    every, t, acts, holes = queries._acts(spark, "/root/testdata/sf0.001")
    made, pairs = R.decisions(acts), R.pairs(every, holes)
    rows = R.seen(made, pairs)
    assert not [f for f in rows.dtypes if "double" in f[1]]
    assert R.settled(rows, R.action_table(made), R.whole()).count() == rows.select("moves", "dead").distinct().count() < rows.count()
    told = lambda df, c: sorted((r.path, r.observer, r.target, round(r[c], 12)) for r in df.collect())
    whole = R.range_vectors(made, pairs)
    assert told(R.true_classes(made, pairs, holes), "true_class_probability") == told(R.true_class(whole, holes), "true_class_probability")
    value = lambda df: df.withColumn("v", P.strength_value(F.col("p")))
    assert told(value(P.later_ranges(made, pairs, boards(t), acts)), "v") == told(value(P.later_streets(whole, boards(t), acts)), "v")
