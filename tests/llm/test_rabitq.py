import numpy as np
import pytest
from pyspark.sql import functions as F
from rangeloom.llm import rabitq
from rangeloom.llm.rabitq import encode, estimates, rotation, search


def brute(rows, every, k):
    """{row number of the query: (id, [(distance, id)])}; each row is a row of its own, those without an id come last among equals."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, v) in enumerate(good):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i is None, i or 0) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))
            out[n] = (q, [(d, None if none else i) for d, none, i in near[:k]])
    return out


def answers(got):
    """The answers to all queries, each a list by rank, in any order of queries."""
    whole, lists = sorted(((r.query_id, r["rank"], r.score, -1 if r.vec_id is None else r.vec_id) for r in got)), []
    ids = {}
    for q, rank, score, i in whole:
        ids.setdefault(q, {}).setdefault(rank, []).append((score, i))
    for q, by in ids.items():
        lists.append((q, [sorted(by[k]) for k in sorted(by)]))
    return lists


def expected(want):
    ids = {}
    for q, near in want.values():
        for k, (d, i) in enumerate(near):
            ids.setdefault(q, {}).setdefault(k, []).append((d, -1 if i is None else i))
    return [(q, [sorted(by[k]) for k in sorted(by)]) for q, by in sorted(ids.items())]


def recall(rows, got, every, k):
    want, found = dict(brute(rows, every, k).values()), {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(found) <= set(want)
    hit = 0
    for q, near in want.items():
        mine = sorted(found.get(q, []))
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hit += len({x[2] for x in mine} & {i for _, i in near})
    return hit / max(1, sum(map(len, want.values())))


def test_small_tables_are_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(rows, search(df).collect(), 100, 10) == 1


def test_recall_over_lists(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(rows, search(df, list_rows=20).collect(), 100, 10) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 200, 5)] + [(1001 + i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    rows += [(20, [1.0, 2.0, 3.0]), (2000, None), (2010, [0.0, 0.0, 0.0]), (2020, [1.0, None, 2.0]), (2030, [float("nan"), 1.0, 1.0]), (2040, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (2050, [1.0, 2.0]), (2060, [2.0, 2.0]), (2070, []), (2080, [-0.0, 1.0, 0.0]), (2090, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, key string")
    assert answers(search(df, every=10).collect()) == expected(brute(rows, 10, 10))
    assert search(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_all_candidates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in (5, 200, 200, 7, None, None)] + [rows[17], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df).collect()
    want = brute(rows, 100, 10)
    assert answers(got) == expected(want) and len(got) == 60
    # the copy of a query is its nearest, and the other rows of its id are among those it may find
    assert sum(r.query_id == 100 and r.vec_id == 100 and r["rank"] == 1 and r.score == 0 for r in got) == 2


def test_a_list_that_all_visit_is_cut_by_entries_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name, size in (("BLOCK_ENTRIES", 50), ("TASK_QUERIES", 20), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(rabitq, name, size)
    seen = []
    found = rabitq._found

    def watched(pairs, lists, k):
        seen.extend(r["n"] for r in pairs.groupBy("dim", "list", "block", "part").agg(F.count("*").alias("n")).collect())
        return found(pairs, lists, k)

    monkeypatch.setattr(rabitq, "_found", watched)
    assert answers(search(df, every=3).collect()) == expected(brute(rows, 3, 10))
    # one list for all: 18 blocks of entries by 15 of queries, none much larger than the others
    assert len(seen) > 200 and max(seen) < 3 * float(np.median(seen))


@pytest.mark.parametrize("d", [8, 64])
def test_bounds_hold(d):
    rng = np.random.default_rng(d)
    x, q, c, turn = rng.normal(size=(400, d)), rng.normal(size=(20, d)), rng.normal(size=d) * 0.1, rotation(d)
    low, high = estimates(q, c, turn, *encode(x, c, turn))
    true = ((q[:, None, :] - x[None]) ** 2).sum(2)
    assert ((low <= true + 1e-6) & (true <= high + 1e-6)).mean() > 0.99
    assert np.abs((low + high) / 2 - true).mean() < 0.5 * true.mean()
