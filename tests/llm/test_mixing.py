import random

import pytest
from pyspark.sql import functions as F
from rangeloom.llm import mixing
from rangeloom.llm.common import word_count
from rangeloom.llm.mixing import balanced_copies, fly, land, mix_documents, source_targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """The resharing as it is stated: give by weight, stop at the cap, share the excess again."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while left > 1e-9 and open_:
        total = sum(w[n] for n in open_)
        give = {n: left * w[n] / total for n in open_}
        left = 0.0
        for n, g in give.items():
            target[n] += g
            if target[n] >= cap * sizes[n]:
                left += target[n] - cap * sizes[n]
                target[n] = cap * sizes[n]
                open_.discard(n)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_match_the_stated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(rng.paretovariate(0.7) * 50) for i in range(11)} | {None: 70, "Ω": 3, "zero": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = brute_targets(sizes)
    for r in source_targets(df, "source", "size").collect():
        assert r.target == pytest.approx(want[r.source], abs=1e-6)


def test_flight_keeps_both_totals():
    rng = random.Random(5)
    x = [float(rng.randrange(1, 5000)) for _ in range(3000)]
    p = [rng.random() for _ in x]
    want_n, want_x = sum(p), sum(a * b for a, b in zip(p, x))
    left = fly(p, x, random.Random(1))
    assert len(left) <= 2 and sum(p) == pytest.approx(want_n, abs=1e-5) and sum(a * b for a, b in zip(p, x)) == pytest.approx(want_x, rel=1e-7)
    land(p, x, left)
    assert set(p) <= {0.0, 1.0}


def test_flight_keeps_inclusion_probabilities():
    p0 = [0.3, 0.3, 0.5, 0.9, 0.25, 0.75]
    hits = [0] * len(p0)
    for k in range(4000):
        p = list(p0)
        fly(p, [3.0, 8.0, 5.0, 2.0, 9.0, 4.0], random.Random(k))
        hits = [h + v for h, v in zip(hits, p)]
    assert all(h / 4000 == pytest.approx(q, abs=0.03) for h, q in zip(hits, p0))


def test_documents(spark, documents):
    out = mix_documents(documents)
    rows = out.collect()
    assert sorted(rows) == sorted(mix_documents(documents.repartition(5)).collect())
    want = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    assert {r.doc_id: r["size"] for r in rows} == want
    assert all(r.taken <= 2 * r["size"] for r in rows)
    by = out.join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"))
    assert all(abs(r.t - r.g) <= r.m for r in by.collect())


def test_every_source_comes_within_a_hundredth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.01 * r.g, r


def test_rows_that_are_all_alike_are_dealt_to_bounded_blocks(spark, monkeypatch):
    df = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.lit(3).alias("n"))
    df = df.union(spark.range(50_000).select("id", F.lit("two"), F.lit(1))).repartition(6)
    real = mixing._rounder

    def watched(level, last, seed):
        run = real(level, last, seed)

        def checked(block):
            assert len(block) < 2000, len(block)
            return run(block)

        return checked

    monkeypatch.setattr(mixing, "_rounder", watched)
    got = {r.source_size: r for r in balanced_copies(df, "doc_id", "source", F.col("n"), block_rows=1000, weights=(1, 2)).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.count("*").alias("n")).collect()}
    assert {r.n for r in got.values()} == {50_000} and all(abs(r.t - r.target) <= 4 for r in got.values())


def test_many_blocks_and_levels(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), (F.col("id") * 37 % 501 + 1).alias("n"))
    df = df.union(spark.range(300).select(F.col("id") + 20_000, F.concat(F.lit("s"), F.col("id") % 5), F.col("id") + 1))
    out = balanced_copies(df, "doc_id", "source", F.col("n"), block_rows=50)
    got = out.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 20_300 and all(abs(r.t - r.target) <= 501 for r in got)


def test_many_sources_join_by_key(spark, monkeypatch):
    """Beyond the bound for broadcasting the sources' parameters, the same rows come from the spread join."""
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 17}", i % 40 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    want = sorted(map(tuple, balanced_copies(df, "doc_id", "source", F.col("n")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, balanced_copies(df, "doc_id", "source", F.col("n")).collect())) == want and len(want) == 3000


def test_odd_rows(odd_docs, no_docs):
    rows = mix_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r.doc_id is None for r in rows) == 1
    assert mix_documents(no_docs).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a  b\tc\x0bd e",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [4, 0, 0]
