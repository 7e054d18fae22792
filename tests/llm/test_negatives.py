import math
import random

import numpy as np
import pytest
from rangeloom.llm import negatives as N
from rangeloom.llm.negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, row string, dim string, score double"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """Plain loops over (id, vector, label) with Python's integers."""
    kept = []
    for name, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((name, [math.floor(256 * x) for x in v], label))
    out = []
    last = lambda name: (name is None, name or 0)
    for i, (name, v, label) in enumerate(kept):
        if name is None or name % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, l) for j, (other, w, l) in enumerate(kept) if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, own, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(name, own, k + 1, other, p, n) for k, (n, other, _) in enumerate(found)]
    return sorted(out, key=repr)


def found(df, **options):
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    return sorted((tuple(r) for r in mine(df, **options).collect()), key=repr), cut


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 0.0) for r in rows], SCHEMA).repartition(parts)


def test_random_rows_against_loops(spark):
    rng = random.Random(5)
    # few values, so that scores tie; a label that holds most rows
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.75]) for _ in range(4)], rng.choice([0, 0, 0, 1, 2])) for k in range(400)]
    got, _ = found(made(spark, rows), every=20)
    assert got == brute(rows, every=20) and len(got) > 100


def test_blocks_and_chunks(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(N, "CHUNK_ROWS", 7)
    monkeypatch.setattr(N, "CHUNK_ANCHORS", 3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(3)], rng.choice([0, 1])) for k in range(150)]
    rows = [(k, [float(np.float32(x)) for x in v], l) for k, v, l in rows]
    got, _ = found(made(spark, rows), every=10, block_bytes=400)
    assert got == brute(rows, every=10) and got


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.8, 0.25], 2), (3, [0.7, 0.5], 3), (3, [0.7, 0.5], 3),
        (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 2), (8, [1.0, 1.0], None),
        (None, [0.8, 0.25], 2), (None, [1.0, 0.5], 1), (100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 2.0], 1), (102, [0.5, 1.0, 1.5], 4), (150, [], 1), (151, [], 1), (152, [], 2), (200, [0.0, 0.0], 9),
    ]
    got, _ = found(made(spark, rows))
    assert got == brute(rows)
    assert any(r[1] is None for r in got) and any(r[0] == r[1] for r in got) and any(r[0] == 150 for r in got)


def test_scores_beyond_doubles(spark):
    big = 2.0**40
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 1), (3, [big * 0.75, 5.0], 2), (4, [big * 0.75, 4.0], 2), (5, [1.0, 1.0], 2), (6, [-big, 1.0], 2)]
    got, cut = found(made(spark, rows))
    assert got == sorted([(*r[:4], cut(r[4]), cut(r[5])) for r in brute(rows)], key=repr) and {r[1] for r in got} == {1, 2}


def test_order_of_big_scores():
    numbers = [10**30, 2**63, 10**30 + 1, 10**25]
    assert sorted(numbers) == sorted(numbers, key=lambda x: N._sortable(str(x)))
    assert sorted(-x for x in numbers) == sorted((-x for x in numbers), key=lambda x: N._sortable(str(x)))


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [0.75], 2)]])
def test_nothing_to_find(spark, rows):
    assert mine(made(spark, rows)).collect() == []
