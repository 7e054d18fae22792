import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rangeloom.llm.toxicity import HALF_Z2, HASH_BITS, NGRAMS, RIDGE, Model, classify, features, fit, ratios, train, training_rows

D = "/root/testdata/sf0.1"
MIX, MASK = 0x9E3779B1, 0xFFFFFFFF


def plain_features(text, bits=HASH_BITS):
    """The features of a text, n-gram by n-gram."""
    text, out = f" {(text or '').lower()} ", set()
    for n in NGRAMS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = ((h ^ ord(c)) * MIX) & MASK
                h ^= h >> 15
            out.add((((h * MIX) & MASK) >> (32 - (bits - 1))) + (NGRAMS.index(n) << (bits - 1)))
    return out


def test_features_are_those_of_each_text_alone():
    texts = ["abc", "", None, "bcd" * 50, "abc", "\x02 torn \x02\x02 in the middle \x02", "\x00", "Ünï \U0001f600 end", "the last of them"]
    got = [f.tolist() for f in features(texts)]
    assert all(len(f) == len(set(f)) for f in got) and [set(f) for f in got] == [plain_features(t) for t in texts]
    model = Model(np.random.default_rng(1).normal(size=1 << HASH_BITS).astype(np.float32), -1.0)
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]))
    assert list(features([])) == [] and list(features(["x" * 2_100_000, "y"]))[1].tolist() == list(features(["y"]))[0].tolist()


def test_ratios_shrink_but_drop_nothing():
    r = ratios(np.array([0.0, 1, 50, 0, 0]), np.array([0.0, 0, 0, 50, 1]), 100, 900)
    assert r[0] == 0 and r[2] > r[1] > 0 > r[4] > r[3]
    full = np.log((50 + 0.1) / 100) - np.log(0.9 / 900)
    z2 = full**2 / (1 / 50.1 + 1 / 0.9)
    assert r[2] == pytest.approx(full * z2**2 / (z2**2 + HALF_Z2**2), rel=1e-6)


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(2)
    y = np.array([1] * 8 + [0] * 24)
    sets = [np.flatnonzero(rng.random(12) < (0.7 if k else 0.2) * np.linspace(0.2, 1, 12)).astype(np.int32) for k in y]
    got = fit(sets * 20, np.tile(y, 20), 12)
    # the same objective by plain gradient steps
    count = np.zeros((2, 12))
    for f, k in zip(sets * 20, np.tile(y, 20)):
        count[k][f] += 1
    ratio, x = ratios(count[1], count[0], 160, 480), np.zeros((32, 12))
    for i, f in enumerate(sets):
        x[i, f] = ratio[f]
    x = np.hstack([x, np.ones((32, 1))])
    share = np.where(y == 1, 32 / 16, 32 / 48)
    w = np.zeros(13)
    for _ in range(60_000):
        w -= 0.05 * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) / 32 + RIDGE * w)
    mine = np.append(np.divide(got.weight, ratio, out=np.zeros(12), where=ratio != 0), got.bias)
    loss = lambda v: (share * np.logaddexp(0, -np.where(y == 1, 1, -1) * (x @ v))).mean() + RIDGE / 2 * v @ v
    assert loss(mine) == pytest.approx(loss(w), rel=0.01)


def test_scores_against_plain_loops(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text")), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = train(docs, labels, bits=16)
    count, n = np.zeros((2, 1 << 16)), [0, 0]
    for r in training_rows(docs, labels).collect():
        n[r.toxic] += 1
        count[r.toxic][list(plain_features(r.text, 16))] += 1
    seen = ratios(count[1], count[0], n[1], n[0]) != 0
    assert np.array_equal(seen & (model.weight != 0), model.weight != 0) and seen.any()
    text = docs.collect()
    z = [model.bias + sum(float(model.weight[f]) for f in plain_features(r.text, 16)) for r in text]
    assert np.allclose(model.score([r.text for r in text]), 1 / (1 + np.exp(-np.array(z))))


def test_labels_of_other_corpora_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words there") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic").unionByName(spark.range(1000, 5000).selectExpr("id as doc_id", "0 as toxic"))
    rows = training_rows(docs, labels, rows=50)
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert training_rows(docs, labels, chars=100).count() == 0 < training_rows(docs, labels, chars=320).count() <= 20


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    hit = sum(r.predicted for r in held if r.toxic)
    # one in eight of the toxic rows here has no text that sets it apart
    assert hit >= 0.85 * sum(r.toxic for r in held) and sum(r.predicted for r in held if not r.toxic) <= 0.005 * len(held)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ids = [r.doc_id for r in training_rows(docs, labels).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(train(docs, labels).weight, train(docs, turned).weight)
    assert training_rows(docs, labels, 10).count() == 10


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x"), (3, 0, "x"), (3, 1, "x")], "doc_id long, toxic int, text string")
    got = classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert classify(no_docs, labels).count() == 0
    none = classify(odd_docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
