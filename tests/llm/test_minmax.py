import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rangeloom.llm.minmax import Shingler, _links, band_values, bands_of, components, document_of, linked, near_duplicates, node_of, one_of_each, signature


def brute(rows, k=3, percent=85):
    """All pairs, on the words themselves."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def compare(spark, rows, **more):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def family(rng, n, base=60, edits=6):
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(base)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_of_graded_copies(spark):
    rng = random.Random(4)
    texts = family(rng, 120) + [t for _ in range(40) for t in family(rng, 3)] + [f"Only {i}" for i in range(5)] + ["only 1", "ONLY 1", "", "  ", "a b c", "A  b\tc"]
    rng.shuffle(texts)
    compare(spark, [(i * 3 + 1, t) for i, t in enumerate(texts)], block_members=16)


def test_hot_bucket_of_many_components(spark):
    """Families that share every band through one text each are not, so one bucket is forced: links across blocks are all found."""
    rng = random.Random(12)
    texts = family(rng, 90, base=80, edits=3) + family(rng, 60, base=80, edits=12)
    rows = list(enumerate(texts))
    compare(spark, rows, block_members=4)


def test_links_keep_texts_that_share_an_id(spark):
    """One comparison with two different texts of one document: both are held."""
    shingler, rng = Shingler(), random.Random(3)
    a, b = family(rng, 1)[0], family(rng, 1)[0]
    sets = [shingler.sets(x) for x in (a, a + " more", b, b + " more")]
    rows = [(1, 0, 0, bytes([k]), s.tobytes()) for k, s in enumerate(sets)]
    links = _links(spark.createDataFrame(rows, "bucket long, i int, j int, node binary, shingles binary"), 85).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in links) == [(b"\0", b"\1"), (b"\2", b"\3")]
    got = near_duplicates(spark.createDataFrame([(1, a), (5, a + " more"), (5, b), (9, b + " more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]


def test_rows_that_stay(spark):
    rows = [(1, "t one two three four five six", "x"), (5, "t one two three four five six", "x"), (5, "u another text of some words", "x"), (5, "u another text of some words", "a"), (None, "t one two three four five six", "x"), (7, None, "x"), (7, "", "x")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"), 80, 5).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.source) for r in got) == [(0, rows[0][1], "x"), (1, rows[0][1], "x"), (5, rows[2][1], "a"), (7, "", "x")]


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (3, 85), (1, 90)])
def test_other_shingles_and_thresholds(spark, words, percent):
    rng = random.Random(words)
    rows = list(enumerate(family(rng, 60, base=100, edits=8) + [t for _ in range(20) for t in family(rng, 3)]))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, words).collect()
    assert sorted(map(tuple, got)) == brute(rows, words, percent)


def test_long_words_are_not_remembered():
    shingler = Shingler()
    a, b = shingler.sets("x" * 500 + " y z w"), shingler.sets("x" * 500 + " y z w")
    assert np.array_equal(a, b) and set(shingler.known) == {b"y", b"z", b"w"}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    compare(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    hits = np.mean(signature(a, 55) == signature(b, 55))
    assert abs(hits - 900 / 1100) < 0.15
    assert (band_values(85), band_values(80)) == (5, 4) and len(bands_of(a, 4)) == 22


def test_blocks_agree_with_pairs():
    rng, shingler = random.Random(9), Shingler()
    texts = family(rng, 30) + family(rng, 30, base=400, edits=40)
    sets = [shingler.sets(t) for t in texts]
    rows = list(enumerate(texts))
    comp = dict(enumerate(range(60)))
    for a, b in linked(list(range(60)), sets):
        comp[b] = a
    assert [comp[i] for i in range(60)] == [r[2] for r in brute(rows)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21)] + [(100 + i, 101 + i) for i in range(40)] + [(i, 500) for i in range(300, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(i, i) for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and {got[i] for i in range(101, 141)} == {100} and got[500] == 300 and got[399] == 300


def test_keys_of_classes_sort_like_documents(spark):
    ids = [-(2**63), -5, -1, 0, 1, 255, 256, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(i, b"k") for i in reversed(ids)], "d long, k binary").withColumn("n", node_of(F.col("d"), F.col("k")))
    assert [(r.d, r.b) for r in df.select("d", "n", document_of(F.col("n")).alias("b")).orderBy("n").collect()] == [(i, i) for i in ids]


def test_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 3, None, True)} <= rows
    assert near_duplicates(no_docs).count() == 0
