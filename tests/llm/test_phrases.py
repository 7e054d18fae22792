import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rangeloom.llm import phrases as P
from rangeloom.llm.phrases import Automaton, coded, collocations, counted, score_of


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts_of(docs, most):
    out = defaultdict(Counter)
    for lang, text in docs:
        for words in pieces_of(text):
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    out[lang or "und" if lang is None else lang][" ".join(words[i : i + k])] += 1
    return out


def brute(docs, most=3, least=10, kept=2000, percent=50):
    rows = []
    for lang, f in counts_of(docs, most).items():
        n = sum(c for p, c in f.items() if " " not in p)
        many = {p: c for p, c in f.items() if " " in p and c >= least}
        best = []
        for p, a in many.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * c >= percent * a for q, c in many.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            best.append((p, a, f[" ".join(w[:k])], f[" ".join(w[k:])], n, s))
        best.sort(key=lambda b: (-b[5], -b[1], b[0].encode()))
        rows += [(lang, i + 1, *b) for i, b in enumerate(best[:kept])]
    return sorted(rows)


def online(pieces):
    """The textbook generalised automaton: states by (longest phrase, length of the shortest, count, longest of the link)."""
    length, link, step, count, longest = [0], [-1], [{}], [0], [()]

    def grow(last, c, word):
        if c in step[last] and length[step[last][c]] == length[last] + 1:
            count[step[last][c]] += 1
            return step[last][c]
        new = len(length)
        length.append(length[last] + 1), link.append(-1), step.append({}), count.append(1), longest.append(word)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
            return new
        q = step[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        clone = len(length)
        length.append(length[p] + 1), link.append(link[q]), step.append(dict(step[q])), count.append(0), longest.append(longest[q][-(length[p] + 1) :])
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        link[q] = clone
        if length[new] == length[clone]:
            # the whole word is the clone
            count[clone] += 1
            count[new] = 0
            link[new] = -2
            return clone
        link[new] = clone
        return new

    for words in pieces:
        last = 0
        for i, c in enumerate(words):
            last = grow(last, c, tuple(words[: i + 1]))
    live = [i for i in range(1, len(length)) if link[i] != -2]
    for i in sorted(live, key=lambda i: -length[i]):
        if link[i] > 0:
            count[link[i]] += count[i]
    return sorted((longest[i], length[link[i]] + 1, count[i], longest[link[i]] if link[i] > 0 else None) for i in live)


@pytest.mark.parametrize("seed", range(6))
def test_states_are_those_of_the_online_construction(seed):
    rng = random.Random(seed)
    pieces = [[rng.choice("ab c".split() + ["d"] * (seed % 2)) for _ in range(rng.randint(1, 7))] for _ in range(12)]
    codes, dictionary, cut = coded([" ".join(p).encode() for p in pieces])
    made = Automaton(codes, -1 if cut < 0 else cut, len(dictionary), 8)
    names = dictionary.to_pylist()
    text = lambda s: None if s is None else tuple(names[c].decode() for c in s)
    got = sorted((text(s), low, n, text(link)) for s, low, n, link in made.states() if s != (cut,))
    assert got == online(pieces)


def test_automaton_enumerates_all_bounded_phrases():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Aa", "b.", "c", "d,e"]) for _ in range(60)) for _ in range(5)]
    codes, dictionary, cut = coded([t.encode() for t in texts])
    made, names = Automaton(codes, cut, len(dictionary), 3), dictionary.to_pylist()
    got = {}
    for k in (1, 2, 3):
        for *words, n in zip(*made.words(k), made.nodes[k - 1]["count"]):
            if n and words != [cut]:
                got[" ".join(names[w].decode() for w in words)] = int(n)
    assert got == counts_of([("x", t) for t in texts], 3)["x"]


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("most", "shard"), [(2, 1 << 20), (3, 300), (4, 1 << 20)])
def test_mined_against_loops(spark, most, shard):
    rng = random.Random(most)
    vocab = ["The", "the", "of", "new", "york", "x", "é", "ß q", "a\x1cb"]
    rows = [(k, rng.choice(["en", "de", None, ""]), " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", "\n", "\t", " ,"]) for _ in range(40))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    got = rows_of(collocations(df, most_words=most, least=6, shard_bytes=shard))
    assert got == brute([r[1:] for r in rows], most, 6) and got


def test_odd_rows(spark, odd_docs, no_docs):
    got = rows_of(collocations(odd_docs, least=2))
    assert got == brute([(d.lang, d.text) for d in odd_docs.collect()], least=2) and {r[0] for r in got} == {"en"}
    assert collocations(no_docs).collect() == []


def test_kept_and_ties(spark):
    rows = [(k, "en", "a b. c d. e f. g h i") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = rows_of(collocations(df, kept=3))
    # 'g h' and 'h i' lie inside the longer 'g h i'
    assert [r[2] for r in got] == ["a b", "c d", "e f"] and got == brute([r[1:] for r in rows], kept=3)
    assert [r[2] for r in rows_of(collocations(df))] == ["a b", "c d", "e f", "g h i"]


def test_filter_holds_back_no_frequent_phrase(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, "en", " ".join(rng.choice(["u", "v", "w", f"r{rng.randint(0, 300)}"]) for _ in range(50))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {p: c for p, c in counts_of([r[1:] for r in rows], 3)["en"].items() if c >= 10}
    for most_bits in (P.MOST_FILTER_BITS, 1 << 16):
        monkeypatch.setattr(P, "MOST_FILTER_BITS", most_bits)
        assert {r.phrase: r.f for r in counted(df)[0].collect()} == want
    frequent = counted(df)[0].filter("words = 2").select("lang", "phrase")
    held, bits = P.filter_of(frequent, frequent.count())
    word = lambda w: np.array([P._digest(w.encode())], np.uint64)
    passes = lambda p: all(held[at[0] >> 3] >> (at[0] & 7) & 1 for at in P.places(P.digests("en", [word(w) for w in p.split()]), bits))
    assert all(passes(p) for p in want if p.count(" ") == 1)
    assert sum(passes(f"r{k} r{k + 1}") for k in range(300)) < 30


def test_exact_scores(spark):
    cases = [(10**14, 10**14 + 1, 10**14 + 7), (10, 999_999_999_999_999, 10), (123_456_789_012, 123_456_789_013, 987_654_321_098), (10, 10, 10)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in df.select(score_of(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (l * r) for a, l, r in cases]
