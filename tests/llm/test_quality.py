import random
from collections import Counter

from rangeloom.llm.quality import FEATURES, RULES, Cascade, Rule, Text, cascade_of, judge, measured, ordered


def brute_repeat(text):
    w = text.encode().split()
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)})


def test_repeat_words():
    rng = random.Random(3)
    for n in [0, 1, 7, 8, 9, 15, 16, 17, 40, 300]:
        for kinds in (1, 2, 3, 50):
            t = " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
            assert Text(t).n_repeat_words == brute_repeat(t)


def test_features():
    t = Text("a#b  c\n\n x \na#b  c\n x \x0b\n x ")
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines) == (7, 11, 2, 2)
    assert Text(None).base_failed and Text("").n_words == 0


def test_order_never_changes_the_verdict(documents):
    texts = [r.text for r in documents.collect()]
    plain = [Cascade(list(RULES)).first_rejection(Text(t)) is None for t in texts]
    for k in range(3):
        order = random.Random(k).sample(RULES, len(RULES))
        assert [Cascade(order).first_rejection(Text(t)) is None for t in texts] == plain


def estimate(texts, rules):
    return ordered(measured(texts, rules), rules)


def test_cheap_and_selective_rules_run_first():
    prose = " ".join(f"word{i}" for i in range(40))
    slow = Rule("slow", lambda t: sum(i for i in range(20_000)) < 0)
    never, always = Rule("never", lambda t: False), Rule("always", lambda t: True)
    got = estimate([prose] * 20, (slow, never, always))
    assert [r.name for r in got.order] == ["always", "never", "slow"]
    assert got.rejected == {"slow": 0, "never": 0, "always": 1}
    assert [r.name for r in estimate([], (slow, never)).order] == ["slow", "never"]


def test_costs_are_beyond_the_base(spark, documents):
    """Rules on base counts cost next to nothing and run first; texts that fail the base test cost no rule anything."""
    seen = []
    probe = Rule("probe", lambda t: seen.append({n for n in FEATURES if n == "n_words" or n in t.__dict__}) or False)
    assert measured(["too short", None], (probe,)) == [(0, 0.0, 0)] and not seen
    measured([" ".join(f"w{i}" for i in range(30))], (probe,))
    assert seen == [set(FEATURES)]
    cascade = cascade_of(documents.select("text"), sample_rows=100)
    base, own = [r.name for r in RULES[:4]], ("capitals", "digits", "one_word")
    assert max(cascade.cost[n] for n in base) < min(cascade.cost[n] for n in ("loud_words", "one_word"))
    assert {r.name for r in cascade.order} == {r.name for r in RULES} and all(cascade.cost[n] > 0 for n in own)


def test_each_rule_rejects_its_own():
    words = [f"word{i}" for i in range(40)]
    bad = {
        "symbols": " ".join(f"{w} #" for w in words), "repeated_lines": "\n".join(random.Random(1).choices(words[:10], k=80)), "short_words": " ".join("abcdefghijklmnopqrstuvwxyz"),
        "long_words": " ".join(f"{i}" + "x" * 40 for i in range(30)), "loud_words": " ".join(f"{w}!!" for w in words), "capitals": " ".join(w.upper() + "AA" for w in words),
        "digits": " ".join(str(10**6 + i) for i in range(40)), "cut_lines": "\n".join(f"{w} and so..." for w in words), "one_word": " ".join(f"the the word{i}" for i in range(30)),
    }
    assert set(bad) == {r.name for r in RULES}
    for name, text in bad.items():
        assert not Text(text).base_failed and name in [r.name for r in RULES if r.rejects(Text(text))], name
    assert not any(r.rejects(Text(" ".join(words))) for r in RULES)


def test_odd_rows(odd_docs, no_docs):
    rows = judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and judge(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[3].rejected_by == "base"
    assert by[5].n_words == 60_000


def test_labelled_quality(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = judge(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    bad = [r for r in got if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
