import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from rangeloom.llm.pii import LABELERS, PROOFS, Model, annotate, candidates, decide, em, find_documents, fit, redact, redacted

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = [(kind, m.start(), m.end()) for kind, rx in KINDS.items() for m in rx.finditer(text or "") if valid(kind, m[0])]
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(k == kind for k, _, _ in spans) for kind in KINDS], hashlib.sha256(line.encode()).hexdigest(), spans


def compare(docs):
    rows = find_documents(docs).collect()
    got = sorted(((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in rows), key=repr)
    assert got == sorted(((d.doc_id, *brute(d.text)[:2]) for d in docs.collect()), key=repr)
    return rows


def test_documents(spark):
    rows = compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows)


def test_noise(spark):
    rng = random.Random(11)
    bits = ["a", "B.", "_", "%", "@", ".", "-", " ", "(", ")", "+", "1", "25", "256", "000", "4111 1111 1111 1111", "5500-0000-0000-0004", "é", "\U0001f600", "\n", "x@y.z", "10.0.0.1"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(50)))) for i in range(800)]
    compare(spark.createDataFrame(docs, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    compare(odd_docs)
    assert find_documents(no_docs).count() == 0
    compare(spark.createDataFrame([(1, "1" * 100_000 + " " + "a" * 100_000), (2, "1 " * 30_000 + "a@" + "b." * 20_000 + "c"), (3, "+" + "1-" * 30_000 + "1")], "doc_id long, text string"))


def voted(rng, n, share, accuracies, abstain=0.0):
    votes = {}
    for _ in range(n):
        z = rng.random() < share
        p = tuple(0 if rng.random() < abstain else (1 if z == (rng.random() < a) else -1) for a in accuracies)
        votes[p] = votes.get(p, 0) + 1
    return votes


def test_em_finds_the_reliable_labelers():
    """Three informative labelers determine the model; with two it is not determined."""
    prior, table, truth = em(voted(random.Random(1), 6000, 0.4, (0.95, 0.9, 0.8)))
    assert prior == pytest.approx(0.4, abs=0.03)
    assert [t[1][2] for t in table] == pytest.approx([0.95, 0.9, 0.8], abs=0.03) and [t[0][0] for t in table] == pytest.approx([0.95, 0.9, 0.8], abs=0.03)
    assert truth[(1, 1, -1)] > 0.9 and truth[(-1, -1, 1)] < 0.1


def test_reliabilities_are_of_each_kind(spark):
    """A labeler that is right on one kind and random on another is told apart, and one that never votes takes no part."""
    rng, rows = random.Random(3), []
    for kind, acc in (("local_phone", (0.95, 0.9, 0.85)), ("email", (0.55, 0.9, 0.95))):
        for p, n in voted(rng, 3000, 0.5, acc).items():
            rows += [(kind, [p[0], 0, p[1], p[2], 0], [f"kind={kind}"])] * n
    df = spark.createDataFrame(rows, "kind string, votes array<int>, features array<string>")
    model = fit(df.select(F.array(F.struct(*df.columns)).alias("c")))
    assert set(model.reliability) == {"local_phone", "email"} and set(model.reliability["local_phone"]) == {LABELERS[0], LABELERS[2], LABELERS[3]}
    assert model.reliability["local_phone"]["strict"][1][2] == pytest.approx(0.95, abs=0.04) and model.reliability["email"]["strict"][1][2] == pytest.approx(0.55, abs=0.06)


def test_method_adds_spans_and_keeps_base_ones(spark):
    texts = [f"please call ({200 + i}) 555-{1000 + i} or mail u{i}@host{i}.com, card 4111 1111 1111 1111." for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "+1 (658) 555-4270")], "doc_id long, text string")
    by = {r.doc_id: r.spans for r in compare(docs)}
    assert sum("local_phone:" in s for s in by.values()) == 40 and by[99] == "phone:0:17"
    assert all({f"{k}:{a}:{b}" for k, a, b in brute(t)[2]} <= set(by[i].split(",")) for i, t in enumerate(texts))


def bad_card(rng):
    digits = [rng.randrange(10) for _ in range(16)]
    while valid("card", "".join(map(str, digits))):
        digits[-1] = (digits[-1] + 1) % 10
    return "".join(map(str, digits))


def test_added_spans_against_decoys(spark):
    """Precision and recall of what the method adds, over texts whose personal data is known; look-alikes outnumber it."""
    rng, docs, true = random.Random(21), [], {}
    for k in range(600):
        said, spans, text = [], set(), ""
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(["local", "id", "card", "order", "version", "octets", "part", "dead"])
            number = {
                "local": lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(rng.randrange(201, 990), rng.randrange(200, 999), rng.randrange(1000, 9999)),
                "id": lambda: f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
                "card": lambda: bad_card(rng),
                "order": lambda: " ".join(bad_card(rng)[i : i + 4] for i in (0, 4, 8, 12)),
                "version": lambda: f"{rng.randrange(300, 999)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(300, 900)}",
                "octets": lambda: f"256.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
                "part": lambda: f"x{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}z",
                "dead": lambda: f"000-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
            }[kind]()
            word = {"local": "call", "id": "ssn", "version": "release", "octets": "release", "part": "item", "dead": "item"}.get(kind, "edan threined ering")
            text += f"{word} {number} thsh the plain words "
            if kind in ("local", "id"):
                spans.add(("local_phone" if kind == "local" else "national_id", text.rindex(number), text.rindex(number) + len(number)))
            said.append(kind)
        docs.append((k, text))
        true[k] = spans
    rows = compare(spark.createDataFrame(docs, "doc_id long, text string"))
    added = {r.doc_id: {(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x} - {s for s in brute(docs[r.doc_id][1])[2]} for r in rows}
    hits, told, there = sum(len(added[k] & true[k]) for k in true), sum(map(len, added.values())), sum(map(len, true.values()))
    assert there > 250 and hits >= 0.95 * there and hits >= 0.95 * told


def test_numbers_that_fail_the_check_digit_are_not_added(spark):
    rows = find_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert all(sum(s.startswith("card:") for s in r.spans.split(",")) == r.n_card for r in rows)


def test_classifier_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, f"please call ({200 + i}) 555-{1000 + i}, ssn {100 + i}-22-{3000 + i}; order {4000 + i} 5000 6000 7001") for i in range(200)]
    proposed = docs.union(spark.createDataFrame(extra, docs.schema)).select("doc_id", candidates(F.col("text")).alias("c")).cache()
    model = fit(proposed)
    rows = [(r.doc_id, x) for r in proposed.collect() for x in r.c]
    truth, n_true = {}, 0.0
    for kind in {x.kind for _, x in rows}:
        votes = [tuple(x.votes) for _, x in rows if x.kind == kind]
        voting = [j for j in range(len(LABELERS)) if any(v[j] for v in votes)]
        counts = {}
        for v in votes:
            p = tuple(v[j] for j in voting)
            counts[p] = counts.get(p, 0) + 1
        soft = em(counts, proofs=tuple(i for i, j in enumerate(voting) if LABELERS[j] in PROOFS.get(kind, ())))[2]
        truth |= {(kind, v): soft[tuple(v[j] for j in voting)] for v in set(votes)}
    yes, both = {}, {}
    for _, x in rows:
        t = truth[x.kind, tuple(x.votes)]
        n_true += t
        for f in x.features:
            yes[f], both[f] = yes.get(f, 0.0) + t, both.get(f, 0) + 1
    odds = {f: math.log((yes[f] + 1) / (n_true + 2)) - math.log((both[f] - yes[f] + 1) / (len(rows) - n_true + 2)) for f in both}
    bias = math.log((n_true + 1) / (len(rows) - n_true + 1))
    assert model.bias == pytest.approx(bias, abs=1e-6) and model.log_odds.keys() == odds.keys() and all(model.log_odds[f] == pytest.approx(odds[f], abs=1e-6) for f in odds)
    want, base_of = {}, {}
    for doc, x in rows:
        if x.base:
            base_of.setdefault(doc, []).append(x)
    for doc, x in rows:
        base = base_of.get(doc, [])
        if x.base or (bias + sum(odds[f] for f in x.features) >= 0 and not any(b.start < x.end and x.start < b.end for b in base)):
            want.setdefault(doc, set()).add((x.kind, x.start, x.end))
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.s} for r in proposed.select("doc_id", decide(F.col("c"), model).alias("s")).collect() if r.s}
    assert got == want and sum(k == "local_phone" for s in got.values() for k, _, _ in s) >= 190


def test_redact(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co now 10.0.0.1", "x"), (2, "nothing", None), (3, None, "y")], "doc_id long, text string, s string")
    spans = annotate(df, ["doc_id"], Model({}, {}, {}, -9.0)).withColumnRenamed("s", "__s")
    got = df.join(spans, "doc_id").select("doc_id", redact(F.col("text"), F.col("__s")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: "é mail [EMAIL] now [IP]", 2: "nothing", 3: None}
    assert df.select(F.size(candidates(F.col("text"))).alias("n")).collect()[2].n == 0


def test_redaction_of_many_spans(spark):
    """Against a walk over the spans, with overlaps and more spans than a block."""
    rng = random.Random(6)
    text = "é".join(rng.choice(["a@b.co", " x ", "10.0.0.1", "\U0001f600"]) for _ in range(900))
    spans, at = [], 0
    for k in range(300):
        start = at + rng.randrange(5)
        end = start + 1 + rng.randrange(9)
        if end > len(text):
            break
        spans.append((k % 4, start, end, ("email", "ip", "card", "phone")[k % 4], True))
        at = start + rng.randrange(4)
    want, pos = [], 0
    merged = []
    for o, a, b, kind, _ in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        want += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    df = spark.createDataFrame([(text, spans)], "text string, s array<struct<ordinal:int,start:int,end:int,kind:string,base:boolean>>")
    assert len(merged) > 70 and df.select(redact(F.col("text"), F.col("s")).alias("t")).first().t == "".join(want) + text[pos:]


def test_redacted_documents_hold_no_base_spans(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert find_documents(out).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    same = {(r.doc_id, r.text, r.n_chars) for r in redacted(odd_docs).collect()}
    assert same == {(r.doc_id, r.text, r.n_chars) for r in odd_docs.collect()}
