import re

import pytest
from pyspark.sql import functions as F
from rangeloom.llm import quotes
from rangeloom.llm.quotes import link, parsed

S = "conv_id long, turn long, role string, text string, k string"
HELLO, SECOND = "Hello there, how are\nyou doing today my friend?", "Quite well, thank you kindly.\n\nAnd the weather here is fine."
ROWS = [
    (1, 0, "user", HELLO),
    (1, 1, "assistant", "On Monday, user wrote:\n> hello there, how are\n> YOU  doing today my friend?\n" + SECOND),
    (1, 2, "user", "A remark that quotes nothing at all."),
    (1, 3, "user", "> > Hello there, how are\n> > you doing today my friend?\n> And the weather here is fine.\nGood to hear."),
    (2, 0, "user", "> And the weather here is fine.\nSaid elsewhere."),
    (2, 1, "user", "> nobody ever said this line before\nwell"),
    (3, 5, "user", "starts late"),
    (3, 6, "user", ">>> \n>\nempty quotes"),
]


def test_levels_passages_and_bodies(spark):
    df = spark.createDataFrame([(t,) for t in ["> a\n> b\n>> c\n>d\nown\n > e", None, "", "plain > text", ">"]], "t string")
    got = [r.p for r in df.select(parsed(F.col("t")).alias("p")).collect()]
    assert [(p.level, p.lines) for p in got[0].passages] == [(1, ["a", "b"]), (2, ["c"]), (1, ["d"]), (1, ["e"])]
    assert [(p.body, p.n_quoted_lines) for p in got] == [("own", 5), ("", 0), ("", 0), ("plain > text", 0), ("", 1)]


def test_links_and_reply_order(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], S)
    by = {(r.conv_id, r.turn): r for r in link(df).collect()}
    assert len(by) == len(ROWS)
    parent = {k: (r.reply_conv, r.reply_turn) for k, r in by.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 1), (2, 0): (1, 1), (2, 1): (2, 0), (3, 5): (None, None), (3, 6): (3, 5)}
    assert {k: r.depth for k, r in by.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (2, 0): 2, (2, 1): 3, (3, 5): 0, (3, 6): 1}
    assert by[1, 1].body == SECOND and by[1, 3].body == "Good to hear." and (by[1, 3].n_passages, by[1, 3].n_linked) == (2, 2)
    assert (by[2, 1].n_passages, by[2, 1].n_linked) == (1, 0) and (by[2, 1].root_conv, by[2, 1].root_turn) == (1, 0)
    for r in by.values():
        assert r.reply_conv is None or by[r.reply_conv, r.reply_turn].reply_order < r.reply_order


def test_long_chain_against_plain_walk(spark):
    rows = [(7, i, "user", f"message number {i} says something of its own" if i % 3 else f"> message number {i // 2} says something of its own\nreply {i}") for i in range(120)]
    got = {r.turn: r for r in link(spark.createDataFrame([(*r, "x") for r in rows], S)).collect()}
    up = {i: (i // 2 if i % 3 == 0 and (i // 2) % 3 else i - 1) for i in range(1, 120)}
    for i in range(120):
        d, k = 0, i
        while k:
            k, d = up[k], d + 1
        assert (got[i].depth, got[i].root_turn) == (d, 0) and (got[i].reply_turn == up[i] if i else got[i].reply_turn is None)


def test_originals_in_larger_conversations(spark):
    rows = [
        (1, 0, "user", "> the report is due on friday evening\nso I read"),
        (1, 1, "user", "> nobody knows the way to the lake\nand this own line is quoted by five"),
        (5, 0, "user", "the report is due on friday evening"),
        (5, 1, "user", "> and this own line is quoted by five\nnobody knows the way to the lake"),
        (6, 0, "user", "> the seventh conversation says this aloud\nthe sixth conversation says this aloud"),
        (7, 0, "user", "> the eighth conversation says this aloud\nthe seventh conversation says this aloud"),
        (8, 0, "user", "> the sixth conversation says this aloud\nthe eighth conversation says this aloud"),
        (9, 0, "user", "> here and elsewhere the same words stand\nquoted before it is said"),
        (9, 1, "user", "here and elsewhere the same words stand"),
        (10, 0, "user", "here and elsewhere the same words stand"),
    ]
    by = {(r.conv_id, r.turn): r for r in link(spark.createDataFrame([(*r, "x") for r in rows], S)).collect()}
    assert len(by) == len(rows) and all(r.n_linked == r.n_passages for r in by.values())
    parent = {k: (r.reply_conv, r.reply_turn) for k, r in by.items() if r.reply_conv is not None}
    # (1, 1) and (5, 1) quote each other, as do 6, 7 and 8 in a ring: the smallest falls back to the turn before it or to none
    assert parent == {(1, 0): (5, 0), (1, 1): (1, 0), (5, 1): (1, 1), (7, 0): (8, 0), (8, 0): (6, 0), (9, 0): (10, 0), (9, 1): (9, 0)}
    assert {k: r.depth for k, r in by.items()} == {(5, 0): 0, (1, 0): 1, (1, 1): 2, (5, 1): 3, (6, 0): 0, (8, 0): 1, (7, 0): 2, (10, 0): 0, (9, 0): 1, (9, 1): 2}
    assert (by[5, 1].root_conv, by[5, 1].root_turn) == (5, 0)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "> a"), (1, None, None, None), (4, 0, "user", None), (4, 1, None, ""), (4, 1, None, ""), (4, 2, "user", "> x\n" * 20_000), (None, None, None, None)]
    got = link(spark.createDataFrame([(*r, "x") for r in rows], S)).collect()
    assert len(got) == len(rows) and {r.body for r in got if r.conv_id is None} == {"> a", ""}
    assert next(r for r in got if r.turn == 2).n_quoted_lines == 20_000
    assert link(spark.createDataFrame([], S)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_conversations_keep_every_message(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert link(df).count() == df.count()


def test_rows_of_one_place_are_all_messages(spark):
    rows = [
        (1, 0, "user", "the first text of this place is said here"), (1, 0, "user", "the other text of this place is said here"), (1, 0, "user", "the other text of this place is said here"),
        (1, 1, "assistant", "> the first text of this place is said here\none"), (1, 1, "assistant", "> the other text of this place is said here\ntwo"), (1, 1, "user", "three"),
        (2, 0, "user", "> the other text of this place is said here\nfar away"), (2, 0, "user", "> nothing of this was ever said by anyone\nnowhere"),
    ]
    got = link(spark.createDataFrame([(*r, "x") for r in rows], S)).collect()
    assert sorted((r.conv_id, r.turn, r.body, r.n_linked) for r in got) == sorted([
        (1, 0, rows[0][3], 0), (1, 0, rows[1][3], 0), (1, 0, rows[1][3], 0), (1, 1, "one", 1), (1, 1, "two", 1), (1, 1, "three", 0), (2, 0, "far away", 1), (2, 0, "nowhere", 0),
    ])
    by = {r.body: (r.reply_conv, r.reply_turn, r.root_conv, r.root_turn, r.depth) for r in got}
    assert by["one"] == by["two"] == by["three"] == (1, 0, 1, 0, 1) and by["far away"] == (1, 0, 1, 0, 1) and by["nowhere"] == (None, None, 2, 0, 0)


def test_a_message_that_all_quote(spark, monkeypatch):
    """Its place is one key for all who answer it; no task gathers them, and all get their depth."""
    rows = [(0, 0, "user", "everybody quotes this very line of mine")] + [(k, 1, "user", f"> everybody quotes this very line of mine\nme too, says {k}") for k in range(1, 4000)]
    rows += [(k, 2, "user", f"I only answer the turn before, {k}") for k in range(1, 4000)]
    sizes = []
    real = quotes.matched

    def watched(left, right, key, weight, count):
        met = real(left, right, key, weight, count)
        parts = met.groupBy(F.spark_partition_id()).count().collect()
        sizes.append(sorted(r["count"] for r in parts))
        return met

    monkeypatch.setattr(quotes, "matched", watched)
    # parts as they are dealt, not merged for their size
    apart = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in apart.items():
        spark.conf.set(k, v)
    try:
        got = link(spark.createDataFrame([(*r, "x") for r in rows], S).repartition(8)).collect()
    finally:
        for k in apart:
            spark.conf.unset(k)
    assert {(r.turn, r.depth, r.root_conv, r.n_linked) for r in got} == {(0, 0, 0, 0), (1, 1, 0, 1), (2, 2, 0, 0)} and len(got) == len(rows)
    assert sizes and all(max(s) < sum(s) / 2 for s in sizes if sum(s) > 1000)


def test_lines_that_introduce_no_quote_stay(spark):
    long = "On Monday " + "x" * 500 + " wrote:"
    df = spark.createDataFrame([(t,) for t in ["As Kafka wrote:\na sentence\nA. wrote:\n> quoted\nend", f"{long}\n> q\nown"]], "t string")
    assert [r.p.body for r in df.select(parsed(F.col("t")).alias("p")).collect()] == ["As Kafka wrote:\na sentence\nend", "own"]


def test_gaps_between_turns(spark):
    rows = [(1, t, "user", f"turn {t}", "x") for t in (0, 2, 3, 9)] + [(2, 4, "user", "alone", "x")]
    got = {(r.conv_id, r.turn): r.reply_turn for r in link(spark.createDataFrame(rows, S)).collect()}
    assert got == {(1, 0): None, (1, 2): 0, (1, 3): 2, (1, 9): 3, (2, 4): None}


def brute(rows):
    """{(conv, turn): (body, n_quoted_lines, n_passages, n_linked, reply, root, depth)} by plain loops."""
    space = " \t\n\x0b\x0c\r"
    norm = lambda x: re.sub(r"[ \t\n\x0b\x0c\r]+", " ", x.lower()).strip(" ")

    def units(lines):
        every = [norm(" ".join(lines)), *map(norm, re.split(r"\n[ \t\n\x0b\x0c\r]*\n", "\n".join(lines))), *(x for x in map(norm, lines) if len(x.split(" ")) >= 4)]
        return {x for x in every if x}

    parsed_, own, reply = {}, {}, {}
    for conv, turn, _, text in rows:
        lines = []
        for x in re.split("\r?\n", text or ""):
            mark = re.match(r"(?:[ \t]{0,3}>)+", x)
            content = x[mark.end():] if mark else x
            lines.append((mark[0].count(">") if mark else 0, content.removeprefix(" ") if mark else x))
        keep = [c for i, (n, c) in enumerate(lines) if not n and not (i + 1 < len(lines) and lines[i + 1][0] and re.search(r"\S\s+(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", c))]
        passages, last = [], 0
        for n, c in lines:
            if n and n == last:
                passages[-1][1].append(c)
            elif n:
                passages.append((n, [c]))
            last = n
        body = "\n".join(keep).strip(space)
        parsed_[conv, turn] = (body, sum(n > 0 for n, _ in lines), passages)
        if body:
            for u in units(body.split("\n")):
                own.setdefault(u, {}).setdefault(conv, []).append(turn)
    for (conv, turn), (_, _, passages) in parsed_.items():
        hits = []
        for k, (level, lines) in enumerate(passages):
            for u in units(lines):
                at = {c: min(t) for c, t in own.get(u, {}).items()}
                if conv in at and at[conv] < turn:
                    hits.append((k, (True, -level, conv, at[conv])))
                elif others := sorted(c for c in at if c != conv):
                    hits.append((k, (False, -level, others[0], at[others[0]])))
        before = max((t for c, t in parsed_ if c == conv and t < turn), default=None)
        none = (conv, before) if before is not None else None
        best = max((h for _, h in hits), default=None)
        early = max((h for _, h in hits if h[2] <= conv), default=None)
        reply[conv, turn] = [best[2:] if best else none, early[2:] if early else none, len({k for k, _ in hits})]
    up = {k: v[0] for k, v in reply.items()}
    while True:  # the smallest message of each cycle takes its earlier link
        heads = set()
        for k in up:
            seen, x = [], k
            while x is not None and x not in seen:
                seen.append(x)
                x = up[x]
            if x is not None:
                heads.add(min(seen[seen.index(x):]))
        if not heads:
            break
        up |= {k: reply[k][1] for k in heads}
    out = {}
    for k, (body, n, passages) in parsed_.items():
        depth, x = 0, k
        while up[x] is not None:
            x, depth = up[x], depth + 1
        out[k] = (body, n, len(passages), reply[k][2], up[k], x, depth)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_whole_table_with_quotes_against_plain_loops(spark, sf):
    """Every message of the table; two of three quote: the turn before, the one before that a level deeper, or another conversation."""
    table = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()}
    keys, rows = sorted(table), []
    for i, (conv, turn) in enumerate(keys):
        lines, one, two = [], table.get((conv, turn - 1)), table.get((conv, turn - 2))
        if i % 3 == 1 and one is not None:
            lines += ["someone wrote:", *(f"> > {x}" for x in (two or "").split("\n")[:2] if two), *(f"> {x.upper() if i % 2 else x}" for x in one.split("\n"))]
        if i % 3 == 2:
            other = keys[(i * 7919) % len(keys)]
            lines += [f"> {x}" for x in table[other].split("\n")[:3]]
        rows.append((conv, turn, "user", "\n".join([*lines, table[conv, turn], "as they wrote:"])))
    want = brute(rows)
    got = {(r.conv_id, r.turn): (r.body, r.n_quoted_lines, r.n_passages, r.n_linked, None if r.reply_conv is None else (r.reply_conv, r.reply_turn), (r.root_conv, r.root_turn), r.depth) for r in link(spark.createDataFrame([(*r, "x") for r in rows], S)).collect()}
    assert sum(w[3] > 0 for w in want.values()) > len(want) // 3
    assert {k: (w, got.get(k)) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)
