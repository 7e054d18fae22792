"""The engine against worked values: replay, ranges, evaluator, post-flop filter."""

import itertools
import random

import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F
from rangeloom.functions import keys as K
from rangeloom.functions.cards import BUCKETS, RANKS, SUITS, card_bits, cards, hand_class, scored, strengths, suit_bits, suits_at, textured
from rangeloom.functions.likelihood import action_table, class_names, combos, hand_classes, psi_table, table_map
from rangeloom.operators import postflop as P
from rangeloom.operators import ranges as R
from rangeloom.operators.replay import betting_history, boards, hole_cards, quarantined, replay, states, tokens
from rangeloom.plans.runs import chosen, dump, report, results, run
from rangeloom.sources.histories import from_rows, from_text, read_session

HANDS = {
    "30/12": ("['MrWhite', 'Gogo', 'Budd', 'Eddie', 'Bill', 'Pluribus']", "['d dh p1 Ks7d', 'd dh p2 8sQh', 'd dh p3 2sKh', 'd dh p4 7c5d', 'd dh p5 Jh9d', 'd dh p6 TcJc', 'p3 f', 'p4 f', 'p5 f', 'p6 cbr 225', 'p1 f', 'p2 cc', 'd db 3dQc2c', 'p2 cc', 'p6 cbr 250', 'p2 cc', 'd db 9s', 'p2 cc', 'p6 cbr 1000', 'p2 cc', 'd db 5s', 'p2 cc', 'p6 cc', 'p2 sm 8sQh', 'p6 sm']"),
    "99/36": ("['MrPink', 'Eddie', 'MrOrange', 'Bill', 'MrBlue', 'Pluribus']", "['d dh p1 Ts5s', 'd dh p2 JhAd', 'd dh p3 6hJs', 'd dh p4 5h9s', 'd dh p5 6s7h', 'd dh p6 8dQc', 'p3 f', 'p4 f', 'p5 f', 'p6 f', 'p1 cc', 'p2 cbr 300', 'p1 cc', 'd db Qh9d4h', 'p1 cc', 'p2 cbr 450', 'p1 f']"),
    "32/23": ("['Pluribus', 'MrWhite', 'Gogo', 'Budd', 'Eddie', 'Bill']", "['d dh p1 Qc4d', 'd dh p2 9d9c', 'd dh p3 KdAd', 'd dh p4 6sTs', 'd dh p5 7c6d', 'd dh p6 AcKh', 'p3 cbr 200', 'p4 f', 'p5 f', 'p6 cbr 725', 'p1 f', 'p2 cc', 'p3 cbr 2900', 'p6 cbr 10000', 'p2 f', 'p3 cc', 'p6 sm AcKh', 'p3 sm KdAd', 'd db Th5h8c', 'd db 5d', 'd db Ks']"),
}


def text_of(name):
    players, actions = HANDS[name]
    return f"variant = 'NT'\nante_trimming_status = true\nantes = [0, 0, 0, 0, 0, 0]\nblinds_or_straddles = [50, 100, 0, 0, 0, 0]\nmin_bet = 100\nstarting_stacks = [10000, 10000, 10000, 10000, 10000, 10000]\nactions = {actions}\nhand = {name.split('/')[1]}\nplayers = {players}\nfinishing_stacks = [1, 2.5, 3, 4, 5, 6]\n"


@pytest.fixture(scope="module")
def log_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for name in HANDS:
        path = root / f"{name}.phh"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text_of(name))
    return root


def one_hand(spark, name):
    return from_text(spark, text_of(name), f"logs/{name}.phh")


def test_parse(spark):
    h = one_hand(spark, "30/12").first()
    assert (h.session_id, h.hand_no, h.variant, h.hand, h.min_bet, h.ante_trimming_status) == ("30", 12, "NT", 12, 100, True)
    assert h.players[1] == "Gogo" and len(h.actions) == 25 and h.finishing_stacks[1] == 2.5


def test_replay_of_a_whole_hand(spark):
    rows = replay(tokens(one_hand(spark, "30/12"))).orderBy("seq").collect()
    got = [(r.street, r.action_index, r.player, r.state_key, r.bucket, r.amount, r.level_after) for r in rows]
    assert got == [
        (0, 0, "Budd", "utg|multiway|facing_bet|raises_0|deep", 0, 0, 0),
        (0, 1, "Eddie", "hj|multiway|facing_bet|raises_0|deep", 0, 0, 0),
        (0, 2, "Bill", "co|multiway|facing_bet|raises_0|deep", 0, 0, 0),
        (0, 3, "Pluribus", "btn|three_way|facing_bet|raises_0|deep", 3, 225, 1),
        (0, 4, "MrWhite", "sb|three_way|facing_bet|raises_1|deep", 0, 0, 1),
        (0, 5, "Gogo", "bb|heads_up|facing_bet|raises_1|deep", 1, 225, 1),
        (1, 0, "Gogo", "bb|heads_up|no_bet|raises_0|deep", 1, 0, 0),
        (1, 1, "Pluribus", "btn|heads_up|facing_bet|raises_0|deep", 2, 250, 1),
        (1, 2, "Gogo", "bb|heads_up|facing_bet|raises_1|deep", 1, 250, 1),
        (2, 0, "Gogo", "bb|heads_up|no_bet|raises_0|medium", 1, 0, 0),
        (2, 1, "Pluribus", "btn|heads_up|facing_bet|raises_0|medium", 3, 1000, 1),
        (2, 2, "Gogo", "bb|heads_up|facing_bet|raises_1|medium", 1, 1000, 1),
        (3, 0, "Gogo", "bb|heads_up|no_bet|raises_0|shallow", 1, 0, 0),
        (3, 1, "Pluribus", "btn|heads_up|facing_bet|raises_0|shallow", 1, 0, 0),
    ]


def test_replay_of_raises(spark):
    rows = replay(tokens(one_hand(spark, "32/23"))).orderBy("seq").collect()
    assert [(r.bucket, r.amount, r.level_after) for r in rows] == [(3, 200, 1), (0, 0, 1), (0, 0, 1), (3, 725, 2), (0, 0, 2), (1, 725, 2), (3, 2900, 3), (3, 10000, 4), (0, 0, 4), (1, 10000, 4)]
    assert rows[7].state_key == "btn|three_way|facing_bet|raises_2plus|shallow"
    t = tokens(one_hand(spark, "32/23"))
    assert [r.board for r in boards(t).orderBy("street").collect()] == ["Th5h8c", "Th5h8c5d", "Th5h8c5dKs"]
    assert len(betting_history(replay(t)).orderBy("seq").collect()[-1].history) == 9


def test_snapshots_conserve_chips(spark):
    for name in HANDS:
        rows = states(tokens(one_hand(spark, name))).orderBy("seq").collect()
        assert all(sum(r.stacks) + r.pot == 60_000 for r in rows)
        assert rows[0].player_to_act == one_hand(spark, name).first().players[2] and rows[0].seq == -1


def test_snapshots_of_a_long_log(spark):
    """Ten thousand actions of one hand: running sums, not lists of all that came before."""
    acts = ["p3 cc", "p1 cc", "p2 cc", "d db 2c3c4c", *[f"p{k % 3 + 1} cc" for k in range(9_990)], "p1 cbr 700", "p2 f", "p3 cc"]
    text = f"blinds_or_straddles = [50, 100, 0]\nstarting_stacks = [10000, 10000, 10000]\nactions = {acts}\nplayers = ['a', 'b', 'c']\n"
    rows = states(tokens(from_text(spark, text))).orderBy("seq").collect()
    assert len(rows) == len(acts) + 1 and all(r.pot + sum(r.stacks) == 30_000 for r in rows)
    last = rows[-1]
    assert (last.alive, last.stacks, last.pot, last.player_to_act) == ([True, False, True], [9200, 9900, 9200], 1700, "a")


def test_broken_hands_leave_in_the_same_replay(spark):
    good, bad = one_hand(spark, "30/12"), one_hand(spark, "99/36").withColumn("actions", F.concat("actions", F.array(F.lit("p1 cc"))))
    both = good.unionByName(bad)
    seen = Observation()
    kept = quarantined(replay(tokens(both), strict=False), seen).collect()
    assert {r.path for r in kept} == {"logs/30/12.phh"} and len(kept) == 14
    assert seen.get["violations"] == 1 and seen.get["rejected"] == seen.get["actions"] - 14
    assert {r.path for r in states(tokens(both), quarantine=True).collect()} == {"logs/30/12.phh"}


def test_hands_from_rows_and_likeliest_strengths(spark):
    row = one_hand(spark, "99/36").first().asDict()
    again = from_rows(spark, [row, {"path": "x/1.phh"}]).collect()
    assert again[0].asDict() == row and again[1].players is None
    rows = spark.createDataFrame([(1, b, p) for b, p in zip(BUCKETS, (0.1, 0.3, 0.1, 0.3, 0.0, 0.1, 0.1))], "k int, strength string, p double")
    assert [(r["rank"], r.strength) for r in P.top_strengths(rows, ["k"], 3).orderBy("rank").collect()] == [(1, BUCKETS[1]), (2, BUCKETS[3]), (3, BUCKETS[0])]


def test_an_observer_is_not_the_target(spark):
    hands = one_hand(spark, "30/12")
    with pytest.raises(ValueError, match="observer"):
        results(hands, ["Gogo"], ["Gogo"])
    assert results(hands, ["Gogo"], ["Gogo", "Pluribus"]).select("target").distinct().collect() == [Row(target="Pluribus")]


@pytest.mark.parametrize("bad", ["'p1 xx'", "'p3 f', 'p3 cc'", "'p2 cbr 100'", "'p3 cbr 10001'", "'d db 2c', 'd db 3c', 'd db 4c', 'd db 5c', 'p1 cc'"])
def test_broken_logs_are_errors(spark, bad):
    text = f"blinds_or_straddles = [50, 100, 0]\nstarting_stacks = [10000, 10000, 10000]\nactions = [{bad}]\nplayers = ['a', 'b', 'c']\n"
    t = tokens(from_text(spark, text))
    with pytest.raises(Exception, match="raise_error|USER_RAISED"):
        replay(t).collect()
    assert any(r.violation for r in replay(t, strict=False).collect())


@pytest.mark.parametrize(
    ("name", "observer", "target", "phi", "n", "ll", "ess", "top"),
    [
        ("30/12", "Gogo", "Pluribus", 0.0, 1, -1.9066066830280792, 133.217275382, [("AKo", 0.014938955324), ("AJo", 0.014833535397), ("KJo", 0.011222189581)]),
        ("30/12", "Gogo", "Pluribus", -1.0, 1, -1.983976738524, 133.4569192, [("AJo", 0.014094418521), ("AKo", 0.013977303378), ("KJo", 0.010573844814)]),
        ("30/12", "Gogo", "Pluribus", 1.0, 1, -1.835031883375, 132.700443017, [("AKo", 0.015635693326), ("AJo", 0.015387767602), ("KJo", 0.011780750953)]),
        ("99/36", "Pluribus", "MrPink", 0.0, 2, -1.704542628021, 131.260070536, [("KJo", 0.014959238019), ("ATo", 0.014684052960), ("KTo", 0.014342337287)]),
    ],
)
def test_ranges(spark, name, observer, target, phi, n, ll, ess, top):
    hands = one_hand(spark, name)
    t = tokens(hands)
    ranged = R.range_vectors(R.decisions(replay(t)), R.pairs(hands, hole_cards(t), [observer], [target]), phi)
    (r,) = R.summaries(ranged, ["path", "observer", "target"], 3).collect()
    assert r.n_decisions == n and r.log_likelihood == pytest.approx(ll, abs=1e-11) and r.effective_size == pytest.approx(ess, abs=1e-8)
    assert [x.hand_class for x in r.top_range] == [c for c, _ in top]
    assert [x.probability for x in r.top_range] == pytest.approx([p for _, p in top], abs=1e-11)
    assert len(r.final_range) == 169 and sum(r.range_vector) == pytest.approx(1, abs=1e-12)


def test_steps(spark):
    hands = one_hand(spark, "99/36")
    t = tokens(hands)
    rows = R.filter_steps(R.decisions(replay(t)), R.pairs(hands, hole_cards(t), ["Pluribus"], ["MrPink"])).orderBy("step").collect()
    assert [r.evidence for r in rows] == pytest.approx([0.445494758003, 0.408210286473], abs=1e-11)
    assert [r.effective_size for r in rows] == pytest.approx([135.60038872, 131.260070536], abs=1e-8)
    assert [(r.top_class, r.action_bucket) for r in rows] == [("KJo", 1), ("KJo", 1)]
    assert rows[1].top_probability == pytest.approx(0.014959238019, abs=1e-11)


def test_classes_combos_and_priors(spark):
    by = {r.hand_class: r.strength for r in hand_classes(spark).collect()}
    want = {"AA": 0.97, "KK": 0.9325, "AKs": 0.99, "AKo": 0.9791666666666666, "T9s": 0.7358333333333333, "A5s": 0.6325, "55": 0.6325, "22": 0.52, "72o": 0.2375, "32o": 0.2075}
    assert len(by) == 169 and all(by[k] == pytest.approx(v, abs=1e-15) for k, v in want.items())
    assert combos(spark).count() == 1326
    rows = R.priors(spark.createDataFrame([("",), ("AhKh",), ("AsAhAd",)], "dead string")).collect()
    n = {(r.dead, r.hand_class): r.combos for r in rows}
    assert [sum(v for (d, _), v in n.items() if d == x) for x in ("", "AhKh")] == [1326, 1225]
    assert (n["AhKh", "AA"], n["AhKh", "AKs"], n["AhKh", "AKo"], n["AsAhAd", "AA"]) == (3, 3, 6, 0)


def test_action_model(spark):
    key = "btn|three_way|facing_bet|raises_0|deep"
    rows = action_table(spark.createDataFrame([(key,)], "state_key string")).collect()
    p = {(r.hand_class, r.bucket): r.lik for r in rows}
    assert len(rows) == 845
    for name, want in {"AA": (0.0296488651, 0.4461645512, 0.1626304413, 0.2265929062, 0.1349632361), "72o": (0.3481231718, 0.3511800155, 0.1247964136, 0.1127614459, 0.0631389533)}.items():
        assert [p[name, a] for a in range(5)] == pytest.approx(want, abs=1e-9)
    assert rows[0].alpha == pytest.approx(5 * rows[0].lik)
    text = table_map(spark.createDataFrame([(key,)], "state_key string")).select(F.to_json("table")).first()[0]
    assert text.startswith('{"AA":[') and text.index('"AKs"') < text.index('"AKo"') < text.index('"32o"') < text.index('"22"')
    with pytest.raises(Exception, match="Invalid state key"):
        action_table(spark.createDataFrame([("a|b",)], "state_key string")).collect()


def five(hand):
    """Plain rating of five cards."""
    values = sorted((RANKS[::-1].index(c[0]) + 2 for c in hand), reverse=True)
    groups = sorted(((values.count(v), v) for v in set(values)), reverse=True)
    form = tuple(n for n, _ in groups)
    run_high = 5 if set(values) == {14, 2, 3, 4, 5} else values[0] if form == (1,) * 5 and values[0] - values[4] == 4 else 0
    flush = len({c[1] for c in hand}) == 1
    if flush and run_high:
        return 8, [run_high]
    kinds = {(4, 1): 7, (3, 2): 6, (3, 1, 1): 3, (2, 2, 1): 2, (2, 1, 1, 1): 1}
    if form in ((4, 1), (3, 2)):
        return kinds[form], [v for _, v in groups]
    if flush:
        return 5, values
    if run_high:
        return 4, [run_high]
    return kinds.get(form, 0), [v for _, v in groups]


def test_evaluator_against_all_subsets(spark):
    rng = random.Random(8)
    deck = [r + s for r in RANKS for s in SUITS]
    small = [r + s for r in "A5432" for s in SUITS]
    hands = [rng.sample(deck if k % 3 else small, rng.choice([5, 6, 7])) for k in range(1500)] + [rng.sample([r + "S" for r in RANKS] + small, 7) for _ in range(500)]
    df = spark.createDataFrame([(h,) for h in hands if len(set(h)) == len(h)], "h array<string>")
    rated = scored(df, "h", "s").collect()
    for r in rated:
        assert (r.s.category, r.s.kickers) == max(five(c) for c in itertools.combinations(r.h, 5))
    # codes order hands as categories and kickers do
    assert sorted((r.s.category, r.s.kickers) for r in rated) == [(r.s.category, r.s.kickers) for r in sorted(rated, key=lambda r: r.s.code)]
    with pytest.raises(Exception, match="five to seven"):
        scored(spark.createDataFrame([(["AS"] * 4,)], "h array<string>"), "h", "s").collect()


def test_strengths(spark):
    rows = [
        ("8sQh", "3dQc2c", "pair", "medium made", 0), ("TcJc", "3dQc2c", "high_card", "weak draw", 9), ("8sQh", "3dQc2c9s5s", "pair", "medium made", 0),
        ("JhAd", "Qh9d4h", "high_card", "weak draw", 3), ("AhKh", "QhJh2c", "high_card", "strong draw", 23), ("As2d", "3c4h9s", "high_card", "strong draw", 11),
        ("AhKd", "QhJhTh8h2h", "flush", "nuts/near-nuts", 0), ("7s7d", "7c8d9h", "trips", "nuts/near-nuts", 0), ("Th9h", "8c7d2s", "high_card", "strong draw", 14),
    ]
    df = spark.createDataFrame(rows, "hole string, board string, name string, bucket string, outs int")
    rated = strengths(df.withColumns({"h": cards(F.col("hole")), "b": cards(F.col("board"))}), "h", "b", "s")
    for r in rated.collect():
        assert (r.s.hand_type, r.s.bucket, r.s.outs) == (r.name, r.bucket, r.outs)
    boards_ = spark.range(1).select(cards(F.lit("2h3h4h")).alias("b"), F.array().cast("array<string>").alias("none"))
    t = textured(textured(boards_, "b", "t"), "none", "e").first()
    assert t.t.asDict() == {"monotone": True, "two_tone": True, "paired": False, "connected": True, "very_connected": False, "high_card": 4} and t.e.high_card is None
    with pytest.raises(Exception, match="two hole cards"):
        strengths(boards_.withColumn("h", F.array(F.lit("AS"))), "h", "b", "s").collect()


def one_class(name, board):
    """The class's first combo in suit order that the board leaves."""
    for i, a in enumerate(SUITS):
        for j, b in enumerate(SUITS):
            if (i < j if len(name) == 2 else (i == j) == (name[2] == "s")) and not {name[0] + a, name[1] + b} & set(board):
                return [name[0] + a, name[1] + b]
    return None


def test_strength_vectors_against_rated_combos(spark):
    rng = random.Random(4)
    deck = [r + s for r in RANKS for s in SUITS]
    suited = [r + s for r in RANKS for s in "SD"]
    some = [rng.sample(deck if k % 3 else suited, rng.choice([3, 4, 5])) for k in range(60)]
    some += [["AS", "AH", "AD"], ["AS", "AH", "AD", "AC"], ["2C", "3C", "4C", "5C", "6C"], ["KD", "QD", "JD", "TD"], ["5H", "5S", "5D", "9H", "9C"], ["2S", "3S", "4S"]]
    df = spark.createDataFrame([("".join(b),) for b in some] + [("AhKd",), ("",)], "board string")
    got = {r.board: r.strengths for r in P.strength_vectors(df).collect()}
    assert set(got) == {"".join(b) for b in some}
    asked = [("".join(b), b, i, one_class(c, b)) for b in some for i, c in enumerate(class_names())]
    rows = spark.createDataFrame([x for x in asked if x[3]], "board string, cards array<string>, class_id int, hole array<string>")
    want = {b: [-1] * 169 for b in got}
    for r in strengths(rows, "hole", "cards", "s").collect():
        want[r.board][r.class_id] = BUCKETS.index(r.s.bucket)
    assert got == want


def test_ratings_are_shared_by_ranks(spark):
    deck = [r + s for r in RANKS for s in SUITS]
    flops = spark.createDataFrame([("".join(c),) for c in itertools.combinations(deck, 3)], "board string")
    vectors = P.strength_vectors(flops)
    assert vectors.count() == 22_100
    bits = card_bits(cards(F.col("board")))
    per_rank = [F.call_function("shiftleft", F.bit_count(suits_at(F.col("x"), r)).cast("long"), F.lit(3 * r)) for r in range(13)]
    sets = flops.select(bits.alias("x")).select(sum(per_rank[1:], per_rank[0]).alias("ranks"), (F.greatest(*[F.bit_count(suit_bits(F.col("x"), k)) for k in range(4)]) == 3).alias("mono"))
    rated = P.rank_boards(sets).count() * 2 * 169
    assert rated * 10 < 22_100 * 169
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    # a board stays one row: no product with the classes, and nothing is taken apart but its text
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Generate" not in plan


def test_priors_with_any_dead_cards(spark):
    rng = random.Random(2)
    deck = [r + s for r in RANKS for s in SUITS]
    dead = [rng.sample(deck, rng.choice([0, 1, 2, 5, 7, 30])) for _ in range(30)]
    pairs = [(class_names().index(one), a, b) for a, b in itertools.combinations(deck, 2) for one in [name_of(a, b)]]
    got = {}
    for r in R.priors(spark.createDataFrame([("".join(d),) for d in dead], "dead string")).collect():
        got.setdefault(r.dead, [None] * 169)[r.class_id] = (r.combos, r.prior)
    for d in dead:
        n = [0] * 169
        for k, a, b in pairs:
            n[k] += a not in d and b not in d
        assert got["".join(d)] == [(x, x / sum(n)) for x in n]
    with pytest.raises(Exception, match="no legal combos"):
        R.priors(spark.createDataFrame([("".join(deck[1:]),)], "dead string")).collect()


def name_of(a, b):
    hi, lo = sorted((a, b), key=lambda c: RANKS.index(c[0]))
    return hi[0] + lo[0] + ("" if hi[0] == lo[0] else "s" if hi[1] == lo[1] else "o")


@pytest.mark.parametrize("text", ["1h2h", "AxKd", "Ah2", "AhAh"])
def test_bad_cards(spark, text):
    with pytest.raises(Exception, match="USER_RAISED"):
        spark.createDataFrame([(text,)], "t string").select(cards(F.col("t"))).collect()


def test_labels(spark):
    row = spark.range(1).select(
        hand_class(cards(F.lit("kdAd"))).alias("c"),
        F.array(*[K.position_name(F.lit(s), F.lit(n)) for n, s in ((6, 6), (3, 3), (4, 4), (7, 7), (2, 1))]).alias("p"),
        F.array(*[K.seat_label(F.lit(s)) for s in (0, 1, 6, 7)]).alias("s"),
        F.array(*[K.spr_label(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (11.0, 1.0), (10.0, 1.0), (3.0, 1.0))]).alias("r"),
        F.array(*[K.action_bucket(F.lit(v), F.lit(100), F.lit(b)) for v, b in (("f", 0), ("cc", 5), ("cbr", 49), ("cbr", 50), ("cbr", 100))]).alias("b"),
    ).first()
    assert (row.c, row.p, row.s) == ("AKs", ["button", "b", "button", "seat_7", "sb"], [None, "sb", "btn", None])
    assert row.r == ["deep", "deep", "medium", "shallow"] and row.b == [0, 1, 2, 3, 4]


def test_collapse_and_strength_filter(spark):
    hands = one_hand(spark, "30/12")
    t = tokens(hands)
    ranged = R.range_vectors(R.decisions(replay(t)), R.pairs(hands, hole_cards(t), ["Gogo"], ["Pluribus"]))
    want = {"3dQc2c": [0.013708860349, 0.079120807665, 0.068806233135, 0.261509817151, 0.013229927345, 0.26315328983, 0.300471064524], "QsQhQd": [0.192939483722, 0.807060516278, 0, 0, 0, 0, 0], "": [1 / 7] * 7}
    both = ranged.crossJoin(spark.createDataFrame([(b,) for b in want], "board string")).withColumn("k", F.col("board"))
    got = {}
    for r in P.collapse(both, ["k"]).orderBy("bucket_idx").collect():
        got.setdefault(r.k, []).append(r.p)
    assert all(got[b] == pytest.approx(w, abs=1e-10) for b, w in want.items())
    start = psi_table(spark).select(F.lit(1).alias("k"), "strength", F.lit(1 / 7).alias("p")).distinct()
    end = P.strength_filter(start, spark.createDataFrame([(1, a) for a in (1, 2, 3)], "k int, bucket int"), ["k"])
    p = {r.strength: r.p for r in end.collect()}
    assert (p["strong made"], p["air"], end.first().log_likelihood) == pytest.approx((0.2578529405, 0.0196403484, -4.5022308476), abs=1e-9)
    e = P.expected_strength(end, ["k"]).first()
    assert (e.expected_strength, e.effective_size) == pytest.approx((0.6036712169, 5.4990628928), abs=1e-9)
    tilted = {(r.strength, r.bucket): r.psi for r in psi_table(spark, 0.5).collect()}
    assert [tilted["air", a] for a in range(5)] == pytest.approx([0.3857617131, 0.2683508378, 0.1696987808, 0.1090809573, 0.067107711], abs=1e-9)


def test_runs(spark, log_folder, tmp_path):
    doc = run(spark, str(log_folder / "30"), ["Gogo"], ["Pluribus", "Pluribus"])
    (r,) = doc["hand_results"]
    assert r["log_likelihood"] == pytest.approx(-1.9066066830280792, abs=1e-12) and r["decisions"][0]["amount"] == 225
    assert list(r["final_range"])[:3] == ["AA", "AKs", "AKo"] and doc["targets"] == ["Pluribus"]
    assert "Hand 0 | Gogo -> Pluribus" in report(doc) and dump(doc, str(tmp_path / "a" / "b.json")).read_text().endswith("}\n")
    single = run(spark, str(log_folder / "30" / "12.phh"), ["Gogo"], ["Pluribus"])
    assert single["hand_results"][0]["top_range"] == r["top_range"]
    with pytest.raises(FileNotFoundError):
        run(spark, str(log_folder / "none"))
    with pytest.raises(NotADirectoryError):
        read_session(spark, str(log_folder / "30" / "12.phh"))
    with pytest.raises(ValueError):
        chosen(["nobody"], ["a"])
