"""The action model P(action | hand class, state key, phi), as column expressions.

Scores are linear in a playability that the class and the state set; phi tilts
them by a utility; a floored softmax makes them probabilities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.cards import BUCKETS, RANKS, SUITS
from rangeloom.functions.keys import key_parts

#: Fixed values of the model. Rows of a score: constant, slope, share of the SPR bonus in the slope, premium, speculative.
POSITION = {"sb": -0.02, "bb": 0.01, "utg": -0.08, "hj": -0.02, "co": 0.05, "btn": 0.08}
ACTIVE = {"heads_up": 0.04, "three_way": -0.02, "multiway": -0.06}
RAISES = {"raises_0": 0.0, "raises_1": -0.12, "raises_2plus": -0.24}
SPR = {"deep": 0.0, "medium": 0.04, "shallow": 0.10}
FACING = ((1.5, -3.0, 0, 0.0, 0.0), (0.2, 1.4, 0, 0.0, 0.15), (-0.8, 1.1, 1, 0.25, 0.0), (-1.0, 1.4, 1, 0.50, 0.0), (-1.6, 1.2, 1, 0.75, 0.0))
NOT_FACING = ((1.1, -2.4, 0, 0.0, 0.0), (0.25, 0.9, 0, 0.0, 0.25), (-0.35, 1.0, 1, 0.0, 0.0), (-0.55, 1.2, 1, 0.25, 0.0), (-1.6, 0.8, 1, 0.55, 0.0))
#: Utility of an action: (at, factor) for factor * (at - strength).
UTILITY = ((0.5, 2.0), (0.5, 1.5), (0.6, 0.8), (0.6, 1.2), (0.6, 1.8))
FLOOR, KAPPA = 0.01, 5.0
#: Scores of actions by post-flop strength, their floor, and utility (factor, at) on the strength's weight.
POSTFLOP = (
    (-3.0, 0.5, 1.2, 1.8, 1.5),
    (-2.0, 1.0, 1.5, 1.2, 0.5),
    (-0.5, 1.5, 0.8, 0.3, -0.5),
    (0.5, 1.0, 0.2, -0.5, -1.5),
    (-1.0, 0.8, 1.0, 1.2, 0.8),
    (0.5, 1.0, 0.3, -0.5, -1.0),
    (1.5, 0.2, -0.3, -0.8, -1.5),
)
POSTFLOP_FLOOR = 0.02
POSTFLOP_UTILITY = ((-1.0, 0.0), (1.0, 0.3), (0.8, 0.2), (0.6, 0.1), (0.5, 0.0))


def class_names() -> list[str]:
    """The 169 classes in rank order: pair, then suited and offsuit with each lower rank."""
    return [a + b + s for i, a in enumerate(RANKS) for b in RANKS[i:] for s in ([""] if a == b else ["s", "o"])]


#: Kinds of classes by the cards that they hold.
PAIR, SUITED, OFFSUIT = range(3)


def class_shapes() -> Column:
    """The 169 classes in class order as a constant array of struct(kind, high, low): ranks from 0 on."""
    one = lambda c: F.struct(F.lit(PAIR if len(c) == 2 else SUITED if c[2] == "s" else OFFSUIT).alias("kind"), F.lit(12 - RANKS.index(c[0])).alias("high"), F.lit(12 - RANKS.index(c[1])).alias("low"))
    return F.array(*map(one, class_names()))


def class_features(name: Column) -> list[Column]:
    """high, low, pair, suited, gap, broadways, has_ace and strength of a class name."""
    value = lambda i: F.lit(15) - F.instr(F.lit(RANKS), F.substring(name, i, 1))
    high, low = value(1), value(2)
    pair, suited = F.length(name) == 2, F.substring(name, 3, 1) == "s"
    gap = F.greatest(F.lit(0), high - low - 1)
    broadways = (high >= 10).cast("int") + (low >= 10).cast("int")
    ace = (high == 14) | (low == 14)
    plain = (
        F.lit(0.10)
        + 0.45 * ((high - 2) / 12)
        + 0.25 * ((low - 2) / 12)
        + F.when(suited, 0.08).otherwise(0.0)
        + F.when(gap <= 1, 0.07).when(gap == 2, 0.03).otherwise(0.0)
        + 0.04 * broadways
        + F.when(ace, 0.05).otherwise(0.0)
        - 0.025 * F.greatest(F.lit(0), gap - 2)
    )
    strength = F.when(pair, 0.52 + 0.45 * ((high - 2) / 12)).otherwise(plain)
    return [
        high.alias("high"), low.alias("low"), pair.alias("pair"), suited.alias("suited"), gap.alias("gap"), broadways.alias("broadways"), ace.alias("has_ace"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.99), strength)).alias("strength"),
    ]


def hand_classes(spark: SparkSession) -> DataFrame:
    """169 rows (class_id, hand_class and features)."""
    names = spark.createDataFrame(list(enumerate(class_names())), "class_id int, hand_class string").coalesce(1)
    return names.select("class_id", "hand_class", *class_features(F.col("hand_class")))


def combos(spark: SparkSession) -> DataFrame:
    """1,326 rows (class_id, combo_order, c1, c2); the order prefers suits S, H, D, C."""
    rows = []
    for k, name in enumerate(class_names()):
        pairs = [(a, b) for i, a in enumerate(SUITS) for j, b in enumerate(SUITS) if (i < j if len(name) == 2 else (i == j) == (name[2] == "s"))]
        rows += [(k, n, name[0] + a, name[1] + b) for n, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "class_id int, combo_order int, c1 string, c2 string").coalesce(1)


def _by(column: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def softmax(scores: list[Column], floor: float) -> list[Column]:
    """Floored softmax over a fixed list of score columns."""
    top = F.greatest(*scores)
    weights = [F.exp(s - top) for s in scores]
    total = sum(weights[1:], weights[0])
    floored = [(1.0 - floor * len(scores)) * (w / total) + floor for w in weights]
    norm = sum(floored[1:], floored[0])
    return [f / norm for f in floored]


def utility(strength: Column, bucket: int) -> Column:
    at, factor = UTILITY[bucket]
    return factor * (at - strength)


def action_scores(key: Column) -> list[Column]:
    """Scores of the five buckets from a key struct and the feature columns of ``hand_classes``."""
    bonus = _by(key["spr"], SPR)
    x = F.col("strength") + _by(key["position"], POSITION) + _by(key["active"], ACTIVE) + _by(key["raises"], RAISES)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    premium = ((F.col("pair") & (F.col("high") >= 10)) | ((F.col("high") == 14) & (F.col("low") >= 11))).cast("int")
    spec = (F.col("suited") & (F.col("gap") <= 2) & (F.col("low") >= 5)).cast("int")
    line = lambda r: r[0] + (r[1] + r[2] * bonus) * x + r[3] * premium + r[4] * spec
    return [F.when(key["facing"] == "facing_bet", line(a)).otherwise(line(b)) for a, b in zip(FACING, NOT_FACING, strict=True)]


def action_table(states: DataFrame, phi: float | Column = 0.0, floor: float = FLOOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """(state_key, class_id, hand_class, bucket, lik, alpha) for each distinct state_key of ``states``: 845 rows each.

    The table is small whatever the log's size, because keys are a product of five
    small categories (270 with unknown positions counted once more). ``keep`` names
    further columns of ``states`` that tell rows apart (such as a phi of their own).
    """
    spark = states.sparkSession
    keyed = states.select("state_key", *keep).distinct().withColumn("__k", key_parts(F.col("state_key")))
    wide = keyed.crossJoin(F.broadcast(hand_classes(spark)))
    tilt = phi if isinstance(phi, Column) else F.lit(float(phi))
    scores = [s + tilt * utility(F.col("strength"), a) for a, s in enumerate(action_scores(F.col("__k")))]
    scored = wide.select("state_key", *keep, "class_id", "hand_class", *[s.alias(f"s{a}") for a, s in enumerate(scores)])
    probs = F.array(*softmax([F.col(f"s{a}") for a in range(5)], floor))
    return scored.select("state_key", *keep, "class_id", "hand_class", F.posexplode(probs).alias("bucket", "lik")).withColumn("alpha", KAPPA * F.col("lik"))


def table_map(states: DataFrame, phi: float = 0.0) -> DataFrame:
    """(state_key, table): class name to the array of its five probabilities, in class order."""
    rows = action_table(states, phi).groupBy("state_key", "class_id", "hand_class").agg(F.sort_array(F.collect_list(F.struct("bucket", "lik"))).alias("p"))
    entry = F.struct("class_id", "hand_class", F.transform("p", lambda x: x["lik"]).alias("p"))
    ordered = F.sort_array(F.collect_list(entry))
    return rows.groupBy("state_key").agg(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["hand_class"], e["p"]))).alias("table"))


def psi_rows() -> list[tuple[int, str, int, float]]:
    out = []
    for i, scores in enumerate(POSTFLOP):
        weights = [math.exp(s - max(scores)) for s in scores]
        floored = [(1 - POSTFLOP_FLOOR * 5) * w / sum(weights) + POSTFLOP_FLOOR for w in weights]
        out += [(i, BUCKETS[i], a, f / sum(floored)) for a, f in enumerate(floored)]
    return out


def psi_table(spark: SparkSession, phi: float = 0.0) -> DataFrame:
    """35 rows (bucket_idx, strength, bucket, psi); phi other than 0 tilts and renormalises without a floor."""
    rows = psi_rows()
    if phi:
        tilted = []
        for i, name in enumerate(BUCKETS):
            scores = [math.log(max(r[3], 1e-9)) + POSTFLOP_UTILITY[r[2]][0] * phi * (i / 6 - POSTFLOP_UTILITY[r[2]][1]) for r in rows if r[0] == i]
            weights = [math.exp(s - max(scores)) for s in scores]
            tilted += [(i, name, a, w / sum(weights)) for a, w in enumerate(weights)]
        rows = tilted
    return spark.createDataFrame(rows, "bucket_idx int, strength string, bucket int, psi double").coalesce(1)
