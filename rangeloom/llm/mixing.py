"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a token target; every document of the source an expected
number of copies, target / source size. The whole part is taken outright. The
fractional parts are inclusion probabilities, and the cube method rounds them:
in its flight phase it moves the probabilities of three documents along the one
direction that changes neither the expected token total nor the expected
document total, until one of them is 0 or 1. What is left when fewer than three
documents are undecided is a small landing problem.

A source may hold most of the corpus, so the flight runs in blocks of bounded
size (chosen by a hash of the row, not by partition, so that reruns agree, and of
its place among equal rows, so that these are spread too); the at most two
undecided documents of each block fly again among themselves, level by level, and
only the last level lands. Flights go from large documents to small ones; the last
one leaves a few of all sizes, and the landing takes the best of their roundings.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import ranked, word_count, written
from rangeloom.llm.skew import lookup

#: Source weights, dealt in code point order and repeating.
WEIGHTS = (5, 2, 1)
#: Share of all tokens that the mix holds, and the most often a document may occur.
MIX_SHARE, MAX_COPIES = 1.5, 2
#: Documents that one flight handles at a time.
BLOCK_ROWS = 4000
#: Up to so many sources their parameters are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 20_000

#: Documents that the last flight leaves undecided beside its own two, so that the landing can choose among many roundings.
RESERVE = 12

EPS = 1e-9


def source_targets(
    sizes: DataFrame,
    source: str,
    size: str,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = MIX_SHARE,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """(source, ordinal, n_docs, source_size, target): one row for each source, kept in the shared folder.

    The budget ``share * total`` goes to the sources by weight; a target stops at
    ``max_copies`` times its source's size and the excess is shared again by weight
    among the rest, until none is above. Each round of that is one aggregate over the
    sources, so their number does not matter; the level only rises, and sources that
    have stopped stay so.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size")
    )
    per = ranked(per, [F.col("source").asc_nulls_last()], "ordinal", "mix-sources")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int")))
    per = written(per.withColumn("cap", F.col("source_size") * float(max_copies)), "mix-sources")
    level, stopped = 0.0, -1
    budget = float(share) * (per.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("cap") < level * F.col("weight")
        r = per.agg(F.sum(full.cast("int")).alias("stopped"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if (r["stopped"] or 0) == stopped or not r["open"]:
            break
        stopped, level = r["stopped"], (budget - r["caps"]) / r["open"]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if r["open"] else F.col("cap")
    return per.select("source", "ordinal", "n_docs", "source_size", target.alias("target"))


def fly(p: list[float], x: list[float], rng: random.Random) -> list[int]:
    """Flight phase in place over probabilities ``p`` and sizes ``x``.

    Returns the indices (at most two) that stay undecided. Each step takes three
    undecided documents; the vector orthogonal to (1, 1, 1) and to their sizes is
    the null space of both balancing constraints.
    """
    undecided: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            undecided.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(undecided) == 3:
            a, b, c = undecided
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            top = max(abs(v) for v in u)
            u = (1.0, -1.0, 0.0) if top == 0 else tuple(v / top for v in u)
            up = min(((1 - p[i]) if v > 0 else p[i]) / abs(v) for i, v in zip(undecided, u, strict=True) if v)
            down = min((p[i] if v > 0 else (1 - p[i])) / abs(v) for i, v in zip(undecided, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            rest = []
            for i, v in zip(undecided, u, strict=True):
                p[i] += step * v
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = float(round(p[i]))
                else:
                    rest.append(i)
            undecided = rest
    return undecided


def reserved(p: list[float], x: list[float]) -> list[int]:
    """Indices of at most ``RESERVE`` undecided documents, evenly through their sizes, that the last flight leaves for the landing."""
    undecided = sorted((i for i in range(len(p)) if EPS < p[i] < 1 - EPS), key=lambda i: (x[i], i))
    if len(undecided) <= RESERVE:
        return undecided
    return [undecided[k * (len(undecided) - 1) // (RESERVE - 1)] for k in range(RESERVE)]


def land(p: list[float], x: list[float], undecided: list[int]) -> None:
    """Landing phase in place: the rounding with the smallest error in tokens, then in documents, of all roundings."""
    size, chance = np.array([x[i] for i in undecided]), np.array([p[i] for i in undecided])
    taken = (np.arange(1 << len(undecided))[:, None] >> np.arange(len(undecided))) & 1
    tokens, docs = np.abs(taken @ size - chance @ size), np.abs(taken.sum(axis=1) - chance.sum())
    best = taken[np.lexsort((np.arange(len(taken)), docs, tokens))[0]]
    for i, t in zip(undecided, best.tolist()):
        p[i] = float(t)


def _rounder(level: int, last: bool, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__size", "__order", "__id"], ascending=[False, True, True], kind="stable")
        p, x = block["__p"].tolist(), [float(v) for v in block["__size"]]
        rng = random.Random(f"{seed}/{level}/{block['__ordinal'].iloc[0]}/{block['__block'].iloc[0]}")
        kept = reserved(p, x) if last else []
        rest = sorted(set(range(len(p))) - set(kept))
        flown, sizes = [p[i] for i in rest], [x[i] for i in rest]
        undecided = [rest[i] for i in fly(flown, sizes, rng)]
        for i, v in zip(rest, flown, strict=True):
            p[i] = v
        if last:
            land(p, x, kept + undecided)
        return block.assign(__p=p)

    return run


def balanced_copies(
    df: DataFrame,
    id_col: str,
    source_col: str,
    size: Column,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = MIX_SHARE,
    max_copies: int = MAX_COPIES,
    block_rows: int = BLOCK_ROWS,
    seed: int = 20240,
) -> DataFrame:
    """(id, size, source_size, target, copies) for each row of ``df``.

    Sizes null count as 0; a null source is a source of its own, ordered last; a
    null id is an ordinary id. Rows of size 0 take part like others (their copies
    weigh nothing). Repeated rows are decided one by one. An empty table gives an
    empty result. Only (id, source, size) are shuffled, whatever else ``df`` holds.
    """
    narrow = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"))
    # equal rows take numbers of their own; which of them has which does not matter
    narrow = written(ranked(narrow, [F.col("__id"), F.col("__size"), F.col("source"), F.monotonically_increasing_id()], "__rank", "mix-ranks"), "mix-sizes")
    targets = written(source_targets(narrow, "source", "__size", weights, share, max_copies), "mix-targets")
    side = targets.agg(F.count("*").alias("sources"), F.max("n_docs").alias("most")).first()
    if side["sources"] <= BROADCAST_SOURCES:
        rows = narrow.join(F.broadcast(targets.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source")))
    else:  # a source may hold much of the table; a null one is a key like others
        named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
        right = targets.withColumn("__source", named).withColumn("__n", F.col("n_docs")).drop("source")
        rows = lookup(narrow.withColumn("__source", named), right, "__source", "__n", narrow.count, ["__id", "__size"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + EPS)
    rows = rows.select(
        "__id",
        "__size",
        "source_size",
        "target",
        F.col("ordinal").alias("__ordinal"),
        whole.cast("long").alias("__whole"),
        F.greatest(F.lit(0.0), expected - whole).alias("__p"),
        F.xxhash64(F.lit(seed), "__id", "__size", "__rank").alias("__order"),
        F.ceil(F.col("n_docs") / block_rows).cast("long").alias("__blocks"),
    )
    done, most, level = [], side["most"] or 0, 0
    while True:
        last = most <= block_rows
        blocks = F.lit(1).cast("long") if last else F.col("__blocks")
        dealt = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "__order"), blocks))
        flown = dealt.groupBy("__ordinal", "__block").applyInPandas(_rounder(level, last, seed), dealt.schema)
        if last:
            done.append(flown.drop("__block"))
            break
        flown = written(flown.drop("__block"), "mix-level")
        decided = F.col("__p").isin(0.0, 1.0)
        done.append(flown.filter(decided))
        # two undecided rows at most for each block of the level before
        rows = flown.filter(~decided).withColumn("__blocks", F.ceil(2 * F.col("__blocks") / block_rows).cast("long"))
        most, level = 2 * math.ceil(most / block_rows), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__whole") + F.col("__p").cast("long")).alias("copies"),
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """``balanced_copies`` over the word counts of ``documents``, with the words taken.

    Null and empty texts have size 0; very long texts count whole; repeated rows and
    null ids are decided one by one; extra columns are not read; an empty table gives no rows.
    """
    out = balanced_copies(docs, "doc_id", "source", word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
