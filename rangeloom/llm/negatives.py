"""Hard negatives by blocked matrix products.

Anchors are read in blocks of bounded size. A block is broadcast, and each task
multiplies it with its own rows, chunk by chunk: one pass keeps each anchor's best
rows of its own label, the next the best rows of other labels whose score lies in the
window that each of these positives opens. What a task keeps is a few rows for each
anchor, and such lists merge: the best of all rows are among the best of each task.

Vectors are whole numbers. Their products are made in float64, which is exact while
no sum can reach 2^53; chunks where one could are multiplied as Python integers.
Every row meets every anchor of its length, and nothing is dealt by label or id, so
no label or copy can make a task large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import fresh_path, written

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score lies between these shares (in percent) of its positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
#: Bytes of an anchor block, and rows and anchors of one product.
BLOCK_BYTES, CHUNK_ROWS, CHUNK_ANCHORS = 32 << 20, 4096, 1024
#: Bits that hold a row's place in a chunk, and the size that no product in float64 may reach.
_PLACE, _EXACT = 13, 2.0**48

FOUND = "anchor_row long, positive int, score long, big string, big_order string, id long, row long"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(row, id, label, v, dim): a number for each row, and its components times ``scale``, rounded down.

    Rows without a label or a vector, or with a component that is null, not finite
    or too large to be scaled, are left out.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).filter("label is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor as doubles: a component may pass 64 bits
    down = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", down.alias("v"), F.size("v").alias("dim"))


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``x`` and ``a``, exact: 64-bit integers, or Python's where these could be passed."""
    if not x.shape[1]:
        return np.zeros((len(x), len(a)), np.int64)
    top = np.abs(x).max(initial=0.0) * np.abs(a).max(initial=0.0) * x.shape[1]
    if top < _EXACT:
        return (x @ a.T).astype(np.int64)
    exact = lambda m: np.array([[int(y) for y in r] for r in m.tolist()], dtype=object)
    return exact(x) @ exact(a).T


def _keys(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Keys that sort rows of a chunk (already in the order of ties) by score; rows that are not allowed come first of all."""
    place = (1 << _PLACE) - 1 - np.arange(len(scores))
    if scores.dtype == object:
        out = scores * (1 << _PLACE) + place[:, None].astype(object)
        out[~allowed] = -(1 << 4096)
        return out
    return np.where(allowed, (scores << _PLACE) | place[:, None], np.iinfo(np.int64).min)


class Best:
    """The best ``k`` (score, id, row) of each slot, from lists that come in any order."""

    def __init__(self, k: int):
        self.k, self.lists, self.waiting = k, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        if len(slot):
            self.lists.append((slot, score.astype(object) if self._wide(score) else score, ids, known, row))
            self.waiting += len(slot)
            if self.waiting > 1 << 20:
                self.lists = [self.merged()]
                self.waiting = len(self.lists[0][0])

    def _wide(self, score: np.ndarray) -> bool:
        return score.dtype == object or any(x[1].dtype == object for x in self.lists)

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self.lists:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))
        slot, score, ids, known, row = (np.concatenate([x[i] for x in self.lists]) for i in range(5))
        if score.dtype == object:
            order = np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], not known[i], ids[i], row[i])), dtype=np.int64)
        else:
            order = np.lexsort((row, ids, ~known, -score, slot))
        slot = slot[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        begins = np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        order = order[np.arange(len(slot)) - begins < self.k]
        return tuple(np.concatenate([x[i] for x in self.lists])[order] for i in range(5))


def _chunks(batches: Iterator[pa.RecordBatch], dims: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, vectors, labels, ids, known, rows) of at most ``CHUNK_ROWS`` rows in the order of ties: by id, those without one last."""
    for whole in batches:
        lengths = whole.column("dim").to_numpy(zero_copy_only=False)
        for d in sorted(set(lengths.tolist()) & dims):
            part = whole.filter(pa.array(lengths == d))
            for start in range(0, part.num_rows, CHUNK_ROWS):
                piece = part.slice(start, CHUNK_ROWS)
                known = np.asarray(piece.column("id").is_valid())
                ids = piece.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                row = piece.column("row").to_numpy(zero_copy_only=False)
                order = np.lexsort((row, ids, ~known))
                x = np.asarray(piece.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(piece.num_rows, d)
                yield d, x[order], piece.column("label").to_numpy(zero_copy_only=False)[order], ids[order], known[order], row[order]


def _sortable(number: str) -> str:
    if number[0] != "-":
        return f"{len(number):06d}{number}"
    digits = number[1:]
    return f"{999_999 - len(digits):06d}" + "".join(str(9 - int(c)) for c in digits)


def _batch(anchors: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    # scores past 64 bits travel as text too, with a text that sorts as they do among those of one sign
    big = [str(s) if abs(int(s)) >= 2**63 else None for s in score.tolist()] if score.dtype == object else [None] * len(score)
    order = [None if b is None else _sortable(b) for b in big]
    narrow = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score.tolist()], dtype=np.int64) if score.dtype == object else score
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors), pa.array(place.astype(np.int32)), pa.array(narrow), pa.array(big, pa.string()), pa.array(order, pa.string()), pa.array(ids, mask=~known), pa.array(row)],
        ["anchor_row", "positive", "score", "big", "big_order", "id", "row"],
    )


def _positives(rows: DataFrame, block, k: int) -> DataFrame:
    """(FOUND) each task's best ``k`` rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(k) for d in block.value}
        for d, x, labels, ids, known, row in _chunks(batches, set(block.value)):
            who, theirs, vectors = block.value[d]["row"], block.value[d]["label"], block.value[d]["v"]
            for label in np.intersect1d(labels, theirs):
                at, of = np.flatnonzero(labels == label), np.flatnonzero(theirs == label)
                for start in range(0, len(of), CHUNK_ANCHORS):
                    some = of[start : start + CHUNK_ANCHORS]
                    score = products(x[at], vectors[some])
                    key = _keys(score, row[at][:, None] != who[some][None, :])
                    n = min(k, len(at))
                    top = np.argpartition(key, len(at) - n, axis=0)[len(at) - n :]
                    good = np.take_along_axis(row[at][:, None] != who[some][None, :], top, axis=0)
                    slot = np.broadcast_to(some[None, :], top.shape)[good]
                    best[d].add(slot, np.take_along_axis(score, top, axis=0)[good], ids[at][top][good], known[at][top][good], row[at][top][good])
        for d, b in best.items():
            slot, score, ids, known, row = b.merged()
            yield _batch(block.value[d]["row"][slot], np.zeros(len(slot)), score, ids, known, row)

    return rows.mapInArrow(run, FOUND)


def _negatives(rows: DataFrame, block, k: int) -> DataFrame:
    """(FOUND) each task's best ``k`` rows of other labels in the window of each anchor's positives; ``positive`` numbers these from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = {d: b["low"].shape[1] for d, b in block.value.items()}
        best = {d: Best(k) for d in block.value}
        for d, x, labels, ids, known, row in _chunks(batches, set(block.value)):
            held = block.value[d]
            for start in range(0, len(held["row"]), CHUNK_ANCHORS):
                some = np.arange(start, min(start + CHUNK_ANCHORS, len(held["row"])))
                score = products(x, held["v"][some])
                key = _keys(score, labels[:, None] != held["label"][some][None, :])
                order = np.argsort(key, axis=0)[::-1]
                ranked = np.take_along_axis(score, order, axis=0)
                n_allowed = (labels[:, None] != held["label"][some][None, :]).sum(axis=0)
                for j in range(wide[d]):
                    low, high = held["low"][some, j], held["high"][some, j]
                    # allowed rows come first and by falling score: those above the window are passed over
                    passed = ((ranked > high[None, :]) & (np.arange(len(x))[:, None] < n_allowed[None, :])).sum(axis=0)
                    for step in range(k):
                        at = passed + step
                        inside = at < n_allowed
                        at = np.minimum(at, len(x) - 1)
                        s = np.take_along_axis(ranked, at[None, :], axis=0)[0]
                        good = (inside & (s >= low) & held["has"][some, j]).astype(bool)
                        chosen = np.take_along_axis(order, at[None, :], axis=0)[0][good]
                        best[d].add(some[good] * wide[d] + j, s[good], ids[chosen], known[chosen], row[chosen])
        for d, b in best.items():
            slot, score, ids, known, row = b.merged()
            yield _batch(block.value[d]["row"][slot // wide[d]], slot % wide[d], score, ids, known, row)

    return rows.mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each (anchor_row, positive), numbered from 0 as ``place``; a task has at most ``k`` for each, so a group has at most ``k`` for each task."""
    w = Window.partitionBy("anchor_row", "positive").orderBy(F.col("score").desc(), F.col("big_order").desc_nulls_last(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < k)


def _share(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole score between ``low`` and ``high`` percent of ``score``."""
    return -(-low * score // 100), high * score // 100


def mine(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    *,
    every: int = ANCHOR_EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. Scores are inner
    products of the vectors in whole numbers (``whole_vectors``). For each of an
    anchor's best ``positives`` other rows of its label: the best ``negatives`` rows
    of other labels with a score between the two shares of the positive's. Ties go to
    the smaller id.

    Rows without an id are no anchors, but are found like others, after those with
    one among equals. A repeated row is a row of its own: as an anchor, and as the
    positive of its copy. Vectors of other lengths never meet. Scores past 64 bits
    are compared exactly and returned as the nearest 64-bit number. Extra columns
    are not read; an empty table, or one without anchors, gives no rows.

    Anchors are broadcast in blocks of ``block_bytes`` at most (by their number and
    the mean length), each of which reads the table twice.
    """
    spark = df.sparkSession
    rows = written(whole_vectors(df, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale), "negatives-rows")
    anchors = rows.filter(F.col("id") % every == 0)
    size = anchors.agg(F.coalesce(F.sum(F.col("dim") * 8 + 64), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, -(-size // block_bytes))
    paths = []
    for b in range(blocks):
        # a bounded part of the anchors, by a hash of the row's number
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        if not own:
            continue
        held: dict[int, dict] = {}
        for d in {r["dim"] for r in own}:
            some = [r for r in own if r["dim"] == d]
            held[d] = {"row": np.array([r["row"] for r in some]), "label": np.array([r["label"] for r in some]), "v": np.array([r["v"] for r in some], np.float64).reshape(len(some), d)}
        shared = spark.sparkContext.broadcast(held)
        near = written(_first(_positives(rows, shared, positives), positives), "negatives-positives")
        # at most ``positives`` rows for each anchor of the block
        windows = {(r["anchor_row"], r["place"]): int(r["big"] or r["score"]) for r in near.select("anchor_row", "place", "score", "big").collect()}
        for x in held.values():
            shares = [[_share(windows[r, j], low_percent, high_percent) if (r, j) in windows else (1, 0) for j in range(positives)] for r in x["row"].tolist()]
            fits = all(abs(v) < 2**62 for s in shares for p in s for v in p)
            x["low"], x["high"] = (np.array([[p[i] for p in s] for s in shares], np.int64 if fits else object).reshape(-1, positives) for i in (0, 1))
            x["has"] = np.array([[(r, j) in windows for j in range(positives)] for r in x["row"].tolist()], bool).reshape(-1, positives)
        again = spark.sparkContext.broadcast(held)
        far = _first(_negatives(rows, again, negatives), negatives).select("anchor_row", F.col("positive").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
        out = near.select("anchor_row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(far.withColumn("rank", F.col("rank") + 1), ["anchor_row", "place"])
        paths.append(fresh_path(spark, "negatives-block"))
        out.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        ).write.parquet(paths[-1])
        shared.destroy()
        again.destroy()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
