"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are grouped by their nearest of some centroids. Relative to its centroid a
vector is a length and a direction; the direction is rotated at random and only
the signs of its coordinates are kept, packed to bits, with the inner product of
sign vector and direction as a correction scalar. With these the inner product of
any query's direction is estimated without bias and with a known error bound, so
bounds on distances follow, and only vectors whose lower bound is below the
tenth smallest upper bound are reranked on the original components.

Every row is indexed. Centroids are fitted on a bounded sample. How many lists a
query visits is measured: for a few queries the true neighbours are found among
all entries, and so many of the nearest lists are visited as hold nearly all of
them. Equal vectors are one entry that holds its smallest ids, as many as an answer
may need, so copies do not swell a list. Every row has a number of its own, so rows
that share an id are all candidates. Large lists are read in blocks of entries, and
lists that many queries visit in blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import written
from rangeloom.llm.skew import lookup

NEIGHBOURS, QUERY_EVERY = 10, 100
#: Sample on which centroids are fitted, vectors for each list on average, and most lists.
SAMPLE_ROWS, LIST_ROWS, MOST_LISTS = 16_384, 512, 2048
#: Queries whose true neighbours are sought among all entries, and the share of these that the visited lists must hold.
TRIAL_QUERIES, TRIAL_RECALL = 64, 0.97
#: Entries of a list, and queries, that one comparison reads; queries of a list that one task answers; standard deviations that the error bound allows.
BLOCK_ENTRIES, BLOCK_QUERIES, TASK_QUERIES, DEVIATIONS = 8192, 512, 8192, 3.0
SEED = 11


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from ``k`` of the rows."""
    c = x[np.random.default_rng(SEED).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, distance from the centre, correction scalar) of each row; a row at its centre has length 0."""
    away = (x - centre) @ turn
    length = np.sqrt((away * away).sum(1))
    unit = away / np.where(length > 0, length, 1)[:, None]
    bits = unit > 0
    scalar = np.abs(unit).sum(1) / math.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), length, np.where(length > 0, scalar, 1.0)


def estimates(q: np.ndarray, centre: np.ndarray, turn: np.ndarray, bits: np.ndarray, length: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on the squared distances of each query to each coded vector."""
    d = q.shape[1]
    away = (q - centre) @ turn
    norm = np.sqrt((away * away).sum(1))
    unit = away / np.where(norm > 0, norm, 1)[:, None]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    inner = (unit.astype(np.float32) @ signs.T) / (math.sqrt(d) * scalar[None, :])
    error = DEVIATIONS * np.sqrt(np.maximum(0, 1 - scalar**2)) / scalar / math.sqrt(max(1, d - 1)) + 1e-5
    scale = 2 * norm[:, None] * length[None, :]
    base = norm[:, None] ** 2 + length[None, :] ** 2
    return base - scale * np.minimum(1, inner + error[None, :]), base - scale * np.maximum(-1, inner - error[None, :])


IDS = "array<struct<nameless:boolean,id:bigint,row:bigint>>"
_IDS = pa.list_(pa.struct([("nameless", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())]))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v, dim, key) of vectors that are neither null nor zero and hold only finite numbers; the key is equal for equal vectors, the row's number is its own."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    same = F.transform(v, lambda x: x + F.lit(0.0))  # -0 counts as 0
    return rows.select("row", "id", same.alias("v"), F.size("v").alias("dim"), F.sha2(F.array_join(F.transform(same, lambda x: x.cast("string")), ","), 256).alias("key"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _probes(homes: DataFrame, queries: DataFrame, lists: dict[int, np.ndarray], k: int) -> int:
    """Nearest lists that hold ``TRIAL_RECALL`` of the true neighbours of ``TRIAL_QUERIES`` queries, over all entries."""
    trial: dict[int, list] = {}
    for r in queries.orderBy("key").limit(TRIAL_QUERIES).collect():
        trial.setdefault(r["dim"], []).append(r["v"])
    if not trial or max((len(c) for c in lists.values()), default=1) == 1:
        return 1
    known = {d: np.array(x) for d, x in trial.items()}
    shared = homes.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.asarray(whole.column("dim").to_pylist(), dtype=np.int64)
            for d in set(dims.tolist()) & set(shared.value):
                part, q = whole.filter(pa.array(dims == d)), shared.value[d]
                x = _matrix(part.column("v"), d)
                far = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
                n = min(k, len(x))
                near = np.argpartition(far, n - 1, axis=1)[:, :n]
                number = np.asarray(part.column("list").to_pylist(), dtype=np.int32)
                who = np.repeat(np.arange(len(q)), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), d), pa.int32()), pa.array(who, pa.int32()), pa.array(number[near.ravel()], pa.int32()), pa.array(far[who, near.ravel()], pa.float64())], ["dim", "q", "list", "far"])

    best = Window.partitionBy("dim", "q").orderBy("far", "list")
    rows = homes.select("dim", "list", "v").mapInArrow(run, "dim int, q int, list int, far double")
    rows = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect()
    ranks = []
    for d, q in known.items():
        c = lists.get(d, np.zeros((1, d)))
        far = (c * c).sum(1)[None, :] - 2 * q @ c.T
        place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
        ranks += [int(place[r["q"], r["list"]]) + 1 for r in rows if r["dim"] == d]
    return int(np.quantile(ranks, TRIAL_RECALL, method="higher")) + 1 if ranks else 1


def _assigned(rows: DataFrame, lists: dict[int, np.ndarray], probes: int, columns: str) -> DataFrame:
    """Rows (columns..., v, dim) with each of the ``probes`` nearest lists of their dimension."""
    shared = rows.sparkSession.sparkContext.broadcast(lists)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                dims = np.asarray(batch.column("dim").to_pylist(), dtype=np.int64)
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    c = shared.value.get(int(d))
                    c = np.zeros((1, d)) if c is None else c
                    x = _matrix(part.column("v"), int(d))
                    far = (c * c).sum(1)[None, :] - 2 * x @ c.T
                    k = min(probes, len(c))
                    near = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
                    again = part.take(pa.array(np.repeat(np.arange(len(x)), k)))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(again.column(n) for n in names)], ["list", *names])

    return rows.select(*names).mapInArrow(run, f"list int, {columns}")


def _found(pairs: DataFrame, lists: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query, ids, distance) candidates of each block; rows of a block come together, entries before queries."""
    shared = pairs.sparkSession.sparkContext.broadcast(lists)
    block_queries = BLOCK_QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, queries, waiting, code = None, [], [], 0, None

        def answer() -> pa.RecordBatch:
            """Candidates of the queries that wait, from the block's entries."""
            nonlocal code, waiting
            who, which, score = [], [], []
            if entries and queries:
                d, number = key[0], key[1]
                c = shared.value.get(d)
                centre, turn = (np.zeros(d) if c is None else c[number]), rotation(d)
                if code is None:
                    x = np.concatenate([e[1] for e in entries])
                    code = (pa.concat_arrays([e[0] for e in entries]), x, *encode(x, centre, turn))
                ids, x, bits, length, scalar = code
                names, q = pa.concat_arrays([e[0] for e in queries]), np.concatenate([e[1] for e in queries])
                low, high = estimates(q, centre, turn, bits, length, scalar)
                n = min(k, len(x))
                limit = np.partition(high, n - 1, axis=1)[:, n - 1]
                for i in range(len(q)):
                    near = np.flatnonzero(low[i] <= limit[i])
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    # equal distances are kept together, so that ties go by id later
                    good = exact <= (np.partition(exact, n - 1)[n - 1] if len(exact) > n else np.inf)
                    who.append(np.full(good.sum(), i))
                    which.append(near[good])
                    score.append(exact[good])
                who, which, score = np.concatenate(who), np.concatenate(which), np.concatenate(score)
                out = [names.take(pa.array(who)), ids.take(pa.array(which)), pa.array(score)]
            else:
                out = [pa.array([], pa.string()), pa.array([], _IDS), pa.array([], pa.float64())]
            queries.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(out, ["key", "ids", "score"])

        for batch in batches:
            at = np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("dim", "list", "block", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                dim, number, block, shift, kind = at[a].tolist()
                if (dim, number, block, shift) != key:
                    yield answer()
                    key, entries, code = (dim, number, block, shift), [], None
                for start in range(a, b, block_queries):
                    part = batch.slice(start, min(block_queries, b - start))
                    if kind == 0:
                        entries.append((part.column("ids"), _matrix(part.column("v"), dim)))
                    else:
                        queries.append((part.column("key"), _matrix(part.column("v"), dim)))
                        waiting += part.num_rows
                        if waiting >= block_queries:
                            yield answer()
        yield answer()

    near = pairs.repartition("dim", "list", "block", "part").sortWithinPartitions("dim", "list", "block", "part", "kind", "key")
    return near.mapInArrow(run, f"key string, ids {IDS}, score double")


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = QUERY_EVERY, k: int = NEIGHBOURS, probes: int | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``, itself excepted.

    Vectors that are null, zero or not finite take no part. Vectors of different
    lengths are indexed apart and never neighbours; very long ones are indexed like
    others. Rows that share an id are rows of their own: each is a candidate, of one
    another too, and each is a query. Rows without an id are no queries, but are
    found like others. Ties go to the smaller id, those without one last. Extra
    columns are not read; an empty table gives no rows.
    """
    rows = written(usable(df, id_col, vector_col), "ann-rows")
    named = F.struct(F.col("id").isNull().alias("nameless"), "id", "row")
    place = F.row_number().over(Window.partitionBy("key").orderBy("named"))
    # of equal vectors only the smallest k + 1 ids can be in an answer; each task drops the others before the shuffle
    few = rows.select("key", "dim", named.alias("named")).withColumn("r", place).filter(F.col("r") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("named")).alias("ids"))
    vectors = rows.groupBy("key", "dim").agg(F.first("v").alias("v"))
    entries = written(vectors.join(ids, "key"), "ann-entries")
    total = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    sample: dict[int, list] = {}
    for r in entries.orderBy("key").limit(SAMPLE_ROWS).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    lists = {d: centroids(np.array(x), max(1, min(MOST_LISTS, total[d] // list_rows, len(x)))) for d, x in sample.items()}
    wanted = rows.filter(F.col("id") % every == 0).select("id", "row", "key")
    asked = written(wanted.groupBy("key").agg(F.count("*").alias("uses")), "ann-queries")
    queries = entries.join(asked.select("key"), "key").select("key", "dim", "v")
    homes = written(_assigned(entries, lists, 1, f"key string, dim int, v array<double>, ids {IDS}"), "ann-lists")
    visits = written(_assigned(queries, lists, probes or _probes(homes, queries, lists, k + 1), "key string, dim int, v array<double>"), "ann-visits")
    blocks = homes.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK_ENTRIES).cast("int").alias("blocks"))
    parts = visits.groupBy("dim", "list").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("parts"))
    plan = written(blocks.join(parts, ["dim", "list"]), "ann-plan")
    # lists have a bounded number for each length; a table of very many lengths is joined by them
    plan_side = F.broadcast(plan) if sum(map(len, lists.values())) <= 4 * MOST_LISTS and len(total) <= 64 else plan
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spread = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    kept = homes.join(plan_side, ["dim", "list"]).select("dim", "list", spread("blocks").alias("block"), each("parts").alias("part"), F.lit(0).alias("kind"), "key", "ids", "v")
    asks = visits.join(plan_side, ["dim", "list"]).select("dim", "list", each("blocks").alias("block"), spread("parts").alias("part"), F.lit(1).alias("kind"), "key", F.lit(None).cast(IDS).alias("ids"), "v")
    candidates = _found(kept.unionByName(asks), lists, k + 1)
    one = candidates.select("key", "score", F.explode("ids").alias("named"))
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "named"))).filter(F.col("r") <= k + 1)
    answers = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "named"))).alias("near")).join(asked, "key")
    out = lookup(wanted.withColumnRenamed("id", "query_id"), written(answers, "ann-answers"), "key", "uses", wanted.count, ["query_id", "row"])
    own = F.slice(F.filter("near", lambda x: x["named"]["row"] != F.col("row")), 1, k)
    out = out.select("query_id", F.posexplode(own).alias("p", "n"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.named.id").alias("vec_id"), F.col("n.score").alias("score"))
