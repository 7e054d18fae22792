"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that occur in a text, lower-cased; every
n-gram counts. Training rows give each hash its log-count ratio
r = log(P(hash | toxic) / P(hash | not)), shrunk towards 0 by its standard error, so
that ratios of rare n-grams weigh little without being left out. A logistic
regression is then fitted on presence times ratio. Text enters alone: neither labels
nor any other column is an input of a score.

The training rows are bounded by ``train_rows`` and ``train_chars``: of the labelled
documents those with the smallest hashes of their ids. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import written

#: Lengths of n-grams in characters, and bits of a feature's number: one for the length, the others hashed.
NGRAMS, HASH_BITS = (4, 6), 22
#: Bounds of the training sample: rows, and characters of all their texts (one text has at most a sixteenth).
TRAIN_ROWS, TRAIN_CHARS = 8_000, 16_000_000
#: Smoothing of the counts, the squared z at which half of a ratio is kept, weight of the ridge, passes over the sample.
SMOOTHING, HALF_Z2, RIDGE, EPOCHS = 1.0, 7.0, 2e-3, 10
THRESHOLD = 0.7
#: Characters that are hashed at a time, and texts handed to the hasher together.
CHUNK_CHARS, CHUNK_TEXTS = 1 << 20, 256

_MIX = np.uint32(0x9E3779B1)


def features(texts: list[str | None], bits: int = HASH_BITS) -> Iterator[np.ndarray]:
    """The distinct features of each text, in turn.

    A text is read with a space before and after it. Texts are hashed together, but
    the n-grams of each are taken by its own bounds, so any character may occur in
    a text. Text that is longer than a chunk is one chunk.
    """
    low = [f" {(t or '').lower()} " for t in texts]
    half = bits - 1
    last = np.empty(1 << half, dtype=np.int32)
    start = 0
    while start < len(low):
        end, size = start, 0
        while end < len(low) and (end == start or size + len(low[end]) <= CHUNK_CHARS):
            size += len(low[end])
            end += 1
        code = np.frombuffer("".join(low[start:end]).encode("utf-32-le", "surrogatepass"), "<u4")
        number = np.arange(len(code), dtype=np.int32)
        h, kept = np.zeros(len(code), dtype=np.uint32), []
        for n in range(1, max(NGRAMS) + 1):
            if len(code) < n:
                break
            h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * _MIX
            h ^= h >> np.uint32(15)
            if n in NGRAMS:
                kept.append((n, ((h * _MIX) >> np.uint32(32 - half)).astype(np.int32)))
        at = 0
        for t in low[start:end]:
            parts = [np.zeros(0, dtype=np.int32)]
            for n, hashes in kept:
                own = hashes[at : max(at, at + len(t) - n + 1)]
                # of equal hashes only the last place finds itself
                last[own] = number[: len(own)]
                parts.append(own[last[own] == number[: len(own)]] + (NGRAMS.index(n) << half))
            at += len(t)
            yield np.concatenate(parts)
        start = end


@dataclass
class Model:
    """``weight`` is what the presence of each feature adds, ``bias`` the constant."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        bits = len(self.weight).bit_length() - 1
        z = np.array([self.bias + self.weight[f].sum(dtype=np.float64) for f in features(texts, bits)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score_batch(self, column: pa.Array) -> np.ndarray:
        texts = column.to_pylist()
        return np.concatenate([np.zeros(0), *(self.score(texts[a : a + CHUNK_TEXTS]) for a in range(0, len(texts), CHUNK_TEXTS))])


def ratios(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Shrunk log-count ratios from the numbers of toxic and clean texts that each feature occurs in; 0 for those that never occur."""
    a, b = toxic + SMOOTHING * n1 / (n1 + n0), clean + SMOOTHING * n0 / (n1 + n0)
    r = np.log(a / n1) - np.log(b / n0)
    z2 = r * r / (1 / a + 1 / b)
    return np.where(toxic + clean > 0, r * z2 * z2 / (z2 * z2 + HALF_Z2**2), 0.0).astype(np.float32)


def fit(sets: list[np.ndarray], y: np.ndarray, size: int) -> Model:
    """Class-balanced logistic regression on present features times their ratios, by stochastic dual coordinate ascent."""
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    count = np.zeros((2, size))
    for f, k in zip(sets, y, strict=True):
        count[int(k)][f] += 1
    ratio = ratios(count[1], count[0], n1, n0)
    del count
    sign, share = np.where(y == 1, 1.0, -1.0), np.where(y == 1, n / (2 * n1), n / (2 * n0))
    values = [ratio[f] for f in sets]
    norm = np.array([float(v.astype(np.float64) @ v) + 1 for v in values])
    step = 1 / (1 + share * norm / (4 * RIDGE * n))
    weight, bias, dual = np.zeros(size, dtype=np.float32), 0.0, np.zeros(n)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            z = float(weight[sets[i]] @ values[i]) + bias
            move = step[i] * (1 / (1 + np.exp(np.clip(sign[i] * z, -40, 40))) - dual[i])
            dual[i] += move
            move *= share[i] * sign[i] / (RIDGE * n)
            weight[sets[i]] += np.float32(move) * values[i]
            bias += move
    return Model(weight * ratio, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents whose crc32(doc_id) mod 3 is not 1, within both bounds.

    Only ids that occur in ``docs`` count; contradicting labels of an id count as
    toxic. The chosen ids, at most ``rows``, are broadcast.
    """
    learnable = lambda c: c.isNotNull() & (F.crc32(c.cast("string").cast("binary")) % 3 != 1)
    marked = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(learnable(F.col("__id")) & F.col("toxic").isNotNull())
    marked = marked.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    here = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")).filter(learnable(F.col("__id")))
    here = here.groupBy("__id").agg(F.sum("n").alias("n")).filter(F.col("n") <= chars // 16)
    chosen = here.join(marked, "__id").withColumn("h", F.xxhash64("__id")).orderBy("h", "__id").limit(rows)
    # a window over at most ``rows`` rows
    so_far = F.sum("n").over(Window.orderBy("h", "__id"))
    chosen = chosen.withColumn("sum", so_far).filter(F.col("sum") <= chars).select("__id", "toxic")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, bits: int = HASH_BITS) -> Model:
    """Fit the model: features of the bounded sample in parallel, the regression in one task; only the weights reach the driver.

    Without labels of both classes all weights are 0 and all scores below the threshold.
    """
    sample = written(training_rows(docs, labels, train_rows, train_chars).repartition(max(8, train_rows // 128), "doc_id"), "toxicity-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_TEXTS):
                part = batch.slice(a, CHUNK_TEXTS)
                sets = [f.astype("<i4").tobytes() for f in features(part.column("text").to_pylist(), bits)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(sets, pa.binary())], ["doc_id", "toxic", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "features")), strict=True)))
        y = np.array([r[1] for r in rows])
        if not (len(y) and y.any() and not y.all()):
            model = Model(np.zeros(1 << bits, dtype=np.float32), -3.0)
        else:
            model = fit([np.frombuffer(r[2], "<i4") for r in rows], y, 1 << bits)
        raw, piece = model.weight.astype("<f4").tobytes(), 1 << 20
        for a in range(0, len(raw), piece):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([raw[a : a + piece]], pa.binary()), pa.array([model.bias], pa.float64())], ["at", "weight", "bias"])

    sets = written(sample.mapInArrow(extract, "doc_id long, toxic int, features binary"), "toxicity-features")
    parts = sets.coalesce(1).mapInArrow(learn, "at long, weight binary, bias double").collect()
    if not parts:
        return Model(np.zeros(1 << bits, dtype=np.float32), -3.0)
    return Model(np.frombuffer(b"".join(bytes(r["weight"]) for r in sorted(parts, key=lambda r: r["at"])), "<f4"), parts[0]["bias"])


def score_all(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts have a score like any other."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score_batch(batch.column("text")), pa.float64())], ["doc_id", "score"])

    scored = picked.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold; scored as they stream by."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.score_batch(batch.column("text")) < threshold))

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row of ``docs``.

    Null ids are never held out (and never labelled); repeated rows score alike, as
    do ties in any other column; null and empty texts have no n-grams and score by
    the constant alone; very long texts are scored whole; extra columns are not read;
    an empty table gives no rows, and labels without rows in ``docs`` are not used.
    """
    return score_all(docs, train(docs, labels))
