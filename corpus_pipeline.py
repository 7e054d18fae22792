"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from rangeloom.llm import minmax, mixing, packing, pii, toxicity
from rangeloom.llm.common import fresh_path, table, word_count

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` and no others; those that are missing are null."""
    have = set(docs.columns)
    return docs.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", "))])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts as toxic."""
    docs = columns(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


#: Shingle length in words and least similarity in percent of the near-duplicate stage.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, once.

    Decided row by row: a text that shares its id with others stays or goes on its own.
    Documents without an id cannot be told from one another and all stay.
    """
    return minmax.one_of_each(columns(docs), LEAST_PERCENT, SHINGLE_WORDS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced by its kind; ``n_chars`` follows the texts that change.

    Each row is redacted on its own, repeated ones alike; null texts stay null.
    """
    return pii.redacted(columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    docs = columns(docs)
    copies = mixing.balanced_copies(docs, "doc_id", "source", word_count(F.col("text")))
    # rows that share an id share the larger decision; those without an id stay as they are
    per = copies.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__n"))
    taken = docs.join(per, F.col("doc_id") == F.col("__id"), "left").withColumn("__n", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("__n")))
    return taken.filter("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long")))).select(*NAMES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens; every row is packed, repeated ones each, and a null text is one token."""
    return packing.pack(columns(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier, hashing, sampling and packing have no equivalent in SQL.
ORACLE_SQL = None
