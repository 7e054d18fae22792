"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import table


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.pii import find_documents

    return find_documents(table(spark, sf_dir, "documents"))


def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.rabitq import search

    return search(table(spark, sf_dir, "embeddings"))


def op3_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))[0]


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.quotes import link

    return link(table(spark, sf_dir, "conversations"))


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.minmax import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_seekable_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.frames import encode_and_read

    return encode_and_read(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one, as noise to mine around."""
    from rangeloom.llm.negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=moved)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_weak_pii, op2_rotated_codes, op3_nbsvm_toxicity, op4_warc_members, op5_rule_cascade, op6_vector_packing, op7_blob_ledger, op8_quotation_links, op9_cube_mixing, op10_minmax_near_dedup]
    own += [op11_seekable_token_frames, op12_hard_negatives, op13_phrase_collocations, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from rangeloom.llm import oracles

    return {
        "op4_warc_members": oracles.OP4,
        "op5_rule_cascade": oracles.OP5,
        "op7_blob_ledger": oracles.OP7,
        "op10_minmax_near_dedup": oracles.OP10,
        "op12_hard_negatives": oracles.OP12,
        "op13_phrase_collocations": oracles.OP13,
    }
