"""Hand histories: one file for each hand, read as whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.sources.shared import found

HANDS = "path string, session_id string, hand_no int, variant string, ante_trimming_status boolean, antes array<bigint>, blinds_or_straddles array<bigint>, min_bet bigint, starting_stacks array<bigint>, actions array<string>, hand int, players array<string>, finishing_stacks array<double>"
_KINDS = {x.split()[0]: x.split()[1] for x in HANDS.split(", ")}


def _field(text: Column, name: str) -> Column:
    raw = F.regexp_extract(text, rf"(?m)^{name}\s*=\s*(.*?)\s*$", 1)
    kind = _KINDS[name]
    if kind.startswith("array"):
        return F.from_json(raw, kind, {"allowSingleQuotes": "true"})
    return F.trim(F.translate(raw, "'\"", "  ")).try_cast(kind)


def parse_texts(texts: DataFrame, strict_names: bool = True) -> DataFrame:
    """(path, value) texts as rows of ``HANDS``. A stem that is not a number is an error, or null if not ``strict_names``."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.phh)?$", 1)
    number = stem.try_cast("int")
    if strict_names:
        number = F.when(number.isNull(), F.raise_error(F.concat(F.lit("a hand file is named by its number, not "), stem)).cast("int")).otherwise(number)
    names = [n for n in _KINDS if n not in ("path", "session_id", "hand_no")]
    return texts.select(
        "path",
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("session_id"),
        number.alias("hand_no"),
        *[_field(F.col("value"), n).alias(n) for n in names],
    )


def _texts(spark: SparkSession, path: str, files_per_task: int, **options) -> DataFrame:
    """(path, value) of text files. Files are much smaller than what a task is opened for, so a task reads up to ``files_per_task`` of them.

    The path is file metadata: what is filtered by path, session or hand number is decided on the listing, before any file is opened.
    """
    raw = spark.read.text(path, wholetext=True, **options)
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(raw.inputFiles()) // files_per_task))
    return raw.select(F.col("_metadata.file_path").alias("path"), "value").coalesce(tasks)


def read_session(spark: SparkSession, path: str, recursive: bool = False, files_per_task: int = 1000) -> DataFrame:
    """All ``.phh`` files of a folder (and of those below it, if ``recursive``), on any file system that Spark reads."""
    kind = found(spark, path)
    if kind is None:
        raise FileNotFoundError(f"no session folder at {path}")
    if kind != "folder":
        raise NotADirectoryError(f"a session is a folder, which {path} is not")
    options = {"recursiveFileLookup": True} if recursive else {}
    return parse_texts(_texts(spark, path, files_per_task, pathGlobFilter="*.phh", **options))


def read_hand(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its name."""
    if found(spark, path) != "file":
        raise FileNotFoundError(f"no hand file at {path}")
    return parse_texts(_texts(spark, path, 1), strict_names=False)


def from_text(spark: SparkSession, text: str, path: str = "memory/0.phh") -> DataFrame:
    return parse_texts(spark.createDataFrame([(path, text)], "path string, value string"), strict_names=False)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Hands already parsed; missing fields are null."""
    return spark.createDataFrame([tuple(r.get(n) for n in _KINDS) for r in rows], HANDS)
