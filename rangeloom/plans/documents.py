"""Results of whole corpora as files: a row for each (hand, observer, target), sessions whole and in order.

``write_documents`` writes a run into a folder of its own and commits it by one
rename of a manifest. Readers follow the newest manifest, so a run that is lost,
killed or repeated is never seen in part, and the run before it stays readable.
A task that is lost leaves nothing: Spark's own writer commits its files. Rows
are dealt by ranges of (session, hand, pair), so a session of any size is spread
over as many tasks as it needs, and the files, by name, hold it in order.

A range is settled by the target's decisions and the observer's cards, which many
rows share: ``ranges`` holds each once, whole, and a row names its ``range_id``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators import ranges as R
from rangeloom.plans.runs import EM, POSTFLOP, decided, hand_result, listed
from rangeloom.sources.shared import found, hadoop_path, ranked, written

ROWS = "session_path string, hand_index int, path string, observer string, target string, observer_hole_cards string, phi double, decisions array<struct<action_index:int,state_key:string,action_bucket:int,amount:bigint>>, range_id bigint, observer_at int, target_at int"
RANGES = "range_id bigint, top_range array<struct<hand_class:string,probability:double>>, range_vector array<double>, log_likelihood double"
SESSIONS = "session_path string, observers array<string>, targets array<string>, n_hands bigint"
ORDER = ("session_path", "hand_index", "observer_at", "target_at")


def session_of(path: Column) -> Column:
    """The folder that a hand file is in."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def session_heads(hands: DataFrame, observers: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """(session_path, observers, targets, n_hands): the players to choose from are those of a session's first hand.

    Requested names keep their order; those who are not seated in a session are passed over there. A session whose first hand has no players has empty lists.
    """
    first = hands.groupBy(session_of(F.col("path")).alias("session_path")).agg(F.min(F.struct("hand_no", "path", "players")).alias("f"), F.count("*").alias("n_hands"))
    seated = F.coalesce("f.players", F.array().cast("array<string>"))
    named = lambda names: F.array_intersect(F.array(*map(F.lit, names)), seated) if names else F.array_distinct(seated)
    return first.select("session_path", named(observers).alias("observers"), named(targets).alias("targets"), "n_hands")


def hand_indexes(hands: DataFrame) -> DataFrame:
    """(path, session_path, hand_index): each hand's place in its session by number, then path. Ranked by ranges, so no session is gathered."""
    keyed = hands.select("path", "hand_no", session_of(F.col("path")).alias("session_path"))
    placed = ranked(keyed, [F.col("session_path"), F.col("hand_no"), F.col("path")], "__at", "hand-order")
    starts = placed.groupBy("session_path").agg(F.min("__at").alias("__start"))
    return placed.join(starts, "session_path").select("path", "session_path", (F.col("__at") - F.col("__start")).cast("int").alias("hand_index"))


def document_rows(hands: DataFrame, observers: list[str] | None = None, targets: list[str] | None = None, phi: float = 0.0, k: int = 10, quarantine: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges) of many sessions: the columns of ``ROWS``, each row with its place, and those of ``RANGES``. ``hands`` is read several times."""
    made, holes = decided(hands, quarantine, keep=True)
    pairs = R.seen(made, R.pairs(hands, holes, observers, targets), keep=True)
    once = {"top_range": R.top_of(F.col("p"), k), "range_vector": F.col("p"), "log_likelihood": F.col("log_likelihood")}
    # numbered behind the writing, so that each reading finds the same numbers
    ranges = written(R.settled(pairs, R.action_table(made, phi), once).withColumn("range_id", F.monotonically_increasing_id()), "ranges")
    # what a target's rows have in common is gathered before its observers meet it
    places = hand_indexes(hands).join(session_heads(hands, observers, targets), "session_path")
    told = listed(made).join(places, "path")
    rows = pairs.join(ranges.select("moves", "dead", "range_id"), ["moves", "dead"]).drop("moves").join(told, ["path", "target"])
    rows = rows.withColumn("observer_at", (F.array_position("observers", F.col("observer")) - 1).cast("int")).withColumn("target_at", (F.array_position("targets", F.col("target")) - 1).cast("int"))
    rows = rows.withColumnRenamed("dead", "observer_hole_cards").withColumn("phi", F.lit(float(phi)))
    names = lambda columns: [c.split()[0] for c in columns.split(", ")]
    return rows.filter("observer_at >= 0 and target_at >= 0").select(*names(ROWS)), ranges.select(*names(RANGES))


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed manifests, oldest first."""
    if found(spark, folder) != "folder":
        return []
    system, at = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _commit(spark: SparkSession, folder: str, manifest: dict) -> str:
    """The manifest written aside and renamed to the next free number."""
    system, aside = hadoop_path(spark, f"{folder}/.{manifest['run']}.json")
    out = system.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    while True:
        past = _manifests(spark, folder)
        name = f"manifest-{int(past[-1][9:-5]) + 1 if past else 1:09d}.json"
        to = hadoop_path(spark, f"{folder}/{name}")[1]
        if not system.exists(to) and system.rename(aside, to):
            return name


def write_documents(hands: DataFrame, folder: str, observers: list[str] | None = None, targets: list[str] | None = None, phi: float = 0.0, k: int = 10, quarantine: bool = False) -> dict:
    """Write the results of all sessions in ``hands`` below ``folder`` and commit them; returns the manifest. Nothing but counts reaches the driver."""
    if observers and targets and set(observers) == set(targets) and len(set(targets)) == 1:
        raise ValueError(f"observer and target are the same player: {targets[0]}")
    spark = hands.sparkSession
    kept = written(hands, "hands")
    name = f"run-{uuid.uuid4().hex}"
    # dealing by ranges reads its input twice, so the results are kept before
    rows, ranges = document_rows(kept, observers, targets, phi, k, quarantine)
    rows = written(rows, "results")
    counted, heads = Observation(), Observation()
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).observe(counted, F.count("*").alias("n"))
    ordered.write.json(f"{folder}/{name}/rows", ignoreNullFields=False)
    ranges.write.json(f"{folder}/{name}/ranges", ignoreNullFields=False)
    session_heads(kept, observers, targets).observe(heads, F.count("*").alias("n")).write.json(f"{folder}/{name}/sessions", ignoreNullFields=False)
    manifest = {"run": name, "phi": phi, "top_k": k, "rows": counted.get["n"], "sessions": heads.get["n"], "em": EM, "postflop": POSTFLOP}
    return manifest | {"manifest": _commit(spark, folder, manifest)}


def read_documents(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, sessions, rows) of the newest committed run; each row with its range: the columns of ``ROWS`` and ``RANGES``."""
    names = _manifests(spark, folder)
    if not names:
        raise FileNotFoundError(f"no committed run in {folder}")
    manifest = json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0])
    at = f"{folder}/{manifest['run']}"
    rows = spark.read.schema(ROWS).json(f"{at}/rows").join(spark.read.schema(RANGES).json(f"{at}/ranges"), "range_id")
    return manifest, spark.read.schema(SESSIONS).json(f"{at}/sessions"), rows


def document(spark: SparkSession, folder: str, session_path: str) -> dict:
    """One session's document, as ``run`` makes it. This collects the session."""
    manifest, sessions, rows = read_documents(spark, folder)
    head = sessions.filter(F.col("session_path") == session_path).first()
    if head is None:
        raise KeyError(session_path)
    mine = sorted(rows.filter(F.col("session_path") == session_path).collect(), key=lambda r: (r.hand_index, r.observer_at, r.target_at))
    return {
        "session_path": session_path,
        "observers": head.observers,
        "targets": head.targets,
        "phi": manifest["phi"],
        "hand_results": [hand_result(r, r.hand_index) for r in mine],
        "em": manifest["em"],
        "postflop": manifest["postflop"],
    }
