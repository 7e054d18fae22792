"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed. The ledger holds, for
each blob and each version of each rule, the spans found; only pairs that it does
not hold are scanned. Findings are then joined back to all paths and versions of a
blob. Everything is column expressions; there is no Python in the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import written
from rangeloom.llm.skew import lookup
from rangeloom.llm.spans import found, listed, of_kind

#: The value's alphabet, the names before it, and what stands between, of an assignment.
_VALUE = "[A-Za-z0-9+/_.=-]+"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"


@dataclass(frozen=True)
class Rule:
    """``version`` changes whenever pattern or test do; the ledger then knows that blobs are unseen."""

    kind: str
    pattern: str
    version: int = 1
    quick: str | None = None
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def valid(self, m: Column) -> Column:
        if self.kind == "assign":
            return F.length(F.regexp_extract(m, f"^{_ASSIGN}({_VALUE})$", 1)) >= 8
        return F.lit(True)

    def spans(self, text: Column) -> Column:
        return F.filter(found(text, self.pattern, self.quick), lambda x: self.valid(x["m"]))


#: In the order in which kinds are listed at equal starts. A run of characters has one longest match, so the least lengths
#: of access and hex can stand in the pattern; a short assignment uses up its text, so its length is tested afterwards.
RULES = (
    Rule("assign", _ASSIGN + _VALUE),
    Rule("access", "AKIA[A-Z0-9]{12,}", quick="AKIA"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("pem", _PEM, quick="PRIVATE KEY-----", base=False),
)
#: Rounds in which a history without a ledger is scanned.
ROUNDS = 2
LEDGER = "blob string, rule string, kind string, spans array<struct<start:int,end:int>>"


def scan(versions: DataFrame, content: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (schema ``LEDGER``) for the blobs of ``versions``: one for each blob and rule version that ``ledger`` lacks.

    Null contents count as empty. A blob that many versions share is kept once before the shuffle and scanned once.
    """
    blobs = versions.select(F.coalesce(F.col(content), F.lit("")).alias("content")).withColumn("blob", F.sha2("content", 256))
    blobs = blobs.groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))

    def entry(rule: Rule) -> Column:
        spans = F.transform(rule.spans(F.col("content")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        made = F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), spans.alias("spans"))
        return F.when(~F.array_contains("seen", rule.key), made)

    entries = F.filter(F.array(*map(entry, rules)), lambda x: x.isNotNull())
    return blobs.select("blob", F.explode(entries).alias("e")).select("blob", "e.rule", "e.kind", "e.spans")


def findings(versions: DataFrame, content: str, ledger: DataFrame, ids: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``ids`` of every version, with its counts of base kinds, digest and span list from ``ledger``.

    Versions without findings have counts of 0 and an empty list. Null ids and
    repeated rows each have their row.
    """
    order = {r.kind: k for k, r in enumerate(rules)}
    rows = versions.select(*ids, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("__blob"))
    wanted = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("kind")].alias("ordinal"), s["end"].alias("end"), F.col("kind").alias("kind")))
    per_blob = wanted.select("blob", spans.alias("s")).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    base = [r.kind for r in rules if r.base]
    own = F.filter("s", lambda x: x["kind"].isin(base))
    counts = [of_kind(F.col("s"), k).alias(f"n_{k}") for k in base]
    facts = per_blob.select(F.col("blob").alias("__blob"), *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))
    uses = rows.groupBy("__blob").agg(F.count("*").alias("__uses"))
    facts = written(facts.join(uses, "__blob"), "secret-facts")
    out = lookup(rows, facts, "__blob", "__uses", rows.count, ids)
    return out.select(
        *ids,
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(findings of every document, the ledger grown by what was scanned); the new parts are kept in the shared folder.

    Documents are versions that arrive in ``rounds`` (by a hash of their ids), as a
    history does for a scan that is repeated: each round looks its blobs up in the
    ledger that the rounds before left and scans those that no round has met.
    Null texts count as empty; null ids, repeated rows and ties each have their row;
    very long texts are searched whole; extra columns are not read; an empty table
    gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for k in range(rounds):
        arrived = picked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        new = written(scan(arrived, "text", ledger), "secret-ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
    return findings(picked, "text", ledger, ["doc_id"]), ledger
