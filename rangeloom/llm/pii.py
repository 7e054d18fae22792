"""Personal data by weak supervision, in column expressions only.

Patterns propose candidate spans. Labelers of three sorts vote on each candidate:
stricter patterns, gazetteers (of domains, prefixes and codes) and the words
around it; a vote is +1, -1 or 0 (abstains). For each kind of span,
expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler that votes on that kind is and gives each pattern a probability; at
least three labelers can vote on every kind, without which their reliabilities
would not be determined. Some votes against are no opinion but a proof (a wrong
check digit, a number that is given to nobody): patterns that hold one keep a
probability near 0 throughout, so that no majority of the others can outvote them. With these as soft labels a naive Bayes classifier over
the candidate's features is trained, and it decides on the final spans. Spans of
the base definition are always kept; the classifier adds others that overlap none.

Only counts reach the driver: of vote patterns (for each kind at most 3 to the
power of the number of labelers) and of feature values (a fixed list).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import written
from rangeloom.llm.spans import found, let, listed, of_kind

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Kinds with their patterns: the base kinds in the order in which they are listed, then what the method proposes besides.
#: A run of characters is entered at its start or where the last match ended, so that long runs are not searched from each character.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "local_phone": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", None),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
BASE_KINDS = ("email", "ip", "card", "phone")

#: Gazetteers (fixed values): common top-level domains, first digits of card issuers, calling codes, reserved address beginnings.
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|example"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|36|6011|65|35"
CALLING = r"1|33|34|44|49|39|31|32|41|43|7|81|86|91"
NOT_PUBLIC = r"(?:0|127|255)\."
#: Words (fixed values) near personal data and near numbers that only look like it.
PERSONAL_WORDS = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|iban|ssn|id|address|host|server|ip|from)\b"
OTHER_WORDS = r"(?i)\b(?:version|release|isbn|section|chapter|figure|table|page|build|item|no)\b"

LABELERS = ("strict", "checksum", "gazetteer", "context", "neighbours")
#: Labelers whose vote against a kind proves that a match is none of it, and the probability that such matches keep.
PROOFS, DISPROVED = {"card": ("strict", "checksum"), "ip": ("strict",), "phone": ("strict",), "national_id": ("strict",)}, 0.001
#: Features are named; each has the values that ``features`` can give.
EM_STEPS, ACCEPT = 60, 0.5
CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<string>>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    chars = F.reverse(F.split(digits, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.expr("0") + c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_base(kind: str, m: Column) -> Column:
    """The tests of the base definition for a match ``m``."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, x: Column) -> Column:
    """One vote of each of ``LABELERS`` on a match."""
    m, before, after = x["m"], x["before"], x["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    never, n = F.lit(False), F.length(digits)
    strict = {
        "email": _vote(like(m, r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}+\.)++[A-Za-z]{2,24}$"), like(m, r"\.[0-9-]+$")),
        "ip": _vote(is_base("ip", m) & ~like(m, r"(?:^|\.)0[0-9]"), ~is_base("ip", m)),
        "card": _vote(like(m, r"^[0-9]{4}([\x20-]?)(?:[0-9]{4}\1){2}[0-9]{4}$"), ~n.between(13, 19)),
        "phone": _vote(n.between(9, 15), ~n.between(9, 15)),
        "local_phone": _vote(like(m, r"^\(|^[0-9]{3}([.-])[0-9]{3}\1"), never),
        "national_id": _vote(~like(m, "^(?:000|666|9)|-00-|-0000$"), like(m, "^(?:000|666|9)|-00-|-0000$")),
    }[kind]
    checksum = _vote(luhn(digits), ~luhn(digits)) if kind == "card" else F.lit(0)
    gazetteer = {
        "email": _vote(like(m, rf"\.(?:{TOP_LEVEL})$"), never),
        "ip": _vote(~like(m, rf"^{NOT_PUBLIC}"), like(m, rf"^{NOT_PUBLIC}")),
        "card": _vote(like(digits, rf"^(?:{ISSUERS})"), ~like(digits, rf"^(?:{ISSUERS})")),
        "phone": _vote(like(digits, rf"^(?:{CALLING})"), never),
        "local_phone": _vote(like(digits, "^[2-9]"), like(digits, "^[01]")),
        "national_id": F.lit(0),
    }[kind]
    context = _vote(like(before, PERSONAL_WORDS) | like(after, PERSONAL_WORDS), like(before, OTHER_WORDS))
    neighbours = _vote(like(before, r"(?:^|[\s:(<,])$") & like(after, r"^(?:$|[\s).,;:>])"), like(before, r"[A-Za-z0-9_$#]$") | like(after, r"^[A-Za-z0-9_%]"))
    return F.array(*[v.cast("int") for v in (strict, checksum, gazetteer, context, neighbours)])


def features(kind: str, x: Column) -> Column:
    """Named feature values of a match: its kind, shape and neighbourhood."""
    m, before, after = x["m"], x["before"], x["after"]
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    edge = lambda c: F.when(F.regexp_like(c, F.lit(r"^\s|^$")), "space").when(F.regexp_like(c, F.lit("^[A-Za-z0-9]")), "word").otherwise("mark")
    named = {
        "kind": F.lit(kind),
        f"{kind}.digits": F.least(n, F.lit(20)).cast("string"),
        f"{kind}.length": F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string"),
        f"{kind}.groups": F.least(F.size(F.split(m, r"[^A-Za-z0-9]+")), F.lit(8)).cast("string"),
        f"{kind}.valid": is_base(kind, m).cast("string"),
        "left": edge(F.reverse(before)),
        "right": edge(after),
        "words": F.when(F.regexp_like(before, F.lit(PERSONAL_WORDS)), "personal").when(F.regexp_like(before, F.lit(OTHER_WORDS)), "other").otherwise("none"),
    }
    return F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in named.items()])


def _candidate(kind: str, x: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        is_base(kind, x["m"]).alias("base"),
        votes(kind, x).alias("votes"),
        features(kind, x).alias("features"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text (null counts as empty), of type ``CANDIDATES``."""
    parts = []
    for kind, (pattern, quick) in PATTERNS.items():
        matches = found(text, pattern, quick)
        if kind == "card":  # shorter chains of digits match nowhere and propose nothing; nor do longer ones
            matches = F.filter(matches, lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(13, 19))
        parts.append(F.transform(matches, partial(_candidate, kind)).cast(CANDIDATES))
    # no digit and no @ sign: no candidate
    return F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit("[0-9@]")), F.concat(*parts)).otherwise(F.array().cast(CANDIDATES))


@dataclass(frozen=True)
class Model:
    """What EM and the classifier learned: for each kind the prior and ``reliability[kind][labeler][z][vote + 1]``, and log-odds of the features."""

    prior: dict[str, float]
    reliability: dict[str, dict[str, list[list[float]]]]
    log_odds: dict[str, float]
    bias: float


def em(patterns: dict[tuple[int, ...], int], steps: int = EM_STEPS, proofs: tuple[int, ...] = ()) -> tuple[float, list, dict[tuple[int, ...], float]]:
    """Two-class EM over counts of vote patterns; returns prior, P(vote | class) of each labeler, and P(true | pattern).

    Patterns in which one of the labelers ``proofs`` votes against stay at ``DISPROVED``.
    """
    total = sum(patterns.values())
    width = len(next(iter(patterns), ()))
    # starts from the majority's vote, softened
    disproved = {p for p in patterns if any(p[j] < 0 for j in proofs)}
    truth = {p: DISPROVED if p in disproved else 1 / (1 + math.exp(-sum(p))) for p in patterns}
    prior, table = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in range(width)]
    for _ in range(steps):
        prior = (sum(n * truth[p] for p, n in patterns.items()) + 1) / (total + 2)
        for j in range(width):
            for z in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for p, n in patterns.items():
                    mass[p[j] + 1] += n * (truth[p] if z else 1 - truth[p])
                table[j][z] = [m / sum(mass) for m in mass]
        for p in patterns.keys() - disproved:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v + 1] / table[j][0][v + 1]) for j, v in enumerate(p))
            truth[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return prior, table, truth


def fit(found_candidates: DataFrame) -> Model:
    """EM over the vote patterns of the candidates in column ``c``, kind by kind, then the classifier from all their soft labels."""
    one = found_candidates.select(F.explode("c").alias("c"))
    # a pattern's features are summed with it, so that one small table serves both steps
    counted = written(one.groupBy("c.kind", "c.votes", "c.features").count(), "pii-patterns")
    by_kind: dict[str, dict[tuple[int, ...], int]] = {}
    for r in counted.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect():
        by_kind.setdefault(r["kind"], {})[tuple(r["votes"])] = r["n"]
    if not by_kind:
        return Model({}, {}, {}, -1.0)
    prior, reliability, truth = {}, {}, {}
    for kind, patterns in sorted(by_kind.items()):
        # labelers that never vote on this kind tell nothing of it
        voting = [j for j in range(len(LABELERS)) if any(p[j] for p in patterns)]
        narrow: dict[tuple[int, ...], int] = {}
        for p, n in patterns.items():
            narrow[tuple(p[j] for j in voting)] = narrow.get(tuple(p[j] for j in voting), 0) + n
        proofs = tuple(k for k, j in enumerate(voting) if LABELERS[j] in PROOFS.get(kind, ()))
        prior[kind], table, soft = em(narrow, proofs=proofs)
        reliability[kind] = {LABELERS[j]: t for j, t in zip(voting, table, strict=True)}
        truth |= {(kind, p): soft[tuple(p[j] for j in voting)] for p in patterns}
    named = lambda kind, p: ",".join([kind, *map(str, p)])
    soft = F.create_map(*[x for (kind, p), t in truth.items() for x in (F.lit(named(kind, p)), F.lit(float(t)))])
    weighed = counted.withColumn("t", soft[F.concat_ws(",", "kind", F.array_join(F.transform("votes", lambda v: v.cast("string")), ","))] * F.col("count"))
    sums = weighed.select(F.explode("features").alias("f"), "t", "count").groupBy("f").agg(F.sum("t").alias("t"), F.sum("count").alias("n")).collect()
    total = sum(sum(p.values()) for p in by_kind.values())
    yes = sum(n * truth[kind, p] for kind, patterns in by_kind.items() for p, n in patterns.items())
    odds = {r["f"]: math.log((r["t"] + 1) / (yes + 2)) - math.log((r["n"] - r["t"] + 1) / (total - yes + 2)) for r in sums}
    return Model(prior, reliability, odds, math.log((yes + 1) / (total - yes + 1)))


SPANS = "array<struct<ordinal:int,start:int,end:int,kind:string,base:boolean>>"


def decide(c: Column, model: Model) -> Column:
    """Final spans of a candidates column: base ones, and accepted ones that overlap no base span; by kind, then start."""
    order = F.create_map(*[F.lit(x) for kv in ((k, i) for i, k in enumerate(PATTERNS)) for x in kv])
    weights = [F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in sorted(model.log_odds.items())]
    table = F.map_from_entries(F.array(*weights)) if weights else F.create_map().cast("map<string,double>")
    base = F.filter(c, lambda x: x["base"])

    def accepted(x: Column) -> Column:
        odds = F.aggregate(x["features"], F.lit(float(model.bias)), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        free = ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return x["base"] | ((odds >= math.log(ACCEPT / (1 - ACCEPT))) & free)

    kept = F.filter(c, accepted)
    made = lambda x: F.struct(order[x["kind"]].alias("ordinal"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))
    return F.sort_array(F.transform(kept, made)).cast(SPANS)


def annotate(docs: DataFrame, ids: list[str], model: Model | None = None) -> DataFrame:
    """``ids`` of every row with its spans (type ``SPANS``); fits a model on all rows if none is given."""
    proposed = written(docs.select(*ids, candidates(F.col("text")).alias("c")), "pii-candidates")
    return proposed.select(*ids, decide(F.col("c"), model or fit(proposed)).alias("s"))


def find_documents(docs: DataFrame) -> DataFrame:
    """Counts, base digest and span list of each document.

    Null texts count as empty; null ids, repeated rows and ties each have their row;
    very long texts are searched whole; extra columns are not read; an empty table
    gives no rows. ``spans`` lists by kind, then start.
    """
    spans = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    base = F.filter("s", lambda x: x["base"])
    counts = [of_kind(base, k).alias(f"n_{k}") for k in BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


#: Spans that are cut out of one stretch of a text together; a stretch is found once, so a text of very many spans is not searched from its start for each.
REDACT_BLOCK = 64


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first to start names the whole stretch."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ordinal"].alias("ordinal"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged_type = "array<struct<start:int,end:int,kind:string>>"

    def step(acc: Column, s: Column) -> Column:
        """Each span with the end of what stands before it; those inside an earlier one only extend it."""
        inside = s["start"] < acc["pos"]
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        out = F.when(inside, longer).otherwise(F.concat(acc["out"], F.array(own)))
        return F.struct(F.greatest(acc["pos"], s["end"]).cast("int").alias("pos"), out.cast(merged_type).alias("out"))

    merged = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.array().cast(merged_type).alias("out")), step, lambda a: a["out"])

    def block(all_: Column, k: Column) -> Column:
        own = F.slice(all_, k * REDACT_BLOCK + 1, F.lit(REDACT_BLOCK))
        start = F.when(k == 0, 0).otherwise(F.coalesce(F.get(all_, k * REDACT_BLOCK - 1)["end"], F.lit(0)))
        stretch = F.substring(text, start + 1, F.element_at(own, -1)["end"] - start)

        def cut(x: Column) -> Column:
            before = lambda i: F.when(i == 0, x["start"]).otherwise(F.get(x["own"], i - 1)["end"])
            part = lambda s, i: F.concat(F.substring(x["stretch"], before(i) - x["start"] + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.array_join(F.transform(x["own"], part), "")

        return let(F.struct(own.alias("own"), start.alias("start"), stretch.alias("stretch")), cut)

    def whole(all_: Column) -> Column:
        ordinals = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / REDACT_BLOCK).cast("int"))
        rest = F.substring(text, F.element_at(all_, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(ordinals, lambda k: block(all_, k)), ""), rest)

    return F.when(F.size(spans) > 0, let(merged, whole)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (text, n_chars, ...) with every found span replaced by its kind; ``n_chars`` follows texts that change.

    The model is fitted on the same candidates, which are searched for once. Null
    texts stay null; repeated rows and null ids are redacted like any others.
    """
    proposed = written(docs.withColumn("__c", candidates(F.col("text"))), "pii-candidates")
    found = proposed.withColumn("__s", decide(F.col("__c"), fit(proposed.select(F.col("__c").alias("c")))))
    found = found.withColumn("text", redact(F.col("text"), F.col("__s")))
    return found.withColumn("n_chars", F.when(F.size("__s") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)
