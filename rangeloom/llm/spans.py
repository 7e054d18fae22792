"""Regular-expression matches with their positions, as plain column expressions.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern what
lies between, both leftmost and non-overlapping, so running lengths give starts
and ends in code points. Patterns must not match the empty string, and must not
need recursion in long texts: repeated groups are possessive here, which the JVM
matches in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``found`` gives for each match: bounds, text, and up to so many characters of what lies before and after.
CONTEXT = 32
MATCH = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


#: Matches whose positions are summed together; sums over blocks keep a text of very many matches from quadratic copying.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(matches: Column, parts: Column) -> Column:
    n = F.size(matches)
    steps = F.arrays_zip(matches.alias("m"), F.slice(parts, F.lit(1), n).alias("gap"), F.slice(parts, F.lit(2), n).alias("next"))
    nothing = F.array().cast(MATCH)

    def one(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = (start + F.length(x["m"])).cast("int")
        made = F.struct(
            start.cast("int").alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after")
        )
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(made)).cast(MATCH).alias("out"))

    def block(steps: Column, acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("pos"), nothing.alias("out")), one)

        def moved(own: Column) -> Column:
            shift = lambda x: F.struct((x["start"] + acc["pos"]).alias("start"), (x["end"] + acc["pos"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((acc["pos"] + own["pos"]).cast("int").alias("pos"), F.concat(acc["out"], F.array(F.transform(own["out"], shift).cast(MATCH))).alias("out"))

        return let(own, moved)

    def blocks(steps: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{MATCH}>").alias("out"))
        ordinals = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(ordinals, start, lambda acc, k: block(steps, acc, k), lambda acc: acc["out"]))

    return let(steps, blocks)


def found(text: Column, pattern: str, quick: str | None = None) -> Column:
    """Matches of ``pattern`` in ``text`` (null counts as empty), of type ``MATCH``.

    ``quick`` is a string that every text with a match contains; others are not searched.
    """
    text, nothing = F.coalesce(text, F.lit("")), F.array().cast(MATCH)

    def with_matches(m: Column) -> Column:
        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda parts: _placed(m, parts))).otherwise(nothing)

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches)
    return F.coalesce(out if quick is None else F.when(F.contains(text, F.lit(quick)), out), nothing)


def listed(spans: Column) -> Column:
    """'kind:start:end' of an array of structs with these fields, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")



def of_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind, as a long."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
