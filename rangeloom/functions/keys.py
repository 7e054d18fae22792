"""Buckets and the categorical state key, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeloom.functions.cards import bad

#: Action buckets and seats.
FOLD, CALL, SMALL, MEDIUM, LARGE = range(5)
ACTIONS = ("f", "cc", "cbr_small", "cbr_medium", "cbr_large")
SEATS = ("sb", "bb", "utg", "hj", "co", "btn")
FIELDS = ("position", "active", "facing", "raises", "spr")


def action_bucket(verb: Column, pot: Column, bet: Column) -> Column:
    """0 to 4 from a verb, the pot and the bet; a missing bet or unknown verb is an error."""
    sized = F.when(bet.isNull(), bad("bet size missing")).when(bet < 0.5 * pot, SMALL).when(bet < pot, MEDIUM).otherwise(LARGE)
    return F.when(verb == "f", FOLD).when(verb == "cc", CALL).when(verb == "cbr", sized).otherwise(bad("Unknown action: ", verb))


def spr_label(stack: Column, pot: Column) -> Column:
    return F.when(pot <= 0, "deep").when(stack > 10 * pot, "deep").when(stack > 3 * pot, "medium").otherwise("shallow")


def active_label(n: Column) -> Column:
    return F.when(n == 2, "heads_up").when(n == 3, "three_way").otherwise("multiway")


def raises_label(n: Column) -> Column:
    return F.when(n == 0, "raises_0").when(n == 1, "raises_1").otherwise("raises_2plus")


def seat_label(seat: Column) -> Column:
    """Position by 1-based seat number, whatever the table's size."""
    return F.when(seat >= 1, F.try_element_at(F.array(*map(F.lit, SEATS)), F.greatest(seat, F.lit(1)).cast("int"))).otherwise(F.lit(None)).cast("string")


def state_key(position: Column, active: Column, facing: Column, raises: Column, stack: Column, pot: Column) -> Column:
    """'position|active|facing|raises|spr' from scalars."""
    return F.concat_ws(
        "|",
        F.coalesce(position, F.lit("unknown")),
        active_label(active),
        F.when(facing, "facing_bet").otherwise("no_bet"),
        raises_label(raises),
        spr_label(F.coalesce(stack, F.lit(0.0)), pot),
    )


def key_parts(key: Column) -> Column:
    """struct of the five fields; another number of parts is an error."""
    parts = F.split(key, r"\|", -1)
    whole = F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])
    return F.when(F.size(parts) == 5, whole).otherwise(bad("Invalid state key: ", key))


def position_name(seat: Column, players: Column) -> Column:
    """Label for display: 'sb', 'bb', then by table size; at three-handed tables the third label is its first letter."""
    by_size = {3: list("button"), 4: ["utg", "button"], 5: ["utg", "co", "button"], 6: ["utg", "hj", "co", "button"]}
    out = F.when(seat == 1, "sb").when(seat == 2, "bb")
    for n, names in by_size.items():
        for i, name in enumerate(names):
            out = out.when((players == n) & (seat == i + 3), name)
    return out.otherwise(F.concat(F.lit("seat_"), seat.cast("string")))
