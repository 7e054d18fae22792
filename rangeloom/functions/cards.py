"""Cards, hand classes and the hand evaluator, as column expressions.

A card is a two-character string, rank then suit, upper-cased. A set of cards is a
number with a bit for each: 13 for each suit, deuce to ace. Hands of five to seven
cards are rated from such numbers without listing their five-card subsets: the ranks
that a hand holds at least once, twice, ... are bit sets of 13, and two tables over
all 8,192 such sets tell the highest ranks and the best straight. The functions that
rate take a DataFrame and add columns step by step, so that each value is computed
once, by generated code.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks from high to low, suits in the order of preference.
RANKS, SUITS = "AKQJT98765432", "SHDC"
CATEGORIES = ("high_card", "pair", "two_pair", "trips", "straight", "flush", "full_house", "quads", "straight_flush")
BUCKETS = ("nuts/near-nuts", "strong made", "medium made", "weak made", "strong draw", "weak draw", "air")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bad(message: str, *args: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[F.coalesce(a.cast("string"), F.lit("null")) for a in args]))


def rank_value(card: Column) -> Column:
    """2 to 14."""
    return F.lit(15) - F.instr(F.lit(RANKS), F.substring(card, 1, 1))


def suit(card: Column) -> Column:
    return F.substring(card, 2, 1)


def card(text: Column) -> Column:
    """A card trimmed and upper-cased; anything else is an error."""
    clean = F.upper(F.trim(text))
    return F.when(F.regexp_like(clean, F.lit("^[2-9TJQKA][SHDC]$")), clean).otherwise(bad("Invalid card: ", text))


def cards(text: Column) -> Column:
    """'AhKd' as an array of cards; odd length and repeated cards are errors; an empty string has none."""
    clean = F.trim(text)
    n = F.length(clean)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: card(F.substring(clean, i, F.lit(2))))
    listed = F.when(n % 2 != 0, bad("Invalid cards string: ", text)).when(n == 0, F.array().cast("array<string>")).otherwise(cut)
    return let(listed, lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), c).otherwise(bad("Duplicate cards: ", text)))


def hand_class(hole: Column) -> Column:
    """Class of an array of two cards: 'AA', 'AKs' or 'AKo'."""
    a, b = F.get(hole, F.lit(0)), F.get(hole, F.lit(1))
    high = F.when(rank_value(a) >= rank_value(b), a).otherwise(b)
    low = F.when(rank_value(a) >= rank_value(b), b).otherwise(a)
    kind = F.when(rank_value(a) == rank_value(b), "").when(suit(a) == suit(b), "s").otherwise("o")
    made = F.concat(F.substring(high, 1, 1), F.substring(low, 1, 1), kind)
    return F.when(F.size(hole) == 2, made).otherwise(bad("a hand class needs two cards"))


def text_class(text: Column) -> Column:
    """``hand_class`` of a string of two cards: plainly written ones by string functions, which are generated code, others by ``cards``."""
    first, second = F.substring(text, 1, 1), F.substring(text, 3, 1)
    at = lambda c: F.instr(F.lit(RANKS), c)
    kind = F.when(first == second, "").when(F.substring(text, 2, 1) == F.substring(text, 4, 1), "s").otherwise("o")
    made = F.concat(F.when(at(first) <= at(second), first).otherwise(second), F.when(at(first) <= at(second), second).otherwise(first), kind)
    plain = F.regexp_like(text, F.lit("^([2-9TJQKA][SHDC]){2}$")) & (F.substring(text, 1, 2) != F.substring(text, 3, 2))
    return F.when(plain, made).otherwise(hand_class(cards(text)))


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _right(x: Column, k: Column | int) -> Column:
    return F.call_function("shiftright", x, F.lit(k) if isinstance(k, int) else k)


def _left(x: Column, k: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(k) if isinstance(k, int) else k)


def _and(x: Column, *more: Column | int) -> Column:
    for y in more:
        x = x.bitwiseAND(F.lit(y) if isinstance(y, int) else y)
    return x


def _or(x: Column, *more: Column) -> Column:
    return reduce(Column.bitwiseOR, more, x)


def _place(c: Column) -> Column:
    """Number of a card: 13 for each suit, then its rank from the deuce on."""
    return 13 * (F.instr(F.lit(SUITS), suit(c)) - 1) + F.lit(13) - F.instr(F.lit(RANKS), F.substring(c, 1, 1))


def card_bits(hand: Column, most: int = 7) -> Column:
    """The set of an array of at most ``most`` cards, as a long."""
    return _or(*[F.coalesce(_left(_long(1), _place(F.get(hand, F.lit(i)))), _long(0)) for i in range(most)])


def text_bits(text: Column) -> Column:
    """The set of a string of any number of cards ('AhKd'), as a long; what is no card is passed over, repeated cards count once."""
    n = F.greatest(F.floor(F.length(text) / 2) - 1, F.lit(0)).cast("int")
    one = F.transform(F.sequence(F.lit(0), n), lambda i: F.upper(F.substring(text, i * 2 + 1, F.lit(2))))
    known = F.filter(one, lambda c: F.regexp_like(c, F.lit("^[2-9TJQKA][SHDC]$")))
    return F.aggregate(known, _long(0), lambda a, c: a.bitwiseOR(_left(_long(1), _place(c))))


def plain_bits(text: Column, most: int = 7) -> Column:
    """``text_bits``: strings of at most ``most`` plainly written cards by string functions, which are generated code."""
    plain = F.regexp_like(text, F.lit(f"^([2-9TJQKA][SHDC]){{0,{most}}}$"))
    one = lambda i: F.when(F.length(text) > 2 * i, _left(_long(1), _place(F.substring(text, 2 * i + 1, 2)))).otherwise(_long(0))
    return F.when(plain, _or(*map(one, range(most)))).otherwise(text_bits(text))


def suit_bits(bits: Column, k: int) -> Column:
    """The ranks of the ``k``-th suit in a set of cards."""
    return _and(_right(bits, 13 * k), 8191).cast("int")


def suits_at(bits: Column, rank: int) -> Column:
    """The suits (four bits) that a set of cards holds at a rank (from 0)."""
    return _or(*[_left(_and(_right(bits, 13 * k + rank), 1).cast("int"), k) for k in range(4)])


def _bits_of(ranks: int) -> list[int]:
    return [v for v in range(14, 1, -1) if ranks >> (v - 2) & 1]


def _top_five(ranks: int) -> int:
    """The five highest ranks (2 to 14) of a set, four bits each, the highest first."""
    return sum(v << 4 * (4 - i) for i, v in enumerate(_bits_of(ranks)[:5]))


def best_run(ranks: int) -> int:
    """Top of the best straight among ranks, or 0; the ace also counts as 1."""
    low = ranks << 1 | ranks >> 12
    return max((k + 5 for k in range(10) if low >> k & 31 == 31), default=0)


def _run_outs(ranks: int) -> int:
    """8 if four of a run of five are held and an end is missing, 4 if only one within, else 0."""
    low = ranks << 1 | ranks >> 12
    missing = [~low >> k & 31 for k in range(10)]
    return 8 if any(m in (1, 16) for m in missing) else 4 if any(m in (2, 4, 8) for m in missing) else 0


@cache
def _values(rule) -> str:
    return ",".join(str(rule(ranks)) for ranks in range(8192))


def looked_up(rule, ranks: Column) -> Column:
    """``rule`` of a set of ranks, from a table of all 8,192 that the optimiser makes a constant array."""
    return F.get(F.split(F.lit(_values(rule)), ",").cast("array<int>"), ranks)


def listed(values: list[int]) -> Column:
    """A constant array of whole numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _first(packed: Column) -> Column:
    return _right(packed, 16)


def _second(packed: Column) -> Column:
    return _and(_right(packed, 12), 15)


def _without(ranks: Column, *values: Column) -> Column:
    """A set of ranks without some (2 to 14; 0 is none)."""
    for v in values:
        ranks = _and(ranks, F.bitwise_not(F.when(v > 1, _left(F.lit(1), v - 2)).otherwise(0)))
    return ranks


def stepwise(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Adds columns step by step; each may read those before it, which are computed once.

    They go into one select, whose later columns name earlier ones, so that the plan is analysed once for all steps.
    """
    return df.select("*", *[c.alias(n) for step in steps for n, c in step.items()])


def reckoned(df: DataFrame, into: str, value: Column, *steps: dict[str, Column]) -> DataFrame:
    """Adds ``into``, the ``value`` that steps lead to, without their columns.

    It passes through an array of one, which filters on it cannot be pushed through: pushed, they would repeat
    every step for each later use of it.
    """
    return stepwise(df, *steps, {"__value": value}).select(*df.columns, F.explode(F.array("__value")).alias(into))


def _held(bits: str) -> dict[str, Column]:
    return {f"__s{k}": suit_bits(F.col(bits), k) for k in range(4)}


def _levels() -> dict[str, Column]:
    """Ranks held at least once, twice, three and four times, and the suit of a flush (or 0), from ``__s0`` to ``__s3``."""
    a, b, c, d = (F.col(f"__s{k}") for k in range(4))
    flush = reduce(lambda out, x: F.when(F.bit_count(x) >= 5, x).otherwise(out), (d, c, b), F.when(F.bit_count(a) >= 5, a).otherwise(0))
    return {
        "__g1": _or(a, b, c, d),
        "__g2": _or(_and(a, b), _and(c, d), _and(_or(a, b), _or(c, d))),
        "__g3": _or(_and(a, b, _or(c, d)), _and(c, d, _or(a, b))),
        "__g4": _and(a, b, c, d),
        "__flush": flush,
        "__most": F.greatest(*[F.bit_count(x) for x in (a, b, c, d)]),
    }


def _named() -> tuple[dict[str, Column], ...]:
    """Steps from levels to ``__category`` and what decides it."""
    g1, g2, g3, g4, flush = (F.col(f"__{n}") for n in ("g1", "g2", "g3", "g4", "flush"))
    runs = {
        "__run": looked_up(best_run, g1),
        "__suited": F.when(flush != 0, looked_up(best_run, flush)).otherwise(0),
        "__pairs": F.bit_count(g2),
        "__tops2": looked_up(_top_five, g2),
        "__top3": _first(looked_up(_top_five, g3)),
        "__top4": _first(looked_up(_top_five, g4)),
    }
    category = (
        F.when(F.col("__suited") > 0, 8)
        .when(g4 != 0, 7)
        .when((g3 != 0) & (F.col("__pairs") >= 2), 6)
        .when(flush != 0, 5)
        .when(F.col("__run") > 0, 4)
        .when(g3 != 0, 3)
        .otherwise(F.least(F.col("__pairs"), F.lit(2)))
    )
    return runs, {"__category": category, "__pair": _first(F.col("__tops2")), "__pair2": _second(F.col("__tops2"))}


#: Kickers that a category's hands are told apart by.
KICKERS = (5, 4, 3, 3, 1, 5, 2, 2, 1)


def _kicked() -> tuple[dict[str, Column], ...]:
    """Steps from a category to ``__code``, a number that orders hands, of the category and five ranks in four bits each."""
    g1, category, pair, pair2, trips, quads = (F.col(f"__{n}") for n in ("g1", "category", "pair", "pair2", "top3", "top4"))
    rest = (
        F.when(category == 7, _without(g1, quads))
        .when(category == 6, _without(F.col("__g2"), trips))
        .when(category == 5, F.col("__flush"))
        .when(category == 3, _without(g1, trips))
        .when(category == 2, _without(g1, pair, pair2))
        .when(category == 1, _without(g1, pair))
        .otherwise(g1)
    )
    left = F.col("__rest")
    high = lambda v, place: _left(v, 4 * place)
    ranks = (
        F.when(category == 8, high(F.col("__suited"), 4))
        .when(category == 7, high(quads, 4).bitwiseOR(high(_first(left), 3)))
        .when(category == 6, high(trips, 4).bitwiseOR(high(_first(left), 3)))
        .when(category == 4, high(F.col("__run"), 4))
        .when(category == 3, high(trips, 4).bitwiseOR(high(_right(left, 12), 2)))
        .when(category == 2, _or(high(pair, 4), high(pair2, 3), high(_first(left), 2)))
        .when(category == 1, high(pair, 4).bitwiseOR(high(_right(left, 8), 1)))
        .otherwise(left)
    )
    return {"__rest": looked_up(_top_five, rest)}, {"__code": _left(category, 20).bitwiseOR(ranks)}


def _told() -> Column:
    """struct(category, kickers, name, code)."""
    ranks = F.array(*[_and(_right(F.col("__code"), 4 * (4 - i)), 15) for i in range(5)])
    n = F.get(F.array(*map(F.lit, KICKERS)), F.col("__category"))
    return F.struct(F.col("__category").alias("category"), F.slice(ranks, F.lit(1), n).alias("kickers"), F.get(F.array(*map(F.lit, CATEGORIES)), F.col("__category")).alias("name"), F.col("__code").alias("code"))


def scored(df: DataFrame, hand: str, into: str) -> DataFrame:
    """Adds ``into``, struct(category, kickers, name, code) of the best five of an array of five to seven cards; greater codes win."""
    bits = F.when(F.size(hand).between(5, 7), card_bits(F.col(hand))).otherwise(bad("a hand has five to seven cards").cast("long"))
    return reckoned(df, into, _told(), {"__bits": bits}, _held("__bits"), _levels(), *_named(), *_kicked())


def _board_levels(bits: str) -> tuple[dict[str, Column], ...]:
    """Steps to the board's ranks held at least once and ``__b_most``, the cards of its commonest suit, from its set of cards."""
    held = {f"__b{k}": suit_bits(F.col(bits), k) for k in range(4)}
    suits = [F.col(f"__b{k}") for k in range(4)]
    return held, {"__b_ranks": _or(*suits), "__b_most": F.greatest(*[F.bit_count(x) for x in suits]), "__b_size": F.bit_count(bits)}


def _texture() -> tuple[dict[str, Column], ...]:
    """Steps from ``__b_ranks``, ``__b_most`` and ``__b_size`` to the board's texture."""
    d, size = F.col("__b_ranks"), F.col("__b_size")
    # neighbours among the distinct ranks that are one or two apart
    near = F.bit_count(_and(d, _right(d, 1))) + F.bit_count(_and(d, _right(d, 2), F.bitwise_not(_right(d, 1))))
    first = {
        "__mono": (size >= 3) & (F.col("__b_most") == size),
        "__paired": F.bit_count(d) < size,
        "__near": near,
        "__high_card": _first(looked_up(_top_five, d)),
    }
    return (first,)


def _texture_told() -> Column:
    high = F.when(F.col("__high_card") > 0, F.col("__high_card"))
    near = F.col("__near")
    return F.struct(F.col("__mono").alias("monotone"), (F.col("__b_most") >= 2).alias("two_tone"), F.col("__paired").alias("paired"), (near >= 2).alias("connected"), (near >= 3).alias("very_connected"), high.alias("high_card"))


def textured(df: DataFrame, board: str, into: str) -> DataFrame:
    """Adds ``into``, struct(monotone, two_tone, paired, connected, very_connected, high_card) of an array of at most five cards; an empty board has no high card."""
    return reckoned(df, into, _texture_told(), {"__board": card_bits(F.col(board), 5)}, *_board_levels("__board"), *_texture())


def draw_bucket(n: Column) -> Column:
    """Place in ``BUCKETS`` of a hand that made nothing, by its outs."""
    return F.when(n >= 10, 4).when(n >= 3, 5).otherwise(6)


def made_bucket(flush_card: Column) -> tuple[dict[str, Column], ...]:
    """Steps to ``__outs`` and ``__bucket`` (a place in ``BUCKETS``).

    Read are the levels of hole and board together, the texture, the ranks of the
    hole (``__first`` and ``__second``) and whether it holds the ace of the flush's suit.
    """
    category, pair, top = F.col("__category"), F.col("__pair"), F.col("__high_card")
    first, second = F.col("__first"), F.col("__second")
    over = (first > top).cast("int") + (second > top).cast("int")
    outs = F.when(F.col("__most") == 4, 9).otherwise(0) + looked_up(_run_outs, F.col("__g1")) + F.when(over == 2, 6).when(over == 1, 3).otherwise(0)
    wet, mono = F.col("__near") >= 3, F.col("__mono")
    is_set = (first == second) & (_and(F.col("__b_ranks"), _left(F.lit(1), first - 2)) != 0)
    kicker = F.greatest(F.when(first != pair, first).otherwise(0), F.when(second != pair, second).otherwise(0))
    made = (
        F.when(category >= 6, 0)
        .when(category == 5, F.when(mono & ~flush_card, 1).otherwise(0))
        .when(category == 4, F.when(F.col("__paired") | mono, 1).otherwise(0))
        .when(category == 3, F.when(is_set & ~(mono | wet), 0).otherwise(1))
        .when(category == 2, F.when((F.col("__b_size") >= 4) & wet, 2).otherwise(1))
        .when(category == 1, F.when(pair > top, 1).when(pair == top, F.when(kicker >= 11, 1).otherwise(2)).otherwise(3))
        .otherwise(draw_bucket(F.col("__outs")))
    )
    return {"__outs": F.when(category == 0, outs).otherwise(0)}, {"__bucket": made}


def rated_by_ranks() -> tuple[dict[str, Column], ...]:
    """Steps to ``__bucket`` from levels, ``__first``, ``__second`` and the board's ranks, size and commonest suit, where no suit has five cards."""
    return (*_texture(), *_named(), *made_bucket(F.lit(False)))


def strengths(df: DataFrame, hole: str, board: str, into: str) -> DataFrame:
    """Adds ``into``, struct(bucket, score, hand_type, outs, board_texture) of arrays of two hole cards and of three to five board cards; null where one of them is null."""
    ok = (F.size(hole) == 2) & F.size(board).between(3, 5)
    checked = lambda bits: F.when(ok, bits).when(F.col(hole).isNotNull() & F.col(board).isNotNull(), bad("needs two hole cards and three to five board cards").cast("long"))
    ranks = {"__tops": looked_up(_top_five, _or(*[suit_bits(F.col("__hole"), k) for k in range(4)]))}
    second = _second(F.col("__tops"))
    # the ace of the suit that makes the flush
    ace = reduce(Column.__or__, [(F.bit_count(F.col(f"__s{k}")) >= 5) & (_and(_right(F.col("__hole"), 13 * k + 12), 1) == 1) for k in range(4)])
    told = F.struct(F.get(F.array(*map(F.lit, BUCKETS)), F.col("__bucket")).alias("bucket"), F.col("__score").alias("score"), F.col("__score.name").alias("hand_type"), F.col("__outs").alias("outs"), _texture_told().alias("board_texture"))
    return reckoned(
        df, into, F.when(F.col("__hole").isNotNull(), told), {"__hole": checked(card_bits(F.col(hole), 2)), "__board": card_bits(F.col(board), 5)}, {"__bits": F.col("__hole").bitwiseOR(F.col("__board"))},
        ranks, {"__first": _first(F.col("__tops")), "__second": F.when(second > 0, second).otherwise(_first(F.col("__tops")))},
        *_board_levels("__board"), *_texture(), _held("__bits"), _levels(), *_named(), *_kicked(), *made_bucket(ace), {"__score": _told()},
    )
