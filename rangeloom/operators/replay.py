"""Replay of betting logs by window functions: no sequential fold.

``replay`` gives one row for each logged betting action with the public state just
before it. All windows are partitioned by the hand, so one shuffle by hand serves
them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.keys import action_bucket, seat_label, state_key

STREETS = ("pre-flop", "flop", "turn", "river")


def tokens(hands: DataFrame) -> DataFrame:
    """(path, seq, p, street and the hand's columns): one row for each entry of the log, with the street it belongs to."""
    rows = hands.select("path", "session_id", "hand_no", "players", "starting_stacks", "blinds_or_straddles", F.posexplode("actions").alias("seq", "raw"))
    rows = rows.withColumn("p", F.split(F.trim("raw"), r"\s+"))
    deal = (F.col("p")[0] == "d") & (F.get("p", F.lit(1)) == "db")
    street = F.sum(deal.cast("int")).over(Window.partitionBy("path").orderBy("seq"))
    return rows.withColumn("street", F.coalesce(street, F.lit(0)).cast("int"))


def hole_cards(tokened: DataFrame) -> DataFrame:
    """(path, player, cards): the last deal to each seat."""
    own = tokened.filter("p[0] = 'd' and get(p, 1) = 'dh'")
    return own.groupBy("path", _player(F.col("p")[2]).alias("player")).agg(F.max_by(F.col("p")[3], "seq").alias("cards"))


def boards(tokened: DataFrame) -> DataFrame:
    """(path, street, board): all community cards from each street's deal on."""
    own = tokened.filter("p[0] = 'd' and get(p, 1) = 'db'")
    so_far = Window.partitionBy("path").orderBy("seq")
    return own.select("path", "street", F.array_join(F.collect_list(F.get("p", F.lit(2))).over(so_far), "").alias("board"))


def _seat(token: Column) -> Column:
    return F.regexp_extract(token, r"^p([0-9]+)$", 1).try_cast("int")


def _player(token: Column) -> Column:
    """The seat's player; an unknown token passes through."""
    seat = _seat(token)
    return F.coalesce(F.when(seat >= 1, F.get("players", seat - 1)), token)


def replay(tokened: DataFrame, strict: bool = True) -> DataFrame:
    """Betting actions with the state before each.

    ``strict`` makes the rules of the log errors, which fail the query as a whole;
    otherwise ``violation`` names the first broken rule of a row, or is null.
    """
    rows = tokened.filter("p[0] <> 'd'").select(
        "path", "session_id", "hand_no", "seq", "street", "players", "starting_stacks",
        F.get("blinds_or_straddles", F.lit(0)).alias("sb"), F.get("blinds_or_straddles", F.lit(1)).alias("bb"),
        _seat(F.col("p")[0]).alias("seat"), _player(F.col("p")[0]).alias("player"), F.get("p", F.lit(1)).alias("verb"),
        F.when(F.get("p", F.lit(1)) == "cbr", F.get("p", F.lit(2)).try_cast("long")).alias("raise_to"),
    )
    known, shown = F.coalesce(F.col("seat").between(1, F.size("players")), F.lit(False)), F.coalesce(F.col("verb") == "sm", F.lit(False))
    before = lambda *keys: Window.partitionBy("path", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    none, blind = F.lit(0).cast("long"), F.when(F.col("seat") == 1, F.col("sb")).when(F.col("seat") == 2, F.col("bb")).otherwise(0)
    first = F.col("street") == 0
    rows = rows.withColumn("action_index", F.sum((~shown).cast("int")).over(Window.partitionBy("path", "street").orderBy("seq")).cast("int") - 1)
    rows = rows.withColumn("cur_bet", F.coalesce(F.last("raise_to", True).over(before("street")), F.when(first, F.col("bb")).otherwise(none)))
    rows = rows.withColumn("amount", F.when(F.col("verb") == "cc", F.col("cur_bet")).when(F.col("verb") == "cbr", F.col("raise_to")).otherwise(none))
    idle = (F.col("verb") == "f") | shown
    put = F.when(~idle, F.col("amount"))
    rows = rows.withColumn("in_before", F.coalesce(F.last(put, True).over(before("street", "seat")), F.when(first, blind).otherwise(none)))
    rows = rows.withColumn("contrib", F.when(idle, none).otherwise(F.col("amount") - F.col("in_before")))
    folds = ((F.col("verb") == "f") & known).cast("int")
    raises = (F.col("verb") == "cbr").cast("int")
    rows = rows.select(
        "*",
        (F.col("sb") + F.col("bb") + F.coalesce(F.sum("contrib").over(before()), none)).alias("pot_before"),
        (F.get("starting_stacks", F.col("seat") - 1) - blind - F.coalesce(F.sum("contrib").over(before("seat")), none)).alias("stack_before"),
        F.coalesce(F.sum(raises).over(before("street")), F.lit(0)).cast("int").alias("level_before"),
        (F.size("players") - F.coalesce(F.sum(folds).over(before()), F.lit(0))).cast("int").alias("live"),
        F.coalesce(F.max(folds).over(before("seat")), F.lit(0)).alias("folded"),
    ).withColumn("pot_after", F.col("pot_before") + F.col("contrib"))
    rows = rows.withColumn("level_after", F.col("level_before") + raises)
    broken = (
        F.when(F.col("street") > 3, "too many board deals")
        .when(~known, "unknown seat")
        .when(F.col("folded") == 1, "acted after folding")
        .when(shown, None)
        .when(~F.col("verb").isin("f", "cc", "cbr") | F.col("verb").isNull(), "unknown action")
        .when((F.col("verb") == "cc") & (F.col("contrib") < 0), "negative call contribution")
        .when((F.col("verb") == "cbr") & ~F.coalesce(F.col("contrib") > 0, F.lit(False)), "non-positive raise")
        .when(F.col("contrib") > F.col("stack_before"), "negative stack")
    )
    # a showdown is no action, but a player who has folded cannot show
    rows = rows.withColumn("violation", broken).filter(~shown | F.col("violation").isNotNull())
    if strict:
        told = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("player"), F.lit(" "), F.col("violation"))).cast("string")
        rows = rows.withColumn("violation", F.when(F.col("violation").isNotNull(), told))
    facing = (F.col("level_before") > 0) | (F.col("seat") != 2)
    key = state_key(seat_label(F.col("seat")), F.col("live"), facing, F.col("level_before"), F.col("stack_before").cast("double"), F.col("pot_before").cast("double"))
    bucket = F.when(F.col("violation").isNull(), action_bucket(F.col("verb"), F.col("pot_after"), F.col("amount"))).cast("int")
    return rows.drop("folded", "sb", "bb").select("*", key.alias("state_key"), bucket.alias("bucket"))


def betting_history(replayed: DataFrame) -> DataFrame:
    """Adds ``history``: the street's earlier actions as structs (player, (bucket, level), amount)."""
    one = F.struct("player", F.struct("bucket", F.col("level_after").alias("level")).alias("action"), "amount")
    w = Window.partitionBy("path", "street").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return replayed.withColumn("history", F.collect_list(one).over(w))


def quarantined(replayed: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Actions of the hands that break no rule, from a replay that is not strict, in the same pass.

    A hand's validity is a window over the hand, by which the rows are dealt already. ``observation``, if given, gets
    the metrics ``actions``, ``violations`` and ``rejected`` (actions in broken hands) when the result is computed.
    """
    broken = F.max(F.col("violation").isNotNull().cast("int")).over(Window.partitionBy("path"))
    rows = replayed.withColumn("__broken", broken)
    if observation is not None:
        rows = rows.observe(observation, F.count("*").alias("actions"), F.count("violation").alias("violations"), F.sum("__broken").alias("rejected"))
    return rows.filter("__broken = 0").drop("__broken")


#: Most seats that a deck can deal two cards each, with a board.
MOST_SEATS = 23


def states(tokened: DataFrame, strict: bool = True, quarantine: bool = False) -> DataFrame:
    """One snapshot for each street's opening and one after each action: alive flags, pot, stacks, who is to act, the board.

    What a seat has paid and who is gone are running sums and bits over the hand, so a log of any length is read once.
    ``quarantine`` leaves out the hands that break a rule, found in the same replay. Hands have at most 23 seats.
    """
    acts = replay(tokened, strict and not quarantine)
    hand = ["players", "starting_stacks", "blinds_or_straddles"]
    nothing = [F.lit(None).cast("int").alias("seat"), F.lit(0).alias("fold"), F.lit(0).cast("long").alias("contrib"), F.lit(False).alias("bad")]
    deals = tokened.filter("p[0] = 'd' and get(p, 1) = 'db'").select("path", "seq", "street", *nothing, *hand)
    start = tokened.select("path", *hand).dropDuplicates(["path"]).select("path", F.lit(-1).alias("seq"), F.lit(0).alias("street"), *nothing, *hand)
    # a replayed action carries its hand's players and stacks; the blinds come with the deals' rows
    acted = acts.select("path", "seq", "street", "seat", (F.col("verb") == "f").cast("int").alias("fold"), "contrib", F.col("violation").isNotNull().alias("bad"), "players", "starting_stacks", F.lit(None).cast("array<bigint>").alias("blinds_or_straddles"))
    marks = deals.unionByName(start).unionByName(acted)
    whole, so_far = Window.partitionBy("path"), Window.partitionBy("path").orderBy("seq")
    if quarantine:
        marks = marks.withColumn("bad", F.max("bad").over(whole)).filter(~F.col("bad"))
    bit = F.when((F.col("fold") == 1) & F.col("seat").between(1, MOST_SEATS), F.call_function("shiftleft", F.lit(1), F.col("seat"))).otherwise(0)
    marks = marks.select(
        "path", "seq", "street", "seat", "players", "starting_stacks", F.first("blinds_or_straddles", True).over(so_far).alias("blinds"),
        F.bit_or(bit).over(so_far).alias("gone"), F.sum("contrib").over(so_far).alias("in_pot"),
        F.array(*[F.sum(F.when(F.col("seat") == s, F.col("contrib")).otherwise(0)).over(so_far) for s in range(1, MOST_SEATS + 1)]).alias("paid"),
    )
    n = F.size("players")
    seats = F.sequence(F.lit(1), F.when(n <= MOST_SEATS, n).otherwise(F.raise_error(F.lit(f"a hand has at most {MOST_SEATS} seats")).cast("int")))
    is_gone = lambda s: F.call_function("shiftright", F.col("gone"), s).bitwiseAND(F.lit(1)) == 1
    sb, bb = F.get("blinds", F.lit(0)), F.get("blinds", F.lit(1))
    blind = lambda s: F.when(s == 1, sb).when(s == 2, bb).otherwise(0)
    marks = marks.withColumn("alive", F.transform(seats, lambda s: ~is_gone(s))).withColumn("live", F.filter(seats, lambda s: ~is_gone(s)))
    stacks = F.transform(seats, lambda s: F.get("starting_stacks", s - 1) - blind(s) - F.get("paid", s - 1))
    first = F.get("live", F.lit(0))
    after = F.coalesce(F.get(F.filter("live", lambda s: s > F.col("seat")), F.lit(0)), first)
    opening = F.when(F.col("street") > 0, first).when(n == 2, 1).otherwise(3)
    to_act = F.get("players", F.when(F.col("seat").isNull(), opening).otherwise(after) - 1)
    out = marks.select("path", "seq", "street", "players", "alive", stacks.alias("stacks"), to_act.alias("player_to_act"), (sb + bb + F.col("in_pot")).alias("pot"))
    return out.join(boards(tokened), ["path", "street"], "left")
