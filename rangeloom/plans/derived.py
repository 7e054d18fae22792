"""Hands derived from the driver's tables, so that the whole path from log to result runs over a table of any size.

A user's day of ``events`` is a hand. Its table has 2 to 6 seats, by the user; events
are the actions in turn, two on each street, so the third, fifth, ... is preceded by
a board deal. Errors fold, views and clicks call, the others raise. Some logs are
broken on purpose: short stacks, players who act after folding, a fifth street,
verbs and seats that do not exist, raises to less than others or the player have paid. Cards are drawn without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.cards import RANKS, SUITS, reckoned

#: Event types in the order of the action buckets (fixed values).
EVENT_BUCKETS = ("error", "view", "click", "signup", "purchase")
PLAYERS = ("ann", "bob", "cyd", "dan", "eve", "fay")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(key: Column, n: int) -> Column:
    """``n`` different cards drawn from a key: an integer generator picks among what is left of the deck.

    A draw is a place among the cards that are left. Going back over the draws before it, the last first, it moves up by
    one at each whose place is at or before its own: its place in the deck as it was before that draw.
    """
    return F.transform(numbers(places(key, n)), card_of)


def places(key: Column, n: int) -> Column:
    """The places of ``n`` draws, each among the cards that are then left."""
    x, out = key.cast("long"), []
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(F.floor(x / 65536).cast("int") % (52 - i))
    return F.array(*out)


def numbers(at: Column) -> Column:
    """The numbers of the cards at ``places``, which are read several times."""
    before = lambda i: F.reverse(F.slice(at, F.lit(1), i))
    return F.transform(at, lambda place, i: F.aggregate(before(i), place, lambda c, p: c + (p <= c).cast("int")))


def card_of(c: Column) -> Column:
    """``card_name`` looked up."""
    return F.get(F.array(*[F.lit(RANKS[12 - i % 13] + SUITS[i // 13]) for i in range(52)]), c)


def with_cards(df: DataFrame, key: str, n: int, into: str = "cards") -> DataFrame:
    """Adds ``into``, the cards of ``drawn`` for a few of them, one by one as columns, so that generated code does it."""
    steps, taken, x = [], [], F.col(key).cast("long")
    for i in range(n):
        steps.append({f"__x{i}": (x * 1103515245 + 12345) % 2147483648})
        x = F.col(f"__x{i}")
        steps.append({f"__at{i}": F.floor(x / 65536).cast("int") % (52 - i)})
        # taken cards in their order; the j-th of them is passed if it is at most the place reached by then
        before = [(t - j <= F.col(f"__at{i}")).cast("int") for j, t in enumerate(taken)]
        steps.append({f"__c{i}": sum(before, F.col(f"__at{i}"))})
        c = F.col(f"__c{i}")
        placed = [F.least(taken[0], c)] + [F.greatest(taken[j - 1], F.least(taken[j], c)) for j in range(1, i)] + [F.greatest(taken[-1], c)] if i else [c]
        steps.append({f"__t{i}_{j}": t for j, t in enumerate(placed)})
        taken = [F.col(f"__t{i}_{j}") for j in range(i + 1)]
    return reckoned(df, into, F.array(*[card_name(F.col(f"__c{i}")) for i in range(n)]), *steps)


def card_name(c: Column) -> Column:
    return F.concat(F.substring(F.lit(RANKS), F.lit(13) - c % 13, F.lit(1)), F.substring(F.lit(SUITS), F.floor(c / 13).cast("int") + 1, F.lit(1)))


def deals(spark: SparkSession, sf_dir: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """(key, cards): seven different cards for each key of a table.

    Rating cards costs far more than moving keys, so the keys of a table in few files are spread first.
    """
    keys = read(spark, sf_dir, table).select(key)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if keys.rdd.getNumPartitions() < spread:
        keys = keys.repartition(spread)
    return with_cards(keys, key, 7)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target, user_id, seq, event_id, bucket, amount): one row for each event, in hands of a user's day.

    They are dealt by hand once, in the session's number of shuffle partitions: what is made of a hand is much work of few bytes.
    """
    e = read(spark, sf_dir, "events")
    bucket = F.array_position(F.array(*map(F.lit, EVENT_BUCKETS)), F.col("event_type")) - 1
    path = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    return e.select(path.alias("path"), F.col("user_id").cast("string").alias("target"), "user_id", "ts", "event_id", bucket.cast("int").alias("bucket"), F.col("value").alias("amount")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").withColumn("seq", F.row_number().over(order))


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived hands, with the columns of a hand history."""
    log = event_log(spark, sf_dir)
    n, s = F.col("user_id") % 5 + 2, F.col("seq")
    first = F.when(s <= 2, F.when(n == 2, 1).otherwise(3)).otherwise(1)
    seat = F.when(F.col("event_id") % 991 == 0, 9).otherwise((first - 1 + (s - 1) % 2) % n + 1)
    verb = (
        F.when(F.col("event_id") % 997 == 1, "xx")
        .when(F.col("bucket") == 0, "f")
        .when(F.col("bucket") <= 2, "cc")
        .when(F.col("event_id") % 97 == 2, "cbr 5")
        .otherwise(F.concat(F.lit("cbr "), (100 * (s + 1) + F.floor("amount") % 100).cast("string")))
    )
    action = F.concat(F.lit("p"), seat.cast("string"), F.lit(" "), verb)
    grouped = log.groupBy("path").agg(F.first("user_id").alias("user_id"), F.min("event_id").alias("key"), F.sort_array(F.collect_list(F.struct(s.alias("s"), action.alias("a")))).alias("acts"))
    grouped = reckoned(grouped.withColumn("n", (F.col("user_id") % 5 + 2).cast("int")), "cards", F.transform("__numbers", card_of), {"__places": places(F.col("key"), 20)}, {"__numbers": numbers(F.col("__places"))})
    card = lambda i: F.get("cards", i)
    holes = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("d dh p"), i.cast("string"), F.lit(" "), card(2 * i - 2), card(2 * i - 1)))
    street = lambda x: F.floor((x["s"] - 1) / 2).cast("int")
    board = lambda k: F.concat(F.lit("d db "), F.when(k == 1, F.concat(card(F.lit(12)), card(F.lit(13)), card(F.lit(14)))).otherwise(F.coalesce(card(13 + k), F.lit(""))))
    # a day of fifteen events and more has deals for which no card is left; they stand in the log without one
    played = F.flatten(F.transform("acts", lambda x: F.when((x["s"] > 1) & (x["s"] % 2 == 1), F.array(board(street(x)), x["a"])).otherwise(F.array(x["a"]))))
    shown = F.when(F.size("acts") >= 5, F.array(F.lit("p1 sm"))).otherwise(F.array().cast("array<string>"))
    stack = F.when(F.col("user_id") % 7 == 0, 400).otherwise(10000).cast("long")
    # behind a barrier: the filter that Spark infers for a later explode of the actions would make them all a second time
    return reckoned(grouped, "actions", F.concat(holes, played, shown)).select(
        "path",
        F.col("user_id").cast("string").alias("session_id"),
        F.col("key").cast("int").alias("hand_no"),
        F.slice(F.array(*map(F.lit, PLAYERS)), F.lit(1), F.col("n")).alias("players"),
        F.array_repeat(stack, F.col("n")).alias("starting_stacks"),
        F.array(F.lit(50).cast("long"), F.lit(100).cast("long")).alias("blinds_or_straddles"),
        "actions",
    )
