"""Post-flop: collapsing a range to seven strengths, and filtering those by actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.cards import BUCKETS, RANKS, bad, best_run, card_bits, cards, let, listed, looked_up, rated_by_ranks, stepwise, strengths, suit_bits, suits_at
from rangeloom.functions.likelihood import OFFSUIT, PAIR, SUITED, class_names, class_shapes, psi_table
from rangeloom.operators.ranges import ranged
from rangeloom.sources.shared import written


def _representatives() -> list[int]:
    """For each kind and each set of suits gone at the high and at the low rank: the suits of the first free combo as first + 4 * second; -1 if none is free."""
    out = []
    for kind in (PAIR, SUITED, OFFSUIT):
        for high in range(16):
            for low in range(16):
                free = [(i, j) for i in range(4) for j in range(4) if not high >> i & 1 and not low >> j & 1 and (i < j if kind == PAIR else (i == j) == (kind == SUITED))]
                out.append(free[0][0] + 4 * free[0][1] if free else -1)
    return out


def representative(shape: Column, gone: Column) -> Column:
    """Suits of a class's first combo, in suit order, that an array of 13 sets of gone suits leaves: first + 4 * second, or -1."""
    return F.get(listed(_representatives()), shape["kind"] * 256 + F.get(gone, shape["high"]) * 16 + F.get(gone, shape["low"]))


def rank_boards(boards: DataFrame) -> DataFrame:
    """(ranks, mono, plain, four): strengths of the 169 classes on each distinct board by ranks, where suits make no flush; bytes in class order.

    ``ranks`` counts a board's ranks in three bits each and ``mono`` tells boards of one suit. ``four`` is for holes that
    have four cards of a suit with the board. Three to five cards have at most 8,450 counts of ranks, so the product
    with the classes and the result (at most 16,900 rows of 350 bytes) are bounded whatever the table.
    """
    spark = boards.sparkSession
    shapes = spark.createDataFrame([(i, c) for i, c in enumerate(class_names())], "class_id int, hand_class string").coalesce(1)
    value = lambda i: F.lit(13) - F.instr(F.lit(RANKS), F.substring("hand_class", i, 1))
    shapes = shapes.select("class_id", value(1).alias("high"), value(2).alias("low"))
    flags = spark.createDataFrame([(False,), (True,)], "four boolean").coalesce(1)
    known = boards.select("ranks", "mono").distinct()
    held = lambda k: reduce(Column.bitwiseOR, [F.when(F.call_function("shiftright", F.col("ranks"), F.lit(3 * r)).bitwiseAND(F.lit(7)) >= k, 1 << r).otherwise(0) for r in range(13)])
    size = sum([F.call_function("shiftright", F.col("ranks"), F.lit(3 * r)).bitwiseAND(F.lit(7)).cast("int") for r in range(1, 13)], F.col("ranks").bitwiseAND(F.lit(7)).cast("int"))
    known = stepwise(known, {f"__n{k}": held(k) for k in (1, 2, 3, 4)} | {"__b_size": size})
    rows = known.crossJoin(F.broadcast(flags.crossJoin(shapes)))
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.col(c))
    first = {"__own": bit("high").bitwiseOR(bit("low")), "__twice": F.when(F.col("high") == F.col("low"), bit("high")).otherwise(0)}
    n = lambda k: F.col(f"__n{k}")
    own, twice = F.col("__own"), F.col("__twice")
    levels = {"__g1": n(1).bitwiseOR(own), "__g2": n(2).bitwiseOR(n(1).bitwiseAND(own)).bitwiseOR(twice)}
    levels |= {f"__g{k}": n(k).bitwiseOR(n(k - 1).bitwiseAND(own)).bitwiseOR(n(k - 2).bitwiseAND(twice)) for k in (3, 4)}
    board = {"__b_ranks": n(1), "__b_most": F.when(F.col("mono"), F.col("__b_size")).otherwise(0), "__flush": F.lit(0), "__most": F.when(F.col("four"), 4).otherwise(0)}
    rows = stepwise(rows, first, levels | board | {"__first": F.col("high") + 2, "__second": F.col("low") + 2}, *rated_by_ranks())
    one = F.struct("class_id", F.col("__bucket").cast("tinyint").alias("b"))
    vector = lambda four: F.transform(F.sort_array(F.collect_list(F.when(F.col("four") == four, one))), lambda x: x["b"])
    return rows.groupBy("ranks", "mono").agg(vector(False).alias("plain"), vector(True).alias("four"))


def strength_vectors(boards: DataFrame) -> DataFrame:
    """(board, strengths, members): for each distinct board the places in ``BUCKETS`` of the 169 classes, bytes in class order, -1 where a class has no combo left; and for each strength its classes.

    A class stands for its first combo in suit order that the board leaves. Boards are told apart as sets of cards.
    By ranks alone a class is rated once for all boards that share them (``rank_boards``); what a board adds is which
    of its classes make a flush, or four to one. A board of other than three to five cards has no strengths.
    """
    # much work of few bytes: parts must not be merged for their size, and a board's text is read once
    parts = int(boards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = boards.select("board").distinct().repartition(parts, "board").withColumn("__cards", cards(F.col("board")))
    known = written(known.select("board", card_bits(F.col("__cards")).alias("__set")), "boards")
    return known.join(_set_strengths(known), "__set").select("board", "strengths", "members")


def _set_strengths(known: DataFrame) -> DataFrame:
    """(__set, strengths, members) of the distinct sets of cards of boards (``strength_vectors``), written; three cards make at most 22,100."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = known.select("__set").distinct().filter(F.bit_count("__set").between(3, 5))
    bits = F.col("__set")
    held = {f"__s{k}": suit_bits(bits, k) for k in range(4)}
    counts = [F.bit_count(f"__s{k}") for k in range(4)]
    per_rank = [F.call_function("shiftleft", F.bit_count(suits_at(bits, r)).cast("long"), F.lit(3 * r)) for r in range(13)]
    sets = sets.withColumns(held).withColumns({
        "__n": F.array(*counts), "__most": F.greatest(*counts), "__gone": F.array(*[suits_at(bits, r) for r in range(13)]), "ranks": reduce(Column.bitwiseOR, per_rank), "mono": F.greatest(*counts) == F.bit_count(bits),
    })
    sets = written(sets.repartition(parts, "__set"), "board-sets")
    met = sets.join(F.broadcast(written(rank_boards(sets), "rank-boards")), ["ranks", "mono"])
    suits = F.array(*[F.col(f"__s{k}") for k in range(4)])
    ace = F.lit(12)

    def flush(shape: Column, first: Column, second: Column) -> Column:
        """Strength of a class that makes a flush; the flush is of a suit that it holds, or of the board alone."""
        own = lambda s: F.get(suits, s)
        with_hole = lambda k: F.get(suits, F.lit(k)).bitwiseOR(F.when(first == k, F.call_function("shiftleft", F.lit(1), shape["high"])).otherwise(0)).bitwiseOR(F.when(second == k, F.call_function("shiftleft", F.lit(1), shape["low"])).otherwise(0))
        in_suit = lambda k: F.bit_count(with_hole(k)) >= 5
        whole = F.when(in_suit(0), with_hole(0)).when(in_suit(1), with_hole(1)).when(in_suit(2), with_hole(2)).otherwise(with_hole(3))
        suit = F.when(in_suit(0), 0).when(in_suit(1), 1).when(in_suit(2), 2).otherwise(3)
        nut = ((first == suit) & (shape["high"] == ace)) | ((second == suit) & (shape["low"] == ace))
        return F.when(nut | ~F.col("mono") | (looked_up(best_run, whole) > 0), 0).otherwise(1)

    def of_class(shape: Column, i: Column) -> Column:
        def told(combo: Column) -> Column:
            first, second = combo.bitwiseAND(F.lit(3)), F.call_function("shiftright", combo, F.lit(2))
            n = lambda s: F.get("__n", s)
            same = F.greatest(n(first) + 2, F.col("__most"))
            apart = F.greatest(n(first) + 1, n(second) + 1, F.col("__most"))
            most = F.when(first == second, same).otherwise(apart)
            known = F.when(most >= 5, flush(shape, first, second).cast("tinyint")).when(most == 4, F.get("four", i)).otherwise(F.get("plain", i))
            return F.when(combo < 0, F.lit(-1).cast("tinyint")).otherwise(known)

        return let(representative(shape, F.col("__gone")), told)

    rated = met.select("__set", F.transform(class_shapes(), of_class).alias("strengths"))
    every = F.sequence(F.lit(0), F.lit(168))
    members = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.filter(every, lambda i: F.get("strengths", i) == k).cast("array<smallint>"))
    return written(rated.withColumn("members", members), "strengths")


def collapsed(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start): the seven strengths of each row (keys, board, p) with p as an array in class order, as an array.

    Mass of classes without a combo is shared in proportion; a row without any mass, or whose board has no strengths, is uniform.
    """
    rated = ranges.join(strength_vectors(ranges).drop("strengths"), "board", "left")
    return _shared(rated.select(*keys, _gathered(F.col("members"), F.col("p")).alias("m")), keys)


def _gathered(members: Column, p: Column) -> Column:
    """A range's mass at each of the seven strengths; each class is read once, in the list of its strength."""
    return F.transform(members, lambda of: F.aggregate(of, F.lit(0.0), lambda a, i: a + F.coalesce(F.get(p, i.cast("int")), F.lit(0.0))))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start) of rows (keys, m): masses in proportion, uniform where there are none."""
    rated = rows.select(*keys, F.coalesce("m", F.array_repeat(F.lit(0.0), 7)).alias("m")).withColumn("z", F.aggregate("m", F.lit(0.0), lambda a, x: a + x))
    return rated.select(*keys, F.when(F.col("z") > 0, F.transform("m", lambda x: x / F.col("z"))).otherwise(F.array_repeat(F.lit(1 / 7), 7)).alias("start"))


def collapse(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket_idx, strength, p): ``collapsed`` with a row for each strength."""
    rows = collapsed(ranges, keys).select(*keys, F.posexplode("start").alias("bucket_idx", "p"))
    return rows.select(*keys, "bucket_idx", F.get(F.array(*map(F.lit, BUCKETS)), F.col("bucket_idx")).alias("strength"), "p")


def later_streets(ranges: DataFrame, boards: DataFrame, acts: DataFrame, phi: float = 0.0) -> DataFrame:
    """The pre-flop ranges of a hand's pairs carried over its later streets: one row for each (path, observer, target) whose target acts after the flop.

    ``ranges`` are rows of ``range_vectors``, ``boards`` has (path, street, board), ``acts`` the replayed actions. A range
    collapses to strengths on the hand's own flop, and the target's later actions filter these. Actions do not depend on
    the observer, so their log-likelihoods are summed for each target before its observers meet them.

    (path, observer, target, board, n_actions, start, p, log_likelihood): strengths before and after as arrays in the order of ``BUCKETS``.
    """
    rows = ranges.join(_acted_later(acts, phi), ["path", "target"]).join(boards.filter("street = 1").select("path", "board"), "path")
    # only pairs whose target acts later are rated
    return _filtered(collapsed(rows, ["path", "observer", "target", "board", "n_actions", "l"]))


def later_ranges(made: DataFrame, observed: DataFrame, boards: DataFrame, acts: DataFrame, phi: float = 0.0, keep: bool = False) -> DataFrame:
    """``later_streets`` of the ranges that ``made`` and ``observed`` lead to: what a pair needs goes with it as a small row, and where it meets its range's array, seven masses are taken."""
    flops = boards.filter("street = 1").select("path", "board").withColumn("__cards", cards(F.col("board"))).select("path", "board", card_bits(F.col("__cards")).alias("__set"))
    flops = written(flops, "flops") if keep else flops
    carried = observed.join(_acted_later(acts, phi), ["path", "target"]).join(flops, "path")
    rows = ranged(made, carried, {"p": F.col("p")}, keep=keep).join(_set_strengths(flops), "__set", "left")
    names = ["path", "observer", "target", "board", "n_actions", "l"]
    return _filtered(_shared(rows.select(*names, _gathered(F.col("members"), F.col("p")).alias("m")), names))


def _acted_later(acts: DataFrame, phi: float) -> DataFrame:
    """(path, target, n_actions, l): log-likelihoods of each target's actions after the flop, by strength."""
    psi = psi_table(acts.sparkSession, phi).groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket_idx", F.log("psi").alias("l")))), lambda x: x["l"]).alias("ln"))
    made = acts.filter("street > 0").select("path", F.col("player").alias("target"), "bucket").join(F.broadcast(psi), "bucket")
    summed = made.groupBy("path", "target").agg(F.count("*").alias("n_actions"), *[F.sum(F.get("ln", F.lit(i))).alias(f"l{i}") for i in range(7)])
    return summed.select("path", "target", "n_actions", F.array(*[f"l{i}" for i in range(7)]).alias("l"))


def _filtered(rows: DataFrame) -> DataFrame:
    top = F.array_max(F.zip_with("start", "l", lambda p, l: F.when(p > 0, l)))
    rows = rows.withColumn("top", top).withColumn("w", F.zip_with("start", "l", lambda p, l: F.when(p > 0, p * F.exp(l - F.col("top"))).otherwise(0.0)))
    rows = rows.withColumn("z", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    return rows.select("path", "observer", "target", "board", "n_actions", "start", F.transform("w", lambda x: x / F.col("z")).alias("p"), (F.log("z") + F.col("top")).alias("log_likelihood"))


def strength_value(p: Column) -> Column:
    """Expected strength of an array of the seven: 1 for certain nuts, 0 for certain air."""
    return F.aggregate(F.transform(p, lambda x, i: x * (6 - i) / 6), F.lit(0.0), lambda a, x: a + x)


def strength_filter(start: DataFrame, actions: DataFrame, keys: list[str], phi: float = 0.0) -> DataFrame:
    """Posterior over strengths: rows (keys, strength, p) of ``start`` filtered by rows (keys, bucket) of ``actions``.

    Unknown strengths have likelihood 1/5 and unknown buckets 0.02. Groups without actions keep their (normalised) start.
    """
    psi = psi_table(start.sparkSession, phi).select("strength", "bucket", "psi")
    counts = actions.groupBy(*keys, "bucket").count()
    known = F.col("strength").isin(list(BUCKETS))
    rows = start.join(counts, keys, "left").join(F.broadcast(psi), ["strength", "bucket"], "left")
    ln = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.col("count") * F.log(F.coalesce("psi", F.when(known, 0.02).otherwise(0.2))))
    rows = rows.groupBy(*keys, "strength", "p").agg(F.sum(ln).alias("ll"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("top", F.max("ll").over(w)).withColumn("w", F.col("p") * F.exp(F.col("ll") - F.col("top")))
    rows = rows.withColumn("z", F.sum("w").over(w)).withColumn("p0", F.sum("p").over(w))
    z = F.when(F.col("z") > 0, F.col("z")).otherwise(bad("zero evidence").cast("double"))
    return rows.select(*keys, "strength", (F.col("w") / z).alias("p"), (F.log(z / F.col("p0")) + F.col("top")).alias("log_likelihood"))


def expected_strength(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected_strength, effective_size): 1 for certain nuts, 0 for certain air."""
    place = F.create_map(*[F.lit(x) for kv in ((b, (6 - i) / 6) for i, b in enumerate(BUCKETS)) for x in kv])
    p = F.col("p")
    return rows.groupBy(*keys).agg(F.sum(p * place[F.col("strength")]).alias("expected_strength"), (1 / F.sum(p * p)).alias("effective_size"))


def strength_steps(start: DataFrame, actions: DataFrame, keys: list[str], phi: float = 0.0) -> DataFrame:
    """Telemetry after each update of the post-flop filter: (keys, step, action_bucket, evidence, effective_size, top_strength, top_probability).

    ``start`` has rows (keys, strength, p), ``actions`` rows (keys, action_index, bucket). Ties go to the stronger; no evidence is an error.
    """
    psi = psi_table(start.sparkSession, phi)
    vectors = psi.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket_idx", F.log("psi").alias("l")))), lambda x: x["l"]).alias("ln"))
    order = F.create_map(*[F.lit(x) for kv in ((b, i) for i, b in enumerate(BUCKETS)) for x in kv])
    listed = start.filter(F.col("strength").isin(list(BUCKETS))).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(order[F.col("strength")], "p"))).alias("m"))
    prior = listed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("p0"))
    met = actions.join(F.broadcast(vectors), "bucket", "left").withColumn("ln", F.coalesce("ln", F.array_repeat(F.log(F.lit(0.02)), 7)))
    numbered = met.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("action_index")))
    so_far = Window.partitionBy(*keys).orderBy("step")
    sums = numbered.select(*keys, "step", "bucket", F.array(*[F.sum(F.get("ln", F.lit(i))).over(so_far) for i in range(7)]).alias("l"))
    rows = sums.join(prior, keys)
    top = F.array_max("l")
    w = F.zip_with("p0", "l", lambda p, l: F.when(p > 0, p * F.exp(l - top)).otherwise(0.0))
    rows = rows.withColumn("w", w).withColumn("z", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).withColumn("z0", F.aggregate("p0", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("z", F.when(F.col("z") > 0, F.col("z")).otherwise(bad("zero evidence").cast("double"))).withColumn("log_z", F.log("z") + top)
    best = F.array_min(F.transform("w", lambda x, i: F.struct((-F.round(x / F.col("z"), 12)).alias("o"), i.alias("i"), x.alias("x"))))
    before = F.coalesce(F.lag("log_z").over(so_far), F.log("z0"))
    names = F.array(*map(F.lit, BUCKETS))
    squares = F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(
        *keys, "step", F.col("bucket").alias("action_bucket"), F.exp(F.col("log_z") - before).alias("evidence"), (F.col("z") * F.col("z") / squares).alias("effective_size"),
        F.get(names, best["i"]).alias("top_strength"), (best["x"] / F.col("z")).alias("top_probability"),
    )


def top_strengths(rows: DataFrame, keys: list[str], k: int = 7) -> DataFrame:
    """(keys, rank, strength, p): the ``k`` likeliest strengths of rows (keys, strength, p); ties go to the stronger."""
    place = F.create_map(*[F.lit(x) for kv in ((b, i) for i, b in enumerate(BUCKETS)) for x in kv])
    w = Window.partitionBy(*keys).orderBy(F.round("p", 12).desc(), place[F.col("strength")])
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "rank", "strength", "p")


def live_strengths(snapshots: DataFrame, holes: DataFrame) -> DataFrame:
    """(path, seq, player, hole, board, rated) for each live player of each snapshot (``states``); ``rated`` is null without a board or hole cards.

    Each distinct pair of hole cards and board is rated once.
    """
    seats = F.filter(F.transform("alive", lambda a, i: F.struct(a.alias("a"), F.get("players", i).alias("player"))), lambda x: x["a"])
    live = snapshots.select("path", "seq", "board", F.explode(seats).alias("s")).select("path", "seq", "board", F.col("s.player").alias("player"))
    live = live.join(holes.select("path", "player", F.col("cards").alias("hole")), ["path", "player"], "left")
    distinct = live.select("hole", "board").distinct().filter("hole <> '' and board <> ''")
    rated = strengths(distinct.withColumns({"__h": cards(F.col("hole")), "__c": cards(F.col("board"))}), "__h", "__c", "rated").drop("__h", "__c")
    return live.join(rated, ["hole", "board"], "left").select("path", "seq", "player", "hole", "board", "rated")
