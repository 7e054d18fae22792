"""Ranges: distributions over the 169 hand classes, by the closed form of the Bayes filter.

The posterior of a target after its decisions is prior(h) * product of the action
likelihoods, normalised; the log-likelihood is the log of the normaliser, because
the evidences of the steps telescope. Likelihoods do not depend on the observer,
so they are summed once for each target and only then fanned out.

Between the operators a range is one row with an array in class order, not 169 rows:
what is shuffled, sorted or joined is one row for each hand and target. Decisions
are dealt by path once, into as many parts as the session shuffles into: vectors
make much work of few bytes, so parts must not be merged for their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.cards import RANKS, bad, let, plain_bits, reckoned, suit_bits, suits_at, text_class
from rangeloom.functions.likelihood import FLOOR, PAIR, SUITED, action_table, class_names, class_shapes
from rangeloom.sources.shared import written


def combo_count(name: Column) -> Column:
    """6 for pairs, 4 for suited and 12 for offsuit classes."""
    return F.when(F.length(name) == 2, 6).when(F.substring(name, 3, 1) == "s", 4).otherwise(12)


def counts_left(bits: Column) -> Column:
    """Combos of the 169 classes, in class order, that a set of dead cards of any size leaves.

    A pair has as many as two of its rank's free suits can be chosen, a suited class as many as suits are free at both
    ranks, an offsuit one the other products of free suits.
    """
    pairs = F.array(*map(F.lit, (0, 0, 1, 3, 6)))

    def of_class(shape: Column, free: Column) -> Column:
        def told(x: Column) -> Column:
            both = F.bit_count(x["high"].bitwiseAND(x["low"]))
            return F.when(shape["kind"] == PAIR, F.get(pairs, both)).when(shape["kind"] == SUITED, both).otherwise(F.bit_count(x["high"]) * F.bit_count(x["low"]) - both)

        return let(F.struct(F.get(free, shape["high"]).alias("high"), F.get(free, shape["low"]).alias("low")), told)

    free_suits = lambda b: F.array(*[F.lit(15).bitwiseXOR(suits_at(b, r)) for r in range(13)])
    # bound once for each row: inlined, the array would be made again for each class
    return let(bits, lambda b: let(free_suits(b), lambda free: F.transform(class_shapes(), lambda s: of_class(s, free))))


def with_pattern(dead: DataFrame) -> DataFrame:
    """Adds ``pattern``: the suits of the dead cards' set (``suit_bits``), put in order and packed into a set again.

    Which suit is which makes no difference to how many combos a class has left, so sets that differ by their suits' names
    alone share a pattern: 169 for two cards, 134,459 for five, whatever the table.
    """
    suits = [F.col(f"__d{k}") for k in range(4)]
    low, high = [F.least(*suits[:2]), F.least(*suits[2:])], [F.greatest(*suits[:2]), F.greatest(*suits[2:])]
    steps = [{"__bits": plain_bits(F.col("dead"))}, {f"__d{k}": suit_bits(F.col("__bits"), k) for k in range(4)}, {"__l0": low[0], "__l1": low[1], "__h0": high[0], "__h1": high[1]}]
    steps.append({"__o0": F.least("__l0", "__l1"), "__o3": F.greatest("__h0", "__h1"), "__m0": F.greatest("__l0", "__l1"), "__m1": F.least("__h0", "__h1")})
    order = [F.col("__o0"), F.least("__m0", "__m1"), F.greatest("__m0", "__m1"), F.col("__o3")]
    packed = [F.call_function("shiftleft", c.cast("long"), F.lit(13 * k)) for k, c in enumerate(order)]
    return reckoned(dead, "pattern", reduce(Column.bitwiseOR, packed), *steps)


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """Adds ``counts``, the combos that a ``pattern`` leaves in class order, and ``total``, their sum. One row for each pattern is enough."""
    dealt = patterns.repartition(int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pattern")
    free = {f"__f{r}": F.lit(15).bitwiseXOR(suits_at(F.col("pattern"), r)) for r in range(13)}
    n = {f"__n{r}": F.bit_count(f"__f{r}") for r in range(13)}
    both = {f"__b{h}_{l}": F.bit_count(F.col(f"__f{h}").bitwiseAND(F.col(f"__f{l}"))) for h in range(13) for l in range(h)}  # noqa: E741

    def left(name: str) -> Column:
        high, low = 12 - RANKS.index(name[0]), 12 - RANKS.index(name[1])
        many = F.col(f"__n{high}") * F.col(f"__n{low}")
        if len(name) == 2:
            return F.call_function("shiftright", many - F.col(f"__n{high}"), F.lit(1))
        return F.col(f"__b{high}_{low}") if name[2] == "s" else many - F.col(f"__b{high}_{low}")

    known = reckoned(dealt, "counts", F.array(*map(left, class_names())), free, n | both)
    cards = F.lit(52) - F.bit_count("pattern")
    return known.withColumn("total", F.call_function("shiftright", cards * (cards - 1), F.lit(1)))


def prior_counts(dead: DataFrame) -> DataFrame:
    """(dead, counts, total) for each distinct string of dead cards: the combos left in class order, and their sum.

    Any number of cards can be dead, an observer's two or a board as well; counts are made once for each pattern of suits.
    """
    distinct = with_pattern(dead.select("dead").distinct())
    known = distinct.join(pattern_counts(distinct.select("pattern").distinct()), "pattern")
    return known.select("dead", "counts", F.when(F.col("total") > 0, F.col("total")).otherwise(bad("no legal combos: ", F.col("dead")).cast("int")).alias("total"))


def priors(dead: DataFrame) -> DataFrame:
    """(dead, class_id, hand_class, combos, prior): ``prior_counts`` in long form; classes without a combo stay with 0."""
    names = F.array(*map(F.lit, class_names()))
    long = prior_counts(dead).select("dead", "total", F.posexplode("counts").alias("class_id", "combos"))
    return long.select("dead", "class_id", F.get(names, F.col("class_id")).alias("hand_class"), "combos", (F.col("combos") / F.col("total")).alias("prior"))


def decisions(replayed: DataFrame) -> DataFrame:
    """Pre-flop decisions, one row each: (path, hand_no, target, action_index, state_key, bucket, amount)."""
    return replayed.filter("street = 0").select("path", "hand_no", F.col("player").alias("target"), "action_index", "state_key", "bucket", "amount")


def pairs(hands: DataFrame, holes: DataFrame, observers: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """(path, observer, target, dead): ordered pairs of different players with the observer's cards ('' if unknown)."""
    chosen = lambda df, names, c: df.filter(F.col(c).isin(names)) if names else df
    # players of one hand meet in its own row
    rows = hands.select("path", F.explode("players").alias("observer"), "players").select("path", "observer", F.explode("players").alias("target")).filter("observer <> target")
    both = chosen(rows, observers, "observer")
    both = chosen(both, targets, "target")
    known = holes.select("path", F.col("player").alias("observer"), F.col("cards").alias("dead"))
    return both.join(known, ["path", "observer"], "left").withColumn("dead", F.coalesce("dead", F.lit("")))


def class_likelihoods(made: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_id, log_lik, n): each group's log-likelihood of its decisions for each class, in long form."""
    return summed(made, table, keys).select(*keys, F.posexplode("log_lik").alias("class_id", "log_lik"), "n")


def action_vectors(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(state_key, keep, bucket, ln): log-likelihoods of all classes in class order, one row for each state key and bucket (at most 1,350 rows of 1.4 KB for each kept value)."""
    entry = F.sort_array(F.collect_list(F.struct("class_id", F.log("lik").alias("ln"))))
    return table.groupBy("state_key", *keep, "bucket").agg(F.transform(entry, lambda x: x["ln"]).alias("ln"))


def dealt(made: DataFrame) -> DataFrame:
    """Decisions dealt by path, in the session's number of shuffle partitions."""
    return made.repartition(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _zeros() -> Column:
    return F.array_repeat(F.lit(0.0), 169)


def summed(made: DataFrame, table: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, keep, log_lik, n): each group's log-likelihoods as an array in class order.

    Equal decisions of a group are counted first, so a group holds at most one vector for each state key and bucket.
    """
    counted = dealt(made).groupBy(*keys, "state_key", "bucket").agg(F.count("*").alias("c"))
    met = counted.join(F.broadcast(action_vectors(table, keep)), ["state_key", "bucket"])
    listed = met.groupBy(*keys, *keep).agg(F.collect_list(F.struct("c", "ln")).alias("l"), F.sum("c").alias("n"))
    total = F.aggregate("l", _zeros(), lambda acc, x: F.zip_with(acc, x["ln"], lambda a, b: a + x["c"] * b))
    return listed.select(*keys, *keep, total.alias("log_lik"), "n")


def prior_vectors(observed: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(dead, prior): the prior of each distinct string of dead cards as an array in class order; ``initial`` (class_id, weight) replaces it."""
    if initial is None:
        return prior_counts(observed).select("dead", F.transform("counts", lambda n: n / F.col("total")).alias("prior"))
    given = F.map_from_entries(F.collect_list(F.struct("class_id", F.col("weight").cast("double"))))
    listed = initial.agg(given.alias("m"), F.sum("weight").alias("t"))
    share = F.when(F.col("t") > 0, F.transform(F.sequence(F.lit(0), F.lit(168)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("t")))
    vector = listed.select(share.otherwise(bad("an initial range without weight").cast("array<double>")).alias("prior"))
    return observed.select("dead").distinct().crossJoin(F.broadcast(vector))


def met_by_path(per_target: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows (path, target, ...) for each of their observers, with the columns of ``observed``.

    The join is by path alone, as the rows are dealt already; a path's pairs are at most its players squared.
    """
    told = [c for c in observed.columns if c not in ("path", "target")]
    by_path = observed.groupBy("path").agg(F.collect_list(F.struct("target", *told)).alias("__pairs"))
    both = per_target.join(by_path, "path").withColumn("__o", F.explode(F.filter("__pairs", lambda x: x["target"] == F.col("target"))))
    return both.select(*per_target.columns, *[F.col(f"__o.{c}").alias(c) for c in told])


def fanned_out(per_target: DataFrame, observed: DataFrame, start: DataFrame) -> DataFrame:
    """``met_by_path`` with each row's ``prior``."""
    return met_by_path(per_target, observed).join(start, "dead")


def _weighed(prior: Column, log_lik: Column, body) -> Column:
    """``body`` of struct(w, z, top): weights prior * exp(log_lik - top), their sum, and the largest log-likelihood that has a prior; no weight is an error."""
    top = F.array_max(F.zip_with(prior, log_lik, lambda p, l: F.when(p > 0, l)))

    def made(top: Column) -> Column:
        w = F.zip_with(prior, log_lik, lambda p, l: F.when(p > 0, p * F.exp(l - top)).otherwise(0.0))
        total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        checked = lambda z: F.when(z > 0, z).otherwise(bad("zero evidence").cast("double"))
        return let(w, lambda w: let(F.struct(w.alias("w"), checked(total(w)).alias("z"), top.alias("top")), body))

    return let(top, made)


def moved(made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, moves, n): each group's decisions as a sorted array of (state_key, bucket, times), and their number. What is no decision of the model is passed over."""
    counted = dealt(made.filter("state_key is not null and bucket between 0 and 4")).groupBy(*keys, "state_key", "bucket").agg(F.count("*").alias("c"))
    return counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("state_key", "bucket", "c"))).alias("moves"), F.sum("c").alias("n"))


def seen(made: DataFrame, observed: DataFrame, keep: bool = False) -> DataFrame:
    """(path, target, moves, n, and the columns of ``observed``): a row for each pair with decisions.

    These rows hold no vectors; a range is settled by ``moves`` and ``dead``, which many pairs share. They are read at least
    twice; ``keep`` writes them, which pays for more than a few hands.
    """
    rows = met_by_path(moved(made, ["path", "target"]), observed).filter("dead is not null")
    return written(rows, "pairs") if keep else rows


def settled(pairs: DataFrame, table: DataFrame, once: dict[str, Column], initial: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(moves, dead, keep, once) for each distinct (moves, dead) of ``seen``: ``once`` are expressions of ``p``, the range in class order, and ``log_likelihood``.

    Only these rows meet vectors. Their number is that of different decisions by that of different hole cards.
    """
    combos = pairs.select("moves", "dead").distinct()
    each = combos.select("moves").distinct().select("moves", F.explode("moves").alias("m")).select("moves", "m.state_key", "m.bucket", "m.c")
    met = each.join(F.broadcast(action_vectors(table, keep)), ["state_key", "bucket"])
    listed = met.groupBy("moves", *keep).agg(F.sort_array(F.collect_list(F.struct("state_key", "bucket", "c", "ln"))).alias("l"))
    like = listed.select("moves", *keep, F.aggregate("l", _zeros(), lambda acc, x: F.zip_with(acc, x["ln"], lambda a, b: a + x["c"] * b)).alias("log_lik"))
    rows = combos.join(prior_vectors(combos, initial), "dead").join(like, "moves")
    out = _weighed(F.col("prior"), F.col("log_lik"), lambda x: F.struct(F.transform(x["w"], lambda w: w / x["z"]).alias("p"), (F.log(x["z"]) + x["top"]).alias("log_likelihood")))
    # behind a barrier, as ``once`` may read a range several times
    known = rows.select("moves", "dead", *keep, F.explode(F.array(out)).alias("__r")).select("moves", "dead", *keep, "__r.p", "__r.log_likelihood")
    return known.select("moves", "dead", *keep, *[c.alias(name) for name, c in once.items()])


def ranged(made: DataFrame, observed: DataFrame, once: dict[str, Column], phi: float = 0.0, floor: float = FLOOR, initial: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """(the columns of ``observed``, n, once): a row for each pair with decisions, with ``once`` as in ``settled``."""
    rows = seen(made, observed, keep)
    return rows.join(settled(rows, action_table(made, phi, floor), once, initial), ["moves", "dead"]).select(*observed.columns, "n", *once)


def whole() -> dict[str, Column]:
    return {"p": F.col("p"), "log_likelihood": F.col("log_likelihood")}


def range_vectors(made: DataFrame, observed: DataFrame, phi: float = 0.0, floor: float = FLOOR, initial: DataFrame | None = None) -> DataFrame:
    """(path, observer, target, dead, p, log_likelihood, n): the posterior of every pair with decisions, as an array in class order.

    What needs less than the whole array takes ``ranged``, so that arrays are not moved with the pairs.
    """
    return ranged(made, observed, whole(), phi, floor, initial).select("path", "observer", "target", "dead", "p", "log_likelihood", "n")


def posteriors(made: DataFrame, observed: DataFrame, phi: float = 0.0, floor: float = FLOOR, initial: DataFrame | None = None) -> DataFrame:
    """(path, observer, target, dead, class_id, hand_class, p, log_likelihood, n): ``range_vectors`` in long form."""
    rows = range_vectors(made, observed, phi, floor, initial)
    names = F.array(*map(F.lit, class_names()))
    long = rows.select("path", "observer", "target", "dead", F.posexplode("p").alias("class_id", "p"), "log_likelihood", "n")
    return long.select("path", "observer", "target", "dead", "class_id", F.get(names, F.col("class_id")).alias("hand_class"), "p", "log_likelihood", "n")


def top_of(p: Column, k: int) -> Column:
    """The ``k`` likeliest classes of a range vector as structs (hand_class, probability); ties keep class order."""
    names = F.array(*map(F.lit, class_names()))
    entries = F.transform(p, lambda x, i: F.struct((-F.round(x, 12)).alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(F.get(names, e["i"]).alias("hand_class"), e["x"].alias("probability")))


def effective_size(p: Column) -> Column:
    """1 / sum of squares; 0 for a vector of zeros."""
    return let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x), lambda s: F.when(s > 0, 1 / s).otherwise(0.0))


def summaries(ranges: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """One row for each row of ``range_vectors``: top ``k`` (ties in class order), the whole range in class order, effective size, log-likelihood, count."""
    names = F.array(*map(F.lit, class_names()))
    return ranges.select(
        *keys,
        top_of(F.col("p"), k).alias("top_range"),
        F.map_from_arrays(names, "p").alias("final_range"),
        F.col("p").alias("range_vector"),
        effective_size(F.col("p")).alias("effective_size"),
        "log_likelihood",
        F.col("n").alias("n_decisions"),
    )


def top_classes(ranges: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` likeliest classes of each row of ``range_vectors``, a row for each with its rank."""
    return ranges.select(*keys, F.posexplode(top_of(F.col("p"), k)).alias("__r", "__t"), "log_likelihood", "n").select(
        *keys, (F.col("__r") + 1).alias("rank"), F.col("__t.hand_class").alias("hand_class"), F.col("__t.probability").alias("p"), "log_likelihood", "n"
    )


def filter_steps(made: DataFrame, observed: DataFrame, phi: float = 0.0, floor: float = FLOOR) -> DataFrame:
    """Telemetry after each update: evidence, effective sample size, likeliest class and its probability.

    The running sums are made once for each target and stay in one row until the observers have met them.
    """
    vectors = action_vectors(action_table(made, phi, floor))
    met = dealt(made.select("path", "target", "action_index", "state_key", "bucket")).join(F.broadcast(vectors), ["state_key", "bucket"])
    listed = met.groupBy("path", "target").agg(F.array_sort(F.collect_list(F.struct("action_index", "state_key", "bucket", "ln"))).alias("l"))
    kind = "struct<sum:array<double>,steps:array<struct<action_index:bigint,state_key:string,bucket:int,log_lik:array<double>>>>"
    start = F.struct(_zeros().alias("sum"), F.array().alias("steps")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        def grown(v: Column) -> Column:
            one = F.struct(x["action_index"].cast("long").alias("action_index"), x["state_key"].alias("state_key"), x["bucket"].alias("bucket"), v.alias("log_lik"))
            return F.struct(v.alias("sum"), F.concat(acc["steps"], F.array(one)).alias("steps")).cast(kind)

        return let(F.zip_with(acc["sum"], x["ln"], lambda a, b: a + b), grown)

    sums = listed.select("path", "target", F.aggregate("l", start, step, lambda acc: acc["steps"]).alias("steps"))
    rows = fanned_out(sums, observed, prior_vectors(observed)).select("path", "observer", "target", "prior", F.posexplode("steps").alias("at", "s"))
    names = F.array(*map(F.lit, class_names()))

    def told(x: Column) -> Column:
        best = F.array_min(F.transform(x["w"], lambda w, i: F.struct((-F.round(w / x["z"], 12)).alias("o"), i.alias("i"), w.alias("w"))))
        return let(best, lambda b: F.struct(
            (F.log(x["z"]) + x["top"]).alias("log_z"),
            effective_size(F.transform(x["w"], lambda w: w / x["z"])).alias("effective_size"),
            F.get(names, b["i"]).alias("top_class"),
            (b["w"] / x["z"]).alias("top_probability"),
        ))

    rows = rows.withColumn("t", _weighed(F.col("prior"), F.col("s.log_lik"), told))
    before = F.lag("t.log_z").over(Window.partitionBy("path", "observer", "target").orderBy("at"))
    return rows.select(
        "path", "observer", "target", (F.col("at") + 1).alias("step"), F.col("s.state_key").alias("state_key"), F.col("s.bucket").alias("action_bucket"),
        "t.effective_size", "t.top_class", "t.top_probability", F.exp(F.col("t.log_z") - F.coalesce(before, F.lit(0.0))).alias("evidence"),
    )


def _real(holes: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, class_names()))
    return holes.select("path", F.col("player").alias("target"), (F.array_position(names, text_class(F.col("cards"))) - 1).cast("int").alias("__real"))


def true_class(ranges: DataFrame, holes: DataFrame) -> DataFrame:
    """Probability that each row of ``range_vectors`` gives to the target's real class; 0 if its cards are unknown."""
    joined = ranges.join(_real(holes), ["path", "target"], "left")
    return joined.select("path", "observer", "target", F.coalesce(F.get("p", F.col("__real")), F.lit(0.0)).alias("true_class_probability"))


def true_classes(made: DataFrame, observed: DataFrame, holes: DataFrame, phi: float = 0.0, keep: bool = False) -> DataFrame:
    """``true_class`` of every pair with decisions: the real class goes with the pair, and of the range one entry is taken where they meet."""
    rows = ranged(made, observed.join(_real(holes), ["path", "target"], "left"), {"p": F.col("p")}, phi, keep=keep)
    return rows.select("path", "observer", "target", F.coalesce(F.get("p", F.col("__real")), F.lit(0.0)).alias("true_class_probability"))


def temperature_fit(made: DataFrame, observed: DataFrame, phis: list[float], keep: bool = False) -> DataFrame:
    """(target, phi, log_likelihood): sum over all pairs for each phi of a grid, in one plan; the best phi of a player is its maximum.

    Equal pairs of a target are counted first: their likelihood is reckoned once and taken as often as they come.
    """
    grid = made.sparkSession.createDataFrame([(float(p),) for p in phis], "phi double")
    table = action_table(made.select("state_key").distinct().crossJoin(F.broadcast(grid)), F.col("phi"), keep=("phi",))
    rows = seen(made, observed).groupBy("target", "moves", "dead").agg(F.count("*").alias("uses"))
    rows = written(rows, "pair-counts") if keep else rows
    known = settled(rows, table, {"ll": F.col("log_likelihood")}, keep=("phi",))
    return rows.join(known, ["moves", "dead"]).groupBy("target", "phi").agg(F.sum(F.col("uses") * F.col("ll")).alias("log_likelihood"))
