"""Quotation linking in column expressions: reply-ordered conversations without quotes.

Lines are parsed into quote levels; neighbouring lines of one level are a passage.
Passages, their paragraphs and their longer lines are hashed after normalising
case and white space, and looked up among the own (unquoted) text of all messages:
first in the same conversation, before the quoting message, then in any other. What a
message answers is the latest original of its outermost quotes, or without any the
turn before it (the largest smaller one that exists). Conversation ids are no order in time, so links could close a cycle;
the smallest message of a cycle then answers what comes before it in (conv_id, turn).
So replies form trees; depth and root come from pointer jumping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import with_previous, written
from rangeloom.llm.skew import lookup, matched
from rangeloom.llm.spans import let

#: A quote prefix, a line that introduces a quote (fixed values: its verbs), and words that a line needs to be looked up alone.
PREFIX = r"^(?:[\x20\t]{0,3}+>)++"
ATTRIBUTION = r"\S\s++(?:wrote|writes|schrieb|escribió|a écrit)\s*+:\s*+$"
LINE_WORDS = 4
QUOTED = r"(?m)^[\x20\t]{0,3}>"


def level_of(line: Column) -> Column:
    """Number of quote marks before a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def content_of(line: Column) -> Column:
    return F.regexp_replace(line, PREFIX + r"\x20?", "")


def normal(text: Column) -> Column:
    """Lower-cased, with single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " "))


def parsed(text: Column) -> Column:
    """struct(body, n_quoted_lines, passages: array of struct(level, lines)) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        # a line that introduces a quote stands right before it; elsewhere it is the author's own
        quote_next = lambda i: F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(quote_next(i) & F.regexp_like(x["content"], F.lit(ATTRIBUTION))))

        def cut(starts: Column) -> Column:
            def passage(s: Column, k: Column) -> Column:
                part = F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)
                return F.struct(F.get(lines, s)["level"].alias("level"), F.transform(part, lambda x: x["content"]).alias("lines"))

            return F.filter(F.transform(starts, passage), lambda p: p["level"] > 0)

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, F.greatest(i - 1, F.lit(0)))["level"]))
        return F.struct(
            F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")).alias("body"),
            F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long").alias("n_quoted_lines"),
            let(starts, cut).alias("passages"),
        )

    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.struct(level_of(x).alias("level"), content_of(x).alias("content")))
    kind = "struct<body:string,n_quoted_lines:bigint,passages:array<struct<level:int,lines:array<string>>>>"
    plain = F.struct(F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"), F.lit(0).cast("long").alias("n_quoted_lines"), F.array().alias("passages"))
    return F.when(F.regexp_like(text, F.lit(QUOTED)), let(lines, of_lines).cast(kind)).otherwise(plain.cast(kind))


def units(lines: Column) -> Column:
    """Hashes of an array of lines as a whole, by paragraph and by longer line."""
    whole = normal(F.array_join(lines, " "))
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), r"\n\s*\n", -1), normal)
    longer = F.filter(F.transform(lines, normal), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS)
    every = F.array_distinct(F.concat(F.array(whole), paragraphs, longer))
    return F.transform(F.filter(every, lambda x: x != ""), lambda x: F.sha2(x, 256))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quoted_lines, n_passages, n_linked, reply_conv, reply_turn, root_conv, root_turn, depth, reply_order).

    Every row is a message, repeated ones too. Where rows share (conv_id, turn),
    each has its own body, quotes and reply, and the texts of all are originals; a
    link to that place is one to the row with the smallest role and digest of its
    text, on which its depth and root rest. Rows without conv_id or turn are messages
    of their own, as they are: they neither quote nor are quoted and answer nothing.
    Very long texts are parsed whole. Sorting a thread (equal root)
    by ``reply_order`` puts every message after the one that it answers. An empty
    table gives no rows; extra columns are not read.
    """
    picked = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = picked.filter(placed).withColumn("p", parsed(F.col("text"))).withColumn("digest", F.xxhash64("text"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "digest", "p.*"), "quote-messages")
    # the row that stands for its place, where rows share one
    first = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "digest", "row"))["row"].alias("row"))

    quoted = rows.select("row", "conv_id", "turn", F.posexplode("passages").alias("passage", "q")).select("row", "conv_id", "turn", "passage", F.col("q.level").alias("level"), F.explode(units(F.col("q.lines"))).alias("h"))
    quoted = written(quoted, "quote-units")
    asked = quoted.groupBy("h").agg(F.count("*").alias("uses"))
    own = rows.filter("body <> ''").select("conv_id", "turn", F.explode(units(F.split("body", "\n", -1))).alias("h"))
    own = own.join(asked.select("h"), "h", "left_semi")
    # earliest message with this text in each conversation, and in the first two conversations
    by_conv = own.groupBy("h", "conv_id").agg(F.min("turn").alias("here"))
    place = F.struct("conv_id", F.col("here").alias("turn"))
    ranked = by_conv.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("conv_id"))).filter("r <= 2")
    anywhere = ranked.groupBy("h").agg(F.min(place).alias("first"), F.min(F.when(F.col("r") == 2, place)).alias("second"))
    in_key = F.concat_ws("/", "h", F.col("conv_id").cast("string"))
    uses = quoted.groupBy(in_key.alias("k")).agg(F.count("*").alias("n"))
    by_conv = written(by_conv.select(in_key.alias("k"), "here").join(uses, "k"), "quote-here")
    anywhere = written(anywhere.join(asked, "h"), "quote-first")
    found = lookup(quoted.withColumn("k", in_key), by_conv, "k", "n", quoted.count, ["row", "passage"])
    found = lookup(found, anywhere, "h", "uses", quoted.count, ["row", "passage"])
    same = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn")))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    found = found.withColumn("source", F.coalesce(same, other)).filter("source is not null")
    # a reply goes to its own conversation before others, then to the outermost quote, then to the latest original
    rank = F.struct((F.col("source.conv_id") == F.col("conv_id")).alias("mine"), (-F.col("level")).alias("outer"), F.col("source.conv_id").alias("c"), F.col("source.turn").alias("t"))
    # the same among originals that come earlier in (conv_id, turn): these close no cycle
    earlier = F.max(F.when(F.col("source.conv_id") <= F.col("conv_id"), rank))
    linked = found.groupBy("row").agg(F.max(rank).alias("b"), earlier.alias("e"), F.countDistinct("passage").alias("n_linked"))
    linked = linked.select("row", F.col("b.c").alias("link_conv"), F.col("b.t").alias("link_turn"), F.col("e.c").alias("earlier_conv"), F.col("e.t").alias("earlier_turn"), "n_linked")
    before = with_previous(first, ["conv_id", "turn"], "quote-order")
    before = before.select("conv_id", "turn", F.col("row").alias("stands"), F.when(F.col("previous.conv_id") == F.col("conv_id"), F.col("previous.turn")).alias("previous"))
    at = _place("conv_id", "turn")
    shared = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"))
    before = written(before.withColumn("at", at).drop("conv_id", "turn").join(shared, "at"), "quote-places")
    full = lookup(rows.withColumn("at", at), before, "at", "n", rows.count, ["row"]).drop("at").join(linked, "row", "left")
    full = full.select(
        "row", (F.col("stands") == F.col("row")).alias("stands"), "conv_id", "turn", "role", "body", "n_quoted_lines", F.size("passages").cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        *[c for k in ("link", "earlier") for c in (
            F.coalesce(f"{k}_conv", F.when(F.col("previous").isNotNull(), F.col("conv_id"))).alias(f"{k}_conv"), F.coalesce(f"{k}_turn", "previous").alias(f"{k}_turn"))],
    )
    full = written(full, "quote-replies")
    tree = acyclic(full.filter("stands").select("conv_id", "turn", *[f"{k}_{c}" for k in ("link", "earlier") for c in ("conv", "turn")]))
    tree = written(roots(tree).join(tree, ["conv_id", "turn"]), "quote-tree")
    own_row = full.filter("stands").drop("link_conv", "link_turn", "earlier_conv", "earlier_turn").join(tree, ["conv_id", "turn"])
    # nothing points to the other rows of a place, so their own links close no cycle
    others = written(full.filter("not stands").withColumn("to", _place("link_conv", "link_turn")), "quote-others")
    uses = others.groupBy("to").agg(F.count("*").alias("n"))
    above = tree.select(_place("conv_id", "turn").alias("to"), F.col("root_conv").alias("rc"), F.col("root_turn").alias("rt"), F.col("depth").alias("d")).join(uses, "to")
    beside = lookup(others, written(above, "quote-above"), "to", "n", others.count, ["row"])
    beside = beside.withColumns({
        "reply_conv": F.col("link_conv"), "reply_turn": F.col("link_turn"),
        "root_conv": F.coalesce("rc", "conv_id"), "root_turn": F.when(F.col("rc").isNull(), F.col("turn")).otherwise(F.col("rt")), "depth": F.coalesce(F.col("d") + 1, F.lit(0)),
    })
    columns = ["conv_id", "turn", "role", "body", "n_quoted_lines", "n_passages", "n_linked", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth"]
    lone = picked.filter(~placed).select(
        "conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("body"), *[F.lit(0).cast("long").alias(c) for c in ("n_quoted_lines", "n_passages", "n_linked")],
        F.lit(None).cast("long").alias("reply_conv"), F.lit(None).cast("long").alias("reply_turn"), F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"),
    )
    order = F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 19, "0") for c in ("depth", "conv_id", "turn")])
    return own_row.select(*columns).unionByName(beside.select(*columns)).unionByName(lone).withColumn("reply_order", order)


def _place(conv: str, turn: str) -> Column:
    """A message's place as one key; null where there is none."""
    return F.concat(F.col(conv).cast("string"), F.lit("/"), F.col(turn).cast("string"))


def acyclic(full: DataFrame) -> DataFrame:
    """The rows with their link as (reply_conv, reply_turn), or with the earlier one where the link would close a cycle.

    The smallest message of a cycle links to a larger conversation, so each round turns such links into earlier
    ones, and links to earlier messages alone have no cycle.
    """
    ends = ("conv", "turn")
    full = full.withColumnsRenamed({f"link_{c}": f"reply_{c}" for c in ends})
    while full.filter("reply_conv > conv_id").limit(1).count():
        heads = cycle_heads(full.select("conv_id", "turn", "reply_conv", "reply_turn"))
        if not heads.limit(1).count():
            break
        met = full.join(heads.withColumn("head", F.lit(True)), ["conv_id", "turn"], "left")
        full = written(met.withColumns({f"reply_{c}": F.when(F.col("head"), F.col(f"earlier_{c}")).otherwise(F.col(f"reply_{c}")) for c in ends}).drop("head"), "quote-replies")
    return full.drop("earlier_conv", "earlier_turn")


def cycle_heads(tree: DataFrame) -> DataFrame:
    """(conv_id, turn) of the smallest message of each cycle in (conv_id, turn, reply_conv, reply_turn).

    Each round doubles the reach of every row, keeps the smallest message that it passed, and drops the rows that
    reach a root. A cycle has no more messages than rows are left, and its smallest one is what that message meets again.
    """
    to = F.struct(F.col("reply_conv").alias("c"), F.col("reply_turn").alias("t"))
    rows = written(tree.filter("reply_conv is not null").select("conv_id", "turn", to.alias("to"), to.alias("low")), "quote-cycles")
    reach, count = 1, rows.count()
    while reach < count:
        left = rows.withColumn("at", _place("to.c", "to.t"))
        uses = left.groupBy("at").agg(F.count("*").alias("n"))
        ahead = rows.select(_place("conv_id", "turn").alias("at"), F.col("to").alias("next"), F.col("low").alias("next_low")).join(uses, "at")
        # a message that many point to is a hot key
        met = matched(left, written(ahead, "quote-ahead"), "at", "n", lambda: count)
        rows = written(met.select("conv_id", "turn", F.col("next").alias("to"), F.least("low", "next_low").alias("low")), "quote-cycles")
        reach, count = reach * 2, rows.count()
    return rows.filter((F.col("low.c") == F.col("conv_id")) & (F.col("low.t") == F.col("turn"))).select("conv_id", "turn")


def roots(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of (conv_id, turn, reply_conv, reply_turn): each round doubles the reach of every row that is not at its root yet.

    Rows that are at their root are written once; a round reads of them, and of the others, only those that some row
    points to, with the number of these, so that a message that everyone points to is spread.
    """
    is_root = F.col("reply_conv").isNull()
    rows = tree.select("conv_id", "turn", F.coalesce("reply_conv", "conv_id").alias("root_conv"), F.when(is_root, F.col("turn")).otherwise(F.col("reply_turn")).alias("root_turn"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"), is_root.alias("done"))
    rows = written(rows, "quote-roots")
    done, todo = [rows.filter("done")], rows.filter("not done")
    while count := todo.count():
        left = todo.withColumn("at", _place("root_conv", "root_turn"))
        uses = left.groupBy("at").agg(F.count("*").alias("n"))
        known = reduce(DataFrame.unionByName, [*done, todo])
        ahead = known.select(_place("conv_id", "turn").alias("at"), F.col("root_conv").alias("rc"), F.col("root_turn").alias("rt"), F.col("depth").alias("d"), F.col("done").alias("e")).join(uses, "at")
        met = matched(left, written(ahead, "quote-ahead"), "at", "n", lambda count=count: count)
        moved = met.select("conv_id", "turn", F.col("rc").alias("root_conv"), F.col("rt").alias("root_turn"), (F.col("depth") + F.col("d")).alias("depth"), F.col("e").alias("done"))
        moved = written(moved, "quote-roots")
        done.append(moved.filter("done"))
        todo = moved.filter("not done")
    return reduce(DataFrame.unionByName, done).drop("done")
