"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule looks at one text and rejects it or not. The base counts of a text are
there before any rule runs, so a rule costs what it computes beyond them: almost
nothing for rules on these counts, a pass over the text or its words for the others.
On a sample every rule is run on every text that passes the base test: that gives
its mean cost in seconds and the share it rejects. The classic order for independent
filters, most rejections for each unit of cost first, is used for the whole table,
and a text stops at its first rejection. The order changes the cost, never the
verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, WINDOW_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 200

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """A text whose features are computed when first asked for, and once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that occur twice or more."""
        n = self.n_words - WINDOW_WORDS + 1
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], dtype=np.int64)
        # exact: each doubling renumbers pairs of shorter windows
        span = 1
        while span < WINDOW_WORDS:
            _, ids = np.unique(ids[:-span] * np.int64(len(ids) + len(number)) + ids[span:], return_inverse=True)
            span *= 2
            if ids.max() == len(ids) - 1 and span < WINDOW_WORDS:
                return 0  # all windows of this length differ, so the longer ones do
        often = np.bincount(ids)[ids] > 1
        covered = np.zeros(self.n_words + 1, dtype=np.int64)
        np.add.at(covered, np.flatnonzero(often), 1)
        np.add.at(covered, np.flatnonzero(often) + WINDOW_WORDS, -1)
        return int((np.cumsum(covered) > 0).sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


LOUD = (b"!!", b"!?", b"?!", b"??")
#: Tables for ``bytes.translate`` that delete all but the named bytes.
_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def commonest(text: Text) -> int:
    """How often the commonest word occurs."""
    return max(Counter(text.words).values(), default=0)


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text is to go. Rules state shares as integers, so that results are exact."""

    name: str
    rejects: Callable[[Text], bool]


#: Each rule leaves ordinary prose far from its limit. The first four read the base counts; the others compute their own.
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 50 * len(t.lines)),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 25 * t.n_words),
    Rule("loud_words", lambda t: 100 * sum(w[-2:] in LOUD for w in t.words) > 25 * t.n_words),
    Rule("capitals", lambda t: 100 * len(t.raw.translate(None, _NOT_CAPITALS)) > 50 * t.word_chars),
    Rule("digits", lambda t: 100 * len(t.raw.translate(None, _NOT_DIGITS)) > 50 * t.word_chars),
    Rule("cut_lines", lambda t: 100 * sum(x.endswith("...") for x in t.lines) > 70 * len(t.lines)),
    Rule("one_word", lambda t: 100 * commonest(t) > 50 * t.n_words),
)


@dataclass
class Cascade:
    """Rules in the order in which they run, with what the sample said of them: seconds a text, and the share rejected."""

    order: list[Rule]
    cost: dict[str, float] = field(default_factory=dict)
    rejected: dict[str, float] = field(default_factory=dict)

    def first_rejection(self, text: Text) -> str | None:
        for rule in self.order:
            if rule.rejects(text):
                return rule.name
        return None


def measured(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[int, float, int]]:
    """(texts, seconds, rejections) of each rule over those of ``texts`` that pass the base test.

    The base counts are made before the clock starts, as they are when the cascade runs.
    """
    out = [(0, 0.0, 0)] * len(rules)
    for text in texts:
        t = Text(text)
        if t.base_failed:
            continue
        for name in FEATURES:
            getattr(t, name)
        for k, rule in enumerate(rules):
            began = time.perf_counter()
            hit = rule.rejects(t)
            n, seconds, hits = out[k]
            out[k] = (n + 1, seconds + time.perf_counter() - began, hits + bool(hit))
    return out


def ordered(seen: list[tuple[int, float, int]], rules: tuple[Rule, ...] = RULES) -> Cascade:
    """``rules`` by rejections for each second. Without texts the given order stays."""
    n = max((x[0] for x in seen), default=0)
    if not n:
        return Cascade(list(rules))
    cost = {r.name: max(x[1], 1e-9) / n for r, x in zip(rules, seen, strict=True)}
    rejected = {r.name: x[2] / n for r, x in zip(rules, seen, strict=True)}
    # one text is added to each count, so that a rule unseen in the sample still goes cheap first
    rank = {r.name: (rejected[r.name] + 1 / (n + 1)) / cost[r.name] for r in rules}
    return Cascade(sorted(rules, key=lambda r: -rank[r.name]), cost, rejected)


def cascade_of(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """The cascade for ``df`` from the ``sample_rows`` rows with the smallest hashes of their contents (and ties of the last).

    Hashes alone are sorted; the rules run on the chosen rows where these are, and only sums reach the driver.
    """
    hashed = df.select(text_col, F.xxhash64(*df.columns).alias("__h"))
    most = hashed.select("__h").orderBy("__h").limit(sample_rows).agg(F.max("__h")).first()[0]
    if most is None:
        return ordered([], rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = measured(batch.column(text_col).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*seen, strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True))], ["rule", "n", "seconds", "hits"])

    sums = hashed.filter(F.col("__h") <= most).select(text_col).mapInArrow(run, "rule int, n long, seconds double, hits long")
    got = {r["rule"]: (r["n"], r["seconds"], r["hits"]) for r in sums.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("n", "seconds", "hits"))).collect()}
    return ordered([got.get(k, (0, 0.0, 0)) for k in range(len(rules))], rules)


SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in FEATURES) + ", base_failed boolean, kept boolean, rejected_by string"


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base counts, verdict and the rejecting rule of each row.

    ``kept`` is false if the base test fails, else the cascade's verdict;
    ``rejected_by`` is 'base', a rule's name or null. Null texts count as empty and
    fail the base test; null ids, repeated rows and ties are judged like others; very
    long texts are read whole; extra columns are not read; an empty table gives no rows.
    """
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cascade = cascade_of(picked, rules=rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *FEATURES, "base_failed", "kept", "rejected_by"]
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                t = Text(value.as_py())
                failed = t.base_failed
                by = "base" if failed else cascade.first_rejection(t)
                rows.append((*(getattr(t, n) for n in FEATURES), failed, by is None, by))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * len(FEATURES) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return picked.mapInArrow(run, SCHEMA)
