"""Phrase collocations from suffix automata of shards, counted globally.

Texts are cut into pieces and words. Each task takes its texts in shards of bounded
size and builds, for each language, the generalised suffix automaton of a shard's
pieces up to a bounded depth: its states are the classes of phrases that end at the
same places, a state's count is their number, and suffix links go from a state to
that of its longest phrase's longest suffix in another one. All phrases of a length
are read off the states and their counts are summed over all shards.

This runs by length. A phrase can only be frequent if the two phrases that it has
without its first and without its last word are, so before the third word is
counted the frequent phrases of two go to all tasks as a Bloom filter of bounded
size: it may let a rare phrase pass, which then is counted and dropped, and never
holds a frequent one back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import written
from rangeloom.llm.skew import lookup

MOST_WORDS, LEAST_COUNT, KEPT, SUBSUMED_PERCENT = 3, 10, 2000, 50
#: Bytes of text in a shard; bits of the filter for each frequent phrase and at most, and its hashes.
SHARD_BYTES, FILTER_BITS, MOST_FILTER_BITS, FILTER_HASHES = 4 << 20, 16, 1 << 28, 2
#: Bits of one block of the filter while it is put together.
_BLOCK = 1 << 16

#: A shard's counts: language and phrase in one key, with a line feed between, which no phrase holds.
COUNTS = "key binary, n long"

#: Cuts between pieces become full stops, the other separators spaces, and A to Z small letters.
_TABLE = bytes(0x2E if c in b".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUT = b" . "


def coded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, int]:
    """Codes of all words in a row with a cut after each piece, the words of the codes, and the cut's code (-1 without words)."""
    raw = _CUT.join(x.translate(_TABLE).replace(b".", _CUT) for x in texts)
    # what pyarrow takes for white space is a space by now, but for the unit separators, which belong to words
    words = pc.split_pattern(pa.array([raw], pa.large_binary()), b" ").flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    cut = pc.index(words.dictionary, pa.scalar(b".", pa.large_binary())).as_py()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, cut


class Automaton:
    """Generalised suffix automaton of a row of codes with cuts, up to a depth in words.

    Built by sorting: the suffix links of a suffix automaton are the tree of the
    contexts to the left of each place, so a phrase is its last word and the node of
    the context before it. ``nodes[k]`` has, for each phrase of k + 1 words, ``last``
    (the node of its last k words, or the word), ``first`` (the code of its first
    word), and ``count``; ``merged[k]`` tells which of them share a state with a
    longer phrase, because they end at the same places.
    """

    def __init__(self, codes: np.ndarray, cut: int, n_words: int, depth: int):
        self.cut, self.nodes, self.merged = cut, [], []
        at = np.flatnonzero(codes != cut)
        node = codes[at]
        count = np.bincount(node, minlength=n_words)
        self.nodes.append({"last": np.arange(n_words), "first": np.arange(n_words), "count": count})
        for k in range(1, depth):
            # places with k more words before them in their piece: those of the last round whose k-th word before is none of the cut
            before = at - k
            ok = before >= 0
            ok[ok] = codes[before[ok]] != cut
            at, parent = at[ok], node[ok]
            key = parent * n_words + codes[at - k]
            kinds, node, count = np.unique(key, return_inverse=True, return_counts=True)
            last, first = kinds // max(1, n_words), kinds % max(1, n_words)
            self.nodes.append({"last": last, "first": first, "count": count})
            # a class of end places goes on while a longer phrase has as many
            shares = np.zeros(len(self.nodes[k - 1]["count"]), bool)
            shares[last[count == self.nodes[k - 1]["count"][last]]] = True
            self.merged.append(shares)
        self.merged.append(np.zeros(len(self.nodes[-1]["count"]), bool))

    def words(self, k: int) -> list[np.ndarray]:
        """Codes of the words, first to last, of all phrases of ``k`` words."""
        out, node = [], np.arange(len(self.nodes[k - 1]["count"]))
        for level in range(k - 1, -1, -1):
            out.append(self.nodes[level]["first"][node])
            node = self.nodes[level]["last"][node]
        return out

    def states(self) -> list[tuple[tuple[int, ...], int, int, tuple[int, ...] | None]]:
        """(longest phrase, length of the shortest, count, longest phrase of the suffix link's state) of each state, for small automata."""
        phrases = [list(zip(*(w.tolist() for w in self.words(k)))) for k in range(1, len(self.nodes) + 1)]
        out = []
        for k, nodes in enumerate(self.nodes):
            for i, phrase in enumerate(phrases[k]):
                if nodes["count"][i] and not self.merged[k][i]:
                    low, node = k, int(nodes["last"][i])
                    while low > 0 and self.merged[low - 1][node]:
                        node, low = int(self.nodes[low - 1]["last"][node]), low - 1
                    out.append((phrase, low + 1, int(nodes["count"][i]), phrases[low - 1][node] if low else None))
        return out


def joined(dictionary: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    """Phrases of the words with these codes, with single spaces."""
    parts = [dictionary.take(pa.array(c)) for c in codes]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def digests(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Digests of phrases from those of their words, first to last."""
    out = np.full(len(words[0]), _digest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for w in words:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def places(digest: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits of each phrase."""
    return [(_mixed(digest + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(FILTER_HASHES)]


def filter_of(frequent: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bloom filter (bytes, bits) of ``n`` phrases (lang, phrase); its size is bounded whatever ``n`` is."""
    bits = max(_BLOCK, min(MOST_FILTER_BITS, 1 << max(1, n * FILTER_BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase").cast(pa.binary()).to_pylist()
                split = [x.split(b" ") for x in rows]
                for k in {len(x) for x in split}:
                    words = np.array([[_digest(w) for w in x] for x in split if len(x) == k], np.uint64).reshape(-1, k)
                    for at in places(digests(lang, list(words.T)), bits):
                        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        step = _BLOCK // 8
        touched = [k for k in range(bits // _BLOCK) if own[k * step : (k + 1) * step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array([own[k * step : (k + 1) * step].tobytes() for k in touched], pa.binary())], ["block", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                own[k] = own[k] | x if k in own else x
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["block", "bits"])

    kind, step = "block int, bits binary", _BLOCK // 8
    whole = np.zeros(bits // 8, np.uint8)
    for r in frequent.select("lang", "phrase").mapInArrow(run, kind).repartition("block").mapInArrow(merged, kind).toLocalIterator():
        whole[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return whole, bits


def _counted(texts: DataFrame, lengths: list[int], sieve=None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(COUNTS) of each shard's phrases of ``lengths`` words; ``sieve`` (broadcast filter and its bits) holds back those with a part that is not frequent."""

    def counts(lang: str, shard: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, dictionary, cut = coded(shard)
        if not len(codes):
            return
        made = Automaton(codes, -1 if cut < 0 else cut, len(dictionary), max(lengths))
        word, prefix = None, pa.scalar(lang.encode("utf-8", "surrogatepass"), pa.large_binary())
        for k in lengths:
            count, words = made.nodes[k - 1]["count"], None
            keep = count > 0
            if k == 1 and cut >= 0:
                keep[cut] = False
            if sieve is not None and k > 1:
                held, bits = sieve.value
                if word is None:
                    word = np.array([_digest(w) for w in dictionary.to_pylist()], np.uint64)
                inner = made.words(k - 1)
                hashed = digests(lang, [word[c] for c in inner])
                passes = np.ones(len(hashed), bool)
                for at in places(hashed, bits):
                    passes &= (held[at >> 3] >> (at & 7)) & 1 == 1
                # the part without the first word is where the suffix link's path leads; that without the last is looked up by its words
                keep = keep & passes[made.nodes[k - 1]["last"]]
                words = [c[keep] for c in made.words(k)]
                front = digests(lang, [word[c] for c in words[:-1]])
                also = np.ones(len(front), bool)
                for at in places(front, bits):
                    also &= (held[at >> 3] >> (at & 7)) & 1 == 1
                words, count = [c[also] for c in words], count[keep][also]
            else:
                words, count = [c[keep] for c in made.words(k)], count[keep]
            for start in range(0, len(count), 50_000):
                part = slice(start, start + 50_000)
                key = pc.binary_join_element_wise(prefix, joined(dictionary, [c[part] for c in words]), pa.scalar(b"\n", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(count[part].astype(np.int64))], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= shard_bytes:
                    yield from counts(lang, waiting.pop(lang))
                    del size[lang]
                elif sum(size.values()) >= 2 * shard_bytes:
                    # many languages at a time: the largest makes room
                    most = max(size, key=size.get)
                    yield from counts(most, waiting.pop(most))
                    del size[most]
        for lang, shard in waiting.items():
            yield from counts(lang, shard)

    return texts.mapInArrow(run, COUNTS)


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases that occur ``least`` times or more, (lang, n) occurrences of all words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.col("key").cast("string")

    def total(rows: DataFrame, kept: Column) -> DataFrame:
        """Counts of all shards together; what is not ``kept`` (by ``words`` and ``f``) goes before keys are taken apart."""
        # shards are summed already, so keys are dealt first: the tasks that build automata hold no table of keys besides
        summed = rows.repartition("key").groupBy("key").agg(F.sum("n").alias("f")).withColumn("words", F.regexp_count(F.substring_index(key, "\n", -1), F.lit(" ")) + 1).filter(kept)
        phrase = F.substring_index(key, "\n", -1)
        return summed.select(F.left(key, F.length(key) - F.length(phrase) - 1).alias("lang"), "words", phrase.alias("phrase"), "f")

    opening = [k for k in (1, 2) if k <= most_words]
    every = _counted(texts, opening, shard_bytes=shard_bytes)
    # words are few enough to be summed for n as well; of longer phrases only the frequent ones are kept
    first = written(total(every, (F.col("f") >= least) | (F.col("words") == 1)), "phrases")
    n = first.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = [first.filter(F.col("f") >= least)]
    for k in range(3, most_words + 1):
        shorter = parts[-1].filter(F.col("words") == k - 1)
        held, bits = filter_of(shorter, shorter.count())
        sieve = spark.sparkContext.broadcast((held, bits))
        parts.append(written(total(_counted(texts, [k], sieve, shard_bytes), F.col("f") >= least), "phrases"))
        sieve.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, n


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly; the numbers may have 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    kept: int = KEPT,
    subsumed_percent: int = SUBSUMED_PERCENT,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``kept`` best phrases of each language.

    A candidate has 2 to ``most_words`` words and occurs ``least`` times or more. Its
    score is that of its weakest cut; it goes if a longer phrase that holds it has
    ``subsumed_percent`` of its occurrences (then one with one word more has, too).
    Null texts have no words; a null language is ``und``. Repeated rows count each
    time; very long texts are taken whole. Ties go to the more frequent, then by the
    phrase's bytes. Extra columns are not read; an empty table gives no rows.
    """
    known, n = counted(docs, text_col, lang_col, most_words=most_words, least=least, shard_bytes=shard_bytes)
    many = known.filter("words > 1")
    split = F.split("phrase", " ", -1)
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(split, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(split, k + 1, F.col("words")), " ").alias("right"))
    cuts = many.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)).alias("c"))
    name = lambda phrase: F.concat(F.col("lang"), F.lit("\n"), phrase)
    asked = cuts.select("lang", "phrase", "a", F.col("c.k").alias("k"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), name(F.col(f"c.{s}")).alias("key")) for s in ("left", "right")])).alias("p"))
    asked = written(asked.select("lang", "phrase", "a", "k", "p.side", "p.key"), "phrase-parts")
    uses = asked.groupBy("key").agg(F.count("*").alias("uses"))
    held = written(known.select(name(F.col("phrase")).alias("key"), "f").join(uses, "key"), "phrase-counts")
    met = lookup(asked, held, "key", "uses", asked.count, ["phrase", "k"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "left", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "right", F.col("f"))).alias("r"))
    weakest = both.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # from each longer phrase to the two that lack its first or last word: its suffix link's path and its front
    inner = F.array_distinct(F.array(F.array_join(F.slice(split, F.lit(2), F.col("words")), " "), F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " ")))
    longer = many.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = weakest.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("most") >= subsumed_percent * F.col("a"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase")
    top = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= kept)
    # n has one row for each language
    return top.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
