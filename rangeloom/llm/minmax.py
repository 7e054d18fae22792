"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Under each hash function both the
minimum and the maximum over the set are kept, so half the hash evaluations of a
plain MinHash give a signature of the same length. Bands of the signature put
documents into buckets; what shares a bucket is compared on full sets, and links
make connected components.

* Documents with equal sets are one class from the start, so copies cost nothing.
* A bucket is compared in blocks of bounded size; buckets with the same members are
  compared once. A block emits a spanning forest of its links, never all pairs.
* A bucket of more than one block is compared in two rounds. In the first, each block
  is compared within itself and with the bucket's first member. What is then one
  component needs no more comparisons. In the second, only buckets that still hold
  several components are compared across blocks: their largest component's blocks
  with those of the rest, and the rest with itself. So a family of near copies
  costs one pass over its members, and no pair is left out that could still join.
* With 22 bands of five values, a pair at similarity 0.85 shares no bucket with a
  chance of about 2.5e-6 (four values and 0.8: 9e-6); what shares one is decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rangeloom.llm.common import written
from rangeloom.llm.skew import lookup, matched

SHINGLE_WORDS, LEAST_PERCENT = 3, 85
BANDS = 22
#: Members, and shingles of all members, that a block of a bucket holds on average, and shingles that are multiplied at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES, BLOCK_COLUMNS = 384, 2_000_000, 4096
#: Words whose hashes a worker remembers, and the longest of them in bytes: together they bound its memory.
CACHED_WORDS, CACHED_BYTES = 400_000, 48


def band_values(percent: int) -> int:
    """Signature values in a band: five down to a similarity of 0.85, four below."""
    return 5 if percent >= 85 else 4


_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, BANDS * 5 // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, np.iinfo(np.uint64).max, BANDS * 5 // 2, dtype=np.uint64)
_MULT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT[0]
    h = (h ^ (h >> np.uint64(29))) * _MULT[1]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """64-bit hashes of the distinct shingles of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def sets(self, text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(known)}
        if new:
            h = np.array([known[w] if w in known else new[w] for w in words], dtype=np.uint64)
            known.update((w, x) for w, x in new.items() if len(w) <= CACHED_BYTES)
        else:
            h = np.array([known[w] for w in words], dtype=np.uint64)
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = _mixed(out) + h[k : len(h) - size + 1 + k] * _MULT[2]
        return np.unique(_mixed(out))


def signature(h: np.ndarray, hashes: int) -> np.ndarray:
    """Minimum and maximum of a set under each hash function, in turn."""
    low = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(hashes, dtype=np.uint64)
    for k in range(0, len(h), 2048):
        v = _A[:hashes, None] * h[None, k : k + 2048] + _B[:hashes, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands_of(h: np.ndarray, values: int = 5) -> list[int]:
    raw, step = signature(h, BANDS * values // 2).tobytes(), 8 * values
    return [xxhash.xxh3_64_intdigest(raw[k * step : (k + 1) * step], seed=k) - (1 << 63) for k in range(BANDS)]


def _key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _signatures(docs: DataFrame, words: int, values: int) -> DataFrame:
    """All columns of ``docs`` but the text, with n_shingles, set_key and bands."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*kept, *StructType.fromDDL("n_shingles long, set_key binary, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            n, key, bands = [], [], []
            for value in batch.column("text"):
                h = shingler.sets(value.as_py(), words)
                n.append(len(h))
                key.append(_key(h) if len(h) else None)
                bands.append(bands_of(h, values) if len(h) else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema.names)

    return docs.mapInArrow(run, schema)


class Forest:
    """Union-find; the smaller key is the root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(r, x) for x in list(self.up) if (r := self.root(x)) != x]


def linked(ids: list, sets: list[np.ndarray], percent: int = LEAST_PERCENT) -> list[tuple]:
    """Spanning forest of the links among sets: 100 * |intersection| >= percent * |union|."""
    forest, size = Forest(), np.array([len(s) for s in sets], dtype=np.int64)
    if len(ids) <= 6:
        for i in range(len(ids)):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]) and ids[i] != ids[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        forest.join(ids[i], ids[j])
        return forest.edges()
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), size)
    _, column, n = np.unique(value, return_inverse=True, return_counts=True)
    often = n[column] > 1
    column, owner = column[often], owner[often]
    place = np.cumsum(n > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, [k, k + BLOCK_COLUMNS])
        held = np.zeros((len(ids), BLOCK_COLUMNS), dtype=np.float32)
        held[owner[a:b], column[a:b] - k] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    for i, j in zip(*np.nonzero(np.tril(100 * both >= percent * (size[:, None] + size[None, :] - both), -1))):
        forest.join(ids[i], ids[j])
    return forest.edges()


def node_of(rep: Column, set_key: Column) -> Column:
    """A class's key: its smallest document (as eight bytes that sort like the numbers), then its set; so the smallest key of a component tells its smallest document."""
    return F.concat(F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")), set_key)


def _long(data: Column) -> Column:
    """Eight bytes as a number."""
    return F.conv(F.hex(data), 16, -10).cast("long")


def document_of(node: Column) -> Column:
    return _long(F.substring(node, 1, 8)).bitwiseXOR(F.lit(-(2**63)).cast("long"))


def short_of(set_key: Column) -> Column:
    """The front of a set's key as a number; with the smallest document it tells a class in narrow tables."""
    return _long(F.substring(set_key, 1, 8))


def _cells(use: dict, key: bytes) -> list[tuple[int, int, int]]:
    """The comparisons (bucket, i, j) that a member of a bucket takes part in; ``i`` and ``j`` number blocks.

    ``main`` and ``rest`` are the numbers of blocks of either side. In the first round
    there is no rest: each block meets itself, and the bucket's first member all blocks.
    In the second the rest's blocks (numbered after the main ones) meet all blocks.
    """
    bucket, main, rest = use["bucket"], use["main"], use["rest"]
    home = xxhash.xxh3_64_intdigest(key)
    if not rest:
        return [(bucket, i, i) for i in range(main)] if use["everywhere"] else [(bucket, home % main, home % main)]
    if use["everywhere"]:
        own = main + home % rest
        return [(bucket, i, own) for i in range(main)] + [(bucket, min(own, j), max(own, j)) for j in range(main, main + rest)]
    return [(bucket, home % main, j) for j in range(main, main + rest)]


_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _blocks(found: DataFrame, words: int) -> DataFrame:
    """One row (bucket, i, j, node, shingles) for each comparison that a class takes part in.

    ``found`` has (text, rep, short, uses) of classes; a class's set is made from the text of its smallest document.
    """
    names = ["bucket", "i", "j", "node", "shingles"]
    most = 32 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                h = shingler.sets(r["text"], words)
                key = _key(h)
                if int.from_bytes(key[:8], "big", signed=True) != r["short"]:
                    continue  # another text under the same id
                data, node = h.tobytes(), (r["rep"] + (1 << 63)).to_bytes(8, "big") + key
                for use in r["uses"]:
                    for cell in _cells(use, node):
                        rows.append((*cell, node, data))
                        held += len(data) + 64
                        if held > most:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK_TYPES, strict=True)], names)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCK_TYPES, strict=True)], names)

    return found.select("text", "rep", "short", "uses").mapInArrow(run, "bucket long, i int, j int, node binary, shingles binary")


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links of each comparison; its rows come together, sorted, and only one comparison is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}

        def done():
            edges = linked(list(members), [np.frombuffer(x, "<u8") for x in members.values()], percent) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.binary()), pa.array([b for _, b in edges], pa.binary())], ["a", "b"])

        for batch in batches:
            for bucket, i, j, node, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "shingles")), strict=True):
                if (bucket, i, j) != key:
                    if len(members) > 1:
                        yield done()
                    key, members = (bucket, i, j), {}
                members[node] = data
        if len(members) > 1:
            yield done()

    sorted_ = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sorted_.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), by large-star and small-star steps.

    A family meets at its smallest node, so that the joins spread such nodes' rows.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), tag)
    state = lambda e: e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    now = state(edges)
    while now.n:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("least", "u").alias("m"), "n")
        large = lookup(both, low, "u", "n", lambda now=now: 2 * now.n, ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = written(large.distinct(), tag)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, "u", "n", lambda now=now: now.n, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), tag)
        before, now = now, state(edges)
        if now == before:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _blocks_of(members: Column, shingles: Column, block_members: int) -> Column:
    return F.greatest(F.ceil(members / block_members), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _second_round(members: DataFrame, found: DataFrame, block_members: int) -> DataFrame | None:
    """``needed`` of the second round, or None if no bucket holds more than one component.

    ``members`` has (rep, short, n_shingles, bucket) of buckets of several blocks.
    """
    parts = found.select(document_of(F.col("node")).alias("__rep"), short_of(F.substring("node", 9, 8)).alias("__short"), "node", "component")
    placed = members.join(parts, (F.col("rep") == F.col("__rep")) & (F.col("short") == F.col("__short")), "left")
    # a class without links is a component of its own
    alone = F.concat(F.lit("\x00").cast("binary"), F.unhex(F.lpad(F.hex("rep"), 16, "0")), F.unhex(F.lpad(F.hex("short"), 16, "0")))
    placed = written(placed.select("rep", "short", "n_shingles", "bucket", F.coalesce("component", alone).alias("part")), "minmax-parts")
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part", "s")).alias("m"), F.sum("n").alias("members"), F.sum("s").alias("shingles")).filter("members > m.n")
    open_ = most.select(
        "bucket", "members", F.col("m.part").alias("main_part"), _blocks_of(F.col("m.n"), F.col("m.s"), block_members).alias("main"),
        _blocks_of(F.col("members") - F.col("m.n"), F.col("shingles") - F.col("m.s"), block_members).alias("rest"),
    )
    open_ = written(open_, "minmax-open")
    if not open_.limit(1).count():
        return None
    joined = matched(placed, open_, "bucket", "members", placed.count)
    use = F.struct("bucket", "main", "rest", (F.col("part") != F.col("main_part")).alias("everywhere"))
    return joined.groupBy("rep", "short").agg(F.collect_list(use).alias("uses"))


def decisions(docs: DataFrame, percent: int = LEAST_PERCENT, words: int = SHINGLE_WORDS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text, ...); all columns but the text stay."""
    picked, others = docs.select("doc_id", "text"), [c for c in docs.columns if c not in ("doc_id", "text")]
    sig = written(_signatures(docs, words, band_values(percent)), "minmax-signatures")
    classes = (
        sig.filter("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("uses"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .filter("rep is not null")
    )
    classes = written(classes.withColumn("short", short_of(F.col("set_key"))), "minmax-classes")
    # numbers only: millions of members, most of them alone in their buckets
    members = classes.select("rep", "short", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"), F.bit_xor("short").alias("x"), F.min("rep").alias("first"))
    shared = shared.filter("m > 1").groupBy("m", "s", "x", "first").agg(F.min("bucket").alias("bucket"))
    shared = written(shared.select("bucket", "m", "first", _blocks_of(F.col("m"), F.col("s"), block_members).alias("main")), "minmax-buckets")
    joined = written(matched(members, shared, "bucket", "m", members.count), "minmax-members")
    use = F.struct("bucket", "main", F.lit(0).alias("rest"), (F.col("rep") == F.col("first")).alias("everywhere"))
    needed = joined.groupBy("rep", "short").agg(F.collect_list(use).alias("uses"), F.max(F.col("main") > 1).alias("large"))
    # what is needed grows with the data: merged at every size, never broadcast for being little; both rounds read the texts found here
    texts = picked.join(needed.hint("merge"), picked["doc_id"] == needed["rep"]).select("text", "rep", "short", "uses", "large")
    texts = written(texts, "minmax-texts")
    links = written(_links(_blocks(texts, words), percent), "minmax-links")
    found = components(links)
    large = joined.filter("main > 1").select("rep", "short", "n_shingles", "bucket")
    if large.limit(1).count():
        again = _second_round(large, found, block_members)
        if again is not None:
            met = texts.filter("large").select("text", "rep", "short").join(again.hint("merge"), ["rep", "short"])
            found = components(links.unionByName(_links(_blocks(met, words), percent)))
    classes = classes.withColumn("node", node_of(F.col("rep"), F.col("set_key")))
    placed = classes.join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    table = written(placed.select("set_key", "uses", document_of(F.coalesce("component", "node")).alias("component_id")), "minmax-components")
    out = lookup(sig.drop("bands"), table, "set_key", "uses", sig.count, ["doc_id", *others])
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *others, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, words: int = SHINGLE_WORDS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Texts without words (and null texts) have no shingles and no links, and are
    kept. Very long texts count whole. Repeated rows each have their row; rows that
    share an id but not a text are documents of their own, which only their texts
    link. A null doc_id has a null component unless its set is that of a document
    with an id, and is kept where it is null. Extra columns are not read; an empty
    table gives no rows.
    """
    return decisions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, words, block_members)


def one_of_each(docs: DataFrame, percent: int = LEAST_PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` (all columns) of which one stays for each group: the smallest id's.

    Decided for each row by its id and text: a row goes if its text is linked to one
    with a smaller id, so a text that shares its id with others stays or goes on its
    own. Of rows equal in id and text (null counts as empty) the smallest in the
    other columns stays. Rows without an id cannot be told from one another and all stay.
    """
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), key))
    made = decisions(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__row"), percent, words).filter("__row is not null")
    stay = written(made.groupBy("__row").agg(F.count("*").alias("__uses"), F.max("kept").alias("__kept")).withColumn("__n", F.col("__uses")), "minmax-kept")
    met = lookup(keyed, stay, "__row", "__uses", keyed.count, ["doc_id", "text"]).filter("__row is null or __kept")
    met = written(met, "minmax-single")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = met.filter("__n > 1").groupBy("__row").agg(F.min(F.struct("doc_id", "text", *others)).alias("r")).select("r.*")
    return met.filter("coalesce(__n, 1) = 1").select(*docs.columns).unionByName(again.select(*docs.columns))
