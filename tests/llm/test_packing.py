import json
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from rangeloom.llm.packing import MAX_LOSS_TOKENS, MAX_SEGMENTS, MAX_TOKENS, Packer, Piece, WordTokenizer, pack


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, tokens=MAX_TOKENS):
    """Every id in exactly one piece, checksums right, sequences gapless; returns the padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = {}
    for d in docs:
        want.setdefault(d.doc_id, []).append(whole_ids(d.text))
    assert set(want) == set(by_doc)
    for doc, copies in want.items():
        ids = copies[0]
        assert all(c == ids for c in copies)
        at = defaultdict(int)
        for r in by_doc[doc]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
            for k in range(r.start, r.start + r.length):
                at[k] += 1
        assert at == {k: len(copies) for k in range(len(ids))}
    padding = 0
    for pieces in by_seq.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= tokens
        padding += 0 if end & (end - 1) == 0 else tokens - end
    return padding


def test_round_trip(documents):
    assert check(pack(documents).collect(), documents.collect()) == 0


SPECIAL = ["doc one <|endoftext|> doc two", "a<|startoftext|>b", "<|ENDOFTEXT|>", "<|endoftext|>. \n", "Straße <|endoftext|>"]
ODD = ["\x00. ", "\x1c, x", "a\x7f. b", "word. Word, \x85next\xa0one", "H\u0331. T\u0308", "x ^ y^z ^^", "it's. we'll, 3. 4", "\u212a. \u1fef,\n", "\u00d7. \u00e9. \u4e2d. ", "l" * 300 + ". "]


def test_ids_are_the_plain_calls():
    rng = np.random.default_rng(5)
    letters = [*"abHTIK.,'^<|>!0 \n\t\x00\x1f\x7f", "\u0331", "\u0308", "\u0301", "\u0307", "\u00e9", "\u00df", "\u03a3", "\u0130", "\u00d7", "\xa0", "\x85", "\u212a", "\u4e2d", "<|endoftext|>", ". ", ", "]
    texts = SPECIAL + ODD + ["".join(rng.choice(letters, rng.integers(0, 9))) for _ in range(20_000)]
    assert tokenizer().encode(SPECIAL[0], add_special_tokens=False).ids[2] == 49407
    for text, ids in zip(texts, WordTokenizer().ids(texts), strict=True):
        assert ids.tolist() == tokenizer().encode(text, add_special_tokens=False).ids, text


def test_special_and_control_characters(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL + ODD)), "doc_id long, text string")
    assert check(pack(df).collect(), df.collect()) == 0


def test_long_words_are_not_remembered():
    words = WordTokenizer()
    list(words.ids(["x" * 1000 + " short"]))
    assert set(words.known) == {b"short"}


class Counted:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, inner):
        self.inner, self.texts = inner, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.inner.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_plain_words_take_only_the_model():
    """Words of ASCII and Latin-1 letters, digits and signs need no whole tokenizer, and each unit is encoded once."""
    words = WordTokenizer()
    words.tokenizer = Counted(words.tokenizer)
    words.units = Counted(words.units)
    texts = ["Don't stop, élan ÉLAN^2 straße!! tion&&& x_1.5", "tion tion&&& I'll re-use élan's 1.5 <b>", "don't"]
    assert [x.tolist() for x in words.ids(texts)] == [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    encoded = [u for t in words.units.texts for u in t.split(" ")]
    assert words.tokenizer.texts == [] and len(encoded) == len(set(encoded))


@pytest.mark.parametrize("group", [1, 50, 10**6])
def test_units_of_plain_words_equal_the_whole_tokenizer(monkeypatch, group):
    monkeypatch.setattr("rangeloom.llm.packing.GROUP_WORDS", group)
    rng = np.random.default_rng(group)
    letters = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA0, 0x180)), *("'s", "'RE", "'ll", "<|", "the", "ing", "</w>"), *" " * 30]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(4_000)] + [None, "", "é" * 400 + " z"]
    texts += [a + b + c for a in ("x", "É", "'", "9") for b in map(chr, range(0x21, 0x180)) for c in ("", "s", "ü", "7")]
    words = WordTokenizer()
    assert words.units is not None
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert ids.tolist() == tokenizer().encode(text or "", add_special_tokens=False).ids, text
    assert max(map(len, words.known)) <= 48


def test_another_splitter_takes_the_whole_tokenizer(tmp_path):
    made = json.loads(tokenizer().to_str())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    (tmp_path / "other.json").write_text(json.dumps(made))
    words = WordTokenizer(str(tmp_path / "other.json"))
    whole, text = words.tokenizer, "ab12 it's 2nd!! élan"
    assert words.units is None
    assert next(words.ids([text])).tolist() == whole.encode(text, add_special_tokens=False).ids != tokenizer().encode(text, add_special_tokens=False).ids


def test_the_three_limits_bind(spark, documents):
    """On real texts bins reach the limits of loss and segments, and lifting these changes where pieces go."""
    small = spark.createDataFrame([(10_000 + k, "tiny text") for k in range(400)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(small).coalesce(1)
    both = pack(docs).collect()
    free = pack(docs, segments=10**6, loss_tokens=MAX_TOKENS, prompt_percent=0).collect()
    by = defaultdict(list)
    for r in both:
        by[r.sequence_id].append(r)
    loss, segments = [sum(r.loss_tokens for r in x) for x in by.values()], [len(x) for x in by.values()]
    assert max(loss) == MAX_LOSS_TOKENS and max(segments) <= MAX_SEGMENTS
    assert sum(x == MAX_LOSS_TOKENS for x in loss) >= 3 and sum(x >= MAX_SEGMENTS - 1 for x in segments) >= 1
    place = lambda rows: {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows}
    assert len(place(both) - place(free)) > len(both) // 4
    assert check(both, docs.collect()) == 0


def test_odd_rows(odd_docs, no_docs):
    assert check(pack(odd_docs).collect(), odd_docs.collect()) == 0
    assert pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_all_limits_hold_at_once(seed):
    rng = np.random.default_rng(seed)
    packer = Packer(0, tokens=256, segments=6, loss=160, pool_pieces=64)
    total = 0
    for d in range(700):
        n = int(rng.integers(1, 400))
        total += n
        packer.add(Piece(d, 0, np.arange(n, dtype="<u4"), n, int(rng.integers(0, n + 1))))
    packer.finish()
    by = defaultdict(list)
    for r in packer.rows:
        by[r[6]].append(r)
    assert sum(r[2] for r in packer.rows) == total
    assert all(sum(r[2] for r in x) <= 256 and len(x) <= 6 and sum(r[5] for r in x) <= 160 for x in by.values())


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "question one two", "answer")], "id long, prompt string, reply string")
    (r,) = pack(df, "id", "reply", prompt_col="prompt").groupBy("doc_id").sum("length", "loss_tokens").collect()
    assert r["sum(length)"] == len(whole_ids("question one two answer")) and r["sum(loss_tokens)"] == len(whole_ids("answer"))
