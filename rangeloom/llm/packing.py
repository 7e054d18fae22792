"""Packing token sequences by vector bin packing with the dot-product heuristic.

A bin is one training sequence. It is limited at the same time in tokens, in
segments (pieces of documents) and in loss-bearing tokens (those after an
example's prompt). Documents are cut into pieces of bounded size that go to a
pool, and an open bin takes from the pool, again and again, the piece whose demand
vector has the largest dot product with what the bin has left. When no piece fits
whole, or one segment is left, the piece of which most fits is cut. A bin that the
limits keep from being full is cut back to a power of two, which needs no padding.

Where examples have no prompt column, the first ``PROMPT_PERCENT`` of a document's
tokens stand in for the prompt, as in instruction data made from plain texts.

Each task packs its own rows as they stream by, with a pool of bounded size, so
there is no shuffle.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
EOS_ID = 2
#: Limits of a sequence, and the share of a document's tokens that is its prompt where no column holds one.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS, PROMPT_PERCENT = 4096, 32, 3328, 25
#: Pieces that a task keeps before it packs, and the longest piece.
POOL_PIECES, PIECE_TOKENS = 1024, 2048
#: Words whose ids a worker remembers, and the longest of them in bytes: together they bound its memory.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 48
#: Words of the texts that are looked up together (a longer text alone), and units in a call of the tokenizer.
GROUP_WORDS, CALL_UNITS = 2_000, 1024

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"

#: A full stop or comma before white space: a unit of its own to the splitter after an ASCII letter or digit or a Latin-1 letter.
_AFTER = rb"(?<![A-Za-z0-9][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])"
_STOP = re.compile(rb"([A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([.,])(?=[ \n])")
#: One that follows anything else and may be joined to it.
_JOINED = re.compile(rb"[.,](?=[ \n])" + _AFTER)


def _apart(raw: bytes) -> bytes:
    """``raw`` with a space before each stop or comma that is a unit of its own."""
    if _JOINED.search(raw):
        return _STOP.sub(rb"\1 \2", raw)
    for mark in (b". ", b", ", b".\n", b",\n"):
        raw = raw.replace(mark, b" " + mark)
    return raw


#: Lead bytes of characters from U+0300 on; those below are no combining marks and are what composition leaves as they are.
_HIGH = re.compile(rb"[\xcc-\xff]")
#: Stands between words that are encoded together.
_FENCE = "^"

#: Normaliser, splitter and end of a word's last token for which plain words are split here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_WORD_END = "</w>"
#: Bytes of plain words: visible ASCII and two-byte characters from U+00C0 to U+00FF. What they must not hold: a special token's opening, and the two that are no letters.
_PLAIN = bytes([*range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3])
_NOT_PLAIN = re.compile(rb"<\||\xc3[\x97\xb7]")
#: The splitter's units in a plain word, lower-cased.
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the model's vocabulary: itself where it is visible in Latin-1."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = _byte_letters()
#: Latin-1 text of bytes to these characters; spaces stay, as they part the units.
_SHOWN = {b: x for b, x in enumerate(_LETTERS) if b != 0x20}


class WordTokenizer:
    """Ids of whole texts, word by word: exactly those of the tokenizer's own call on the whole text.

    The tokenizer drops white space, and neither its special tokens nor its
    normaliser nor its splitter look across it, so the ids of a text are those of
    its words in a row. Words repeat; the ids of short ones are kept as
    little-endian bytes. ASCII letters are lower-cased first, as the normaliser does,
    but not in texts with a special token's opening or with characters that could
    compose, because both come before lower-casing. One of these lives as long as a
    Python worker.

    New words of many texts are encoded in one call. Plain ones (``_PLAIN``) need no
    normalising but lower case, and are split into units here: a tokenizer with the
    same model that only splits at spaces encodes each new unit, and a token that ends
    one ends with ``_WORD_END``. All others take the whole tokenizer, and so does every
    word where a tokenizer file has another normaliser or splitter.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        fence = self.tokenizer.encode(_FENCE, add_special_tokens=False).ids
        self.fence = fence[0] if len(fence) == 1 else None
        self.units = self._for_units()

    @staticmethod
    @cache
    def of_worker(path: str | None) -> WordTokenizer:
        return WordTokenizer(path)

    def _for_units(self):
        """A tokenizer with the same model that only splits at spaces; None where the file's is not the one that ``_UNITS`` was written for."""
        from tokenizers import Tokenizer, pre_tokenizers

        whole, model = self.tokenizer, self.tokenizer.model
        steps = [json.loads(x.__getstate__()) if x is not None else None for x in (whole.normalizer, whole.pre_tokenizer)]
        plain = [getattr(model, x, None) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if steps != [_NORMALIZER, _SPLITTER] or plain != [None, None, None, _WORD_END, False, False] or whole.truncation or whole.padding:
            return None
        vocab = whole.get_vocab(with_added_tokens=False)
        if not all(x in vocab and x + _WORD_END in vocab for x in _LETTERS):
            return None
        if any(not x.content.startswith("<|") for x in whole.get_added_tokens_decoder().values()):
            return None
        self.ends_unit = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_unit[[k for x, k in vocab.items() if x.endswith(_WORD_END)]] = True
        units = Tokenizer(model)
        units.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return units

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _fenced(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of words without a fence, by the whole tokenizer."""
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            found = self.tokenizer.encode_batch_fast([f" {_FENCE} ".join([w.decode("utf-8", "replace") for w in part])], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = [4 * int(e) for e in np.flatnonzero(ids == self.fence)] + [4 * len(ids)]
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                yield w, raw[start:end]
                start = end + 4

    def _by_units(self, units: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of units of plain words."""
        for k in range(0, len(units), CALL_UNITS):
            part = units[k : k + CALL_UNITS]
            text = b" ".join(part).decode("latin-1")
            if not text.isascii():
                text = text.translate(_SHOWN)
            ids = np.array(self.units.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for u, end in zip(part, (4 * np.flatnonzero(self.ends_unit[ids]) + 4).tolist(), strict=True):
                yield u, raw[start:end]
                start = end

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Adds the ids of words, and of their units, to those known; returns the words that are too long to be remembered."""
        known, units, of_units, fenced, alone = self.known, set(), {}, [], []
        for w in new:
            if len(w) > CACHED_BYTES:
                alone.append(w)
            elif self.units is not None and w.isalpha() and w.islower():
                units.add(w)
            elif self.units is not None and not (w.translate(None, _PLAIN) or _NOT_PLAIN.search(w)):
                of_units[w] = [u.encode() for u in _UNITS.findall(w.decode().lower())]
                units.update(of_units[w])
            else:
                (alone if self.fence is None or _FENCE.encode() in w else fenced).append(w)
        units = units.difference(known)
        ascii_only = [u for u in units if u.isascii()]
        known.update(self._by_units(ascii_only))
        known.update(self._by_units(list(units.difference(ascii_only))))
        known.update([(w, b"".join([known[u] for u in own])) for w, own in of_units.items()])
        known.update(self._fenced(fenced))
        known.update((w, self._alone(w)) for w in alone)
        return [w for w in alone if len(w) > CACHED_BYTES]

    def _looked_up(self, group: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of texts, given as words."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = set().union(*group).difference(known)
        long = self._learn(new) if new else []
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in group]
        for w in long:
            del known[w]
        return out

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian 32-bit numbers, without an end marker; none for null."""
        group, size = [], 0
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if b"<|" not in raw and (raw.isascii() or not _HIGH.search(raw)):
                raw = raw.lower()
            group.append(_apart(raw).split())
            size += len(group[-1])
            if size >= GROUP_WORDS:
                yield from self._looked_up(group)
                group, size = [], 0
        yield from self._looked_up(group)


@dataclass
class Piece:
    """Tokens ``ids`` of a document from ``start`` on; those before ``prompt`` (of the document) bear no loss."""

    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    prompt: int = 0

    def loss(self, length: int | None = None) -> int:
        end = self.start + (len(self.ids) if length is None else length)
        return max(0, end - max(self.start, self.prompt))

    def split(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:length], self.doc_tokens, self.prompt),
            Piece(self.doc, self.start + length, self.ids[length:], self.doc_tokens, self.prompt),
        )


@dataclass
class Packer:
    """Packs the pieces of one task; ``first`` numbers its first sequence."""

    first: int
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS_TOKENS
    pool_pieces: int = POOL_PIECES
    pool: list[Piece] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        while len(piece.ids) > PIECE_TOKENS:
            front, piece = piece.split(PIECE_TOKENS)
            self._keep(front)
        self._keep(piece)

    def _keep(self, piece: Piece) -> None:
        self.pool.append(piece)
        if len(self.pool) >= self.pool_pieces:
            self._pack(keep=self.pool_pieces // 4)

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for x in pieces:
            self.rows.append((x.doc, x.start, len(x.ids), zlib.crc32(x.ids.tobytes()), x.doc_tokens, x.loss(), self.first, at))
            at += len(x.ids)
        self.first += 1

    def _pack(self, keep: int) -> None:
        """Fill bins until at most ``keep`` pieces or less than a bin of tokens is left; at least one bin."""
        pool, back = self.pool, []
        size = np.array([len(x.ids) for x in pool], dtype=np.float64)
        loss = np.array([x.loss() for x in pool], dtype=np.float64)
        alive = np.ones(len(pool), dtype=bool)
        first = True
        while alive.any() and (first or (alive.sum() > keep and size[alive].sum() >= self.tokens)):
            first, rest, slots, rest_loss, taken = False, self.tokens, self.segments, self.loss, []
            while rest and slots and alive.any():
                fits = alive & (size <= rest) & (loss <= rest_loss)
                if slots > 1 and fits.any():
                    # demand . remaining, each in shares of the bin's limits; a piece demands one segment whichever it is
                    score = size * (rest / self.tokens**2) + slots / self.segments**2 + loss * (rest_loss / self.loss**2)
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    piece, alive[k] = pool[k], False
                else:
                    most = np.where(alive, np.minimum(np.minimum(size, rest), size - loss + rest_loss), 0)
                    k = int(np.argmax(most))
                    if not (n := int(most[k])):
                        break
                    piece, pool[k] = pool[k].split(n)
                    size[k], loss[k] = len(pool[k].ids), pool[k].loss()
                    alive[k] = size[k] > 0
                taken.append(piece)
                rest, slots, rest_loss = rest - len(piece.ids), slots - 1, rest_loss - piece.loss()
            over = (self.tokens - rest) - (self.tokens if not rest else 1 << ((self.tokens - rest).bit_length() - 1))
            while over:  # back to a power of two; what is cut off waits for the next round
                piece = taken.pop()
                front, tail = piece.split(max(0, len(piece.ids) - over))
                over -= len(tail.ids)
                taken += [front] if len(front.ids) else []
                back.append(tail)
            self._emit(taken)
        self.pool = [x for x, y in zip(pool, alive, strict=True) if y] + back

    def finish(self) -> None:
        """Pack all that is left."""
        while self.pool:
            self._pack(keep=0)

    def drain(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        cols = [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(cols, names)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prompt_col: str | None = None,
    prompt_percent: int = PROMPT_PERCENT,
    tokenizer_path: str | None = None,
    tokens: int = MAX_TOKENS,
    segments: int = MAX_SEGMENTS,
    loss_tokens: int = MAX_LOSS_TOKENS,
    pool_pieces: int = POOL_PIECES,
) -> DataFrame:
    """Pieces of all rows of ``df``, placed in sequences.

    A row's tokens are those of ``prompt_col`` (if given; they bear no loss), then
    those of ``text_col``, then the end id 2. Without ``prompt_col`` the first
    ``prompt_percent`` of a row's tokens, rounded down, are its prompt. Null texts
    count as empty: they are one token. Null ids and repeated rows are packed like
    any others; extra columns are not read. Very long texts are cut into pieces as
    they come. An empty table gives no rows. Sequence ids hold the task's number in
    their upper bits.
    """
    picked = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.col(prompt_col) if prompt_col else F.lit(None)).cast("string").alias("prompt"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = WordTokenizer.of_worker(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33, tokens, segments, loss_tokens, pool_pieces)
        end = np.array([EOS_ID], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                prompts = words.ids(part.column("prompt").to_pylist()) if prompt_col else itertools.repeat(end[:0])
                for doc, prompt, ids in zip(part.column("doc_id").to_pylist(), prompts, words.ids(part.column("text").to_pylist())):
                    whole = np.concatenate([prompt, ids, end])
                    packer.add(Piece(doc, 0, whole, len(whole), len(prompt) if prompt_col else len(whole) * prompt_percent // 100))
                if (out := packer.drain()) is not None:
                    yield out
        packer.finish()
        if (out := packer.drain()) is not None:
            yield out

    return picked.mapInArrow(run, PIECE_SCHEMA)
