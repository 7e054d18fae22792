"""Token ids in files of independent zstandard frames that can be read document by document.

A file holds, in this order: data frames, each compressed on its own, with the
checksum of its content; one skippable frame with the ids and lengths of the file's
documents; and a seek table, which is zstandard's public seekable format: for each
frame its size, its content's size and a checksum of the content. A reader fetches
the file's end, looks a document up, and decompresses only the frames that hold it;
any zstandard decoder reads the whole file as the ids one after the other.

Documents are dealt by ranges of their id, so files in order hold them in ascending
order. A file is written under a name of its own for each task attempt; only what
the task returned is ever read, so a task that runs twice does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import fresh_path, qualified, written
from rangeloom.llm.packing import WordTokenizer
from rangeloom.llm.warc import opened

#: Id that ends each document; ids in a frame; content after which a new file begins.
END_ID, FRAME_IDS, FILE_BYTES = 1, 1 << 16, 256 << 20
LEVEL = 3
#: Fixed values of the seekable format: skippable frames (of documents, of the table), its footer, and the flag that says that entries have checksums.
DOCUMENTS_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER, _HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")

FILES = "part int, number int, path string, docs long, tokens long, bytes long, frames long, first_id long, last_id long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
TOKENS = "doc_id long, ids array<int>"


def checksum(content: bytes) -> int:
    """Low 32 bits of XXH64, as the seekable format has it."""
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file; ``add`` takes documents in their order."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.waiting, self.entries, self.size, self.content = bytearray(), [], 0, 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self, content: bytes) -> None:
        data = self.zip.compress(content)
        self._write(data)
        self.entries.append((len(data), len(content), checksum(content)))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4", copy=False).tobytes()
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.content += len(raw)
        self.waiting += raw
        while len(self.waiting) >= self.frame_bytes:
            self._frame(bytes(self.waiting[: self.frame_bytes]))
            del self.waiting[: self.frame_bytes]

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
            self.waiting.clear()
        known = np.array([x is not None for x in self.docs], dtype=bool)
        names = np.array([0 if x is None else x for x in self.docs], dtype="<i8")
        packed = self.zip.compress(struct.pack("<Q", len(self.docs)) + names.tobytes() + np.array(self.lengths, "<i8").tobytes() + np.packbits(known).tobytes())
        self._write(_HEAD.pack(DOCUMENTS_MAGIC, len(packed)) + packed)
        self.entries.append((_HEAD.size + len(packed), 0, checksum(b"")))
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, FOOTER_MAGIC)
        self._write(_HEAD.pack(TABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads one file of ``FrameWriter`` from an object with ``seek`` and ``read``.

    ``docs`` has the ids (None for null), ``starts`` and ``lengths`` their places in
    ids. A frame or table whose checksum or size is not what it should be is an
    error. ``frames_read`` counts the frames that were decompressed.
    """

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        source.seek(size - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = count * _ENTRY.size + _FOOTER.size
        source.seek(size - length - _HEAD.size)
        if _HEAD.unpack(source.read(_HEAD.size)) != (TABLE_MAGIC, length):
            raise ValueError("the seek table has not the size that its footer says")
        table = np.frombuffer(source.read(length - _FOOTER.size), "<u4").reshape(count, 3).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.frames, self.places = table[:-1], places[:-1]
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        source.seek(int(places[-2]))
        magic, length = _HEAD.unpack(source.read(_HEAD.size))
        if magic != DOCUMENTS_MAGIC:
            raise ValueError("no frame of documents before the seek table")
        raw = self.unzip.decompress(source.read(length))
        n = struct.unpack_from("<Q", raw)[0]
        names, self.lengths = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 16 * n), count=n).astype(bool)
        self.names, self.known = names, int(known.sum())
        self.docs = [x if k else None for x, k in zip(names.tolist(), known.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """Content of the ``k``-th data frame."""
        if self._last[0] != k:
            packed, length, check = self.frames[k].tolist()
            self.source.seek(int(self.places[k]))
            content = self.unzip.decompress(self.source.read(packed))
            if len(content) != length or checksum(content) != check:
                raise ValueError(f"frame {k} is not what the seek table says")
            self.frames_read += 1
            self._last = (k, content)
        return self._last[1]

    def parts(self, place: int) -> Iterator[bytes]:
        """The bytes of the document at ``place``, frame by frame."""
        at, end = 4 * int(self.starts[place]), 4 * int(self.starts[place + 1])
        k = int(np.searchsorted(self.begins, at, "right")) - 1
        while at < end:
            stop = min(end, int(self.begins[k + 1]))
            yield self.frame(k)[at - int(self.begins[k]) : stop - int(self.begins[k])]
            at, k = stop, k + 1

    def ids(self, place: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(place)), "<u4")

    def find(self, doc: int) -> range:
        """Places of a document's id: ids ascend, and rows without one come last."""
        names = self.names[: self.known]
        return range(int(np.searchsorted(names, doc, "left")), int(np.searchsorted(names, doc, "right")))


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of each row's text and the end id, in ascending order of the row's id; returns the files (``FILES``).

    Rows without an id come last. Rows that share an id are ordered by a digest of
    their text; equal rows may be in either order, and are spread like all others.
    Null and empty texts are one id, the end. A very long text fills many frames.
    Extra columns are not read; an empty table writes no file.
    """
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("row")]
    dealt = picked.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = opened(folder)
        words, end = WordTokenizer.of_worker(tokenizer_path), np.array([END_ID], "<u4")
        part, number, made, out = TaskContext.get().partitionId(), 0, [], None

        def finish() -> None:
            writer.close()
            out.close()
            named = [x for x in writer.docs if x is not None]
            made.append((part, number, path, len(writer.docs), writer.content // 4, writer.size, len(writer.entries) - 1, min(named, default=None), max(named, default=None)))

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                for doc, ids in zip(piece.column("doc_id").to_pylist(), words.ids(piece.column("text").to_pylist())):
                    if out is None:
                        system.create_dir(root)
                        path = f"{folder}/part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.ids.zst"
                        out = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                        writer = FrameWriter(out, frame_ids)
                    writer.add(doc, np.concatenate([ids, end]))
                    if writer.content >= file_bytes:
                        finish()
                        out, number = None, number + 1
        if out is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(zip(*made))], [x.split()[0] for x in FILES.split(", ")])

    return dealt.mapInArrow(run, FILES)


def _read(files: DataFrame, body, schema: str, carried: str) -> DataFrame:
    """``body(reader, carried value)`` over each file, a task for each; yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column(carried).to_pylist()):
                system, place = opened(path)
                with system.open_input_file(place) as f:
                    yield from body(FrameReader(f, f.size()), value)

    return files.select("path", carried).mapInArrow(run, schema)


def read_lengths(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of ``files``, read from them; ``start`` counts the ids of all files before."""
    # one row for each file; the sum goes over files, not documents
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = files.select("path", before.cast("long").alias("before"))

    def told(reader: FrameReader, before: int) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(reader.docs), 10_000):
            high, sums = min(low + 10_000, len(reader.docs)), []
            for k in range(low, high):
                crc = 0
                for part in reader.parts(k):
                    crc = zlib.crc32(part, crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reader.docs[low:high], pa.int64()), pa.array(before + reader.starts[low:high]), pa.array(reader.lengths[low:high].astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    n = max(1, files.count())
    return _read(numbered.repartition(n), told, READ, "before")


def read_documents(files: DataFrame, docs: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named by ``docs``, a list that the caller bounds: only their files are opened and only their frames decompressed."""
    wanted = sorted(set(docs))
    among = F.filter(F.lit(wanted).cast("array<bigint>") if wanted else F.array().cast("array<bigint>"), lambda x: x.between(F.col("first_id"), F.col("last_id")))
    touched = files.select("path", among.alias("wanted")).filter(F.size("wanted") > 0)

    def told(reader: FrameReader, wanted: list[int]) -> Iterator[pa.RecordBatch]:
        for doc in wanted:
            for place in reader.find(doc):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([reader.ids(place).astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _read(touched, told, TOKENS, "wanted")


def encode_and_read(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the ids of ``df`` (as ``write_tokens``) and read every document back from the files.

    The files stay in ``folder``, by default a new one in the shared folder.
    """
    spark = df.sparkSession
    folder = qualified(spark, folder) if folder else fresh_path(spark, "token-frames")
    return read_lengths(written(write_tokens(df, folder, **options), "token-files"))
