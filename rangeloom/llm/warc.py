"""WARC archives: writing them, and making monolithic ones randomly readable.

A badly written archive is one gzip stream for the whole file: no record can be
reached without inflating all that lies before. The normaliser inflates each such
stream once, rewrites every record as a gzip member of its own, and writes a
sidecar index of the members' offsets beside the archive. The normaliser and the
reader stream payloads through in chunks.

Files go to a folder that all executors share. A file is written under a name of
its own for each task attempt and then renamed, so a task that runs twice leaves
one whole file.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import fresh_path, qualified, written
from rangeloom.llm.skew import lookup

#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 100
#: Inflated bytes after which a new archive begins, and bytes handled at a time.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 16
GZIP = 31  # zlib's window bits for gzip members
#: Capture date of pages that come without one; characters of a URI that stay as they are; namespace of record ids.
CAPTURED = "1970-01-01T00:00:00Z"
URI_SAFE = "!#$%&'()*+,/:;=?@[]~"
_NAMESPACE = uuid.UUID(int=0x8F3C5A1E)

FILES = "archive string, records long, bytes long"
INDEX = "archive string, offset long, length long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def opened(path: str):
    """(file system, path in it) for a URI or plain path; also on executors."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _replace(system, draft: str, final: str) -> None:
    """Give a finished draft its name; another attempt's file of that name is as good and goes."""
    try:
        system.move(draft, final)
    except OSError:
        system.delete_file(final)
        system.move(draft, final)


def uri_of(page_id, url: str | None) -> str:
    """A page's URI: what URIs cannot hold is percent-encoded; a page without a URL is named by its id."""
    return quote(url, safe=URI_SAFE, errors="replace") if url else f"urn:page:{'none' if page_id is None else page_id}"


def record_bytes(name: str, page_id, url, payload: bytes, digest: str, kind: str, refers_to=None, refers_url=None, date: str = CAPTURED) -> bytes:
    """One WARC/1.1 record whose id follows from ``name``, which must be unique.

    A revisit has no block of its own; it names the capture that it repeats by target
    URI and date, and its page. Page ids and the payload's length are extension fields.
    """
    block = payload if kind == "response" else b""
    page = lambda x: "none" if x is None else str(x)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri_of(page_id, url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {uri_of(refers_to, refers_url)}",
            f"WARC-Refers-To-Date: {date}",
            f"Refers-To-Page: {page(refers_to)}",
        ] if kind == "revisit" else []),
        f"Page-Id: {page(page_id)}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflater:
    """Reads a gzip file, of one member or many, as one stream of bytes."""

    def __init__(self, source):
        self.source, self.inflate, self.raw, self.buffer, self.ended = source, zlib.decompressobj(GZIP), b"", bytearray(), False

    def _more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data + self.raw
                if not self.raw:
                    self.raw = self.source.read(CHUNK)
                if not self.raw:
                    self.ended = True
                    break
                self.inflate = zlib.decompressobj(GZIP)
            data = self.inflate.unconsumed_tail or self.raw or self.source.read(CHUNK)
            self.raw = b""
            if not data:
                raise EOFError("the gzip stream ends inside a member")
            if out := self.inflate.decompress(data, CHUNK):
                self.buffer += out
                return True
        return False

    def head(self) -> bytes | None:
        """Up to and with the next blank line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("the archive ends inside a record's header")
                return None
        out = bytes(self.buffer[: at + 4])
        del self.buffer[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in chunks."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _page(text: str | None) -> int | None:
    return None if text in (None, "none") else int(text)


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, payload_digest, record_type, refers_to, refers_url) rows as archives of one gzip stream each; returns the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = opened(folder)
        system.create_dir(root)
        part, number = TaskContext.get().partitionId(), 0
        out = None

        def close():
            out.write(packed.flush())
            out.close()
            _replace(system, draft, final)
            return pa.RecordBatch.from_arrays([pa.array([posixpath.basename(final)]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    final = f"{root}/part-{part:05d}-{number:05d}.warc.gz"
                    draft = f"{final}.{uuid.uuid4().hex}"
                    out, packed, count, size, number = system.open_output_stream(draft, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0, number + 1
                data = record_bytes(f"{folder}/{part}/{number}/{count}", r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], r["refers_url"])
                out.write(packed.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.mapInArrow(run, FILES)


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``source`` with one member for each record, and a ``.idx`` file of JSON lines beside it; returns the archives with their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(source)
        there, to = opened(target)
        there.create_dir(to)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                final, mark = f"{to}/{name}", uuid.uuid4().hex
                count = at = 0
                with (
                    system.open_input_stream(f"{root}/{name}", compression=None) as raw,
                    there.open_output_stream(f"{final}.{mark}", compression=None) as out,
                    there.open_output_stream(f"{final}.idx.{mark}", compression=None) as idx,
                ):
                    stream = Inflater(raw)
                    while (head := stream.head()) is not None:
                        got = fields(head)
                        member = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        length = out.write(piece) if (piece := member.compress(head)) else 0
                        for part in stream.take(int(got["content-length"])):
                            if piece := member.compress(part):
                                length += out.write(piece)
                        if b"".join(stream.take(4)) != b"\r\n\r\n":
                            raise ValueError(f"{name}: a record does not end where its length says")
                        length += out.write(member.compress(b"\r\n\r\n") + member.flush())
                        row = {"offset": at, "length": length, "record_id": got["warc-record-id"], "type": got["warc-type"], "digest": got["warc-payload-digest"]}
                        idx.write(json.dumps(row).encode() + b"\n")
                        at, count = at + length, count + 1
                _replace(there, f"{final}.{mark}", final)
                _replace(there, f"{final}.idx.{mark}", f"{final}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([at], pa.int64())], ["archive", "records", "bytes"])

    return files.mapInArrow(run, FILES)


def read_members(files: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each read at its offset of the sidecar index.

    The length and digest of a response are those of the payload that was read; a
    digest that differs from the header's is an error. Those of a revisit are what
    its header says: ``verified`` holds them against the response.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        names = [x.split()[0] for x in INDEX.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("archive", "url", "record_type", "payload_digest") else pa.int64()) for n in names])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with system.open_input_file(f"{root}/{name}") as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        stream = Inflater(Slice(f, entry["length"]))
                        got = fields(stream.head())
                        size, sha, kind, digest = 0, hashlib.sha256(), got["warc-type"], got["warc-payload-digest"].removeprefix("sha256:")
                        for part in stream.take(int(got["content-length"])):
                            size += len(part)
                            sha.update(part)
                        if kind == "response" and sha.hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {got['warc-record-id']} does not have its digest")
                        size = size if kind == "response" else int(got["payload-length"])
                        rows.append((name, entry["offset"], entry["length"], _page(got["page-id"]), got["warc-target-uri"], kind, size, digest, _page(got.get("refers-to-page"))))
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, INDEX)


class Slice:
    """The next ``length`` bytes of a file, as a file."""

    def __init__(self, source, length: int):
        self.source, self.left = source, length

    def read(self, n: int) -> bytes:
        data = self.source.read(min(n, self.left))
        self.left -= len(data)
        return data


def verified(records: DataFrame) -> DataFrame:
    """``records`` (read back) whose revisits each have a response: one of the page they refer to, with their digest and length. Any other is an error."""
    name = lambda page: F.concat_ws("/", page.cast("string"), "payload_digest")
    again = records.filter("record_type = 'revisit'")
    uses = again.groupBy(name(F.col("refers_to")).alias("k")).agg(F.count("*").alias("n"))
    there = records.filter("record_type = 'response' and page_id is not null").groupBy(name(F.col("page_id")).alias("k")).agg(F.min("payload_bytes").alias("found"))
    met = lookup(again.withColumn("k", name(F.col("refers_to"))), written(there.join(uses, "k"), "warc-responses"), "k", "n", again.count, ["page_id", "archive", "offset"])
    wrong = F.raise_error(F.concat(F.lit("a revisit without its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    sure = F.when(F.col("found") == F.col("payload_bytes"), F.col("found")).otherwise(wrong.cast("long"))
    return records.filter("record_type <> 'revisit'").unionByName(met.withColumn("payload_bytes", sure).drop("k", "found"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to, refers_url) for each page.

    Of equal payloads of at least 100 bytes the smallest page_id is the response
    (every row that has it, if it is repeated) and the others revisit it. Null html
    is an empty payload. A null page_id is larger than any other; where a payload
    has no other, its rows are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT_BYTES
    firsts = (
        rows.filter(large)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n")
        .filter("n > 1 and first_id is not null")
    )
    rows = lookup(rows, firsts, "payload_digest", "n", rows.count, ["page_id", "url"])
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_url"),
    )


def archive_and_read(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back.

    The archives stay in ``folder`` (by default a new one in the shared folder):
    ``monolithic/`` and ``members/`` with its indexes. Revisits are held against the
    responses that they refer to. A page is in memory whole when it is written (as
    Spark holds a row), and streamed afterwards. An empty table writes no archive;
    extra columns are not read; null ids and URLs and repeated rows are records of their own.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else fresh_path(spark, "warc")
    files = written(write_monolithic(with_revisits(pages), f"{folder}/monolithic", archive_bytes), "warc-files")
    n = max(1, files.count())
    done = written(normalise(files.repartition(n), f"{folder}/monolithic", f"{folder}/members"), "warc-members")
    records = written(read_members(done.repartition(n), f"{folder}/members").drop("url", "length"), "warc-records")
    return verified(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
