import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from rangeloom.llm.frames import FrameReader, FrameWriter, encode_and_read, read_documents, read_lengths, write_tokens
from rangeloom.llm.warc import opened


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: np.array([*made.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def small(docs, frame_ids):
    out = io.BytesIO()
    writer = FrameWriter(out, frame_ids)
    for name, ids in docs:
        writer.add(name, np.array(ids, "<u4"))
    writer.close()
    assert writer.size == len(out.getvalue())
    return out.getvalue()


def test_frames_decompress_alone_and_together():
    docs = [(3, [5, 1]), (3, [1]), (7, list(range(40)) + [1]), (9, []), (None, [2, 1])]
    raw = small(docs, 8)
    reader = FrameReader(io.BytesIO(raw), len(raw))
    assert reader.docs == [3, 3, 7, 9, None]
    assert [reader.ids(k).tolist() for k in range(5)] == [d[1] for d in docs]
    assert list(reader.find(3)) == [0, 1] and list(reader.find(7)) == [2] and not reader.find(8)
    # any decoder reads the file from end to end, skipping what is not content
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [x for d in docs for x in d[1]]


def test_only_the_frames_of_a_document_are_read():
    docs = [(k, [k] * 10) for k in range(100)]
    raw = small(docs, 16)
    reader = FrameReader(io.BytesIO(raw), len(raw))
    assert reader.ids(reader.find(50)[0]).tolist() == [50] * 10
    assert len(reader.frames) == 63 and reader.frames_read <= 2


@pytest.mark.parametrize("where", ["frame", "checksum", "footer"])
def test_damage_is_found(where):
    raw = bytearray(small([(k, list(range(k, k + 50))) for k in range(9)], 64))
    first = FrameReader(io.BytesIO(bytes(raw)), len(raw))
    place = {"frame": int(first.places[2]) + 12, "checksum": len(raw) - 9 - 12 * len(first.places) - 12 + 12 * 2 + 8, "footer": len(raw) - 1}[where]
    raw[place] ^= 0x55
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader = FrameReader(io.BytesIO(bytes(raw)), len(raw))
        for k in range(9):
            reader.ids(k)


def test_empty_file():
    raw = small([], 8)
    reader = FrameReader(io.BytesIO(raw), len(raw))
    assert reader.docs == [] and not reader.find(1)


def test_query_against_the_tokenizer(spark, documents, encode):
    from rangeloom.llm.queries import op11_seekable_token_frames

    rows = op11_seekable_token_frames(spark, "/root/testdata/sf0.001").collect()
    at, want = 0, []
    for d in sorted(documents.select("doc_id", "text").collect()):
        ids = encode(d.text)
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in rows) == want


def test_odd_rows_small_frames_and_files(spark, odd_docs, encode):
    rows = encode_and_read(odd_docs, frame_ids=64, file_bytes=1024).collect()
    texts = [(d.doc_id, d.text) for d in odd_docs.collect()]
    want = defaultdict(list)
    for name, text in texts:
        ids = encode(text)
        want[name].append((len(ids), zlib.crc32(ids.tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    # starts are gapless in the order of ids, those without one last
    at, ordered = 0, sorted(rows, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in ordered]
    assert names == sorted(n for n in names if n is not None) + [None]


def test_no_rows(spark, no_docs):
    assert encode_and_read(no_docs).collect() == []


def test_documents_read_alone(spark, documents, encode, tmp_path):
    spread = documents.repartition(5)
    files = write_tokens(spread, f"file://{tmp_path}/ids", frame_ids=256, file_bytes=64 << 10).cache()
    assert files.count() > 3
    texts = {d.doc_id: d.text for d in documents.collect()}
    wanted = [min(texts), max(texts), sorted(texts)[57], 10**9]
    got = {r.doc_id: r.ids for r in read_documents(files, wanted).collect()}
    assert got == {k: encode(texts[k]).tolist() for k in wanted if k in texts}
    assert read_documents(files, []).collect() == []
    assert read_lengths(files).agg(F.sum("n_tokens")).first()[0] == files.agg(F.sum("tokens")).first()[0]
    system, path = opened(files.first().path)
    with system.open_input_file(path) as f:
        assert len(FrameReader(f, f.size()).frames) == files.first().frames
