import gzip
import hashlib
import io
import json
import os
import random
import zlib

import pytest
from rangeloom.llm.warc import GZIP, Inflater, archive_and_read, fields, record_bytes, verified

PAGES = "page_id long, url string, html string, __key string, payload string"


def brute(rows):
    first = {}
    for r in rows:
        h = (r.html or "").encode()
        if len(h) >= 100 and r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    out = []
    for r in rows:
        h = (r.html or "").encode()
        f = first.get(h)
        again = f is not None and r.page_id != f
        out.append((r.page_id, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_odd_rows(spark, tmp_path):
    big = "x" * 300_000 + "é"
    rows = [(9, "u", "a" * 100, "k", "p"), (3, None, "a" * 100, "k", "p"), (3, "u2", "a" * 100, "k", "p"), (1, "u", "a" * 99, None, "p"), (2, "u", "a" * 99, "k", "p")]
    rows += [(5, 'q"\r\nx', None, "k", "p"), (6, "u", "", "k", "p"), (7, "u", big, "k", None), (8, "u", big, "k", "p"), (None, "u", big, "k", "p"), (None, "u", "z" * 200, "k", "p")]
    rows += [(100 + i, "hot", "h" * 150, "k", "p") for i in range(600)]
    df = spark.createDataFrame(rows, PAGES)
    got = archive_and_read(df, str(tmp_path), archive_bytes=20_000).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(df.collect())
    names = [n for n in os.listdir(tmp_path / "members") if n.endswith(".warc.gz")]
    assert len(names) > 1
    heads = []
    for n in names:
        whole = gzip.open(tmp_path / "members" / n).read()
        assert whole == gzip.open(tmp_path / "monolithic" / n).read()
        raw = (tmp_path / "members" / n).read_bytes()
        for line in (tmp_path / "members" / f"{n}.idx").read_text().splitlines():
            e = json.loads(line)
            member = zlib.decompress(raw[e["offset"] : e["offset"] + e["length"]], GZIP)
            assert member.startswith(b"WARC/1.1") and e["record_id"].encode() in member
            heads.append(fields(member[: member.index(b"\r\n\r\n") + 4]))
    assert len(heads) == len(rows) == len({h["warc-record-id"] for h in heads})
    for h in heads:
        assert {"warc-type", "warc-date", "warc-record-id", "warc-target-uri", "content-length"} <= set(h) and not set(h["warc-target-uri"]) & set(' "<>\r\n')
        assert h["warc-type"] == "response" or {"warc-profile", "warc-refers-to-target-uri", "warc-refers-to-date"} <= set(h)


def test_revisits_are_held_against_their_responses(spark):
    schema = "archive string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
    rows = [("a", 0, 1, "response", 200, "d", None), ("a", 9, 2, "revisit", 200, "d", 1), ("b", 0, 3, "revisit", 200, "d", 1)]
    assert verified(spark.createDataFrame(rows, schema)).count() == 3
    for bad in (("c", 0, 4, "revisit", 201, "d", 1), ("c", 0, 4, "revisit", 200, "e", 1), ("c", 0, 4, "revisit", 200, "d", 2)):
        with pytest.raises(Exception, match="without its response"):
            verified(spark.createDataFrame([*rows, bad], schema)).collect()


def test_empty_table(spark):
    assert archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_inflater_reads_one_member_or_many(seed):
    rng = random.Random(seed)
    records = [record_bytes(str(i), i, "u", rng.randbytes(rng.randrange(200_000)), "d", "response", None) for i in range(6)]
    for raw in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        stream, seen = Inflater(io.BytesIO(raw)), []
        while (head := stream.head()) is not None:
            n = int(head.split(b"Content-Length: ")[1].split()[0])
            seen.append(head + b"".join(stream.take(n + 4)))
        assert seen == records


def test_a_cut_stream_is_an_error():
    raw = gzip.compress(record_bytes("1", 1, "u", b"y" * 5000, "d", "response", None))[:-20]
    stream = Inflater(io.BytesIO(raw))
    with pytest.raises(EOFError):
        stream.head()
        list(stream.take(6000))
