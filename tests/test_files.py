"""Hand files in, documents out: listing, packing, bad names, the bulk sink and the command line."""

import json

import pytest
from pyspark.sql import functions as F
from rangeloom.plans import documents, runs
from rangeloom.sources.histories import read_hand, read_session

HAND = "['d dh p1 Ks7d', 'd dh p2 8sQh', 'd dh p3 2sKh', 'p3 cbr 225', 'p1 f', 'p2 cc', 'd db 3dQc2c', 'p2 cc', 'p3 f']"


def text(players="['Ann', 'Bob', 'Cyd']", actions=HAND):
    return f"blinds_or_straddles = [50, 100, 0]\nstarting_stacks = [10000, 10000, 10000]\nactions = {actions}\nplayers = {players}\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Two sessions whose file names sort otherwise than their numbers."""
    root = tmp_path_factory.mktemp("corpus")
    for session, numbers in (("30", (2, 10, 1)), ("31", (7,))):
        (root / session).mkdir()
        for k in numbers:
            (root / session / f"{k}.phh").write_text(text())
    # a hand whose table has changed: only players of the session's first hand are sought
    (root / "31" / "8.phh").write_text(text("['Ann', 'Zoe', 'Cyd']"))
    return root


def files_opened(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for session in ("1", "2"):
        (tmp_path / session).mkdir()
        for k in range(700):
            (tmp_path / session / f"{k}.phh").write_text(f"hand = {k}\nplayers = ['a', 'b']\n")
    hands = read_session(spark, str(tmp_path), recursive=True)
    assert hands.rdd.getNumPartitions() == 4 and hands.count() == 1400
    assert read_session(spark, str(tmp_path), recursive=True, files_per_task=100).rdd.getNumPartitions() == 14
    # what is asked of the path is decided on the listing: other files are never opened
    assert files_opened(hands.filter("hand_no = 31")) == 2
    assert files_opened(hands.filter("session_id = '2'")) == 700
    assert files_opened(hands.filter("session_id = '2' and hand_no between 5 and 9")) == 5
    assert [r.hand for r in hands.filter("session_id = '1' and hand_no = 31").collect()] == [31]


def test_paths_and_uris(spark, corpus, tmp_path):
    by_uri, by_path = (read_session(spark, p) for p in (f"file://{corpus}/30", f"{corpus}/30"))
    assert sorted(r.hand_no for r in by_uri.collect()) == sorted(r.hand_no for r in by_path.collect()) == [1, 2, 10]
    for reader, missing in ((read_session, "none"), (read_hand, "none.phh")):
        for prefix in ("", "file://"):
            with pytest.raises(FileNotFoundError):
                reader(spark, f"{prefix}{corpus}/{missing}")
    with pytest.raises(NotADirectoryError):
        read_session(spark, f"file://{corpus}/30/1.phh")
    (tmp_path / "empty").mkdir()
    assert read_session(spark, str(tmp_path / "empty")).count() == 0
    assert runs.run(spark, f"file://{corpus}/30") == runs.run(spark, f"{corpus}/30")


def test_a_stem_that_is_not_a_number(spark, tmp_path):
    (tmp_path / "1.phh").write_text(text())
    (tmp_path / "one.phh").write_text(text())
    (tmp_path / "two.txt").write_text("no hand")
    with pytest.raises(Exception, match="named by its number"):
        read_session(spark, str(tmp_path)).select("hand_no").collect()
    assert read_hand(spark, str(tmp_path / "one.phh")).first().hand_no is None


def test_documents_equal_runs(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, out)
    hands = read_session(spark, str(corpus), recursive=True)
    told = documents.write_documents(hands, out, phi=0.5, k=3)
    manifest, sessions, rows = documents.read_documents(spark, f"file://{out}")
    assert (manifest["rows"], manifest["sessions"], told["manifest"]) == (rows.count(), 2, "manifest-000000001.json")
    paths = {r.session_path.rsplit("/", 1)[1]: r.session_path for r in sessions.collect()}
    for session in ("30", "31"):
        want = runs.run(spark, str(corpus / session), phi=0.5, k=3)
        got = documents.document(spark, out, paths[session])
        assert got.pop("session_path").endswith(want.pop("session_path").lstrip("/"))
        assert json.dumps(got) == json.dumps(want)
    # hands by their numbers, not by the order of their names
    by = {r.path.rsplit("/", 1)[1]: r.hand_index for r in rows.filter("path like '%/30/%'").collect()}
    assert by == {"1.phh": 0, "2.phh": 1, "10.phh": 2}
    assert not rows.filter("observer = 'Zoe' or target = 'Zoe'").count()
    with pytest.raises(KeyError):
        documents.document(spark, out, "elsewhere")


def test_rows_lie_in_order_over_files(spark, corpus, tmp_path):
    documents.write_documents(read_session(spark, str(corpus), recursive=True), str(tmp_path), ["Cyd", "Ann"], ["Bob"])
    manifest, _, _ = documents.read_documents(spark, str(tmp_path))
    lines = [json.loads(x) for f in sorted((tmp_path / manifest["run"] / "rows").glob("part-*")) for x in f.read_text().splitlines()]
    keys = [(r["session_path"], r["hand_index"], r["observer_at"], r["target_at"]) for r in lines]
    assert keys == sorted(keys) and len(keys) == manifest["rows"] > 0
    assert {(r["observer"], r["observer_at"]) for r in lines} == {("Cyd", 0), ("Ann", 1)} and {r["target"] for r in lines} == {"Bob"}


def test_a_failed_run_leaves_the_one_before(spark, corpus, tmp_path):
    hands = read_session(spark, str(corpus), recursive=True)
    documents.write_documents(hands, str(tmp_path))
    first = documents.read_documents(spark, str(tmp_path))[0]
    broken = hands.withColumn("actions", F.when(F.col("hand_no") == 10, F.array(F.lit("p1 xx"))).otherwise(F.col("actions")))
    with pytest.raises(Exception, match="unknown action"):
        documents.write_documents(broken, str(tmp_path))
    # a task killed while it writes: files without a manifest
    (tmp_path / "run-lost" / "rows").mkdir(parents=True)
    (tmp_path / "run-lost" / "rows" / "part-00000.json").write_text("{")
    assert documents.read_documents(spark, str(tmp_path))[0] == first
    again = documents.write_documents(broken, str(tmp_path), quarantine=True)
    manifest, _, rows = documents.read_documents(spark, str(tmp_path))
    assert again["manifest"] == "manifest-000000002.json" and manifest["run"] == again["run"] != first["run"]
    assert 0 < manifest["rows"] < first["rows"] and not rows.filter("path like '%/30/10.phh'").count()


def test_documents_of_no_hands(spark, corpus, tmp_path):
    none = read_session(spark, str(corpus), recursive=True).filter("false")
    assert documents.write_documents(none, str(tmp_path))["rows"] == 0
    assert documents.read_documents(spark, str(tmp_path))[2].count() == 0


def test_command_line(spark, corpus, tmp_path, capsys):
    assert runs.main([str(corpus / "30"), "--observer", "Ann", "--target", "Bob", "--json", "--json-out", str(tmp_path / "a" / "r.json")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told == json.loads((tmp_path / "a" / "r.json").read_text()) and {r["target"] for r in told["hand_results"]} == {"Bob"}
    assert runs.main([str(corpus / "30" / "1.phh"), "--phi", "0.5", "--top-k", "2"]) == 0
    shown = capsys.readouterr().out
    assert "Fixed phi: 0.5" in shown and "Hand 0 | Bob -> Cyd" in shown
    assert runs.main([str(corpus), "--documents-out", str(tmp_path / "all")]) == 0
    assert json.loads(capsys.readouterr().out)["sessions"] == 2
    with pytest.raises(ValueError, match="not at this table"):
        runs.main([str(corpus / "30"), "--target", "Nobody"])
