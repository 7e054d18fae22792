from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F
from rangeloom.llm import minmax, mixing, pii, toxicity
from rangeloom.llm.common import word_count

from test_packing import check

D = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    """Each stage's decisions against its operator's, on what the stage before kept."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        stage(spark, kept[-1], D).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    for x in kept[1:-1]:
        assert x.columns == docs.columns and [t for _, t in x.dtypes] == [t for _, t in docs.dtypes]
    start, clean, single, masked, mixed, packed = kept
    bad = {r.doc_id for r in toxicity.classify(start, spark.read.parquet(f"{D}/labels.parquet")).filter("predicted = 1").collect()}
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in kept[:-1]]
    assert bad and ids[1] == Counter({k: v for k, v in ids[0].items() if k not in bad})
    left = {r.doc_id for r in minmax.near_duplicates(clean, C.LEAST_PERCENT, C.SHINGLE_WORDS).filter("kept").collect()}
    assert ids[2] == Counter(left) and len(left) < len(ids[1])
    assert ids[3] == ids[2]
    again = pii.find_documents(masked).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")).alias("n")).first().n
    assert again == 0 and masked.filter("text like '%[EMAIL]%'").count() > 0
    want = {r.doc_id: r.copies for r in mixing.balanced_copies(masked, "doc_id", "source", word_count(F.col("text"))).collect()}
    assert ids[4] == Counter({k: v for k, v in want.items() if v})
    assert check(packed.collect(), mixed.collect()) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    start = rows(odd_docs)
    for name, stage in C.STAGES:
        out, none = stage(spark, odd_docs, D), stage(spark, no_docs, D)
        assert none.count() == 0 and none.columns == out.columns
        if name in ("toxicity", "personal_data"):  # nothing toxic, nothing personal: all rows stay as they are
            assert rows(out) == start
        elif name == "near_duplicates":  # ids 1, 1 and 2 are one text; the row without an id stays
            assert rows(out) == Counter({k: 1 for k in start if k[0] != 2})
        elif name == "mixing":
            assert set(rows(out)) <= set(start) and max(rows(out).values()) <= 4
        else:
            assert check(out.collect(), odd_docs.collect()) == 0


def test_texts_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "one text of five words here"), (5, "one text of five words here"), (5, "another text that nobody else has")], "doc_id long, text string")
    got = C.one_of_each_group(spark, docs, D).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "one text of five words here"), (5, "another text that nobody else has")]
