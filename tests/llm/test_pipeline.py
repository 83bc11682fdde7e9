"""Every stage of the pipeline against a plain version over its own input, and odd tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_training_data import brute, check_packing

import corpus_pipeline as p
from ringsight.llm import bpe, langid, quality
from ringsight.llm.common import workspace

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP9_SQL}) WHERE kept").fetchall()}
    one = p.quality(spark, docs, SF)
    assert one.columns == docs.columns and rows_of(one) == rows_of(docs.filter(F.col("doc_id").isin(*good)))
    # the model of the stage, and each score from kernel values worked out one by one
    two = p.language(spark, one, SF)
    model = langid.fit(one.select("doc_id", "text", "lang"))
    told = {r["doc_id"]: r for r in langid.predict(one, model).collect()}
    want = {d for d, r in told.items() if r["lang_pred"] != langid.UNKNOWN and r["score"] >= p.LEAST_SCORE}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.select("doc_id").collect()} == want and len(want) > 0.9 * one.count()
    assert sum(r["lang_pred"] == r["lang"] for r in two.join(spark.createDataFrame([(d, told[d]["lang_pred"]) for d in want], "doc_id long, lang_pred string"), "doc_id").collect()) > 0.99 * len(want)
    kept = {r["doc_id"]: r["text"] for r in two.select("doc_id", "text").collect()}
    three = p.near_duplicates(spark, two, SF)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.select("doc_id").collect()} == {c for _, c in brute(kept, p.WORDS, p.NUM, p.DEN).values()}
    left = {r["doc_id"]: r["text"] for r in three.select("doc_id", "text").collect()}
    check_packing(p.packing(spark, three, SF).collect(), left, bpe.default_path("word_bpe_49k.json"))
    assert sorted({r["doc_id"] for r in p.run(spark, SF).select("doc_id").distinct().collect()}) == sorted(left)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_tables(spark, which):
    """Null and repeated ids, null and empty texts, copies and one very long text; no rows at all."""
    prose = lambda k: " ".join(f"word{(i * k) % 997} und" if i % 9 == 0 else f"word{(i * k) % 997}" for i in range(120))
    rows = [(i, prose(i + 3), "en", "s", None) for i in range(40)] + [(100, prose(3), "en", "s", None), (101, prose(3), None, None, 5)]  # copies of row 0
    rows += [(None, prose(55), "en", "s", 1), (None, None, None, None, None), (7, prose(10), "en", "s", 2), (200, None, "en", "s", 3), (201, "", "en", "s", 0), (202, " ".join(f"long{i}" for i in range(9_000)), "en", "s", 1), (203, "1 2 3 " * 60, "en", "s", 1)]
    path = workspace(spark, "tables")
    spark.createDataFrame(rows if which == "odd" else [], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] if which == "odd" else [], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    out = p.run(spark, path).collect()
    if which == "empty":
        assert out == []
        return
    ids = {r["doc_id"] for r in out}
    assert set(range(40)) - {7} <= ids and 202 in ids  # clean documents and the long one stay
    assert not ids & {100, 101, 200, 201, 203}  # copies, what has no words, and no letters or only repeats
    assert max(r["piece"] for r in out if r["doc_id"] == 202) >= 4
