import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textlab.llm import bpe, decontam, minhash, pii, quality
from textlab.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(llm.ORACLE_SQL) <= set(llm.QUERIES)


def test_pipeline_equals_its_operators(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    item = "the quick green lizard climbs over a sleeping stone wall"
    rows = [(1, long, "en"), (2, long + " more", "en"), (3, "A sentence with a.b@c.example.com in it.", None), (4, f"Before it {item} and after", "en"), (5, "### $$$ %%% &&&", "en"), (6, None, None), (7, "Plain words stay here.", "en"), (7, "Plain words stay here.", "en"), (None, "Nobody knows the number.", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 7), (False, 7), (True, 0)]
    texts = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(got)).collect()}
    assert texts[1] == long and texts[3] == pii.replaced(rows[2][1])[0] != rows[2][1]
    stage = docs
    for (_, fn), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [["doc_id", "n_tokens", "tokens", "round_trip"]], strict=True):
        stage = fn(spark, stage, str(tmp_path))
        assert stage.columns == columns
    empty = docs.limit(0)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = {r.doc_id for r in quality.judge(docs).where("keep").collect()}
    left = docs.where(F.col("doc_id").isin(list(keep)))
    keep -= {r.doc_id for r in minhash.duplicates(left).collect()}
    keep -= {r.doc_id for r in decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == keep and all(r.round_trip for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(llm.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = llm.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
