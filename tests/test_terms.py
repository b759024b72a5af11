import json
import math

import pytest

from textlab.operators import postings, spec, termvectors
from textlab.operators.spec import Feature, VectorSpec
from textlab.operators.vectorize import linear_scores, vectorize


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "a cat and a dog"), (2, "a dog"), (3, "Bird!"), (4, ""), (5, None)], "doc_id int, text string")


def terms(df):
    return [r.term for r in df.collect()]


def test_all_terms(docs):
    assert terms(postings.all_terms(docs)) == ["a", "and", "bird", "cat", "dog"]
    assert terms(postings.all_terms(docs, from_="and")) == ["bird", "cat", "dog"]
    assert terms(postings.all_terms(docs, from_="ar", size=1)) == ["bird"]
    assert terms(postings.all_terms(docs, min_doc_freq=2)) == ["a", "dog"]
    assert terms(postings.all_terms(docs, size=0)) == []
    with pytest.raises(ValueError, match="not found"):
        postings.all_terms(docs, "none")


def test_statistics(docs):
    assert tuple(postings.field_statistics(docs).first()) == (7, 3, 8)
    assert {tuple(r) for r in postings.dictionary(docs).collect()} == {("a", 2, 3), ("cat", 1, 1), ("and", 1, 1), ("dog", 2, 2), ("bird", 1, 1)}
    assert tuple(postings.field_statistics(docs.limit(0)).first()) == (0, 0, 0)


def test_term_vectors(docs):
    v = termvectors.term_vectors(docs, positions=True, term_statistics=True)
    assert tuple(v.where("doc_id = 1 and term = 'a'").first()) == (1, "text", "a", 2, [0, 3], 2, 3)
    kept = termvectors.filtered(docs, max_num_terms=1).collect()
    assert {(r.doc_id, r.term) for r in kept} == {(1, "a"), (2, "a"), (3, "bird")}
    keyword = termvectors.term_vectors(docs, per_field_analyzer={"text": "keyword"})
    assert keyword.where("doc_id = 2").first().term == "a dog"


def test_offsets_count_utf16_units(spark):
    df = spark.createDataFrame([(1, "Né \U0001f600 x")], "doc_id int, text string")
    assert [tuple(r) for r in termvectors.offsets(df).collect()] == [(1, "né", 0, 0, 2), (1, "x", 1, 6, 7)]


@pytest.mark.parametrize("limit", [64, 0])
def test_vectors(docs, monkeypatch, limit):
    monkeypatch.setattr("textlab.operators.vectorize.INLINE_TERMS", limit)

    def of(number, sparse):
        s = VectorSpec((Feature("text", number, ("a", "bird", "dog", "zonk")),), sparse)
        return {r.doc_id: r.vector.asDict() for r in vectorize(docs, s.to_json()).collect()}

    assert of("tf", False)[1] == {"values": [2, 0, 1, 0], "length": 4}
    assert of("occurrence", False)[1]["values"] == [1, 0, 1, 0]
    assert of("tf", True)[1] == {"indices": [0, 2], "values": [2, 1], "length": 4}
    assert of("tf", True)[4] == {"indices": [], "values": [], "length": 4} == of("occurrence", True)[5]
    dense, sparse = of("tf_idf", False)[1], of("tf_idf", True)[1]
    assert dense["values"] == pytest.approx([2 * math.log(4 / 3), 0, math.log(4 / 3), 0])  # three documents with tokens
    assert sparse["values"] == pytest.approx([2 * math.log(6 / 3), math.log(6 / 3)])  # five documents


def test_zero_idf_stays_in_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id int, text string")
    v = vectorize(df, VectorSpec((Feature("text", "tf_idf", ("a", "b")),), True)).where("doc_id = 1").first().vector
    assert v["indices"] == [0, 1] and v["values"] == pytest.approx([0, math.log(1.5)])


def test_specs(docs, spark):
    request = {"features": [{"field": "text", "number": "tf", "type": "string", "tokens": "given", "terms": ["b", "a", "b"]}, {"field": "text", "number": "occurrence", "type": "string", "tokens": "all_terms", "index": "d", "min_doc_freq": 2}], "sparse": "true"}
    made = spec.prepare_spec(json.dumps(request), {"d": docs})
    body = json.loads(made.to_json())
    assert body["length"] == "4" and body["sparse"] is True and [f["terms"] for f in body["features"]] == [["a", "b"], ["a", "dog"]]
    assert VectorSpec.from_json(made.to_json()) == made
    for change, message in (({"tokens": "x"}, "tokens"), ({"type": "number"}, "type"), ({"number": "bm25"}, "number"), ({"extra": 1}, "extra"), ({"terms": None}, "terms")):
        feature = {k: v for k, v in (request["features"][0] | change).items() if v is not None}
        with pytest.raises(ValueError, match=message):
            spec.prepare_spec({"features": [feature]}, {})
    with pytest.raises(ValueError, match="features"):
        spec.prepare_spec({"features": []}, {})


def test_significant_terms(spark):
    df = spark.createDataFrame([("good x",) + ("p",), ("good y", "p"), ("bad x", "n"), ("bad y", "n")], "text string, label string")
    found = {(r["class"], r.term): r.score for r in spec.significant_terms(df, "label", min_doc_count=0).collect()}
    assert found == {("p", "good"): 1.0, ("n", "bad"): 1.0}
    request = {"aggs": {"c": {"terms": {"field": "label"}, "aggs": {"s": {"significant_terms": {"field": "text", "min_doc_count": 0}}}}}}
    feature = {"field": "text", "number": "tf", "type": "string", "tokens": "significant_terms", "index": "d", "request": request}
    assert spec.prepare_spec({"features": [feature]}, {"d": df}).features[0].terms == ("bad", "good")


def test_linear_scores(docs):
    assert {r.doc_id: r.score for r in linear_scores(docs, {"a": 2.0, "dog": -1.0}, 0.5).collect()} == {1: 3.5, 2: 1.5, 3: 0.5, 4: 0.5, 5: 0.5}


def test_vectors_of_rows_that_share_an_id(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a", ["x"]), (1, "a c", None), (None, "b", ["y", "x"]), (None, "b b", []), (2, None, None), (3, "c zonk", ["x", "x"])], "doc_id int, text string, tags array<string>")
    s = VectorSpec((Feature("text", "tf_idf", ("a", "b", "c")), Feature("tags", "occurrence", ("x", "y"))), True)
    idf = {k: math.log(7 / (n + 1)) for k, n in (("a", 2), ("b", 3), ("c", 2))}
    monkeypatch.setattr("textlab.operators.vectorize.INLINE_TERMS", 0)
    for slice_tokens, broadcast in ((500_000, 1_000_000), (1, 1_000_000), (1, 0)):
        monkeypatch.setattr("textlab.operators.vectorize.SLICE_TOKENS", slice_tokens)
        monkeypatch.setattr("textlab.operators.vectorize.BROADCAST_TERMS", broadcast)
        got = {r.doc_id: (r.vector["indices"], r.vector["values"]) for r in vectorize(df, s, analyzers={"tags": "keyword"}).collect()}
        want = {1: {0: 3 * idf["a"], 1: idf["b"], 2: idf["c"], 3: 1}, None: {1: 3 * idf["b"], 3: 1, 4: 1}, 2: {}, 3: {2: idf["c"], 3: 1}}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert sorted(got[k][0]) == sorted(v) and dict(zip(*got[k], strict=True)) == pytest.approx(v)


def test_statistics_of_frequent_terms_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "a b d d"), (3, "d e"), (4, "")], "doc_id int, text string")
    want = {(1, "a", 2, 3, 4), (1, "b", 1, 2, 2), (2, "a", 1, 3, 4), (2, "c", 1, 1, 1), (3, "a", 1, 3, 4), (3, "b", 1, 2, 2), (3, "d", 3, 1, 3), (3, "e", 1, 1, 1)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (0, 2, 99):
            monkeypatch.setattr(termvectors, "FREQUENT_TERMS", limit)
            v = termvectors.term_vectors(df, term_statistics=True)
            assert "BroadcastHashJoin" in v._jdf.queryExecution().executedPlan().toString()
            got = [(r.doc_id, r.term, r.tf, r.df, r.ttf) for r in v.collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
