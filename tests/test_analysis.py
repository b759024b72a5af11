import pytest
from pyspark.sql import functions as F

from textlab.functions import analysis as A
from textlab.streaming.ingest import ingest_analyze, ingest_stream


def tokens(spark, text, analyzer):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(A.tokens_of(df, "text", analyzer).alias("t")).first().t


@pytest.mark.parametrize(
    ("analyzer", "text", "wanted"),
    [
        ("standard", "Red, blue and GREEN! I don't", ["red", "blue", "and", "green", "i", "don't"]),
        ("standard", "", []),
        ("standard", None, None),
        ("whitespace", " I am,  me\n", ["I", "am,", "me"]),
        ("keyword", "One whole Thing", ["One whole Thing"]),
        ("simple", "a1b, C", ["a", "b", "c"]),
        ("stop", "This is the house", ["house"]),
        (A.chain("keyword", ["lowercase"]), "Red, Blue", ["red, blue"]),
        (A.chain("whitespace", ["lowercase"]), "Red, Blue", ["red,", "blue"]),
        (A.chain("standard", ["asciifolding", "unique"]), "é e É ß", ["e", "E", "ss"]),
        (A.chain("standard", [], ["html_strip"]), "<p>a&amp;b</p><script>x</script>", ["a", "b"]),
        (A.Analyzer(A.ngram(1, 2)), "abc", ["a", "ab", "b", "bc", "c"]),
        (A.Analyzer(A.whitespace, (A.edge_ngram(1, 2), A.reverse)), "abc d", ["a", "ba", "d"]),
        (A.Analyzer(A.whitespace, (A.length(2, 3), A.uppercase, A.truncate(2))), "a bcd efghi", ["BC"]),
        (A.Analyzer(A.whitespace, (), (A.mapping({"&": "and"}), A.pattern_replace("[0-9]+", "#"))), "a & 12", ["a", "and", "#"]),
    ],
)
def test_analyzers(spark, analyzer, text, wanted):
    assert tokens(spark, text, analyzer) == wanted


def test_unknown_parts():
    for make, part in ((lambda: A.resolve("x"), "analyzer"), (lambda: A.chain("x"), "tokenizer"), (lambda: A.chain("standard", ["x"]), "token filter"), (lambda: A.chain("standard", [], ["x"]), "char filter")):
        with pytest.raises(A.UnknownPart, match=rf"failed to find {part} \[x\]"):
            make()


def test_registry_keeps_old_definitions_after_a_bad_update(spark):
    r = A.Registry()
    r.update({"filter": {"short": {"type": "length", "max": 3}}, "analyzer": {"own": {"tokenizer": "whitespace", "filter": ["short"]}}})
    with pytest.raises(A.UnknownPart):
        r.update({"analyzer": {"own": {"tokenizer": "nothing"}}})
    assert tokens(spark, "a long word", r.get("own")) == ["a"]
    r.update({"analyzer": {"other": {"type": "keyword"}}})
    with pytest.raises(A.UnknownPart):
        r.get("own")


def test_ingest(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b", ["C d", None, "e"]), (2, None, None)], "id int, one string, many array<string>")
    rows = ingest_analyze(ingest_analyze(df, "one", "standard"), "many", "standard", "t").orderBy("id").collect()
    assert (rows[0].one, rows[0].t) == (["a", "b"], ["c", "d", "e"]) and rows[1].one is None and rows[1].t is None
    with pytest.raises(Exception, match="is null"):
        ingest_analyze(df, "one", "standard", strict=True).collect()
    with pytest.raises(ValueError, match="can't be analyzed"):
        ingest_analyze(df, "id", "standard")
    with pytest.raises(ValueError, match="not found"):
        ingest_analyze(df, "none", "standard")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "one", "whitespace").awaitTermination()
    assert [r.one for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == [["A", "b"], None]


def test_analyzed_text_reads_nested_fields(spark):
    df = spark.createDataFrame([(1, "A b")], "id int, t string").select("id", F.struct(F.col("t").alias("b")).alias("a"))
    assert A.analyzed_text(df, "a.b").first().analyzed_text == ["a", "b"]
