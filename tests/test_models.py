import math

import pytest
from pyspark.sql import functions as F

from textlab.api import Textlab
from textlab.plans import train
from textlab.plans.compile import score
from textlab.plans.pmml import Counts, DataField, Derived, Gaussian, GeneralRegression, IfMissing, MiningField, NaiveBayes, Node, Norm, Pmml, Predicate, Regression, RegressionTable, Tree, Unsupported, parse, write
from textlab.sources.store import ModelStore

AGE, WORK, CLASS = DataField("age", "continuous", "double"), DataField("work", "categorical", "string", ["p", "q"]), DataField("y", "categorical", "string", ["hi", "lo"])


def glm(work_missing=None, cells=None):
    derived = [Derived("age0", "continuous", "double", IfMissing("age", "10")), Derived("z", "continuous", "double", Norm("age0", [(0.0, -1.0), (10.0, 1.0)]))]
    betas = [("p0", 0.5, "hi"), ("pp", 1.5, "hi"), ("pz", -2.0, "hi")]
    model = GeneralRegression("multinomialLogistic", None, None, ["p0", "pp", "pz"], ["work"], ["z"], cells or [("p", "work", "pp"), ("1", "z", "pz")], betas)
    return Pmml([AGE, WORK, CLASS], [MiningField("age"), MiningField("work", "active", work_missing), MiningField("y", "predicted")], derived, model)


def people(spark, work="string"):
    return spark.createDataFrame([(1, 5.0, "p"), (2, None, "q"), (3, 20.0, None)], "id int, age double, work string")


def results(df):
    return {r.id: r.prediction for r in df.collect()}


def test_glm(spark):
    got = results(score(people(spark), write(glm())))
    for i, z in ((1, 2.0), (2, -1.5), (3, 0.5 - 2 * 3.0)):
        p = 1 / (1 + math.exp(-z))
        assert got[i]["class"] == ("hi" if z > 0 else "lo") and got[i].probs["hi"] == pytest.approx(p) and got[i].probs["lo"] == pytest.approx(1 - p)
    assert results(score(people(spark), glm("p"), debug=False))[3] == "lo"
    many = people(spark).withColumn("work", F.array(F.lit("p"), F.lit("q")))
    assert results(score(many, glm()))[1].probs["hi"] == pytest.approx(1 / (1 + math.exp(-2)))
    with pytest.raises(Unsupported, match="several predictors"):
        score(people(spark), glm(cells=[("p", "work", "pp"), ("1", "z", "pp")]))


def test_regression_and_missing_input(spark):
    def model(name):
        return Pmml([AGE, CLASS], [MiningField("age"), MiningField("y", "predicted")], [], Regression(name, [RegressionTable("hi", -6.0, [("age", 1.0)]), RegressionTable("lo", 0.0, [])]))

    got = results(score(people(spark), model("logistic regression")))
    assert got[1]["class"] == "lo" and got[2] is None and got[3].probs["hi"] == pytest.approx(1 / (1 + math.exp(-14)))
    assert results(score(people(spark), write(model("linear SVM")), debug=False)) == {1: "lo", 2: None, 3: "hi"}
    with pytest.raises(Exception, match="is missing"):
        score(people(spark), model("linear SVM"), strict=True).collect()
    with pytest.raises(Unsupported):
        score(people(spark), model("other"))


def test_naive_bayes(spark):
    m = NaiveBayes(0.01, [Gaussian("age", {"hi": (10.0, 4.0), "lo": (20.0, 9.0)}), Counts("work", {"p": {"hi": 3, "lo": 0}, "q": {"hi": 1, "lo": 2}})], {"hi": 4, "lo": 2})
    df = spark.createDataFrame([(1, 12.0, "p"), (2, 12.0, "unknown"), (3, None, "p")], "id int, age double, work string")
    got = results(score(df, write(Pmml([AGE, WORK, CLASS], [MiningField("age"), MiningField("work"), MiningField("y", "predicted")], [], m))))
    gauss = lambda x, mean, v: math.exp(-((x - mean) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v)
    a, b = 4 / 6 * gauss(12, 10, 4) * 3 / 4, 2 / 6 * gauss(12, 20, 9) * 0.01
    assert got[1]["class"] == "hi" and got[1].probs["hi"] == pytest.approx(a / (a + b))
    a, b = 4 / 6 * gauss(12, 10, 4), 2 / 6 * gauss(12, 20, 9)
    assert got[2].probs["hi"] == pytest.approx(a / (a + b)) and got[3] is None


def tree(root):
    fields = [AGE, WORK, DataField("n", "categorical", "integer")]
    return write(Pmml([*fields, CLASS], [MiningField(f.name) for f in fields] + [MiningField("y", "predicted")], [], Tree(root)))


@pytest.mark.parametrize(
    ("predicate", "wanted"),
    [
        (Predicate("lessThan", "age", "6"), {1}),
        (Predicate("notEqual", "work", "p"), {2}),
        (Predicate("isMissing", "work"), {3}),
        (Predicate("isNotMissing", "age"), {1, 3}),
        (Predicate("isIn", "n", values=["1", "3"]), {1, 3}),
        (Predicate("isNotIn", "work", values=["p", "x y"]), {2}),
        (Predicate("and", parts=[Predicate("equal", "n", "1"), Predicate("equal", "work", "p")]), {1}),
        (Predicate("or", parts=[Predicate("equal", "n", "2"), Predicate("equal", "work", "p")]), {1, 2}),
        (Predicate("xor", parts=[Predicate("equal", "n", "1"), Predicate("equal", "work", "p"), Predicate("true")]), {2, 3}),
        (Predicate("surrogate", parts=[Predicate("greaterThan", "age", "10"), Predicate("equal", "work", "q")]), {2, 3}),
        (Predicate("false"), set()),
    ],
)
def test_predicates(spark, predicate, wanted):
    df = people(spark).withColumn("n", F.col("id"))
    root = Node(Predicate("true"), "lo", [Node(predicate, "hi")])
    assert {i for i, c in results(score(df, tree(root), debug=False)).items() if c == "hi"} == wanted


def test_tree_takes_the_first_child_and_keeps_the_last_score(spark):
    inner = Node(Predicate("greaterOrEqual", "age", "5"), "a", [Node(Predicate("equal", "work", "zz"), "b")])
    root = Node(Predicate("true"), "lo", [inner, Node(Predicate("true"), "c")])
    assert results(score(people(spark).withColumn("n", F.col("id")), tree(root), debug=False)) == {1: "a", 2: "c", 3: "a"}


def test_unsupported_documents():
    xml = write(glm())
    with pytest.raises(Unsupported, match="exactly one"):
        parse("<PMML></PMML>")
    with pytest.raises(Unsupported, match="Unsupported model type"):
        parse("<PMML><SupportVectorMachineModel/></PMML>")
    with pytest.raises(Unsupported, match="two LinearNorm"):
        parse(xml.replace('<LinearNorm orig="0.0" norm="-1.0" />', ""))
    with pytest.raises(Unsupported, match="binarySplit"):
        parse(tree(Node(Predicate("true"), "a")).replace("binarySplit", "multiSplit"))


def test_train_store_load_score(spark, tmp_path):
    rows = [("red red car", "k", 1.0, "x"), ("red bus", "l", 2.0, "x"), ("blue car", "k", 5.0, "y"), ("blue", "k", 7.0, "y"), ("grey", "l", 9.0, None)]
    df = spark.createDataFrame(rows, "text string, kind string, num double, label string")
    fields = [{"name": "text", "analyzer": "standard"}, "kind", "num"]
    api = Textlab({"t": df}, ModelStore(spark, str(tmp_path)))
    assert api.train_model({"type": "naive_bayes", "target_field": "label", "fields": fields, "training_set": {"index": "t"}, "id": "m"}) == {"id": "m"}
    m = api.store.get("m").model
    assert m.threshold == 0.2 and m.classes == {"x": 2, "y": 2} and m.inputs[0].counts["red"] == {"x": 2, "y": 0} and m.inputs[2].stats["y"] == (6.0, 1.0)
    got = score(train.with_tokens(df, fields), api.store.get("m"), debug=False).collect()
    assert [r.prediction for r in got][:4] == ["x", "x", "y", "y"]
    assert api.store.ids() == ["m"]
    with pytest.raises(KeyError):
        api.store.get("none")
    with pytest.raises(ValueError, match="model is missing"):
        api.store_model('{"spec": 1}')
    with pytest.raises(ValueError, match=r"input field \[none\] not found"):
        train.train("naive_bayes", df, "label", ["none"])
    with pytest.raises(ValueError, match="two classes"):
        train.train("naive_bayes", df.where("label = 'x'"), "label", ["kind"])
    with pytest.raises(ValueError, match="unsupported type"):
        train.train("naive_bayes", df.withColumn("b", F.lit(True)), "label", ["b"])
    with pytest.raises(ValueError, match="unknown model type"):
        train.train("forest", df, "label", ["kind"])


def test_text_model_equals_the_one_on_the_driver(spark):
    from textlab.plans import train

    rows = [(1, "good fine day", "p"), (2, "bad day", "n"), (3, "fine fine good", "p"), (4, "awful bad", "n"), (5, "day", None), (6, None, "n"), (7, "unknown words", None), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    fields = [{"name": "text", "analyzer": "standard"}]
    driver = score(train.with_tokens(df, fields), train.train("naive_bayes", df, "label", fields))
    want = {r.doc_id: r.prediction for r in driver.collect()}
    got = {r.doc_id: r.prediction for r in train.score_text(df, train.text_bayes(df, "label")).collect()}
    assert set(got) == set(want) == set(range(1, 9))
    for i in want:
        assert got[i]["class"] == want[i]["class"] and got[i]["probs"] == pytest.approx(want[i]["probs"])
    with pytest.raises(ValueError, match="two classes"):
        train.text_bayes(df.where("label = 'p'"), "label")


def test_large_models_and_vocabularies_raise(spark, monkeypatch):
    from textlab.operators import spec
    from textlab.plans import train

    df = spark.createDataFrame([("a b c d", "x"), ("e f", "y")], "text string, label string")
    monkeypatch.setattr(train, "MODEL_VALUES", 2)
    with pytest.raises(ValueError, match="more than 2 values"):
        train.train("naive_bayes", df, "label", [{"name": "text", "analyzer": "standard"}])
    monkeypatch.setattr(spec, "VOCABULARY", 3)
    request = {"features": [{"field": "text", "number": "tf", "type": "string", "tokens": "all_terms", "index": "i", "min_doc_freq": 0}]}
    with pytest.raises(ValueError, match="more than 3 terms"):
        spec.prepare_spec(request, {"i": df})


def test_each_likelihood_is_planned_once(spark):
    from textlab.plans import train

    df = spark.createDataFrame([(float(i), "xyz"[i % 3]) for i in range(30)], "v double, label string")
    plan = score(df, train.train("naive_bayes", df, "label", ["v"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("power(") == 3


def test_frequent_parameters_are_broadcast_and_rare_ones_shuffled(spark, monkeypatch):
    from textlab.operators.postings import least_frequent

    rows = [(1, "the good day", "p"), (2, "the bad day", "n"), (3, "the fine the good", "p"), (4, "the awful bad", "n"), (5, "the day rare", None), (6, None, "n"), (7, "unknown words", None), (8, "", None), (9, "awful fine", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string")
    model = train.text_bayes(df, "label")
    want = {r.doc_id: r.prediction for r in train.score_text(df, model).collect()}
    assert least_frequent(model.terms, "n", 1) == 4 and least_frequent(model.terms, "n", 4) == 2 and least_frequent(model.terms, "n", 99) is None
    monkeypatch.setattr(train, "MODEL_VALUES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (0, 1, 4):
            monkeypatch.setattr(train, "FREQUENT_TERMS", limit)
            got = train.score_text(df, model)
            assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
            got = {r.doc_id: r.prediction for r in got.collect()}
            assert set(got) == set(want) == set(range(1, 10))
            for i in want:
                assert got[i]["class"] == want[i]["class"] and got[i]["probs"] == pytest.approx(want[i]["probs"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
