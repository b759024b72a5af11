"""PMML models: a small tree of dataclasses, read from XML and written to it."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from dataclasses import field as made_by


class Unsupported(ValueError):
    """A model, or a part of one, that can't be scored."""


@dataclass
class DataField:
    name: str
    optype: str
    data_type: str
    values: list[str] = made_by(default_factory=list)


@dataclass
class MiningField:
    name: str
    usage: str = "active"
    missing: str | None = None


@dataclass
class Norm:
    """Linear through two points (original value, normalised value)."""

    source: str
    points: list[tuple[float, float]]


@dataclass
class IfMissing:
    """A constant where the source is missing."""

    source: str
    constant: str


@dataclass
class Alias:
    source: str


@dataclass
class Derived:
    name: str
    optype: str
    data_type: str
    step: Norm | IfMissing | Alias


@dataclass
class GeneralRegression:
    kind: str
    distribution: str | None
    link: str | None
    parameters: list[str]
    factors: list[str]
    covariates: list[str]
    cells: list[tuple[str, str, str]]  # value, predictor, parameter
    betas: list[tuple[str, float, str | None]]  # parameter, beta, target category


@dataclass
class RegressionTable:
    category: str
    intercept: float
    coefficients: list[tuple[str, float]]


@dataclass
class Regression:
    name: str
    tables: list[RegressionTable]


@dataclass
class Gaussian:
    name: str
    stats: dict[str, tuple[float, float]]  # class -> mean, variance


@dataclass
class Counts:
    name: str
    counts: dict[str, dict[str, float]]  # value -> class -> count


@dataclass
class NaiveBayes:
    threshold: float
    inputs: list[Gaussian | Counts]
    classes: dict[str, float]


@dataclass
class Predicate:
    """``op`` is true, false, a comparison, isMissing, isNotMissing, and, or, xor, surrogate, isIn or isNotIn."""

    op: str
    field: str | None = None
    value: str | None = None
    values: list[str] = made_by(default_factory=list)
    parts: list[Predicate] = made_by(default_factory=list)


@dataclass
class Node:
    predicate: Predicate
    score: str | None
    children: list[Node] = made_by(default_factory=list)


@dataclass
class Tree:
    root: Node


Body = GeneralRegression | Regression | NaiveBayes | Tree


@dataclass
class Pmml:
    fields: list[DataField]
    mining: list[MiningField]
    derived: list[Derived]
    model: Body

    def field(self, name: str) -> DataField:
        for f in self.fields:
            if f.name == name:
                return f
        raise Unsupported(f"field [{name}] is not in the data dictionary")

    @property
    def target(self) -> str | None:
        return next((m.name for m in self.mining if m.usage in ("predicted", "target")), None)


def _bare(element: ET.Element) -> ET.Element:
    for e in element.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return element


def _array(e: ET.Element) -> list[str]:
    text, out, now, quoted, any_ = e.text or "", [], "", False, False
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] == '"':
            now += '"'
            i += 1
        elif c == '"':
            quoted, any_ = not quoted, True
        elif c.isspace() and not quoted:
            if now or any_:
                out.append(now)
            now, any_ = "", False
        else:
            now += c
        i += 1
    if now or any_:
        out.append(now)
    return out


def _derived(e: ET.Element) -> Derived:
    name, optype, kind = e.get("name"), e.get("optype"), e.get("dataType")
    body = next((c for c in e if c.tag != "Extension"), None)
    if body is None:
        raise Unsupported(f"derived field [{name}] is empty")
    if body.tag == "NormContinuous":
        points = [(float(p.get("orig")), float(p.get("norm"))) for p in body.findall("LinearNorm")]
        if len(points) != 2:
            raise Unsupported(f"NormContinuous of [{name}] must have exactly two LinearNorm")
        return Derived(name, optype, kind, Norm(body.get("field"), points))
    if body.tag == "FieldRef":
        return Derived(name, optype, kind, Alias(body.get("field")))
    if body.tag == "Apply" and body.get("function") == "if":
        parts = list(body)
        if len(parts) == 3 and parts[0].tag == "Apply" and parts[0].get("function") == "isMissing" and parts[1].tag == "Constant" and parts[2].tag == "FieldRef":
            return Derived(name, optype, kind, IfMissing(parts[2].get("field"), (parts[1].text or "").strip()))
    raise Unsupported(f"can't evaluate derived field [{name}]")


def _predicate(e: ET.Element) -> Predicate:
    if e.tag in ("True", "False"):
        return Predicate(e.tag.lower())
    if e.tag == "SimplePredicate":
        return Predicate(e.get("operator"), e.get("field"), e.get("value"))
    if e.tag == "SimpleSetPredicate":
        return Predicate(e.get("booleanOperator"), e.get("field"), values=_array(e.find("Array")))
    if e.tag == "CompoundPredicate":
        return Predicate(e.get("booleanOperator"), parts=[_predicate(c) for c in e if c.tag in _PREDICATES])
    raise Unsupported(f"unknown predicate [{e.tag}]")


_PREDICATES = ("True", "False", "SimplePredicate", "SimpleSetPredicate", "CompoundPredicate")


def _node(e: ET.Element) -> Node:
    found = [c for c in e if c.tag in _PREDICATES]
    return Node(_predicate(found[0]) if found else Predicate("true"), e.get("score"), [_node(c) for c in e.findall("Node")])


def _general(m: ET.Element) -> GeneralRegression:
    names = lambda path: [p.get("name") for p in m.findall(path)]
    return GeneralRegression(
        m.get("modelType"), m.get("distribution"), m.get("linkFunction"), names("ParameterList/Parameter"), names("FactorList/Predictor"), names("CovariateList/Predictor"),
        [(c.get("value"), c.get("predictorName"), c.get("parameterName")) for c in m.findall("PPMatrix/PPCell")],
        [(c.get("parameterName"), float(c.get("beta")), c.get("targetCategory")) for c in m.findall("ParamMatrix/PCell")],
    )


def _regression(m: ET.Element) -> Regression:
    tables = []
    for t in m.findall("RegressionTable"):
        if t.findall("CategoricalPredictor") or t.findall("PredictorTerm"):
            raise Unsupported("only numeric predictors are supported in a RegressionModel")
        tables.append(RegressionTable(t.get("targetCategory"), float(t.get("intercept", 0)), [(p.get("name"), float(p.get("coefficient"))) for p in t.findall("NumericPredictor")]))
    return Regression(m.get("modelName", ""), tables)


def _bayes(m: ET.Element) -> NaiveBayes:
    inputs: list[Gaussian | Counts] = []
    for b in m.findall("BayesInputs/BayesInput"):
        stats = b.findall("TargetValueStats/TargetValueStat")
        if stats:
            inputs.append(Gaussian(b.get("fieldName"), {s.get("value"): (float(s.find("GaussianDistribution").get("mean")), float(s.find("GaussianDistribution").get("variance"))) for s in stats}))
        else:
            inputs.append(Counts(b.get("fieldName"), {p.get("value"): {c.get("value"): float(c.get("count")) for c in p.findall("TargetValueCounts/TargetValueCount")} for p in b.findall("PairCounts")}))
    classes = {c.get("value"): float(c.get("count")) for c in m.findall("BayesOutput/TargetValueCounts/TargetValueCount")}
    return NaiveBayes(float(m.get("threshold")), inputs, classes)


def _tree(m: ET.Element) -> Tree:
    wanted = {"functionName": "classification", "splitCharacteristic": "binarySplit", "missingValueStrategy": "defaultChild", "noTrueChildStrategy": "returnLastPrediction"}
    for name, value in wanted.items():
        if m.get(name) != value:
            raise Unsupported(f"only tree models with {name} = {value} are supported")
    return Tree(_node(m.find("Node")))


#: Readers by element; more kinds of models can be added.
READERS = {"GeneralRegressionModel": _general, "RegressionModel": _regression, "NaiveBayesModel": _bayes, "TreeModel": _tree}
_MODELS = {*READERS, "SupportVectorMachineModel", "NeuralNetwork", "ClusteringModel", "MiningModel", "RuleSetModel", "AssociationModel", "Scorecard", "TextModel", "SequenceModel", "TimeSeriesModel", "NearestNeighborModel", "BaselineModel", "BayesianNetworkModel", "GaussianProcessModel"}


def parse(xml: str) -> Pmml:
    """The one model of a PMML document."""
    root = _bare(ET.fromstring(xml.strip()))
    models = [e for e in root if e.tag in _MODELS]
    if len(models) != 1:
        raise Unsupported(f"a document must have exactly one model, this one has {len(models)}")
    (m,) = models
    if m.tag not in READERS:
        raise Unsupported(f"Unsupported model type [{m.tag}]")
    fields = [DataField(d.get("name"), d.get("optype"), d.get("dataType"), [v.get("value") for v in d.findall("Value")]) for d in root.findall("DataDictionary/DataField")]
    mining = [MiningField(f.get("name"), f.get("usageType", "active"), f.get("missingValueReplacement")) for f in m.findall("MiningSchema/MiningField")]
    derived = [_derived(d) for path in ("TransformationDictionary", "LocalTransformations") for p in (root if path[0] == "T" else m).findall(path) for d in p.findall("DerivedField")]
    if m.tag in ("GeneralRegressionModel", "RegressionModel") and m.get("functionName") != "classification":
        raise Unsupported("only classification is supported")
    return Pmml(fields, mining, derived, READERS[m.tag](m))


def write(p: Pmml) -> str:
    """PMML 4.2 of a model."""
    text = lambda x: repr(float(x))
    root = ET.Element("PMML", {"version": "4.2", "xmlns": "http://www.dmg.org/PMML-4_2"})
    ET.SubElement(root, "Header")
    fields = ET.SubElement(root, "DataDictionary", {"numberOfFields": str(len(p.fields))})
    for f in p.fields:
        e = ET.SubElement(fields, "DataField", {"name": f.name, "optype": f.optype, "dataType": f.data_type})
        for v in f.values:
            ET.SubElement(e, "Value", {"value": v})
    tag = {GeneralRegression: "GeneralRegressionModel", Regression: "RegressionModel", NaiveBayes: "NaiveBayesModel", Tree: "TreeModel"}[type(p.model)]
    m = ET.SubElement(root, tag, {"functionName": "classification"})
    schema = ET.SubElement(m, "MiningSchema")
    for f in p.mining:
        ET.SubElement(schema, "MiningField", {"name": f.name, "usageType": f.usage} | ({"missingValueReplacement": f.missing} if f.missing is not None else {}))
    if p.derived:
        local = ET.SubElement(m, "LocalTransformations")
        for d in p.derived:
            e = ET.SubElement(local, "DerivedField", {"name": d.name, "optype": d.optype, "dataType": d.data_type})
            if isinstance(d.step, Norm):
                n = ET.SubElement(e, "NormContinuous", {"field": d.step.source})
                for a, b in d.step.points:
                    ET.SubElement(n, "LinearNorm", {"orig": text(a), "norm": text(b)})
            elif isinstance(d.step, IfMissing):
                outer = ET.SubElement(e, "Apply", {"function": "if"})
                ET.SubElement(ET.SubElement(outer, "Apply", {"function": "isMissing"}), "FieldRef", {"field": d.step.source})
                ET.SubElement(outer, "Constant").text = d.step.constant
                ET.SubElement(outer, "FieldRef", {"field": d.step.source})
            else:
                ET.SubElement(e, "FieldRef", {"field": d.step.source})
    b = p.model
    if isinstance(b, GeneralRegression):
        m.attrib |= {k: v for k, v in (("modelType", b.kind), ("distribution", b.distribution), ("linkFunction", b.link)) if v}
        for path, item, names in (("ParameterList", "Parameter", b.parameters), ("FactorList", "Predictor", b.factors), ("CovariateList", "Predictor", b.covariates)):
            e = ET.SubElement(m, path)
            for n in names:
                ET.SubElement(e, item, {"name": n})
        e = ET.SubElement(m, "PPMatrix")
        for value, predictor, parameter in b.cells:
            ET.SubElement(e, "PPCell", {"value": value, "predictorName": predictor, "parameterName": parameter})
        e = ET.SubElement(m, "ParamMatrix")
        for parameter, beta, category in b.betas:
            ET.SubElement(e, "PCell", {"parameterName": parameter, "beta": text(beta)} | ({"targetCategory": category} if category else {}))
    elif isinstance(b, Regression):
        m.set("modelName", b.name)
        for t in b.tables:
            e = ET.SubElement(m, "RegressionTable", {"targetCategory": t.category, "intercept": text(t.intercept)})
            for n, c in t.coefficients:
                ET.SubElement(e, "NumericPredictor", {"name": n, "coefficient": text(c)})
    elif isinstance(b, NaiveBayes):
        m.set("threshold", text(b.threshold))
        inputs = ET.SubElement(m, "BayesInputs")
        for i in b.inputs:
            e = ET.SubElement(inputs, "BayesInput", {"fieldName": i.name})
            if isinstance(i, Gaussian):
                stats = ET.SubElement(e, "TargetValueStats")
                for c, (mean, variance) in i.stats.items():
                    ET.SubElement(ET.SubElement(stats, "TargetValueStat", {"value": c}), "GaussianDistribution", {"mean": text(mean), "variance": text(variance)})
            else:
                for v, counts in i.counts.items():
                    pair = ET.SubElement(ET.SubElement(e, "PairCounts", {"value": v}), "TargetValueCounts")
                    for c, n in counts.items():
                        ET.SubElement(pair, "TargetValueCount", {"value": c, "count": text(n)})
        out = ET.SubElement(ET.SubElement(m, "BayesOutput", {"fieldName": p.target or "class"}), "TargetValueCounts")
        for c, n in b.classes.items():
            ET.SubElement(out, "TargetValueCount", {"value": c, "count": text(n)})
    else:
        m.attrib |= {"splitCharacteristic": "binarySplit", "missingValueStrategy": "defaultChild", "noTrueChildStrategy": "returnLastPrediction"}
        _write_node(m, b.root)
    return ET.tostring(root, encoding="unicode")


def _write_node(parent: ET.Element, n: Node) -> None:
    e = ET.SubElement(parent, "Node", {"score": n.score} if n.score is not None else {})
    _write_predicate(e, n.predicate)
    for c in n.children:
        _write_node(e, c)


def _write_predicate(parent: ET.Element, p: Predicate) -> None:
    if p.op in ("true", "false"):
        ET.SubElement(parent, p.op.capitalize())
    elif p.op in ("and", "or", "xor", "surrogate"):
        e = ET.SubElement(parent, "CompoundPredicate", {"booleanOperator": p.op})
        for q in p.parts:
            _write_predicate(e, q)
    elif p.op in ("isIn", "isNotIn"):
        e = ET.SubElement(parent, "SimpleSetPredicate", {"field": p.field, "booleanOperator": p.op})
        ET.SubElement(e, "Array", {"type": "string", "n": str(len(p.values))}).text = " ".join('"' + v.replace('"', '\\"') + '"' for v in p.values)
    else:
        ET.SubElement(parent, "SimplePredicate", {"field": p.field, "operator": p.op} | ({"value": p.value} if p.value is not None else {}))
