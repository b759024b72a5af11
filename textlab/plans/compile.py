"""PMML models as Spark expressions, so that scoring stays in generated code.

``score`` gives ``struct<class:string[, probs:map<string,double>]>``, or the bare class. A
missing continuous input without a replacement gives a null prediction, or an error with
``strict``. An unknown or missing category adds nothing. Predicates on missing fields are
false. Array columns are multi-valued fields: categories and set predicates take any of the
values, continuous inputs the first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.plans.pmml import Alias, Gaussian, GeneralRegression, IfMissing, NaiveBayes, Node, Norm, Pmml, Predicate, Regression, Tree, Unsupported, parse

_TYPES = {"double": "double", "float": "float", "integer": "bigint", "string": "string", "boolean": "boolean"}


class Inputs:
    """A model's fields as columns of a table, with preprocessing."""

    def __init__(self, p: Pmml, schema: T.StructType, strict: bool = False) -> None:
        self.p, self.strict = p, strict
        self.derived = {d.name: d for d in p.derived}
        self.missing = {m.name: m.missing for m in p.mining}
        self.kinds = {f.name: f.dataType for f in schema}

    def raw(self, name: str) -> str:
        """The data field that a name comes from."""
        seen = set()
        while name in self.derived:
            if name in seen:
                raise Unsupported(f"derived field [{name}] refers to itself")
            seen.add(name)
            name = self.derived[name].step.source
        return name

    def many(self, name: str) -> bool:
        return isinstance(self.kinds.get(self.raw(name)), T.ArrayType)

    def data_type(self, name: str) -> str:
        return self.derived[name].data_type if name in self.derived else self.p.field(name).data_type

    def optype(self, name: str) -> str:
        return self.derived[name].optype if name in self.derived else self.p.field(name).optype

    def literal(self, value: str, kind: str) -> Column:
        if kind not in _TYPES:
            raise Unsupported(f"data type [{kind}] is not supported")
        if kind == "string":
            return F.lit(value)
        if kind == "boolean":
            return F.lit(value.strip().lower() == "true")
        number = float(value)
        return F.lit(int(number)).cast("bigint") if kind == "integer" and number == int(number) else F.lit(number).cast("double" if kind == "integer" else _TYPES[kind])

    def column(self, name: str) -> Column:
        """The value of a field, or the array of its values; replacements and derivations applied."""
        if name in self.derived:
            d = self.derived[name]
            source = self.column(d.step.source)
            if isinstance(d.step, Alias):
                return source
            if isinstance(d.step, IfMissing):
                constant = self.literal(d.step.constant, d.data_type)
                return self._filled(source, constant, self.many(name))
            (a1, b1), (a2, b2) = d.step.points
            line = lambda x: F.lit(b1) + (x.cast("double") - F.lit(a1)) * F.lit((b2 - b1) / (a2 - a1))
            return F.transform(source, line) if self.many(name) else line(source)
        if name not in self.kinds:
            raise ValueError(f"the table has no column [{name}]")
        kind = _TYPES.get(self.p.field(name).data_type)
        if kind is None:
            raise Unsupported(f"data type [{self.p.field(name).data_type}] is not supported")
        many = self.many(name)
        out = F.col(f"`{name}`").cast(f"array<{kind}>" if many else kind)
        if self.missing.get(name) is not None:
            out = self._filled(out, self.literal(self.missing[name], self.p.field(name).data_type), many)
        return out

    @staticmethod
    def _filled(x: Column, constant: Column, many: bool) -> Column:
        if many:
            return F.when(x.isNull() | (F.size(x) == 0), F.array(constant)).otherwise(F.transform(x, lambda v: F.coalesce(v, constant)))
        return F.coalesce(x, constant)

    def number(self, name: str) -> Column:
        x = self.column(name)
        x = (F.get(x, F.lit(0)) if self.many(name) else x).cast("double")
        return F.coalesce(x, F.raise_error(F.lit(f"field [{name}] is missing")).cast("double")) if self.strict else x

    def is_category(self, name: str, value: str) -> Column:
        """True where the field has this category; never null."""
        x = self.column(name)
        wanted = F.lit(value) if self.data_type(name) == "string" else self.literal(value, self.data_type(name))
        return F.coalesce(F.array_contains(x, wanted) if self.many(name) else x == wanted, F.lit(False))

    def lookup(self, name: str, table: dict[str, float]) -> Column:
        """The sum of a table's values over the categories that the field has; 0 for others."""
        if not table:
            return F.lit(0.0)
        m = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
        x = self.column(name)
        one = lambda v: F.coalesce(F.try_element_at(m, v.cast("string")), F.lit(0.0))
        if self.many(name):
            return F.coalesce(F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + one(v)), F.lit(0.0))
        return one(x)


def _answer(label: Column, probs: dict[str, Column] | None, debug: bool, known: Column | None = None) -> Column:
    if not debug:
        out = label
    elif probs is None:
        out = F.struct(label.alias("class"))
    else:
        out = F.struct(label.alias("class"), F.create_map(*[x for k, v in probs.items() for x in (F.lit(k), v)]).alias("probs"))
    return out if known is None else F.when(known, out)


def _logistic(z: Column, first: str, second: str, debug: bool) -> Column:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return _answer(F.when(z > 0, F.lit(first)).otherwise(F.lit(second)), {first: p, second: F.lit(1.0) - p}, debug, z.isNotNull())


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _general(p: Pmml, m: GeneralRegression, x: Inputs, debug: bool) -> Column:
    if not (m.kind == "multinomialLogistic" or (m.kind == "generalizedLinear" and m.distribution == "binomial" and m.link == "logit")):
        raise Unsupported(f"unsupported general regression [{m.kind}, {m.distribution}, {m.link}]")
    categories = list(dict.fromkeys(c for _, _, c in m.betas if c is not None))
    if len(categories) > 1:
        raise Unsupported("only one target category is supported")
    values = p.field(p.target).values if p.target else []
    first = categories[0] if categories else (values[0] if values else "1")
    others = [v for v in values if v != first]
    if not others:
        raise Unsupported("the data dictionary has no other target category")
    seen: set[str] = set()
    terms: dict[str, list[tuple[str, str]]] = {}
    for value, predictor, parameter in m.cells:
        if parameter in seen:
            raise Unsupported(f"parameter [{parameter}] of several predictors is not supported")
        seen.add(parameter)
        terms.setdefault(predictor, []).append((value, parameter))
    beta: dict[str, float] = {}
    for parameter, b, _ in m.betas:
        beta[parameter] = beta.get(parameter, 0.0) + b
    parts = [F.lit(sum(b for name, b in beta.items() if name not in seen))]
    for predictor in sorted(terms):
        if predictor in m.factors or (predictor not in m.covariates and x.optype(predictor) == "categorical"):
            parts.append(x.lookup(predictor, {v: beta.get(q, 0.0) for v, q in terms[predictor]}))
        else:
            parts += [x.number(predictor) * F.lit(beta.get(q, 0.0)) for _, q in terms[predictor]]
    return _logistic(_total(parts), first, others[-1], debug)


def _regression(p: Pmml, m: Regression, x: Inputs, debug: bool) -> Column:
    if len(m.tables) != 2:
        raise Unsupported("a regression model must have two tables")
    t = m.tables[0]
    z = _total([F.lit(t.intercept), *[x.number(n) * F.lit(c) for n, c in t.coefficients]])
    first, second = (t.category for t in m.tables)
    if m.name == "logistic regression":
        return _logistic(z, first, second, debug)
    if m.name == "linear SVM":
        return _answer(F.when(z > 0, F.lit(first)).otherwise(F.lit(second)), None, debug, z.isNotNull())
    raise Unsupported(f"unsupported regression model [{m.name}]")


def _bayes(p: Pmml, m: NaiveBayes, x: Inputs, debug: bool) -> Column:
    total = sum(m.classes.values())
    logs = {}
    for c, n in m.classes.items():
        parts, constant = [], math.log(n / total) if n else -math.inf
        for i in m.inputs:
            if isinstance(i, Gaussian):
                mean, variance = i.stats[c]
                parts.append(-(F.pow(x.number(i.name) - F.lit(mean), 2) / F.lit(2 * variance) if variance else F.pow(x.number(i.name) - F.lit(mean), 2) / F.lit(0.0)))
                constant -= math.log(math.sqrt(2 * math.pi * variance)) if variance else -math.inf
            else:
                share = {v: (k.get(c, 0.0) / n if k.get(c, 0.0) else m.threshold) for v, k in i.counts.items()}
                parts.append(x.lookup(i.name, {v: math.log(s) for v, s in share.items()}))
        logs[c] = _total([F.lit(constant), *parts])
    names = list(logs)
    if len(names) < 2:
        raise Unsupported("a Naive Bayes model needs two classes at least")
    # the log-likelihoods, and then their maximum, are bound once instead of copied into each use
    return _bound(F.array(*[logs[c] for c in names]), lambda v: F.when(~F.exists(v, lambda x: x.isNull()), bayes_answer(v, names, debug)))


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def bayes_answer(logs: Column, names: list[str], debug: bool) -> Column:
    """Class (the first of the most likely ones) and probabilities from an array of log-likelihoods by class."""
    classes = F.array(*map(F.lit, names))

    def answer(most: Column) -> Column:
        label = F.element_at(classes, F.array_position(logs, most).cast("int"))
        if not debug:
            return label
        each = F.transform(logs, lambda x: F.exp(x - most))
        return _bound(each, lambda e: F.struct(label.alias("class"), F.map_from_arrays(classes, F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))).alias("probs")))

    return _bound(F.array_max(logs), answer)


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda a, b: a == b, "notEqual": lambda a, b: a != b, "lessThan": lambda a, b: a < b, "lessOrEqual": lambda a, b: a <= b,
    "greaterThan": lambda a, b: a > b, "greaterOrEqual": lambda a, b: a >= b,
}


def predicate(p: Predicate, x: Inputs) -> Column:
    """A predicate as a column that is never null."""
    if p.op in ("true", "false"):
        return F.lit(p.op == "true")
    if p.op in ("and", "or"):
        return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), [predicate(q, x) for q in p.parts])
    if p.op == "xor":
        return _total([predicate(q, x).cast("int") for q in p.parts]) == 1
    if p.op == "surrogate":
        return F.coalesce(*[F.when(_present(q, x), predicate(q, x)) for q in p.parts], F.lit(False))
    column, many = x.column(p.field), x.many(p.field)
    there = (F.size(F.filter(column, lambda v: v.isNotNull())) > 0) if many else column.isNotNull()
    if p.op in ("isMissing", "isNotMissing"):
        there = F.coalesce(there, F.lit(False))
        return there if p.op == "isNotMissing" else ~there
    kind = x.data_type(p.field)
    if p.op in ("isIn", "isNotIn"):
        values = [x.literal(v, kind) for v in p.values]
        hit = F.arrays_overlap(column, F.array(*values)) if many else column.isin(*values)
        return F.coalesce(hit if p.op == "isIn" else F.when(there, ~F.coalesce(hit, F.lit(False))), F.lit(False))
    if p.op not in _COMPARE:
        raise Unsupported(f"unknown operator [{p.op}]")
    value = x.literal(p.value, kind)
    if many:
        if p.op not in ("equal", "notEqual"):
            raise Unsupported(f"operator [{p.op}] can't be applied to the multi-valued field [{p.field}]")
        hit = F.array_contains(column, value)
        return F.coalesce(hit if p.op == "equal" else F.when(there, ~F.coalesce(hit, F.lit(False))), F.lit(False))
    return F.coalesce(_COMPARE[p.op](column, value), F.lit(False))


def _present(p: Predicate, x: Inputs) -> Column:
    """Are all fields that a predicate reads there?"""
    if p.parts:
        return reduce(lambda a, b: a & b, [_present(q, x) for q in p.parts])
    if p.field is None or p.op in ("isMissing", "isNotMissing"):
        return F.lit(True)
    c = x.column(p.field)
    return F.coalesce(F.size(F.filter(c, lambda v: v.isNotNull())) > 0, F.lit(False)) if x.many(p.field) else c.isNotNull()


def _tree(p: Pmml, m: Tree, x: Inputs, debug: bool) -> Column:
    def build(n: Node) -> Column:
        score = F.lit(n.score).cast("string")
        if not n.children:
            return score
        out = None
        for c in n.children:
            test = predicate(c.predicate, x)
            out = F.when(test, build(c)) if out is None else out.when(test, build(c))
        return out.otherwise(score)

    return _answer(build(m.root), None, debug)


#: Compilers by kind of model; more can be added.
COMPILERS: dict[type, Callable[[Pmml, object, Inputs, bool], Column]] = {GeneralRegression: _general, Regression: _regression, NaiveBayes: _bayes, Tree: _tree}


def register(kind: type, compiler: Callable[[Pmml, object, Inputs, bool], Column]) -> None:
    """Add a kind of model; one kind has one compiler."""
    if kind in COMPILERS:
        raise ValueError(f"a compiler for [{kind.__name__}] is already registered")
    COMPILERS[kind] = compiler


def prediction(model: Pmml | str, schema: T.StructType, debug: bool = True, strict: bool = False) -> Column:
    """The prediction of a model for the rows of a table with this schema."""
    p = parse(model) if isinstance(model, str) else model
    if type(p.model) not in COMPILERS:
        raise Unsupported(f"Unsupported model type [{type(p.model).__name__}]")
    return COMPILERS[type(p.model)](p, p.model, Inputs(p, schema, strict), debug)


def score(df: DataFrame, model: Pmml | str, debug: bool = True, target: str = "prediction", strict: bool = False) -> DataFrame:
    """The table with the prediction of a model in another column."""
    return df.withColumn(target, prediction(model, df.schema, debug, strict))


def class_histogram(df: DataFrame, model: Pmml | str) -> DataFrame:
    """(class, n): how many rows a model gives each class."""
    return df.select(prediction(model, df.schema, debug=False).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


__all__ = ["COMPILERS", "Inputs", "Norm", "class_histogram", "predicate", "prediction", "register", "score"]
