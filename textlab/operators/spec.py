"""Vector specifications: which terms of which fields make the places of a vector."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from textlab.functions.analysis import Analyzer
from textlab.operators.postings import doc_freq

#: Terms of a vocabulary that the driver holds at most.
VOCABULARY = 5_000_000
NUMBERS = ("tf", "occurrence", "tf_idf")


@dataclass(frozen=True)
class Feature:
    """The terms of a field, in the order of their places."""

    field: str
    number: str
    terms: tuple[str, ...]
    #: Of a vocabulary that was chosen from a table: its plan's hash, the analyzer and the document frequencies.
    known: tuple[int, str | None, tuple[int, ...]] | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.number not in NUMBERS:
            raise ValueError(f"number must be one of {', '.join(NUMBERS)}, not [{self.number}]")


@dataclass(frozen=True)
class VectorSpec:
    features: tuple[Feature, ...]
    sparse: bool = False

    @property
    def length(self) -> int:
        return sum(len(f.terms) for f in self.features)

    def to_json(self) -> str:
        """The exchange format, in which the length is a string."""
        return json.dumps({"sparse": self.sparse, "features": [{"field": f.field, "number": f.number, "terms": list(f.terms), "type": "terms"} for f in self.features], "length": str(self.length)}, ensure_ascii=False)

    @classmethod
    def from_json(cls, body: str | Mapping) -> VectorSpec:
        body = json.loads(body) if isinstance(body, str) else body
        if "features" not in body:
            raise ValueError("features are missing in the spec")
        for f in body["features"]:
            if f.get("type") != "terms":
                raise ValueError(f"unknown feature type [{f.get('type')}]")
        return cls(tuple(Feature(f["field"], f["number"], tuple(f["terms"])) for f in body["features"]), as_bool(body.get("sparse", False)))


def as_bool(value: object) -> bool:
    if isinstance(value, bool):
        return value
    if value in ("true", "false"):
        return value == "true"
    raise ValueError(f"expected true or false, not [{value}]")


def given(terms: Sequence[str]) -> tuple[str, ...]:
    """Given terms, sorted as Spark sorts strings (by UTF-8 bytes), each once."""
    return tuple(sorted(set(terms), key=lambda t: t.encode()))


def significant_terms(df: DataFrame, class_col: str, field: str = "text", size: int = 10, min_doc_count: int = 3, analyzer: str | Analyzer | None = None) -> DataFrame:
    """(class, term, score): the ``size`` best terms of each class.

    The score is (fg - bg) * fg / bg, where fg and bg are the shares of the class's and of
    all documents that have the term, for terms with fg > bg in ``min_doc_count`` documents
    of the class; rounded to nine places, of equals the first term wins. Rows whose class
    is null count in the background alone.
    """
    from textlab.functions.analysis import tokens_of

    by_class = df.where(F.col(class_col).isNotNull()).select(F.col(class_col).alias("class"), F.explode(F.array_distinct(tokens_of(df, field, analyzer))).alias("term")).groupBy("class", "term").agg(F.count("*").alias("f")).where(F.col("f") >= max(1, min_doc_count))
    sizes = df.groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("class_size"))
    total = df.agg(F.count("*").alias("n"))
    fg, bg = F.col("f") / F.col("class_size"), F.col("df") / F.col("n")
    scored = by_class.join(doc_freq(df, field, analyzer), "term").join(F.broadcast(sizes), "class").crossJoin(F.broadcast(total)).where(fg > bg).select("class", "term", F.round((fg - bg) * (fg / bg), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= size).drop("place")


_ARGUMENTS = {"given": {"terms"}, "all_terms": {"index", "min_doc_freq"}, "significant_terms": {"index", "request"}}


def prepare_spec(request: Mapping | str, tables: Mapping[str, DataFrame]) -> VectorSpec:
    """A spec from a request ``{"features": [...], "sparse": false}``.

    Each feature has ``field``, ``number``, ``type`` ("string") and ``tokens``: "given" with
    ``terms``; "all_terms" with ``index`` and ``min_doc_freq``; "significant_terms" with
    ``index`` and ``request``, whose only aggregation is a terms aggregation, or one with a
    significant_terms aggregation inside. The vocabulary is what the driver has to hold; one of
    more than ``VOCABULARY`` terms is an error.
    """
    body = json.loads(request) if isinstance(request, str) else request
    if not body.get("features"):
        raise ValueError("features are missing or empty")
    features = []
    for f in body["features"]:
        if f.get("type") != "string":
            raise ValueError(f"unknown field type [{f.get('type')}], only [string] is supported")
        for name in ("field", "number", "tokens"):
            if name not in f:
                raise ValueError(f"[{name}] is missing in a feature")
        method, known = f["tokens"], None
        if method not in _ARGUMENTS:
            raise ValueError(f"unknown way to choose tokens [{method}]")
        missing = _ARGUMENTS[method] - f.keys()
        if missing:
            raise ValueError(f"[{sorted(missing)[0]}] is missing for tokens [{method}]")
        extra = f.keys() - _ARGUMENTS[method] - {"field", "number", "tokens", "type", "analyzer"}
        if extra:
            raise ValueError(f"unknown parameter [{sorted(extra)[0]}] for tokens [{method}]")
        if method == "given":
            terms = given(f["terms"])
        else:
            if f["index"] not in tables:
                raise ValueError(f"no such index [{f['index']}]")
            df = tables[f["index"]]
            if method == "all_terms":
                found = doc_freq(df, f["field"], f.get("analyzer")).where(F.col("df") >= int(f["min_doc_freq"]))
                counts = {r.term: r.df for r in _bounded(found)}
                terms = given(counts)
                known = (df.semanticHash(), f.get("analyzer"), tuple(counts[t] for t in terms))
            else:
                terms = given([r.term for r in _bounded(_leaves(df, f["request"], f.get("analyzer")))])
        features.append(Feature(f["field"], f["number"], terms, known))
    return VectorSpec(tuple(features), as_bool(body.get("sparse", False)))


def _bounded(terms: DataFrame) -> list[Row]:
    """A vocabulary's rows; an error where they are more than the driver should hold."""
    rows = terms.limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"the vocabulary has more than {VOCABULARY} terms; raise min_doc_freq")
    return rows


def _leaves(df: DataFrame, request: Mapping | str, analyzer: str | None) -> DataFrame:
    """(term) at the leaves of the one aggregation of a request."""
    body = json.loads(request) if isinstance(request, str) else request
    aggs = body.get("aggregations", body.get("aggs", {}))
    if len(aggs) != 1:
        raise ValueError("the request must have exactly one aggregation")
    (agg,) = aggs.values()
    inner = agg.get("aggregations", agg.get("aggs", {}))
    kind = next((k for k in ("terms", "significant_terms") if k in agg), None)
    if kind is None:
        raise ValueError("only bucket aggregations (terms, significant_terms) are supported")
    if not inner:
        if kind == "significant_terms":
            raise ValueError("significant_terms needs a class aggregation around it")
        a = agg["terms"]
        best = doc_freq(df, a["field"], analyzer).where(F.col("df") >= a.get("min_doc_count", 1))
        return best.orderBy(F.desc("df"), "term").limit(a.get("size", 10)).select("term")
    if len(inner) != 1 or kind != "terms":
        raise ValueError("only significant_terms inside of terms is supported")
    (leaf,) = inner.values()
    if "significant_terms" not in leaf:
        raise ValueError("only significant_terms inside of terms is supported")
    s = leaf["significant_terms"]
    return significant_terms(df, agg["terms"]["field"], s["field"], s.get("size", 10), s.get("min_doc_count", 3), analyzer).select("term").distinct()
