"""A front end that takes requests as dictionaries (or JSON) and tables by name."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.analysis import analyzed_text
from textlab.operators import postings, termvectors
from textlab.operators import spec as specs
from textlab.operators.vectorize import vectorize
from textlab.plans.compile import score
from textlab.plans.pmml import write
from textlab.plans.train import train
from textlab.sources.store import ModelStore


def query_column(query: Mapping) -> Column:
    """A query as a condition: match_all, term, terms, exists, range, and bool of those."""
    ((kind, body),) = query.items()
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    if kind == "bool":
        out = F.lit(True)
        listed = lambda k: body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]]
        for q in listed("must") + listed("filter"):
            out = out & query_column(q)
        for q in listed("must_not"):
            out = out & ~F.coalesce(query_column(q), F.lit(False))
        any_ = [query_column(q) for q in listed("should")]
        if any_ and not (listed("must") or listed("filter")):
            first, *rest = any_
            for q in rest:
                first = first | q
            out = out & first
        return out
    ((name, value),) = body.items()
    if kind == "term":
        return F.col(name) == F.lit(value["value"] if isinstance(value, Mapping) else value)
    if kind == "terms":
        return F.col(name).isin(list(value))
    if kind == "range":
        out = F.lit(True)
        for op, bound in value.items():
            c = F.col(name)
            out = out & {"gt": c > bound, "gte": c >= bound, "lt": c < bound, "lte": c <= bound}[op]
        return out
    raise ValueError(f"unsupported query [{kind}]")


class Textlab:
    """Tables by name, and a store for models."""

    def __init__(self, tables: Mapping[str, DataFrame], store: ModelStore | None = None) -> None:
        self.tables, self.store = dict(tables), store

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no such index [{name}]")
        return self.tables[name]

    def all_terms(self, index: str, field: str, size: int = 10, from_: str | None = None, min_doc_freq: int = 0) -> dict:
        return {"terms": [r.term for r in postings.all_terms(self.table(index), field, size, from_, min_doc_freq).collect()]}

    def analyzed_text(self, index: str, field: str, **how: object) -> DataFrame:
        return analyzed_text(self.table(index), field, **how)

    def term_vectors(self, index: str, **how: object) -> DataFrame:
        return termvectors.term_vectors(self.table(index), **how)

    def prepare_spec(self, request: Mapping | str) -> dict:
        made = specs.prepare_spec(request, self.tables)
        return {"spec": made.to_json(), "length": made.length}

    def vectors(self, index: str, spec: Mapping | str, id_col: str = "doc_id") -> DataFrame:
        return vectorize(self.table(index), spec, id_col)

    def store_model(self, model: str, id_: str | None = None) -> dict:
        return self._store().put(model, id_)

    def _store(self) -> ModelStore:
        if self.store is None:
            raise ValueError("no model store is set up")
        return self.store

    def train_model(self, request: Mapping | str) -> dict:
        """``{"type", "target_field", "fields", "training_set": {"index", "query"}[, "id", "settings"]}``: the id of the stored model, or the model."""
        body = json.loads(request) if isinstance(request, str) else dict(request)
        for name in ("type", "target_field", "fields", "training_set"):
            if not body.get(name):
                raise ValueError(f"[{name}] is missing in the training request")
        known = {"type", "target_field", "fields", "training_set", "testing_set", "id", "settings"}
        if extra := body.keys() - known:
            raise ValueError(f"unknown parameter [{sorted(extra)[0]}]")
        source = body["training_set"]
        if "index" not in source:
            raise ValueError("[index] is missing in the training set")
        df = self.table(source["index"])
        if source.get("query"):
            df = df.where(query_column(source["query"]))
        target = body["target_field"] if isinstance(body["target_field"], str) else body["target_field"]["name"]
        xml = write(train(body["type"], df, target, body["fields"], body.get("settings")))
        if body.get("id"):
            return {"id": self._store().put(xml, body["id"])["id"]}
        return {"model": xml}

    def score(self, index: str, model_id: str, debug: bool = True) -> DataFrame:
        return score(self.table(index), self._store().get(model_id), debug)
