"""Training: grouped aggregates whose small results become a model."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.analysis import Analyzer, tokens_of
from textlab.operators.postings import FREQUENT_TERMS, least_frequent
from textlab.plans.compile import bayes_answer
from textlab.plans.pmml import Counts, DataField, Gaussian, MiningField, NaiveBayes, Pmml

_NUMBERS = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
Field = str | Mapping[str, object]
#: Values of a field that a model on the driver holds; more are an error.
MODEL_VALUES = 1_000_000


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n) without the rows that have no class."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))


def _values(df: DataFrame, name: str, analyzer: str | Analyzer | None) -> Column:
    """The distinct values of a field in each row."""
    if analyzer is not None:
        return F.array_distinct(tokens_of(df, name, analyzer))
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.array_distinct(F.filter(F.col(name).cast("array<string>"), lambda x: x.isNotNull()))
    return F.when(F.col(name).isNotNull(), F.array(F.col(name)))


def categorical_counts(df: DataFrame, target: str, name: str, analyzer: str | Analyzer | None = None) -> DataFrame:
    """(class, value, n): in how many rows of a class the field has a value; absent pairs have 0.

    Zeros are filled from the classes by values, both far smaller than the table.
    """
    pairs = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("class"), F.explode(_values(df, name, analyzer)).alias("value")).groupBy("class", "value").agg(F.count("*").alias("n"))
    wide = pairs.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m"))
    return wide.crossJoin(F.broadcast(class_counts(df, target).select("class"))).select("class", "value", F.coalesce(F.try_element_at("m", F.col("class")), F.lit(0)).cast("bigint").alias("n"))


def numeric_stats(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """(class, then mean and population variance of each field) in one aggregate."""
    each = [a for n in names for a in (F.avg(F.col(n).cast("double")).alias(f"{n}_mean"), F.var_pop(F.col(n).cast("double")).alias(f"{n}_variance"))]
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"), *each)


def naive_bayes(df: DataFrame, target: str, fields: Sequence[Field], settings: Mapping | None = None) -> Pmml:
    """A Naive Bayes model of text (with an ``analyzer``), keyword and number fields.

    Rows without a class count in the threshold (one by the number of rows) alone. A field
    is a name, or ``{"name": ..., "analyzer": ...}``. What reaches the driver is the model.
    """
    names = [(f, None) if isinstance(f, str) else (f["name"], f.get("analyzer")) for f in fields]
    known = {f.name: f.dataType for f in df.schema}
    if target not in known:
        raise ValueError(f"target field [{target}] not found")
    numbers = []
    for name, _ in names:
        if name not in known:
            raise ValueError(f"input field [{name}] not found")
        kind = known[name].elementType if isinstance(known[name], T.ArrayType) else known[name]
        if isinstance(known[name], _NUMBERS):
            numbers.append(name)
        elif not isinstance(kind, T.StringType):
            raise ValueError(f"field [{name}] has the unsupported type [{known[name].simpleString()}]")
    rows = df.count()
    stats = {r["class"]: r for r in numeric_stats(df, target, numbers).orderBy("class").collect()}
    if len(stats) < 2:
        raise ValueError(f"the target must have two classes at least, it has {len(stats)}")
    inputs, dictionary = [], []
    nan = lambda v: float("nan") if v is None else v
    for name, analyzer in names:
        if name in numbers:
            inputs.append(Gaussian(name, {c: (nan(r[f"{name}_mean"]), nan(r[f"{name}_variance"])) for c, r in stats.items()}))
            dictionary.append(DataField(name, "continuous", "double"))
            continue
        counts: dict[str, dict[str, float]] = {}
        got = categorical_counts(df, target, name, analyzer).limit(MODEL_VALUES * len(stats) + 1).collect()
        if len(got) > MODEL_VALUES * len(stats):
            raise ValueError(f"field [{name}] has more than {MODEL_VALUES} values; text_bayes keeps them in a table")
        for r in sorted(got, key=lambda r: (r["value"], r["class"])):
            counts.setdefault(r["value"], {})[r["class"]] = float(r["n"])
        inputs.append(Counts(name, counts))
        dictionary.append(DataField(name, "categorical", "string", list(counts)))
    dictionary.append(DataField(target, "categorical", "string", list(stats)))
    mining = [MiningField(n) for n, _ in names] + [MiningField(target, "predicted")]
    return Pmml(dictionary, mining, [], NaiveBayes(1.0 / rows, inputs, {c: float(r["n"]) for c, r in stats.items()}))


@dataclass(frozen=True)
class TextBayes:
    """A Naive Bayes model of a text field whose parameters are a table.

    ``terms`` has (term, n, logs): how many rows with a class have the term, and the logarithm
    of each class's share of rows with it.
    """

    classes: list[str]
    priors: list[float]
    terms: DataFrame


def text_bayes(df: DataFrame, target: str, name: str = "text", analyzer: str | Analyzer | None = "standard") -> TextBayes:
    """The text model of ``naive_bayes`` without its vocabulary on the driver: an aggregate by term, classes alone are collected."""
    sizes = {r["class"]: r["n"] for r in class_counts(df, target).collect()}
    if len(sizes) < 2:
        raise ValueError(f"the target must have two classes at least, it has {len(sizes)}")
    classes, total, least = sorted(sizes), sum(sizes.values()), math.log(1.0 / df.count())
    tokens = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("class"), F.explode(_values(df, name, analyzer)).alias("term"))
    counts = tokens.groupBy("term").agg(F.count("*").alias("n"), *[F.count_if(F.col("class") == c).alias(f"n{i}") for i, c in enumerate(classes)])
    logs = [F.when(F.col(f"n{i}") > 0, F.log(F.col(f"n{i}") / F.lit(float(sizes[c])))).otherwise(F.lit(least)) for i, c in enumerate(classes)]
    return TextBayes(classes, [math.log(sizes[c] / total) for c in classes], counts.select("term", "n", F.array(*logs).alias("logs")))


def score_text(df: DataFrame, model: TextBayes, name: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = "standard", debug: bool = True) -> DataFrame:
    """(id, prediction) of every row: distinct terms are joined with the parameters and summed by row; unknown terms add nothing.

    Parameters of up to ``MODEL_VALUES`` terms are broadcast. Of more, those of the most
    frequent terms are, and only tokens that are none of these are shuffled to the others.
    """
    terms = model.terms.persist(StorageLevel.DISK_ONLY)
    tokens = df.select(F.col(id_col), F.explode_outer(_values(df, name, analyzer)).alias("term"))
    bound = least_frequent(terms, "n", FREQUENT_TERMS) if terms.count() > MODEL_VALUES else None
    found = tokens.join(F.broadcast((terms if bound is None else terms.where(F.col("n") >= bound)).select("term", "logs")), "term", "left")
    if bound is not None:
        left = found.where(F.col("logs").isNull() & F.col("term").isNotNull()).select(id_col, "term")
        found = found.select(id_col, "logs").unionByName(left.join(terms.where(F.col("n") < bound).select("term", "logs"), "term").select(id_col, "logs"))
    sums = [F.coalesce(F.sum(F.get("logs", F.lit(i))), F.lit(0.0)) + F.lit(p) for i, p in enumerate(model.priors)]
    return found.groupBy(id_col).agg(F.array(*sums).alias("logs")).select(id_col, bayes_answer(F.col("logs"), model.classes, debug).alias("prediction"))


Trainer = Callable[[DataFrame, str, Sequence[Field], Mapping | None], Pmml]
#: Trainers by the type that a request names.
TRAINERS: dict[str, Trainer] = {"naive_bayes": naive_bayes}


def register(kind: str, trainer: Trainer) -> None:
    if kind in TRAINERS:
        raise ValueError(f"a trainer for [{kind}] is already registered")
    TRAINERS[kind] = trainer


def train(kind: str, df: DataFrame, target: str, fields: Sequence[Field], settings: Mapping | None = None) -> Pmml:
    if kind not in TRAINERS:
        raise ValueError(f"unknown model type [{kind}]")
    return TRAINERS[kind](df, target, fields, settings)


def with_tokens(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """The table as a trained model reads it: text fields as arrays of their distinct terms."""
    for f in fields:
        if not isinstance(f, str) and f.get("analyzer"):
            df = df.withColumn(f["name"], F.array_distinct(tokens_of(df, f["name"], f["analyzer"])))
    return df
