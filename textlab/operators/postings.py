"""Postings, dictionaries and the statistics of a text field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.analysis import REGISTRY, Analyzer, Registry, tokens_of

#: Repeated ids up to so many are broadcast; beyond, the rows of a table are joined with them by a shuffle.
BROADCAST_IDS = 1_000_000

#: Dictionaries of up to so many terms are broadcast; of larger ones, as many of the most frequent terms.
FREQUENT_TERMS = 300_000


def once(column: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a column that is evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(column), fn), F.lit(0))


def by_repeats(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the others (None where there are none).

    A pass over the ids decides, so that documents are counted where they lie and only those
    that several rows make up are shuffled. Null ids count as one id.
    """
    repeated = df.groupBy(F.col(id_col).alias("_repeated")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_repeated")
    n = repeated.count()
    if not n:
        return df, None
    if n <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    same = F.col(id_col).eqNullSafe(F.col("_repeated"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def _runs(tokens: Column, positions: bool) -> Column:
    """(term, tf[, positions]) of a row's tokens: runs of equal ones after sorting."""
    term = (lambda e: e["term"]) if positions else (lambda e: e)
    listed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("position"))) if positions else tokens

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (term(F.get(s, i)) != term(F.get(s, i - 1))))

        def run(at: Column, i: Column, k: Column) -> Column:
            tf = F.coalesce(F.get(at, k + 1), F.size(s)) - i
            places = [F.transform(F.slice(s, i + 1, tf), lambda e: e["position"]).alias("positions")] if positions else []
            return F.struct(term(F.get(s, i)).alias("term"), tf.cast("bigint").alias("tf"), *places)

        return once(starts, lambda at: F.transform(at, lambda i, k: run(at, i, k)))

    return F.when(F.size(tokens) > 0, once(F.sort_array(listed), of))


def counted(df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = None, positions: bool = False) -> DataFrame:
    """(id, term, tf[, positions]) of every document's distinct terms.

    A row's tokens are counted within the row, without a shuffle; only the counts of rows
    that share an id are merged.
    """

    def of(rows: DataFrame) -> DataFrame:
        tokens = rows.select(F.col(id_col).alias("_id"), tokens_of(rows, field, analyzer).alias("_t"))
        return tokens.select(F.col("_id").alias(id_col), F.inline(_runs(F.col("_t"), positions)))

    own, shared = by_repeats(df, id_col)
    if shared is None:
        return of(own)
    places = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
    return of(own).unionByName(of(shared).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"), *places))


def least_frequent(terms: DataFrame, count: str, limit: int) -> int | None:
    """The least power of two so that at most ``limit`` rows have such a count at least; None where no bound is needed.

    Terms from there on can be broadcast. They are few and make up nearly all postings; what
    is left is many terms with few postings each.
    """
    by_digits = terms.groupBy(F.length(F.bin(count)).alias("digits")).agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect()
    total, least = 0, 1 << by_digits[0].digits if by_digits else 1
    for r in by_digits:
        total += r.n
        if total > limit:
            return least
        least = 1 << (r.digits - 1)
    return None


def occurrences(df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = None) -> DataFrame:
    """(id, position, term): a row for each token."""
    return df.select(F.col(id_col), F.posexplode(tokens_of(df, field, analyzer)).alias("position", "term"))


def postings(df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = None) -> DataFrame:
    """(id, term, tf) of every document's distinct terms."""
    return counted(df, field, id_col, analyzer)


def dictionary(df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = None) -> DataFrame:
    """(term, df, ttf) of a field.

    Tokens are counted by document first, so that long texts shuffle each term once; the
    counts by document are partly merged before they move.
    """
    return postings(df, field, id_col, analyzer).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def doc_freq(df: DataFrame, field: str = "text", analyzer: str | Analyzer | None = None) -> DataFrame:
    """(term, df): how many documents have each term."""
    return df.select(F.explode(F.array_distinct(tokens_of(df, field, analyzer))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def field_statistics(df: DataFrame, field: str = "text", analyzer: str | Analyzer | None = None) -> DataFrame:
    """One row: sum_doc_freq, doc_count (documents with a token), sum_ttf."""
    t = df.select(tokens_of(df, field, analyzer).alias("t")).where(F.size("t") > 0)
    return t.agg(
        F.coalesce(F.sum(F.size(F.array_distinct("t"))), F.lit(0)).cast("bigint").alias("sum_doc_freq"),
        F.count("*").alias("doc_count"),
        F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("bigint").alias("sum_ttf"),
    )


def all_terms(df: DataFrame, field: str = "text", size: int | None = 10, from_: str | None = None, min_doc_freq: int = 0, analyzer: str | Analyzer | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """(term): the distinct terms after ``from_``, in UTF-8 order; ``size`` None gives them all.

    The bound is applied to the tokens, before anything is shuffled.
    """
    if field not in df.columns:
        raise ValueError(f"field [{field}] not found")
    if size is not None and size < 0:
        raise ValueError("size must not be negative")
    tokens = F.array_distinct(tokens_of(df, field, analyzer, registry))
    if from_ is not None:
        tokens = F.filter(tokens, lambda t: t > F.lit(from_))
    terms = df.select(F.explode(tokens).alias("term"))
    if min_doc_freq > 1:
        terms = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_doc_freq).select("term")
    else:
        terms = terms.distinct()
    terms = terms.orderBy("term")
    return terms if size is None else terms.limit(size)
