"""Term vectors: each document's terms with frequencies, positions, offsets and statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.analysis import Analyzer, python_pattern
from textlab.operators.postings import FREQUENT_TERMS, counted, doc_freq, least_frequent, postings


#: Rows of offsets from which on a batch is given.
ROWS = 10_000


def term_vectors(df: DataFrame, fields: Sequence[str] = ("text",), id_col: str = "doc_id", per_field_analyzer: Mapping[str, str | Analyzer] | None = None, positions: bool = False, term_statistics: bool = False) -> DataFrame:
    """(id, field, term, tf[, positions][, df, ttf]) of every document, field and term."""
    chosen = per_field_analyzer or {}

    def of(field: str) -> DataFrame:
        a = chosen.get(field)
        out = counted(df, field, id_col, a, positions)
        if term_statistics:
            out = _with_statistics(out.persist(StorageLevel.DISK_ONLY))
        return out.select(id_col, F.lit(field).alias("field"), "term", "tf", *(["positions"] if positions else []), *(["df", "ttf"] if term_statistics else []))

    return reduce(DataFrame.unionByName, [of(f) for f in fields])


def _with_statistics(vectors: DataFrame) -> DataFrame:
    """Term vectors with df and ttf of their terms.

    A dictionary of up to ``FREQUENT_TERMS`` terms is broadcast. Of a larger one the most
    frequent terms are, so that only postings of rare terms are shuffled, none of which has many.
    Vectors and dictionary are kept on disk, as they are read more than once.
    """
    terms = vectors.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).persist(StorageLevel.DISK_ONLY)
    bound = least_frequent(terms, "df", FREQUENT_TERMS)
    if bound is None:
        return vectors.join(F.broadcast(terms), "term")
    found = vectors.join(F.broadcast(terms.where(F.col("df") >= bound)), "term", "left")
    rare = found.where(F.col("df").isNull()).select(*vectors.columns)
    return found.where(F.col("df").isNotNull()).unionByName(rare.join(terms.where(F.col("df") < bound), "term"))


def filtered(
    df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str | Analyzer | None = None, max_num_terms: int | None = None, min_term_freq: int = 1, max_term_freq: int | None = None,
    min_doc_freq: int = 1, max_doc_freq: int | None = None, min_word_length: int = 0, max_word_length: int | None = None,
) -> DataFrame:
    """(id, term, tf, df, score): the terms that pass all bounds, the best ``max_num_terms`` of each document.

    The score is tf * ln((N + 1) / (df + 1)), rounded to nine places; of equals the first term wins.
    """
    bounds = [F.length("term") >= min_word_length]
    if max_word_length:
        bounds.append(F.length("term") <= max_word_length)
    inner = [F.col("tf") >= min_term_freq] + ([F.col("tf") <= max_term_freq] if max_term_freq else [])
    outer = [F.col("df") >= min_doc_freq] + ([F.col("df") <= max_doc_freq] if max_doc_freq else [])
    every = lambda conditions: reduce(lambda a, b: a & b, conditions)
    vectors = postings(df, field, id_col, analyzer).where(every(bounds + inner))
    kept = doc_freq(df, field, analyzer).where(every(outer + bounds))
    n = df.agg(F.count("*").alias("n"))
    score = F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), 9)
    out = vectors.join(kept, "term").crossJoin(F.broadcast(n)).select(id_col, "term", "tf", "df", score.alias("score"))
    if max_num_terms is None:
        return out
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "term"))
    return out.withColumn("place", place).where(F.col("place") <= max_num_terms).drop("place")


def offsets(df: DataFrame, field: str = "text", id_col: str = "doc_id", analyzer: str = "standard") -> DataFrame:
    """(id, term, position, start_offset, end_offset), offsets in UTF-16 units.

    Matching places are out of reach of built-in expressions, hence Arrow batches.
    """
    kind = df.schema[id_col].dataType.simpleString()
    lower = analyzer in ("standard", "default", "simple")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = python_pattern(analyzer).finditer
        rows, terms, places, starts, ends = columns = [], [], [], [], []

        def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            out = pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), *(pa.array(x, pa.int32()) for x in (places, starts, ends))], names=[id_col, "term", "position", "start_offset", "end_offset"])
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                at = _units(text) if not text.isascii() and max(text) > "\uffff" else None
                for n, m in enumerate(find(text)):
                    rows.append(i)
                    terms.append(m[0].lower() if lower else m[0])
                    places.append(n)
                    starts.append(at[m.start()] if at else m.start())
                    ends.append(at[m.end()] if at else m.end())
                if len(rows) >= ROWS:
                    yield gathered(batch)
            if rows:
                yield gathered(batch)

    return df.select(id_col, field).mapInArrow(run, f"{id_col} {kind}, term string, position int, start_offset int, end_offset int")


def _units(text: str) -> list[int]:
    """The UTF-16 place of every character, and of the end."""
    at = [0]
    for c in text:
        at.append(at[-1] + (2 if c > "\uffff" else 1))
    return at
