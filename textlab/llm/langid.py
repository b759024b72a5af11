"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: each of the table's positions holds one bit for
each language (in as many words of 64 bits as the languages need), so that the ``and`` of an n-gram's positions is the mask of all languages
that contain it. A text's languages get the number of its n-grams that carry their bit,
corrected for the rate of false positives of their filter, and the largest share decides.

N-grams are of ``ORDER`` bytes of lower-case UTF-8, with digits, signs and white space read
as one blank each. Texts are read whole.

Defined results: a null text, or one shorter than an n-gram, gives language ``und``, share
0; so does a text of which no language holds ``MIN_SHARE`` of the n-grams. Of equal shares
the language first in the alphabet wins. Repeated rows give repeated results, an empty
table an empty one. Where no row has a label, every text is ``und``. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import data, kind_of, offsets, over_slices

ORDER = 4
#: Bound of the sample that the filters are made from: labelled rows of each language.
SAMPLE_PER_LANGUAGE = 400
#: log2 of the positions of a filter, and positions of each n-gram.
LOG_POSITIONS, HASHES = 20, 2
#: An n-gram is put into each language whose rate is at least this part of its highest rate.
RATE = 0.3
MIN_SHARE = 0.15
SCHEMA = "lang string, share double, n_grams bigint"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Filters:
    """Bit-sliced filters (of more than 64 languages a row for each word of bits) and the share of positions each has filled."""

    languages: list[str]
    table: np.ndarray
    filled: np.ndarray

    def false_rate(self) -> np.ndarray:
        return self.filled**HASHES


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of an array of strings as 32-bit numbers; the first of each text, and how many."""
    lower = pc.utf8_lower(texts)
    raw = _FOLD[data(lower)]
    starts, ends = offsets(lower)
    n = np.maximum(ends - starts - (ORDER - 1), 0)
    if len(raw) < ORDER:
        return np.zeros(0, np.uint32), starts, n
    raw = raw.astype(np.uint32)
    code = raw[: len(raw) - ORDER + 1].copy()
    for i in range(1, ORDER):
        code |= raw[i : len(raw) - ORDER + 1 + i] << np.uint32(8 * i)
    return code, starts, n


def positions(code: np.ndarray) -> list[np.ndarray]:
    """The places of n-grams in the table."""
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [(mixed >> np.uint64(64 - LOG_POSITIONS * (i + 1))) & np.uint64((1 << LOG_POSITIONS) - 1) for i in range(HASHES)]


def fit(texts: dict[str, list[str]]) -> Filters:
    """Filters from texts by language.

    An n-gram that occurs more than once goes to every language in which its rate is at
    least ``RATE`` of its highest rate in any.
    """
    languages = sorted(texts)
    kind, bits = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
    table = np.zeros((max(1, -(-len(languages) // bits)), 1 << LOG_POSITIONS), kind)
    seen, rates = [], []
    for language in languages:
        code, starts, n = grams(pa.array(texts[language], pa.string()))
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, starts[n > 0], 1)
        np.add.at(inside, (starts + n)[n > 0], -1)
        value, count = np.unique(code[np.cumsum(inside)[:-1] > 0], return_counts=True)
        keep = count > 1
        seen.append(value[keep])
        rates.append(count[keep] / max(1, count.sum()))
    every = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)
    rate = np.zeros((len(languages), len(every)))
    for i, (value, r) in enumerate(zip(seen, rates, strict=True)):
        rate[i, np.searchsorted(every, value)] = r
    highest = rate.max(axis=0, initial=0)
    for i in range(len(languages)):
        for at in positions(every[(rate[i] > 0) & (rate[i] >= RATE * highest)]):
            table[i // bits, at] |= kind(1) << kind(i % bits)
    filled = np.array([((table[i // bits] >> kind(i % bits)) & kind(1)).mean() for i in range(len(languages))])
    return Filters(languages, table[0] if len(table) == 1 else table, filled)


def classify(filters: Filters, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, share and number of n-grams of each text (nulls count as empty)."""
    code, starts, n = grams(texts)
    rows, langs = len(n), len(filters.languages)
    counts = np.zeros((langs, rows))
    if len(code) and langs:
        at, table = positions(code), np.atleast_2d(filters.table)
        ends = starts + n
        kind = filters.table.dtype.type
        bits = 8 * filters.table.dtype.itemsize
        some = n > 0
        # Each text's n-grams and the stretch up to the next text's, by turns; only the former count.
        edge = np.stack([starts[some], np.minimum(ends[some], len(code))], 1).ravel()
        last = int(edge[-1]) if edge.size else 0
        for i in range(langs) if edge.size else ():
            if i % bits == 0:
                word = table[i // bits]
                mask = word[at[0]]
                for a in at[1:]:
                    mask &= word[a]
            bit = ((mask[:last] >> kind(i % bits)) & kind(1)).astype(np.int32)
            counts[i, some] = np.add.reduceat(np.append(bit, 0), edge[:-1])[::2]
    false = filters.false_rate()[:, None]
    share = np.maximum(0, (counts - n * false) / np.maximum(1e-9, 1 - false)) / np.maximum(n, 1)
    best = share.argmax(axis=0) if langs else np.zeros(rows, int)
    top = share[best, np.arange(rows)] if langs else np.zeros(rows)
    named = [filters.languages[b] if s >= MIN_SHARE else "und" for b, s in zip(best.tolist(), top.tolist(), strict=True)]
    return named, np.where(top >= MIN_SHARE, top, 0.0), n


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[str]]:
    """Texts of at most ``per_language`` labelled rows of each language, chosen by a hash of the id.

    The first pass reads only ids and labels and keeps the few first rows of each language
    in each partition; the second fetches their texts by a join with that bounded list. An id
    that rows repeat gives one text for each of its languages, the least.
    """
    labelled = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang")).where("lang is not null and id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.select("id", "lang", F.row_number().over(order).alias("n")).where(F.col("n") <= per_language).select("id").distinct().collect()
    ids = docs.sparkSession.createDataFrame([(r.id,) for r in chosen], docs.select(docs[id_col].alias("id")).schema)
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("text is not null and lang is not null").join(F.broadcast(ids), "id").groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, share, n_grams) of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, share, n = classify(shared.value, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "lang", "share", "n_grams"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(over_slices(run), f"doc_id {kind_of(docs, id_col)}, {SCHEMA}")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; filters from a bounded sample of labelled rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(sample(docs)))
