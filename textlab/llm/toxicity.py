"""Toxic documents by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of the rows of a hashed table for the word itself and for its
first 4 to 8 bytes. Filters of one, two and three words run over a text, each filter's
highest response is kept, and a logistic layer over those gives the score. As filters are
linear in the embedding, scoring reads each filter's response to each row from a table.

The table starts from the log odds of each row in the labelled texts (one column) and small
noise (the others); Adam then trains everything. Every labelled row is counted, trained on and
used for thresholds: the rows fall into two halves by a hash of the id, each with a model of
its own. Each row is scored by the half that hasn't seen it, and those scores give each
language the threshold of the best F1; languages with few labelled rows get the threshold of
all. The model is the mean of both halves. Where a half would have fewer than
``LEAST_IN_HALF`` rows of a label there is one model, which gives the thresholds, too.

Training runs where the rows are: in each of ``EPOCHS`` rounds the shards of a half start from
the same parameters, pass over their rows in batches, and return parameters that are averaged
by the number of rows, whatever the order in which tasks end. What reaches the driver is
bounded by ``SHARDS``, but for a bitmap of one to two bytes a label.

Defined results: a null text and one without words score 0 and aren't toxic. A null or
unknown language has the threshold of all. Labels that are null, or of no document, are
left out; of several labels of a document the highest counts, of several texts of an id the
greatest is learned from. Texts are read whole, whatever their length. Without labels of both
kinds nothing is toxic (all scores are 0). Repeated rows get equal results, an empty table
gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import data, kind_of, offsets, over_slices
from textlab.llm.words import hashed_words, mix

#: Labelled rows of a shard in small tables, and the most shards (even): those of larger tables hold more rows.
SHARD_ROWS, SHARDS = 4096, 16
#: Words after which a batch ends before it has ``BATCH`` rows.
BATCH_WORDS = 1 << 20
LOG_ROWS, DIMENSIONS, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Labelled rows of each label that both halves must have to be trained apart.
LEAST_IN_HALF = 4
#: Labelled rows of each label that a language must have for a threshold of its own.
LEAST_FOR_THRESHOLD = 8
SCHEMA = "score double, toxic boolean"
#: Shapes of the parameters: embedding, filters, their biases, weights and offset of the last layer.
SHAPES = [(1 << LOG_ROWS, DIMENSIONS), *[(w, DIMENSIONS, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS),), (1,)]
#: Scores where intervals begin that thresholds are searched in side by side.
EDGES = 1 / (1 + np.exp(-np.arange(-30, 30, 1 / 64)))


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of each distinct word (itself and its beginnings; -1 where it is shorter), the number of each word among those, and words by text."""
    lower = pc.utf8_lower(texts)
    h, first, end, count = hashed_words(lower, lower=False)
    starts, _ = offsets(lower)
    first, size = first + np.repeat(starts, count), end - first
    h, some, which = np.unique(h, return_index=True, return_inverse=True)
    first, size = first[some], size[some]
    mask = np.uint64((1 << LOG_ROWS) - 1)
    rows = np.full((len(h), 1 + len(PREFIXES)), -1, np.int32)
    rows[:, 0] = (h & mask).astype(np.int32)
    if not len(h):
        return rows, which, count
    raw = data(lower)
    p = np.zeros(len(h), np.uint64)
    for i in range(max(PREFIXES)):
        p = (p + raw[np.minimum(first + i, len(raw) - 1)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if i + 1 in PREFIXES:
            some = size > i + 1
            rows[some, 1 + PREFIXES.index(i + 1)] = (mix(p[some] + np.uint64(i)) & mask).astype(np.int32)
    return rows, which, count


def encode(texts: pa.Array) -> list[pa.Array]:
    """``distinct_features`` by text, to be kept: words, rows of each distinct word (16 bits) and how many of them it has, and the places of all words among those (16 bits; 32 in texts of more distinct words)."""
    rows, which, count = distinct_features(texts)
    n = max(1, len(rows))
    own, place = np.unique(np.repeat(np.arange(len(count)), count) * n + which, return_inverse=True)
    size = np.bincount(own // n, minlength=len(count))
    place = place - np.repeat(np.cumsum(size) - size, count)
    rows = rows[own % n]
    parts: list[list[bytes]] = [[], [], []]
    a = b = 0
    for c, d in zip(count.tolist(), size.tolist(), strict=True):
        parts[0].append(rows[a : a + d].astype(np.uint16).tobytes())
        parts[1].append((rows[a : a + d] >= 0).sum(axis=1).astype(np.uint8).tobytes())
        parts[2].append(place[b : b + c].astype(np.uint16 if d <= 1 << 16 else np.uint32).tobytes())
        a, b = a + d, b + c
    return [pa.array(count, pa.int64()), *[pa.array(x, pa.binary()) for x in parts]]


def decode(words: pa.Array, rows: pa.Array, sizes: pa.Array, places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distinct_features`` from ``encode``; words that several texts share are there for each."""
    count = words.to_numpy()
    has = data(sizes)
    out = np.frombuffer(data(rows), np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32)
    out[np.arange(1 + len(PREFIXES)) >= has[:, None]] = -1
    starts, ends = offsets(sizes)
    if (ends - starts).max(initial=0) <= 1 << 16:
        place = np.frombuffer(data(places), np.uint16)
    else:
        place = np.concatenate([np.frombuffer(x, np.uint16 if n <= 1 << 16 else np.uint32) for x, n in zip(places.to_pylist(), ends - starts, strict=True)])
    return out, place + np.repeat(starts, count), count


@dataclass
class Model:
    """A trained classifier; ``tables`` has each filter's response to each table row, by width and place."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 2.0
    tables: np.ndarray | None = None

    def compile(self) -> None:
        """The responses; the last table row is that of no word, all zeros."""
        parts = [self.embedding @ f[j] for f in self.filters for j in range(f.shape[0])]
        self.tables = np.vstack([np.hstack(parts), np.zeros((1, sum(p.shape[1] for p in parts)))]).astype(np.float32)

    def pooled(self, rows: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each text (0 at least), from ``distinct_features``."""
        out = np.zeros((len(count), sum(f.shape[2] for f in self.filters)), np.float32)
        some = np.flatnonzero(count)
        if not some.size:
            return out
        response = self.tables[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            has = np.flatnonzero(rows[:, k] >= 0)
            response[has] += self.tables[rows[has, k]]
        response = response[which]
        first = (np.cumsum(count) - count)[some]
        left = np.repeat(count, count) - (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))  # words left in the text
        column = done = 0
        for f, b in zip(self.filters, self.bias, strict=True):
            width, n = f.shape[0], f.shape[2]
            total = response[:, column : column + n].copy()
            for j in range(1, width):
                total[:-j][left[:-j] > j] += response[j:, column + j * n : column + (j + 1) * n][left[:-j] > j]
            column += width * n
            out[some, done : done + n] = np.maximum.reduceat(total, first, axis=0) + b
            done += n
        return np.maximum(out, 0)

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.score_features(*distinct_features(texts))

    def score_features(self, rows: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.compile()
        z = self.pooled(rows, which, count) @ self.weight + self.offset
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def begin(bad: np.ndarray, all_: np.ndarray, share: float, seed: int = 5) -> list[np.ndarray]:
    """Parameters before training, from the number of toxic and of all texts that have each table row."""
    rng = np.random.default_rng(seed)
    odds = np.log((bad + 4 * share) / (all_ - bad + 4 * (1 - share))) - np.log(share / (1 - share))
    embedding = rng.normal(0, 0.02, SHAPES[0])
    embedding[:, 0] = np.where(all_ > 0, odds, 0)
    filters = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 0.5
        f[0, 0, FILTERS // 2 :] -= 0.3
    weight = rng.normal(0, 0.05, FILTERS * len(WIDTHS))
    weight[[i for w in range(len(WIDTHS)) for i in range(w * FILTERS, w * FILTERS + FILTERS // 2)]] += 0.2
    return [embedding, *filters, *[np.zeros(FILTERS) for _ in WIDTHS], weight, np.array([-2.0])]


def pack(flat: list[np.ndarray]) -> bytes:
    return np.concatenate([x.ravel() for x in flat]).astype(np.float32).tobytes()


def unpack(packed: bytes) -> list[np.ndarray]:
    x = np.frombuffer(packed, np.float32).astype(np.float64)
    ends = np.cumsum([int(np.prod(shape)) for shape in SHAPES])
    return [part.reshape(shape) for part, shape in zip(np.split(x, ends[:-1]), SHAPES, strict=True)]


class Training:
    """Adam over the parameters ``flat``, which it changes; both labels weigh the same, ``share`` of the rows are toxic."""

    def __init__(self, flat: list[np.ndarray], share: float):
        self.share, self.t = share, 0
        # a row of zeros stands for beginnings that a word doesn't have
        self.padded = np.vstack([flat[0], np.zeros((1, DIMENSIONS))]).astype(np.float32)
        self.flat = [self.padded[:-1], *flat[1:]]
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in self.flat]

    def learn(self, rows: np.ndarray, which: np.ndarray, count: np.ndarray, labels: np.ndarray) -> None:
        """A step on a batch, from ``distinct_features``; texts without words add nothing."""
        some = np.flatnonzero(count)
        if not some.size:
            return
        embedding, weight, offset = self.flat[0], self.flat[-2], self.flat[-1]
        filters, bias = self.flat[1 : 1 + len(WIDTHS)], self.flat[1 + len(WIDTHS) : -2]
        c, y = count[some], labels[some]
        sums = self.padded.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            sums += self.padded.take(rows[:, k], axis=0)
        words = sums.take(which, axis=0)
        n = len(which)
        first = np.cumsum(c) - c
        own = np.repeat(np.arange(len(c)), c)
        last = first + c - 1
        pooled, where = [], []
        for f, b in zip(filters, bias, strict=True):
            f = f.astype(np.float32)
            total = words @ f[0]
            for j in range(1, f.shape[0]):
                step = words[j:] @ f[j]
                for back in range(j):  # no word j places after the last ones of a text
                    at = last - back
                    step[at[(at >= first) & (at < len(step))]] = 0
                total[:-j] += step
            top = np.maximum.reduceat(total, first, axis=0)
            at = np.flatnonzero(total == top.repeat(c, axis=0))
            place = np.full(top.shape, n)
            np.minimum.at(place.reshape(-1), own[at // FILTERS] * FILTERS + at % FILTERS, at // FILTERS)
            where.append(place)
            pooled.append(np.maximum(top + b, 0))
        x = np.hstack(pooled)
        z = np.clip(x @ weight + offset[0], -30, 30)
        importance = np.where(y == 1, 0.5 / self.share, 0.5 / (1 - self.share))
        error = (1 / (1 + np.exp(-z)) - y) * importance / len(some)
        back = error[:, None] * weight * (x > 0)
        d_filters, d_bias, d_words, places = [], [], [], []
        for i, f in enumerate(filters):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d_bias.append(g.sum(axis=0))
            d = np.zeros_like(f)
            for j in range(f.shape[0]):
                gj = np.where(where[i] + j <= last[:, None], g, 0)
                place = np.minimum(where[i] + j, n - 1)
                d[j] = np.einsum("nfd,nf->df", words[place], gj)
                at = np.flatnonzero(gj)
                places.append(place.ravel()[at])
                d_words.append(gj.ravel()[at, None] * f[j].T[at % FILTERS])
            d_filters.append(d)
        # gradients of table rows, from those of the words that hold a filter's highest response
        hit, step = rows[which[np.concatenate(places)]], np.concatenate(d_words)
        used, local = np.unique(hit[hit >= 0], return_inverse=True)
        of = np.nonzero(hit >= 0)[0]
        g = np.stack([np.bincount(local, step[of, d], len(used)) for d in range(DIMENSIONS)], axis=1)
        m, v = self.moments[0]
        m[used] = 0.9 * m[used] + 0.1 * g
        v[used] = 0.99 * v[used] + 0.01 * g * g
        embedding[used] -= RATE * 0.3 * m[used] / (np.sqrt(v[used]) + 1e-6) * (np.abs(g) > 0)
        self.t += 1
        for p, (m, v), g in zip(self.flat[1:], self.moments[1:], [*d_filters, *d_bias, x.T @ error, np.array([error.sum()])], strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def model_of(flat: list[np.ndarray]) -> Model:
    k = len(WIDTHS)
    single = [x.astype(np.float32) for x in flat[: 1 + 2 * k]]
    return Model(single[0], single[1 : 1 + k], single[1 + k :], flat[-2], float(flat[-1][0]))


def best_threshold(score: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, in the middle between the two scores that it parts; scores are above 0 (``thresholds`` is the same for tables)."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(labels[order] * weight[order])
    said, all_ = np.cumsum(weight[order]), float((labels * weight).sum())
    f1 = 2 * hit / (said + all_)
    last = np.append(s[1:] < s[:-1], True)
    f1 = np.where(last, f1, -1)
    best = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best] * 0.5)


def thresholds(scored: DataFrame) -> tuple[float, dict[str, float]]:
    """``best_threshold`` of all rows and of each language, from every (lang, label, score, bin).

    Running counts are those of the higher bins, which are few, and of the higher scores of the
    bin, so that no task needs all the rows of a language.
    """
    scope = F.explode(F.when(F.col("lang") != "", F.array(F.lit(""), "lang")).otherwise(F.array(F.lit(""))))
    equal = scored.select(scope.alias("scope"), "label", "score", "bin").groupBy("scope", "bin", "score").agg(F.sum("label").alias("hit"), F.count("*").alias("said"))
    down, whole = Window.partitionBy("scope").orderBy(F.desc("bin")), Window.partitionBy("scope")
    bins = equal.groupBy("scope", "bin").agg(F.sum("hit").alias("bin_hit"), F.sum("said").alias("bin_said"), F.max("score").alias("top"))
    bins = bins.select(
        "scope", "bin", F.lead("top").over(down).alias("below"), F.sum("bin_hit").over(whole).alias("toxic"), F.sum("bin_said").over(whole).alias("rows"),
        (F.sum("bin_hit").over(down) - F.col("bin_hit")).alias("above_hit"), (F.sum("bin_said").over(down) - F.col("bin_said")).alias("above_said"),
    )
    inner = Window.partitionBy("scope", "bin").orderBy(F.desc("score"))
    hit, said = (F.col(f"above_{x}") + F.sum(x).over(inner) for x in ("hit", "said"))
    lower = F.coalesce(F.lead("score").over(inner), F.col("below"))
    cut = equal.join(bins, ["scope", "bin"]).select("scope", "toxic", "rows", "score", (2 * hit / (said + F.col("toxic"))).alias("f1"), F.coalesce((F.col("score") + lower) / 2, F.col("score") * 0.5).alias("cut"))
    best = cut.groupBy("scope").agg(F.max(F.struct("f1", "score", "cut")).alias("best"), F.max(F.least("toxic", F.col("rows") - F.col("toxic"))).alias("least")).collect()
    own = {r.scope: r.best.cut for r in best if r.scope and r.least >= LEAST_FOR_THRESHOLD}
    return next(r.best.cut for r in best if not r.scope), own


#: What ``fit`` keeps of each row.
KEPT = "half int, label int, lang string, words bigint, rows binary, sizes binary, places binary"


def encode_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``KEPT`` from (half, text, label, lang)."""
    half, text, label, lang = batch.columns
    return pa.RecordBatch.from_arrays([half, label, lang, *encode(text)], names=[x.split(" ")[0] for x in KEPT.split(", ")])


def batches_of(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(half, labels, languages, ``decode``) of ``BATCH`` rows at a time, from ``KEPT`` in the order of halves, however it is cut on arrival."""

    def joined(held: list[pa.RecordBatch]) -> tuple:
        x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return x.column(0)[0].as_py(), x.column(1).to_numpy(), x.column(2), decode(*x.columns[3:])

    held: list[pa.RecordBatch] = []
    n = size = 0
    last = None
    for part in parts:
        at = 0
        for i, (half, words) in enumerate(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True)):
            if n and (half != last or n == BATCH or size >= BATCH_WORDS):
                yield joined([*held, part.slice(at, i - at)])
                held, n, size, at = [], 0, 0, i
            n, size, last = n + 1, size + words, half
        if at < part.num_rows:
            held.append(part.slice(at))
    if n:
        yield joined(held)


def count_rows(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By half: rows, toxic rows, and how many toxic and how many texts at all have each table row."""
    n = 1 << LOG_ROWS
    got: dict[int, list] = {}
    for half, labels, _, (rows, which, count) in batches_of(parts):
        text = np.zeros(len(rows), np.int64)
        text[which] = np.repeat(np.arange(len(count)), count)
        has = rows >= 0
        pairs = np.unique(np.repeat(text * n, has.sum(axis=1)) + rows[has])
        sums = got.setdefault(half, [0, 0, np.zeros((2, n), np.int64)])
        sums[0] += len(labels)
        sums[1] += int(labels.sum())
        sums[2] += [np.bincount(pairs[labels[pairs // n] == 1] % n, minlength=n), np.bincount(pairs % n, minlength=n)]
    for half, (rows, toxic, counts) in got.items():
        yield pa.RecordBatch.from_pydict({"half": [half], "rows": [rows], "toxic": [toxic], "counts": [counts.tobytes()]}, pa.schema({"half": pa.int32(), "rows": pa.int64(), "toxic": pa.int64(), "counts": pa.binary()}))


def fit(rows: DataFrame | list[tuple]) -> Model | None:
    """A model with thresholds from (doc_id, lang, text, label), where rows of an id may hold the text or the label alone; None without both labels."""
    if not isinstance(rows, DataFrame):
        rows = SparkSession.active().createDataFrame(rows, "doc_id bigint, lang string, text string, label int")
    sc = rows.sparkSession.sparkContext
    # the hash that partitions ids, so that a shard of ``sample`` has rows of one half
    half = F.pmod(F.hash("doc_id"), F.lit(2))
    text = F.max(F.when(F.col("text").isNotNull(), F.struct("text", "lang")))
    found = rows.groupBy(half.alias("half"), F.xxhash64("doc_id").alias("place"), "doc_id").agg(F.max("label").alias("label"), text.alias("x")).where("label is not null and x is not null")
    ordered = found.sortWithinPartitions("half", "place", "doc_id").select("half", "x.text", "label", "x.lang")
    kept = ordered.mapInArrow(over_slices(encode_rows), KEPT).persist(StorageLevel.DISK_ONLY)
    try:
        found = kept.mapInArrow(count_rows, "half int, rows bigint, toxic bigint, counts binary").collect()
        size = {h: np.array([sum(r["rows"] - r.toxic for r in found if r.half == h), sum(r.toxic for r in found if r.half == h)]) for h in (0, 1)}
        if not all(size[0] + size[1]):
            return None
        apart = min(*size[0], *size[1]) >= LEAST_IN_HALF
        halves = [(0,), (1,)] if apart else [(0, 1)]
        flats, shares = [], []
        for own in halves:
            bad, all_ = sum(np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in found if r.half in own)
            whole = sum(size[h] for h in own)
            shares.append(float(whole[1] / whole.sum()))
            flats.append(begin(bad, all_, shares[-1]))
        del found
        for _ in range(EPOCHS):
            shared = sc.broadcast([pack(f) for f in flats])

            def learn(parts: Iterable[pa.RecordBatch], shared=shared, shares=shares) -> Iterator[pa.RecordBatch]:
                training: dict[int, list] = {}
                for half, labels, _, features in batches_of(parts):
                    k = min(half, len(shares) - 1)
                    if k not in training:
                        training[k] = [Training(unpack(shared.value[k]), shares[k]), 0]
                    training[k][0].learn(*features, labels)
                    training[k][1] += len(labels)
                part = TaskContext.get().partitionId()
                for k, (t, n) in training.items():
                    yield pa.RecordBatch.from_pydict({"part": [part], "k": [k], "rows": [n], "flat": [pack(t.flat)]}, pa.schema({"part": pa.int32(), "k": pa.int32(), "rows": pa.int64(), "flat": pa.binary()}))

            got = sorted(kept.mapInArrow(learn, "part int, k int, rows bigint, flat binary").collect(), key=lambda r: r.part)
            for k in range(len(flats)):
                own = [r for r in got if r.k == k]
                flats[k] = unpack((sum(np.frombuffer(r.flat, np.float32).astype(np.float64) * r["rows"] for r in own) / sum(r["rows"] for r in own)).astype(np.float32).tobytes())
            del got
            shared.destroy()
        shared = sc.broadcast([model_of(f) for f in flats])

        def score(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for half, labels, lang, features in batches_of(parts):
                s = shared.value[1 - half if apart else 0].score_features(*features)
                yield pa.RecordBatch.from_arrays([lang, pa.array(labels, pa.int32()), pa.array(s, pa.float64()), pa.array(np.searchsorted(EDGES, s, "right").astype(np.int32))], names=["lang", "label", "score", "bin"])

        model = model_of([sum(x) / len(flats) for x in zip(*flats, strict=True)])
        scored = kept.mapInArrow(score, "lang string, label int, score double, bin int").persist(StorageLevel.DISK_ONLY)
        try:
            model.threshold, model.thresholds = thresholds(scored)
        finally:
            scored.unpersist()
            shared.destroy()
        return model
    finally:
        kept.unpersist()


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame]:
    """What ``fit`` learns from: every label and the texts of every labelled document, in shards by id."""
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "lang", "text")
    label = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic").cast("double") > 0).cast("int").alias("label"))
    n = label.count()
    if kind_of(docs, "doc_id") == kind_of(labels, "doc_id"):
        known = may_be_of(known, label, n)
    parts = min(SHARDS, n // SHARD_ROWS // 2 * 2) or 1
    # one shuffle into a given number of partitions, which a join wouldn't keep
    return (known.withColumn("label", F.lit(None).cast("int")).unionByName(label, allowMissingColumns=True).repartition(parts, "doc_id"),)


def may_be_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``docs`` without most of those whose id isn't among ``n`` ids, so that few texts are shuffled in vain: a bitmap of hashes, eight bits an id at least."""
    bits = 1 << max(15, (8 * n).bit_length())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in ids.select((place + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect():
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            there = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select([0, 1, 2]).filter(pa.array(there == 1))

    return docs.select("doc_id", "lang", "text", place.alias("place")).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, score, toxic) of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if m is None:
            score, bound = np.zeros(batch.num_rows), np.ones(batch.num_rows)
        else:
            score = m.score(batch.column(1))
            bound = np.array([m.thresholds.get(x, m.threshold) for x in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(score > bound)], names=["doc_id", "score", "toxic"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).mapInArrow(over_slices(run), f"doc_id {kind_of(docs, id_col)}, {SCHEMA}")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, and whether it is toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, fit(*sample(docs, labels)))
