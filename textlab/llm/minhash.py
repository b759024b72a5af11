"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. *Signatures.* Every document's shingles of ``SHINGLE`` words give ``TREES * DEPTH``
   minima, 16 bits of each, and a hash of them all. Documents with the same hash are one
   class from here on: a task writes the minima of a class once, however often it meets it,
   so that copies by the million are a number and an id each.
2. *Orders.* Each tree orders all classes by its own ``DEPTH`` minima. Classes with a common
   prefix are neighbours in that order; a *region* is a run of them with a common prefix of
   ``LEAST_DEPTH``. First only (region, class) is shuffled, to find the classes that have
   neighbours, and in which trees; these alone get rows with their minima.
3. *Candidates* are all pairs of a region, however crowded it is: up to ``REGION`` classes
   are compared pair by pair; in a larger region leaders search it: what is alike to a
   leader is linked and leads a pass itself over what isn't linked yet. Two classes are left
   uncompared only where they are linked already, through others, or where their distances
   from a third show that they are unlike. So no candidate is dropped for want of room; a
   region's time grows with the square of the number of its classes that are unlike each
   other.
4. A candidate pair is linked where the share of equal minima (all trees) reaches
   ``THRESHOLD``, an estimate of the Jaccard similarity of the shingle sets. Groups are the
   connected components of the links; the document with the least id stays.

Orders are hash-partitioned by region and sorted within partitions, so that a region is
never cut between partitions. Joins with all documents broadcast the other side where it
has at most ``BROADCAST_ROWS`` rows, and else are shuffled by class, where adaptive
execution splits a class that holds a large part of all rows.

Defined results: texts that are null or hold no words belong to no group; a text with
fewer words than a shingle has one shingle of them all. Texts are read whole, whatever
their length. Rows with the same id count as one document, rows with a null id as none. An
empty table has no groups. Ids keep their type. Extra columns are ignored, and kept by
``keep_one``, also ones named like the results here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import drop_shared, kind_of, materialize, slices
from textlab.llm.words import hashed_words, mix, shingles

SHINGLE, TREES, DEPTH, LEAST_DEPTH = 3, 16, 8, 3
THRESHOLD, REGION = 0.5, 256
#: Up to so many rows of a class or an id, and a number, are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: Classes that a task remembers, so as to write their minima once.
SEEN = 1 << 20
ORDER_SCHEMA = "region bigint, place binary, sketch binary, id bigint"

_RNG = np.random.default_rng(0x1F0E57)
_XOR = _RNG.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32)
_MUL = _RNG.integers(1 << 31, size=TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SUM = _RNG.integers(1 << 62, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a word, and their minima (uint32, one column for each permutation)."""
    h, _, _, count = hashed_words(texts)
    s, n = shingles(h, count, width)
    rows = np.flatnonzero(n)
    if not rows.size:
        return rows, np.zeros((0, TREES * DEPTH), np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    first = (np.cumsum(n) - n)[rows]
    out = np.empty((rows.size, TREES * DEPTH), np.uint32)
    step = 1 << 15
    if len(x) <= 4 * step:
        for j in range(TREES * DEPTH):
            out[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], first)
    else:  # long texts: by stretches that fit the cache
        out[:] = 0xFFFFFFFF
        for a in range(0, len(x), step):
            part = x[a : a + step]
            i = int(np.searchsorted(first, a, "right")) - 1
            k = int(np.searchsorted(first, a + len(part)))
            cut = np.maximum(first[i:k] - a, 0)
            for j in range(TREES * DEPTH):
                out[i:k, j] = np.minimum(out[i:k, j], np.minimum.reduceat((part ^ _XOR[j]) * _MUL[j], cut))
    return rows, out


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary array with the bytes of each row."""
    raw = np.ascontiguousarray(rows).tobytes()
    n = len(raw) // max(1, len(rows))
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(raw)])


def _wide(column: pa.Array, n: int) -> np.ndarray:
    """The bytes of a binary array whose rows all have ``n``."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at : at + len(column) * n].reshape(len(column), n)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, class, minima) of every document with a word; the minima are null where the task gave them already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            rows, minima = signatures(batch.column(1), width)
            if not rows.size:
                continue
            number = mix((minima.astype(np.uint64) * _SUM).sum(axis=1, dtype=np.uint64)).view(np.int64)
            value, first = np.unique(number, return_index=True)
            if len(seen) > SEEN:
                seen.clear()
            new = [i for v, i in zip(value.tolist(), first.tolist(), strict=True) if v not in seen]
            seen.update(value.tolist())
            # minima of long texts are small numbers: take bits that depend on all of theirs
            bits = (((minima[new] ^ (minima[new] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
            at = np.full(len(rows), -1)
            at[new] = np.arange(len(new))
            kept = _fixed(bits).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number), kept], names=["id", "class", "minima"])

    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id is not null and text is not null")
    return read.mapInArrow(run, f"id {kind_of(docs, id_col)}, class bigint, minima binary")


def _regions(key: np.ndarray) -> np.ndarray:
    """The region of each class in each tree, from ``key`` by class, tree and depth."""
    region = np.zeros((len(key), TREES), np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(LEAST_DEPTH):
        region = mix(region * np.uint64(0x9E3779B97F4A7C15) + key[:, :, d].astype(np.uint64))
    return region.view(np.int64)


def neighbours(classes: DataFrame) -> DataFrame:
    """(class, trees): the classes that share a region with another, and a bit for each tree in which they do."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _wide(batch.column(1), 2 * TREES * DEPTH).view(">u2").reshape(-1, TREES, DEPTH)
            number = np.repeat(batch.column(0).to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int8), len(key))
            yield pa.RecordBatch.from_arrays([pa.array(_regions(key).ravel()), pa.array(number), pa.array(tree)], names=["region", "class", "tree"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)], False
        for batch in batches:
            if not batch.num_rows:
                continue
            region, number, tree = (np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True))
            new = np.append(True, (region[1:] != region[:-1]) | (number[1:] != number[:-1]))
            region, number, tree = region[new], number[new], tree[new]
            same = region[1:] == region[:-1]
            several = np.append(same, False) | np.append(False, same)
            last = bool(several[-1]) or (done and len(region) == 1)
            held = [x[-1:].copy() for x in (region, number, tree)]
            if done:  # the row held from before was given
                several[0] = False
            done = last
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(number[several]), pa.array(np.int32(1) << tree[several].astype(np.int32))], names=["class", "tree"])

    placed = classes.mapInArrow(place, "region bigint, class bigint, tree tinyint").repartition("region").sortWithinPartitions("region", "class")
    return placed.mapInArrow(shared, "class bigint, tree int").groupBy("class").agg(F.bit_or("tree").alias("trees"))


def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree in which it has neighbours: region, place in the tree's order, sketch, class; of (class, minima, trees)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                key = _wide(batch.column(1), 2 * TREES * DEPTH).view(">u2").reshape(-1, TREES, DEPTH)
                row, tree = np.nonzero(batch.column(2).to_numpy()[:, None] >> np.arange(TREES) & 1)
                sketch = (key.reshape(len(key), -1) & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(_regions(key)[row, tree]), _fixed(key[row, tree]), _fixed(sketch[row]), pa.array(batch.column(0).to_numpy()[row])], names=["region", "place", "sketch", "id"])

    return classes.select("class", "minima", "trees").mapInArrow(run, ORDER_SCHEMA)


def small(df: DataFrame) -> DataFrame:
    """The table, marked for a broadcast where it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def agreeing(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The number of places in which each row of a sketch equals ``one``."""
    out = np.empty(len(sketch), np.int64)
    for a in range(0, len(sketch), 1024):
        eights = (sketch[a : a + 1024] == one).view(np.uint64).sum(axis=1)  # eight counts in each number
        out[a : a + 1024] = eights.view(np.uint8).reshape(-1, 8).sum(axis=1) if len(one) > 255 else (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


def links_of_region(ids: np.ndarray, key: np.ndarray, sketch: np.ndarray, threshold: float = THRESHOLD, limit: int = REGION) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among the documents of a region (sorted by key).

    Up to ``limit`` documents give all pairs. A larger region gives pairs that connect all
    that are connected: a document leads a pass over those that nothing has reached, then
    each that was reached leads one, until none is added; then the next one begins.
    """
    out = []
    width = sketch.shape[1]
    least = int(np.ceil(threshold * width - 1e-9))
    if len(ids) <= limit:
        for i in range(len(ids) - 1):
            hit = np.flatnonzero(agreeing(sketch[i + 1 :], sketch[i]) >= least)
            if hit.size:
                out.append((ids[i + 1 + hit], np.full(hit.size, ids[i])))
        return out
    _, first, which = np.unique(np.ascontiguousarray(sketch).view(f"V{width}").ravel(), return_index=True, return_inverse=True)
    same = first[which]
    again = np.flatnonzero(same != np.arange(len(ids)))
    if again.size:
        out.append((ids[again], ids[same[again]]))
    rest = np.sort(first)
    free = sketch[rest]
    while rest.size > 1:
        # (row, places equal to the first leader's) of those reached that haven't led yet
        todo = [(int(rest[0]), width)]
        rest, free = rest[1:], free[1:]
        near = None
        while todo and rest.size:
            row, agree = todo.pop()
            if near is None:
                count = near = agreeing(free, sketch[row])
                hit = count >= least
            else:
                # unequal places are a distance: what is far from the first leader is far from those next to it
                may = np.flatnonzero(near >= least + agree - width)
                hit = np.zeros(rest.size, bool)
                hit[may[agreeing(free[may], sketch[row]) >= least]] = True
            if hit.any():
                out.append((ids[rest[hit]], np.full(int(hit.sum()), ids[row])))
                todo += zip(rest[hit].tolist(), near[hit].tolist(), strict=True)
                rest, free, near = rest[~hit], free[~hit], near[~hit]
    return out


def links(order: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (u, v), u > v, of linked documents; ``order`` as ``orders`` gives it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def parts(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return b.column(0).to_numpy(), _wide(b.column(1), 2 * DEPTH).view(">u2"), _wide(b.column(2), TREES * DEPTH), b.column(3).to_numpy()

        def solve(region: np.ndarray, key: np.ndarray, sketch: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
            size = np.diff(np.append(cut, len(region)))
            found = []
            two = cut[size == 2]
            if two.size:  # the common case, all at a time
                hit = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= int(np.ceil(threshold * sketch.shape[1] - 1e-9))]
                found.append((ids[hit], ids[hit + 1]))
            for a, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found += links_of_region(ids[a : a + n], key[a : a + n], sketch[a : a + n], threshold)
            if found:
                u, v = (np.concatenate(x) for x in zip(*found, strict=True))
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1)[u != v], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = parts(batch)
            last = np.flatnonzero(now[0] != now[0][-1])
            end = int(last[-1]) + 1 if last.size else 0  # the last region may go on in the next batch
            kept.append(tuple(a[:end] for a in now) if end else now)
            if end:
                yield from solve(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept = [tuple(a[end:].copy() for a in now)]
            else:
                kept[-1] = tuple(a.copy() for a in now)
        if kept:
            yield from solve(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    placed = order.repartition("region").sortWithinPartitions("region", "place")
    return placed.mapInArrow(run, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least number of u's component, for every u that isn't it.

    Alternates two steps until nothing changes: every vertex hangs its larger neighbours on
    the least of its neighbours, then its smaller ones. The least is a partly merged
    aggregate, and the join with it is one that adaptive execution can split, so that a
    vertex with very many neighbours isn't for one task. Each round is a table in the shared
    folder, removed after the next one. The number of rounds grows with the logarithm of the
    size of a component.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v")) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = both.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
        if large:
            out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    seen, old = None, None
    while True:
        edges = materialize(step(step(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old is not None:
            drop_shared(old)
        if now == seen or not now[0]:
            return edges
        seen, old = now, edges


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(doc_id, kept_id) of every document that isn't the one kept of its group."""
    every = materialize(signed(docs, id_col, text_col, width), "signatures")
    classes = every.where("minima is not null").select("class", "minima")
    near = materialize(neighbours(classes), "neighbours")
    known = classes.join(small(near), "class").dropDuplicates(["class"])
    # rows with the same id are one document, also where their texts are of several classes
    several = every.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("id", "a")
    same = every.join(several, "id").where(F.col("class") != F.col("a")).select(F.col("class").alias("u"), F.col("a").alias("v"))
    found = materialize(links(orders(known), threshold).union(same), "links")
    joined = components(found)
    drop_shared(near, found)
    # the least id of each class, then of each group; groups of one document drop out
    sizes = every.groupBy("class").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    group = joined.select(F.col("u").alias("class"), F.col("v").alias("group")).union(joined.select("v", "v").distinct().toDF("class", "group"))
    labelled = sizes.join(group, "class", "left").where("group is not null or first < last").select("class", "first", F.coalesce("group", "class").alias("group"))
    labelled = materialize(labelled, "classes")
    kept = labelled.groupBy("group").agg(F.min("first").alias("kept_id"))
    of_class = materialize(labelled.join(kept, "group").select("class", "kept_id"), "kept")
    drop_shared(labelled)
    return every.select("id", "class").join(small(of_class), "class").where("id <> kept_id").select(F.col("id").alias("doc_id"), "kept_id").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that ``duplicates`` names, with all of their columns."""
    name = "_removed"
    while name in docs.columns:
        name += "_"
    removed = materialize(duplicates(docs, id_col, text_col).select(F.col("doc_id").alias(name)), "removed")
    return docs.join(small(removed), docs[id_col] == F.col(name), "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy of another, with the one that is kept."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
