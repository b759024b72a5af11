"""Passages that repeat across documents, by a run-length index of the places that can repeat.

A passage is ``LEAST`` words or more (letters and digits, small letters) that also occur,
word by word, in another document. All are found, and nothing else is marked.

1. *Anchors.* In every stretch of ``LEAST`` words the least hash of its ``WIDTH``-word
   shingles marks an anchor. Two equal stretches have the same anchor, so that a passage
   can only lie in the ``LEAST`` words around an anchor whose hash occurs in two documents.
2. *Whole contexts.* Anchors are counted by hash, and those left by hash and by a fingerprint
   of all the words around, in partly merged aggregates. A context that two documents share
   whole is a passage; each context has one representative from here on.
3. *Index.* The words around the representatives of an anchor go to one task, which makes
   the run-compressed Burrows-Wheeler transform of all its contexts (an anchor's contexts
   have an alphabet of their own): the word and the length of each run, and the places of
   the suffixes at both ends of each run. The suffix array that it is made from is dropped.
   The places at run heads, each with the suffix before it and their common prefix, give
   every other place's neighbour and common prefix by a predecessor search: both go on as
   they are from word to word within a run, the common prefix less by one. Matching
   statistics stream from there, in stretches of ``STRETCH`` words; a neighbour of the same
   document is stepped over. Matches of ``LEAST`` or more are marked.
   An anchor with more than ``CROWDED`` different contexts (where a passage begins or ends
   that very many documents hold) isn't for one task: each stretch of ``LEAST`` words of
   its contexts is hashed and counted by a distributed aggregate, with the same result.
4. Marks go back to all documents that have the context, by a join that adaptive execution
   splits where very many do, and are joined to passages.

Defined results: a null text and one of fewer than ``LEAST`` words have no passages; texts
are read whole, whatever their length. What repeats within one document only is not marked.
Rows with the same id are one document, rows with a null id none. An empty table has no
passages. Ids keep their type. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import csr_take, drop_shared, kind_of, materialize, over_slices, slices
from textlab.llm.words import hashed_words, mix, shingles

#: Words of the shortest passage, and of an anchor's shingle.
LEAST, WIDTH = 50, 8
#: Different contexts of an anchor that one task indexes at most; more are counted instead.
CROWDED = 4096
#: Words whose matching statistics are streamed at a time.
STRETCH = 1 << 17
ANCHOR_SCHEMA = "place int, anchor bigint, print bigint, low int, high int"
INDEX_SCHEMA = "anchor bigint, print bigint, low int, high int"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def anchors(texts: pa.Array, least: int = LEAST, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Row, place, hash, context's fingerprint and the context's first and last word, of all anchors of some texts."""
    h, _, _, count = hashed_words(texts)
    none = np.zeros(0, np.int64)
    window = least - width + 1
    long = np.flatnonzero(count >= least)
    if not long.size:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    first_word = np.cumsum(count) - count
    h = csr_take(h, first_word[long], count[long])
    count = count[long]
    first_word = np.cumsum(count) - count
    s, n = shingles(h, count, width)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(s), dtype=np.uint64)
    began = np.cumsum(n) - n
    packed = (s & ~low) | ((place - np.repeat(began, n).astype(np.uint64)) & low)
    # least of each window, by windows of powers of two
    span, least_of = 1, packed
    while span * 2 <= window:
        least_of = np.minimum(least_of[: len(least_of) - span], least_of[span:])
        span *= 2
    if span < window:
        least_of = np.minimum(least_of[: len(least_of) - (window - span)], least_of[window - span :])
    # where the least stands: the place in the low bits, next to the window's own
    per = n - window + 1
    at = csr_take(np.arange(len(least_of), dtype=np.int64), began, per)
    row = np.repeat(np.arange(len(n)), per)
    local = at - began[row]
    offset = ((least_of[at] & low).astype(np.int64) - local) & int(low)
    chosen = at + offset
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    chosen, row = chosen[new], row[new]
    p = chosen - began[row]
    a = np.maximum(p - (least - width), 0)
    z = np.minimum(p + least, count[row])
    # fingerprints of contexts: differences of the running sum of words by powers of an odd number
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)))
    back = _powers(_INVERSE, len(h))
    lo, hi = first_word[row] + a, first_word[row] + z
    sums = (total[hi] - total[lo]) * back[lo]
    print_ = mix(sums + mix(((z - a).astype(np.uint64) << np.uint64(32)) + (p - a).astype(np.uint64)))
    return long[row], p, s[chosen], print_, a, z


def stretches(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first word and hash of every stretch of ``least`` words of some contexts."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.view(np.uint64) * _powers(_BASE, len(words)), dtype=np.uint64)))
    n = np.maximum(sizes - least + 1, 0)
    context = np.repeat(np.arange(len(sizes)), n)
    low = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = starts[context] + low
    return context, low, mix((total[at + least] - total[at]) * _powers(_INVERSE, len(words) + 1)[at])


def suffixes(words: np.ndarray, group: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of contexts one after another, and each word's number in its group's alphabet (from 1).

    A suffix ends with its context; equal ones are ordered by place.
    """
    n = len(words)
    context = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ends = np.append(starts[1:], n)[context]
    order = np.lexsort((words, group[context]))
    change = np.ones(n, bool)
    change[1:] = (words[order[1:]] != words[order[:-1]]) | (group[context[order[1:]]] != group[context[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(change)  # from 1; 0 is the end of a context
    letters = rank
    span = 1
    longest = int(np.diff(np.append(starts, n)).max(initial=0))
    place = np.arange(n)
    while span < longest and rank.max(initial=0) < n:
        beyond = place + span
        second = np.where(beyond < ends, rank[np.minimum(beyond, n - 1)], 0)
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        change[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        span *= 2
    return order, letters


def common(letters: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common at their front."""
    size, lane, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while lane.size:
        lane = lane[(a[lane] + step < end_a[lane]) & (b[lane] + step < end_b[lane])]
        lane = lane[letters[a[lane] + step] == letters[b[lane] + step]]
        step += 1
        size[lane] = step
    return size


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of contexts, with the places at both ends of each run.

    ``letter`` and ``first`` are the letter and the first rank of each run; letters below 0
    are the beginnings of contexts. ``above`` has the places of run heads in text order, the
    place of the suffix before each in suffix order (-1: none) and their common prefix;
    ``below`` the same for run ends and the suffix after. All grow with the runs.
    """

    def __init__(self, words: np.ndarray, group: np.ndarray, starts: np.ndarray) -> None:
        order, letters = suffixes(words, group, starts)
        self.n, self.starts = len(words), starts
        before = np.empty(self.n, np.int64)
        before[1:] = letters[:-1]
        before[starts] = -1 - np.arange(len(starts))
        transform = before[order]
        self.first = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
        self.letter = transform[self.first]
        head, end = order[self.first], order[np.append(self.first[1:], self.n) - 1]
        # suffixes by first letter, and those of one letter, which no suffix goes before
        self.size = np.bincount(letters, minlength=int(letters.max()) + 2)
        self.alone = np.bincount(letters[np.append(starts[1:], self.n) - 1], minlength=len(self.size))
        ends = np.append(starts[1:], self.n)
        stop = lambda at: ends[np.searchsorted(starts, at, "right") - 1]
        lcp = common(letters, end[:-1], head[1:], stop(end[:-1]), stop(head[1:]))
        self.above = self._sampled(head, np.append(-1, end[:-1]), np.append(0, lcp))
        self.below = self._sampled(end, np.append(head[1:], -1), np.append(lcp, 0))
        # runs by letter, for ranks
        self.by_letter = np.lexsort((np.arange(len(self.letter)), self.letter))
        length = np.diff(np.append(self.first, self.n))[self.by_letter]
        self.before_run = np.cumsum(length) - length

    @staticmethod
    def _sampled(at: np.ndarray, other: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(at)
        return at[order], other[order], lcp[order]

    @staticmethod
    def step(sample: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of the suffixes at some places (-1: none) and the common prefixes with them."""
        k = np.searchsorted(sample[0], at, "right") - 1
        far = at - sample[0][k]
        other, lcp = sample[1][k], sample[2][k]
        return np.where(other < 0, -1, other + far), np.maximum(lcp - far, 0)

    def rank(self, letter: int, at: int) -> int:
        """How often a letter stands before a rank of the transform."""
        a, z = np.searchsorted(self.letter[self.by_letter], [letter, letter + 1])
        if a == z:
            return 0
        runs = self.by_letter[a:z]
        k = int(np.searchsorted(self.first[runs], at))  # runs of the letter that begin before
        if not k:
            return 0
        begin = int(self.first[runs[k - 1]])
        end = int(self.first[runs[k - 1] + 1]) if runs[k - 1] + 1 < len(self.first) else self.n
        return int(self.before_run[a + k - 1] - self.before_run[a]) + min(at, end) - begin

    def count(self, letters: list[int]) -> int:
        """How often a string of letters occurs, by backward search."""
        low, high = 0, self.n
        for i, c in enumerate(reversed(letters)):
            if not 0 < c < len(self.size):
                return 0
            begin = int(self.size[:c].sum())
            low, high = (begin, begin + int(self.size[c])) if not i else (begin + int(self.alone[c]) + self.rank(c, x) for x in (low, high))
            if low >= high:
                return 0
        return high - low

    def nearest(self, sample: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, document: np.ndarray, least: int) -> np.ndarray:
        """The common prefix with the nearest suffix, on one side, of another document; 0 where it is below ``least``."""
        own = document[np.searchsorted(self.starts, at, "right") - 1]
        other, size = self.step(sample, at)
        size[(other < 0) | (size < least)] = 0
        lane = np.flatnonzero(size)
        while (lane := lane[document[np.searchsorted(self.starts, other[lane], "right") - 1] == own[lane]]).size:
            other[lane], lcp = self.step(sample, other[lane])
            size[lane] = np.minimum(size[lane], lcp)
            size[lane[(other[lane] < 0) | (size[lane] < least)]] = 0
            lane = lane[size[lane] > 0]
        return size


def statistics(words: np.ndarray, group: np.ndarray, document: np.ndarray, starts: np.ndarray, least: int = 1) -> np.ndarray:
    """For each word: the longest match from it on with a context of another document of its group; 0 where it is below ``least``.

    ``document`` and ``group`` are by context. Matches at the nearest suffixes of another
    document on both sides are taken; no other suffix matches further.
    """
    out = np.zeros(len(words), np.int64)
    if len(words):
        index = RunIndex(words, group, starts)
        for a in range(0, len(words), STRETCH):
            at = np.arange(a, min(a + STRETCH, len(words)))
            out[at] = np.maximum(index.nearest(index.above, at, document, least), index.nearest(index.below, at, document, least))
    return out


def marks(words: np.ndarray, group: np.ndarray, document: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last word (within the context) of the stretches that repeat."""
    size = statistics(words, group, document, starts, least)
    at = np.flatnonzero(size >= least)
    if not at.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    context = np.searchsorted(starts, at, "right") - 1
    begin, end = at - starts[context], at - starts[context] + size[at]
    cut = np.ones(len(at), bool)
    reach = end + context * (1 << 40)  # ends don't fall within a context: matches shrink by one a word at most
    cut[1:] = (context[1:] != context[:-1]) | (begin[1:] + context[1:] * (1 << 40) > reach[:-1])
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(at)) - 1
    return context[heads], begin[heads], np.maximum.reduceat(end, heads) if heads.size else end[tails]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, width: int = WIDTH, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, first_word, last_word) of all stretches that repeat in other documents; words count from 0, ``last_word`` is the last one's number."""
    kind = kind_of(docs, id_col)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text is not null")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, p, h, prints, a, z = anchors(batch.column(1), least, width)
        if not row.size:
            return None
        ints = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ints(p), pa.array(h.view(np.int64)), pa.array(prints.view(np.int64)), ints(a), ints(z)], names=["doc_id", "place", "anchor", "print", "low", "high"])

    found = materialize(source.mapInArrow(over_slices(find), f"doc_id {kind}, {ANCHOR_SCHEMA}"), "anchors")
    spread = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    shared = materialize(found.join(spread, "anchor", "left_semi"), "shared")
    drop_shared(found)
    by_context = shared.groupBy("anchor", "print").agg(F.min(F.struct("doc_id", "place", "low", "high")).alias("one"), F.max("doc_id").alias("most"))
    by_context = materialize(by_context.select("anchor", "print", "one.*", (F.col("one.doc_id") < F.col("most")).alias("whole")), "representatives")
    per_anchor = by_context.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")

    # words of the representatives of contexts that may match in part
    open_ = by_context.join(per_anchor, "anchor").withColumn("crowded", F.col("contexts") > crowded)
    wanted = open_.groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor", "print", "low", "high", "whole", "crowded")).alias("wanted"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h, _, _, count = hashed_words(batch.column(1))
            first = np.cumsum(count) - count
            want = batch.column(2)
            sizes = np.diff(want.offsets.to_numpy())
            flat = want.flatten()
            col = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            row = np.repeat(np.arange(batch.num_rows), sizes)
            # rows with the same id may hold other texts: only contexts that are there as they were
            a, z = first[row] + col["low"], first[row] + col["high"]
            fits = col["high"] <= count[row]
            row, a, z = row[fits], a[fits], z[fits]
            body = (csr_take(h, a, z - a) >> np.uint64(16)).astype(np.uint64).view(np.int64)
            at = np.concatenate(([0], np.cumsum(z - a))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(at), pa.array(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(col["anchor"][fits]), pa.array(col["print"][fits]), pa.array(col["low"][fits].astype(np.int32)), pa.array(col["whole"][fits].astype(bool)), pa.array(col["crowded"][fits].astype(bool)), values],
                names=["doc_id", "anchor", "print", "low", "whole", "crowded", "words"],
            )

    texts = source.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(cut, f"doc_id {kind}, anchor bigint, print bigint, low int, whole boolean, crowded boolean, words array<bigint>")
    texts = materialize(texts, "contexts")
    placed = texts.where("not crowded").repartition("anchor").sortWithinPartitions("anchor")

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            if not t.num_rows:
                return
            lists = t.column("words").combine_chunks()
            at = lists.offsets.to_numpy().astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False)
            anchor = t.column("anchor").to_numpy()
            document = t.column("doc_id").to_numpy().copy()
            whole = t.column("whole").combine_chunks().to_numpy(zero_copy_only=False)
            _, document = np.unique(document, return_inverse=True)
            document = np.where(whole, -1 - np.arange(len(document)), document)  # of several documents
            context, begin, end = marks(words, anchor, document, at[:-1] - at[0], least)
            if context.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[context]), pa.array(t.column("print").to_numpy()[context]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                    names=["anchor", "print", "low", "high"],
                )

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 8192:
                continue
            last = batch.column(1)[batch.num_rows - 1].as_py()
            keep = np.flatnonzero(batch.column(1).to_numpy() != last)
            end = int(keep[-1]) + 1 if keep.size else 0  # the last anchor may go on in the next batch
            if end:
                held[-1] = batch.slice(0, end)
                yield from solve(held)
                held, size = [batch.slice(end)], batch.num_rows - end
        if held:
            yield from solve(held)

    partial = placed.select("doc_id", "anchor", "print", "low", "whole", "words").mapInArrow(index, INDEX_SCHEMA).withColumnsRenamed({"low": "from", "high": "to"})

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                lists = batch.column(4)
                at = lists.offsets.to_numpy().astype(np.int64)
                context, low, h = stretches(lists.flatten().to_numpy(zero_copy_only=False), at[:-1] - at[0], np.diff(at), least)
                rows = pa.array(context)
                yield pa.RecordBatch.from_arrays([*[batch.column(j).take(rows) for j in range(4)], pa.array(low.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "anchor", "print", "whole", "from", "stretch"])

    each = texts.where("crowded").select("doc_id", "anchor", "print", "whole", "words").mapInArrow(hashed, f"doc_id {kind}, anchor bigint, print bigint, whole boolean, from int, stretch bigint")
    common_ = each.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.max("whole").alias("many")).where("a < z or many").select("anchor", "stretch")
    counted = each.join(common_, ["anchor", "stretch"]).select("anchor", "print", "from", (F.col("from") + least).alias("to"))
    settled = by_context.where(F.col("whole") & (F.col("high") - F.col("low") >= least)).select("anchor", "print", F.lit(0).alias("from"), (F.col("high") - F.col("low")).alias("to"))
    back = shared.join(settled.union(partial).union(counted), ["anchor", "print"]).select("doc_id", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))

    # join overlapping and touching stretches
    order = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = back.withColumn("new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("low").alias("first_word"), (F.max("high") - 1).alias("last_word")).drop("island")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that another document repeats."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from w where len(w) >= 50),
g as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as g from p),
r as (select doc_id, i from g where g in (select g from g group by g having count(distinct doc_id) > 1)),
s as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from r),
t as (select doc_id, i, sum(new) over (partition by doc_id order by i) as island from s)
select doc_id, (min(i) - 1)::int as first_word, (max(i) + 48)::int as last_word from t group by doc_id, island
"""
