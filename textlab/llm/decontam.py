"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes (normalised: lower case, every run of other signs than letters and
digits one blank) may occur with up to k = ``RATE`` * m edits. It is split into k + 1
pieces, of which an occurrence must hold one untouched. An Aho-Corasick automaton finds
all exact hits of all pieces in one pass over the texts.

A hit is verified upwards: j consecutive pieces with fewer than j edits in them can be cut
in two runs of pieces of which one has fewer edits than pieces, too. So runs are nested, from
the whole item (k + 1 pieces, k edits) down to single pieces, and a hit counts only while
each next larger run around it matches within its budget. Myers' bit-parallel algorithm
gives the least distance of a run, and of the item, to any stretch of the text around.
Occurrences within k edits are all found, and none beyond is reported.

Many items may share a template. Pieces are cut from the front in equal widths and runs are
of 1, 2, 4, ... pieces, so that such items have pieces and runs in common; a run is verified
once for all of them, and their last step runs Myers' algorithm for many items side by side.

The items go to the executors in blocks of at most ``BLOCK_BYTES`` of normalised text.
There is one block, and one pass over the documents, as long as the benchmark is smaller
than that; a larger one takes a pass for each block.

Defined results: null or blank texts and items match nothing. Items with a null id match
like others, with a null id in the result. Items with the same text each match. An item of
fewer than 1 / ``RATE`` bytes has no budget: it must occur exactly, and as whole words (``no``
isn't in ``nothing``). Of several occurrences of an item in a document the least distance
counts, in one row; repeated rows give repeated rows. Texts and items are read whole,
whatever their length. Empty tables match nothing. Ids keep their type. Extra columns are
ignored, and kept by ``keep_clean``, also ones named like the results here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textlab.llm.common import data, kind_of, offsets, slices
from textlab.llm.words import WORD

#: Edits allowed for each byte of an item.
RATE = 0.1
BLOCK_BYTES = 2 << 20
#: From so many candidates on they are verified side by side, in blocks of so many 64-bit words.
SIDE_BY_SIDE, LANE_WORDS = 64, 2048


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts in a row, and where each begins and ends."""
    lower = pc.utf8_lower(texts)
    raw = data(lower)
    starts, ends = offsets(lower)
    word = WORD[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first sign after a word becomes a blank
    edge = ends[(ends > starts) & (ends < len(raw))]
    if edge.size:
        keep[edge] = word[edge]  # a text's first sign doesn't follow a word of its own
    kept = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(word, raw, np.uint8(32))[keep]
    first, last = kept[starts], kept[ends]
    trailing = (last > first) & (out[np.maximum(last - 1, 0)] == 32) if len(out) else np.zeros(len(first), bool)
    return out, first, last - trailing


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """Starts and ends of the k + 1 pieces of an item of m bytes: of equal width, the last has the rest."""
    cut = [*range(0, m // (k + 1) * (k + 1), max(1, m // (k + 1))), m]
    return list(zip(cut, cut[1:], strict=False))


def nested(m: int, k: int) -> list[list[tuple[int, int, int]]]:
    """For each piece, the ever larger runs of pieces around it, without it and the item: (start, end, budget)."""
    cut = pieces(m, k)
    chains: list[list[tuple[int, int, int]]] = [[] for _ in cut]

    def halve(a: int, b: int) -> None:
        if b - a < len(cut):
            for i in range(a, b):
                chains[i].insert(0, (cut[a][0], cut[b - 1][1], b - a - 1))
        if b - a > 1:
            middle = a + (1 << (b - a - 1).bit_length() - 1)
            halve(a, middle)
            halve(middle, b)

    halve(0, len(cut))
    return [c[1:] for c in chains] if len(cut) > 1 else chains


def intact(part: bytes, text: bytes, at: int, budget: int) -> bool:
    """Is one of ``budget + 1`` parts whole in the text, no further than ``budget`` from its place?"""
    for a, b in pieces(len(part), budget):
        if text.find(part[a:b], max(0, at + a - budget), at + b + budget) >= 0:
            return True
    return False


def myers(pattern: bytes, text: bytes) -> int:
    """Least edit distance of the pattern to any stretch of the text (Myers 1999)."""
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full  # the text may begin anywhere, so nothing enters from above
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


def myers_many(patterns: list[bytes], windows: list[bytes]) -> list[int]:
    """``myers`` of many patterns, each with a text of its own, side by side."""
    out = [0] * len(patterns)
    words = [-(-len(p) // 64) for p in patterns]
    order = sorted(range(len(patterns)), key=lambda i: (words[i], len(windows[i])))
    at = 0
    while at < len(order):
        w = words[order[at]]
        lanes = [i for i in order[at : at + max(1, LANE_WORDS // w)] if words[i] == w]
        at += len(lanes)
        known = {p: j for j, p in enumerate(dict.fromkeys(patterns[i] for i in lanes))}
        peq = np.zeros((len(known), 256, w), np.uint64)
        for p, j in known.items():
            place = np.arange(len(p))
            np.bitwise_or.at(peq, (j, np.frombuffer(p, np.uint8), place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        own = np.array([known[patterns[i]] for i in lanes])
        m = np.array([len(patterns[i]) for i in lanes], np.int64)
        size = np.array([len(windows[i]) for i in lanes], np.int64)
        text = np.zeros((len(lanes), int(size.max(initial=0))), np.uint8)
        text[np.arange(text.shape[1]) < size[:, None]] = np.frombuffer(b"".join(windows[i] for i in lanes), np.uint8)
        last = ((m - 1) & 63).astype(np.uint64)
        pv, mv = np.full((w, len(lanes)), ~np.uint64(0)), np.zeros((w, len(lanes)), np.uint64)
        score, best, one, top = m.copy(), m.copy(), np.uint64(1), np.uint64(63)
        for t in range(text.shape[1]):
            plus = minus = np.zeros(len(lanes), np.uint64)  # nothing enters from above: the text may begin anywhere
            eqs = peq[own, text[:, t]]
            for j in range(w):
                eq, p, n = eqs[:, j], pv[j], mv[j]
                xv = eq | n
                eq = eq | minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = n | ~(xh | p), p & xh
                if j == w - 1:
                    score += ((ph >> last) & one).astype(np.int64)
                    score -= ((mh >> last) & one).astype(np.int64)
                up, down = ph >> top, mh >> top
                ph, mh = ph << one | plus, mh << one | minus
                pv[j], mv[j] = mh | ~(xv | ph), ph & xv
                plus, minus = up, down
            np.minimum(best, np.where(t < size, score, best), out=best)
        for i, d in zip(lanes, best.tolist(), strict=True):
            out[i] = d
    return out


def distances(patterns: list[bytes], windows: list[bytes]) -> list[int]:
    """``myers`` of each pattern and window, side by side where there are many."""
    return myers_many(patterns, windows) if len(patterns) >= SIDE_BY_SIDE else list(map(myers, patterns, windows))


class Matcher:
    """The automaton of a block of items.

    Each of its words has the items without a budget that it stands for, and groups of
    items in which it is a piece with the same runs around.
    """

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE) -> None:
        import ahocorasick

        self.items = [(i, p, int(rate * len(p))) for i, p in items if p]
        exact: dict[bytes, list[int]] = {}
        by_piece: dict[bytes, dict[tuple, list[int]]] = {}
        self.runs: dict[tuple[bytes, int], int] = {}
        for n, (_, p, k) in enumerate(self.items):
            if not k:
                exact.setdefault(b" " + p + b" ", []).append(n)
                continue
            for (a, b), runs in zip(pieces(len(p), k), nested(len(p), k), strict=True):
                chain = tuple((self.runs.setdefault((p[x:y], budget), len(self.runs)), a - x) for x, y, budget in runs)
                by_piece.setdefault(p[a:b], {}).setdefault((chain, a), []).append(n)
        self.run = list(self.runs)
        self.members: list[tuple[int, ...]] = []
        numbers: dict[tuple[int, ...], int] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in {**exact, **by_piece}:
            groups = []
            for (chain, a), of in by_piece.get(piece, {}).items():
                number = numbers.setdefault(tuple(of), len(numbers))
                if number == len(self.members):
                    self.members.append(tuple(of))
                groups.append((number, a, chain))
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), exact.get(piece, ()), groups))
        self.automaton.make_automaton()

    def verified(self, hits: list[tuple], raw: bytes, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        """The hits (row, group, start, offset in the item, size, chain) around which all runs match within their budgets.

        One size of runs after the other; each run is verified once for a place.
        """
        out = []
        level = 0
        while hits:
            known: dict[tuple[int, int, int], bool] = {}
            todo, windows, budgets = [], [], []
            for row, _, start, _, size, chain in hits:
                if level == len(chain):
                    continue
                key = (*chain[level], start)
                if key in known:
                    continue
                text, k = self.run[chain[level][0]]
                b = start - chain[level][1]
                left, right = text[: chain[level][1]], text[chain[level][1] + size :]
                known[key] = raw[b : b + len(text)] == text if b >= first[row] and b + len(text) <= last[row] else False
                if not known[key] and ((left and intact(left, raw, b, k)) or (right and intact(right, raw, start + size, k))):
                    todo.append((key, text))
                    budgets.append(k)
                    windows.append(raw[max(int(first[row]), b - k) : min(int(last[row]), b + len(text) + k)])
            for (key, _), d, k in zip(todo, distances([t for _, t in todo], windows), budgets, strict=True):
                known[key] = d <= k
            out += [h for h in hits if level == len(h[5])]
            hits = [h for h in hits if level < len(h[5]) and known[*h[5][level], h[2]]]
            level += 1
        return out

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item number, distance, budget) of all matches."""
        if not self.items:
            return []
        body, first, last = normalised(texts)
        plain = body.tobytes()
        # a blank before and after each text
        raw = b" " + b" ".join([plain[a:z] for a, z in zip(first.tolist(), last.tolist(), strict=True)]) + b" "
        first = np.cumsum(last - first + 1) - (last - first)
        last = np.append(first[1:] - 1, len(raw) - 1)
        ends, hits = [], []
        for end, hit in self.automaton.iter(raw.decode("latin-1")):
            ends.append(end)
            hits.append(hit)
        if not ends:
            return []
        rows = np.searchsorted(first, np.array(ends) - 1, "right") - 1
        best: dict[tuple[int, int], int] = {}
        begin: dict[tuple[int, int], set[int]] = {}
        found = []
        for end, row, (size, exact, groups) in zip(ends, rows.tolist(), hits, strict=True):
            start = end + 1 - size
            lo, hi = int(first[row]), int(last[row])
            for n in exact if start + 1 >= lo and end <= hi else ():
                best[row, n] = 0
            if start >= lo and end < hi:
                found += [(row, number, start, a, size, chain) for number, a, chain in groups]
        for row, number, start, a, _, _ in self.verified(found, raw, first, last):
            begin.setdefault((row, number), set()).add(start - a)
        by_item: dict[tuple[int, int], set[int]] = {}
        for (row, number), at in begin.items():
            for n in self.members[number]:
                key = row, n
                by_item[key] = by_item[key] | at if key in by_item else at
        todo: list[tuple[int, int]] = []
        windows: list[bytes] = []
        for (row, n), at in by_item.items():
            _, p, k = self.items[n]
            if any(raw[b : b + len(p)] == p and b >= first[row] and b + len(p) <= last[row] for b in at):
                best[row, n] = 0
                continue
            done = None
            for b in sorted(at):  # near beginnings share one window
                if done is None or b > done:
                    done = b + k
                    todo.append((row, n))
                    windows.append(raw[max(int(first[row]), b - k) : min(int(last[row]), b + len(p) + 2 * k)])
        for (row, n), d in zip(todo, distances([self.items[n][1] for _, n in todo], windows), strict=True):
            if d <= min(self.items[n][2], best.get((row, n), d)):
                best[row, n] = d
        return [(row, n, d, self.items[n][2]) for (row, n), d in sorted(best.items())]


#: The last matcher of this worker; it keeps the items, so that no other list has their address.
_matchers: dict[tuple[int, float], tuple[list[tuple[int, bytes]], Matcher]] = {}


def _matcher(items: list[tuple[int, bytes]], rate: float) -> Matcher:
    key = (id(items), rate)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = items, Matcher(items, rate)
    return _matchers[key][1]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items, by blocks of about ``limit`` bytes at most."""
    items = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        body, first, last = normalised(pa.array([r.text for r in rows], pa.string()))
        yield [(r.id, body[a:z].tobytes()) for r, a, z in zip(rows, first, last, strict=True)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, budget) of each document that holds a benchmark item."""
    spark = docs.sparkSession
    kind = kind_of(benchmark, "item_id")
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    read = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def finder(items: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate)
            for part in slices(batches):
                found = matcher.find(part.column(1))
                if found:
                    rows, ns, distance, budget = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array([matcher.items[n][0] for n in ns], item_type), pa.array(distance, pa.int32()), pa.array(budget, pa.int32())],
                        names=["doc_id", "item_id", "distance", "budget"],
                    )

        return read.mapInArrow(run, f"doc_id {kind_of(docs, id_col)}, item_id {kind}, distance int, budget int")

    return reduce(DataFrame.union, [finder(items) for items in blocks(benchmark, limit=limit)])


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all of their columns; no shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for items in blocks(benchmark, limit=limit):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = _matcher(shared.value, rate)
            for part in slices(batches, at):
                good = np.ones(part.num_rows, bool)
                good[[row for row, *_ in matcher.find(part.column(at))]] = False
                yield part if good.all() else part.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the item and its distance."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
