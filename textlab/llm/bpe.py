"""Byte-pair encoding by speculation and verification, and decoding.

A text is split into pre-tokens by a pattern. Each distinct pre-token is encoded once
per worker:

1. *Speculate*: a vectorised walk of the vocabulary's trie takes the longest token at
   every place, for all new pre-tokens at a time.
2. *Verify*: a token sequence is the BPE encoding of its bytes if and only if each
   adjacent pair of tokens is the BPE encoding of that pair's bytes. The test of a pair
   undoes the merges of both tokens in the reverse of their order and asks at each step
   whether the two parts at the boundary would have merged first. It runs over all
   distinct pairs at a time, in numpy.
3. Only pre-tokens with a pair that fails are merged exactly.

Null texts give null tokens, empty texts an empty list; repeated texts are encoded like
any other, an empty table gives an empty one. Texts of any length are encoded whole. Ids
keep their type. No special tokens are recognised: their strings are ordinary text. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textlab.llm.common import csr_take, data, kind_of, offsets, over_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split of byte-level BPE: contractions, letters, digits, other signs, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct units, and tokens of them, that a worker keeps.
CACHE_UNITS, CACHE_TOKENS = 300_000, 1 << 22
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 1 << 20
#: Words of up to so many bytes are merged side by side.
SIDE_BY_SIDE = 32
SCHEMA = "n_tokens int, tokens array<int>, round_trip boolean"


class Vocabulary:
    """Tokens by rank, with the tables that greedy matching and the pair test need."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens, self.pattern = tokens, pattern
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        n = len(tokens)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        reachable = np.ones(n, bool)
        for t, token in enumerate(tokens):
            if len(token) > 1:
                parts = merge(token, self.rank, t)
                if len(parts) == 2:
                    self.left[t], self.right[t] = self.rank[parts[0]], self.rank[parts[1]]
                else:
                    reachable[t] = False
        self.reachable = reachable
        self._tables()

    def _tables(self) -> None:
        n = len(self.tokens)
        whole = np.flatnonzero(self.reachable & (self.left != np.arange(n)))
        key = self.left[whole].astype(np.int64) * n + self.right[whole]
        order = np.argsort(key)
        # all pairs of tokens that make a token, also those that no token is merged from
        splits, rank = [], self.rank
        for t, i in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    splits.append((a * n + b, i))
        every = np.array(sorted(splits), np.int64).reshape(-1, 2)
        self.split_key, self.split_rank = np.ascontiguousarray(every[:, 0]), np.ascontiguousarray(every[:, 1]).astype(np.int32)
        self.pair_key, self.pair_rank = key[order], whole[order].astype(np.int64)
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        ends: dict[int, int] = {}
        for t in np.flatnonzero(self.reachable):
            token = self.tokens[t]
            node = 0
            for i in range(1, len(token) + 1):
                child = nodes.get(token[:i])
                if child is None:
                    child = nodes[token[:i]] = len(nodes)
                    edges.append((node * 256 + token[i - 1], child))
                node = child
            ends[node] = int(t)
        edge = np.array(edges, np.int64)
        edge = edge[np.argsort(edge[:, 0])]
        self.edge_key, self.edge_to = np.ascontiguousarray(edge[:, 0]).astype(np.int32), np.ascontiguousarray(edge[:, 1]).astype(np.int32)
        self.node_token = np.full(len(nodes), -1, np.int32)
        self.node_token[list(ends)] = list(ends.values())

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("tokens", "pattern", "byte", "left", "right", "reachable")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self._tables()

    @classmethod
    def load(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
        """From a file with a base64 token and its rank in each line; ranks run from 0."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls([base64.b64decode(t) for t, _ in sorted(pairs, key=lambda p: int(p[1]))], pattern)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: does the encoding of their bytes consist of just the two?"""
        n = len(self.tokens)
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        lane, limit = np.arange(len(a)), np.full(len(a), n + 1, np.int64)
        while lane.size:
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossed = (self.pair_key[at] == key) & (self.pair_rank[at] < limit)
            good[lane[crossed]] = False
            first = a > b  # the later of the two merges is undone first; of equals, the one on the right
            to_a, to_b = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            go = ~crossed & np.where(first, to_a != a, to_b != b)
            limit = np.where(first, a, b + 1)[go]
            a, b, lane = np.where(first, to_a, a)[go], np.where(first, b, to_b)[go], lane[go]
        return good

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words: word numbers and tokens, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        body = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at, lanes = ends - size, np.flatnonzero(size)
        out_lane, out_token = [], []
        while lanes.size:
            node = np.zeros(lanes.size, np.int32)
            best, step = np.full(lanes.size, -1, np.int32), np.zeros(lanes.size, np.int64)
            alive, place, depth = np.arange(lanes.size), at[lanes], 0
            stop = ends[lanes]
            while alive.size:
                key = node[alive] * 256 + body[place[alive] + depth]
                e = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                hit = self.edge_key[e] == key
                alive, to = alive[hit], self.edge_to[e[hit]]
                depth += 1
                node[alive] = to
                token = self.node_token[to]
                ended = token >= 0
                best[alive[ended]], step[alive[ended]] = token[ended], depth
                alive = alive[place[alive] + depth < stop[alive]]
            out_lane.append(lanes)
            out_token.append(best)
            at[lanes] += step
            lanes = lanes[at[lanes] < ends[lanes]]
        if not out_lane:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        lane, token = np.concatenate(out_lane), np.concatenate(out_token)
        order = np.argsort(lane, kind="stable")
        return lane[order], token[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words in a row, how many each has, and how many words had to be merged exactly."""
        lane, token = self.greedy(words)
        size = np.bincount(lane, minlength=len(words))
        start = np.cumsum(size) - size
        same = lane[1:] == lane[:-1]
        left, right = token[:-1][same], token[1:][same]
        key, back = np.unique(left.astype(np.int64) * len(self.tokens) + right, return_inverse=True)
        bad = ~self.compatible(key // len(self.tokens), key % len(self.tokens))[back]
        failing = np.unique(lane[:-1][same][bad])
        if not failing.size:
            return token, size, 0
        length = np.fromiter((len(words[w]) for w in failing.tolist()), np.int64, failing.size)
        failing = failing[np.argsort(length, kind="stable")]
        short = int((length <= SIDE_BY_SIDE).sum())
        parts, known = [token], len(token)
        for i in range(0, short, 4096):
            some = failing[i : min(i + 4096, short)]
            flat, n = self.merge_flat([words[w] for w in some.tolist()])
            start[some], size[some] = known + np.cumsum(n) - n, n
            parts.append(flat)
            known += len(flat)
        for w in failing[short:].tolist():
            flat = np.array([self.rank[p] for p in merge(words[w], self.rank, len(self.tokens))], np.int32)
            start[w], size[w] = known, len(flat)
            parts.append(flat)
            known += len(flat)
        return csr_take(np.concatenate(parts), start, size), size, failing.size

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that pairs of tokens make, the size of the vocabulary where they make none."""
        n = len(self.tokens)
        key = a.astype(np.int64) * n + b
        at = np.minimum(np.searchsorted(self.split_key, key), len(self.split_key) - 1)
        return np.where((self.split_key[at] == key) & (a >= 0) & (b >= 0), self.split_rank[at], n).astype(np.int32)

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words side by side (tokens in a row, how many by word): each round merges the first least pair of every word."""
        n, size = len(self.tokens), np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        parts = np.full((len(words), width + 1), -1, np.int32)
        parts[:, :width][np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        pair = self.merged(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width)
        lanes = np.arange(len(words))
        while lanes.size:
            now = pair[lanes]
            at = now.argmin(axis=1)
            token = now[np.arange(lanes.size), at]
            go = token < n
            lanes, at, token = lanes[go], at[go], token[go]
            if not lanes.size:
                break
            column = np.arange(width)
            p, q = parts[lanes], pair[lanes]
            p = np.take_along_axis(p, np.minimum(np.arange(width + 1) + (np.arange(width + 1) > at[:, None]), width), 1)
            q = np.take_along_axis(q, np.minimum(column + (column > at[:, None]), width - 1), 1)
            row = np.arange(lanes.size)
            p[row, at] = token
            q[row, at] = self.merged(token, p[row, at + 1])
            left = at > 0
            q[row[left], at[left] - 1] = self.merged(p[row[left], at[left] - 1], token[left])
            parts[lanes], pair[lanes] = p, q
        there = parts >= 0
        return parts[there].astype(np.int32), there.sum(axis=1)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge_flat`` with each word's tokens as the bytes of an int32 array."""
        flat, size = self.merge_flat(words)
        return [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])]

    @cached_property
    def token_bytes(self) -> dict[bytes, bytes]:
        """Each token's number as the bytes of an int32."""
        return {t: i.to_bytes(4, "little") for t, i in self.rank.items()}


def merge(word: bytes, rank: dict[bytes, int], limit: int) -> list[bytes]:
    """Exact BPE: merge the adjacent pair of least rank (below ``limit``), leftmost first."""
    get = rank.get
    if len(word) <= 64:
        cut = list(range(len(word) + 1))
        ranks = [get(word[i : i + 2], limit) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < limit:
            i = ranks.index(least)
            del cut[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(word[cut[i] : cut[i + 2]], limit)
            if i:
                ranks[i - 1] = get(word[cut[i - 1] : cut[i + 1]], limit)
        return [word[i:j] for i, j in zip(cut, cut[1:])]
    parts = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1], limit)) < limit]
    heapq.heapify(heap)
    while heap:
        r, i, whole = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != whole:
            continue
        parts[i], alive[j], after[i] = whole, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n and (q := rank.get(parts[x] + parts[after[x]], limit)) < limit:
                heapq.heappush(heap, (q, x, parts[x] + parts[after[x]]))
    return [p for p, a in zip(parts, alive, strict=True) if a]


#: ASCII white space; that of other blocks is found by ``_wide_spaces``.
_WHITE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


#: ASCII letters 1, digits 2, other signs 3 (the apostrophe 4), white space and beyond ASCII 0.
_KIND = np.array([0 if b > 127 or _WHITE[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdecimal() else 4 if chr(b) == "'" else 3 for b in range(256)], np.uint8)


def _wide_spaces(raw: np.ndarray, space: np.ndarray) -> None:
    """Mark the bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000)."""
    for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(raw == lead)
        if not at.size:
            continue
        second, third = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
        if lead == 0xC2:
            white = (second == 0x85) | (second == 0xA0)
        elif lead == 0xE1:
            white = (second == 0x9A) & (third == 0x80)
        elif lead == 0xE2:
            white = ((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F))
        else:
            white = (second == 0x80) & (third == 0x80)
        for i in range(width):
            space[at[white] + i] = True


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after another, and how many there are up to each text's end.

    ``PATTERN`` never matches across their edges: a run of other signs than white space,
    with the one blank before it, is cut between ASCII letters, digits and other signs (but
    not from an apostrophe to a letter); the last sign of white space before such a run is a
    unit where it isn't a blank, and so is what is left of a run of white space.
    """
    raw = data(texts)
    starts, ends = offsets(texts)
    space = _WHITE[raw]
    if len(raw) and raw.max() >= 0xC2:
        _wide_spaces(raw, space)
    cut = np.zeros(len(raw) + 1, bool)
    cut[starts] = True
    cut = cut[:-1]
    word = np.zeros(len(raw), bool)
    word[1:] = space[:-1] & ~space[1:] & ~cut[1:]
    cut[1:] |= space[1:] != space[:-1]
    word = np.flatnonzero(word)
    last = word - 1
    while (inner := (raw[last] & 0xC0) == 0x80).any():
        last = last - inner
    cut[last] = True
    cut[word[raw[last] == 32]] = False
    kind = _KIND[raw]
    signs = np.minimum(kind, 3)
    cut[1:] |= (kind[1:] > 0) & (kind[:-1] > 0) & (signs[1:] != signs[:-1]) & ~((kind[:-1] == 4) & (kind[1:] == 1))
    at = np.flatnonzero(cut)
    edges = np.append(at, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(raw)), np.searchsorted(at, ends)


class Encoder:
    """Encodes texts in one worker; keeps the tokens of about ``CACHE_UNITS`` distinct units.

    Texts are cut into units by numpy, Arrow finds the distinct ones of a slice, and only
    units that are new to the worker go through the pattern and the three steps. Tokens of
    all texts are then gathered at once.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.v, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self.table = pa.array(vocabulary.tokens, pa.binary())
        self.exact = self.seen = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Keep the units that more than one slice had, the half of the most frequent ones at most."""
        hits = self.hits[: len(self.known)]
        keep = np.flatnonzero(hits > 1)
        if keep.size > CACHE_UNITS // 2:
            keep = np.sort(np.argsort(-hits, kind="stable")[: CACHE_UNITS // 2])
        names, size = list(self.known), self.size[keep]
        flat = csr_take(self.flat, self.start[keep], size)
        self._forget()
        if len(flat) <= CACHE_TOKENS // 2:
            self._keep(flat, size, [names[i] for i in keep.tolist()])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pre-tokens in a row, and how many each has."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            flat, size, exact = self.v.encode_words([w.encode() for w in some])
            parts.append(flat)
            sizes.append(size)
            self.exact += exact
            self.seen += len(some)
        return np.concatenate(parts), np.concatenate(sizes)

    def _keep(self, flat: np.ndarray, size: np.ndarray, known: list[str]) -> np.ndarray:
        """Numbers under which the tokens of units are kept."""
        first, n = len(self.known), len(self.known) + len(known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n > len(self.size):
            self.start, self.size, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.hits))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first:n], self.size[first:n] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        self.known.update(zip(known, range(first, n), strict=True))
        return np.arange(first, n)

    def _add(self, new: list[str]) -> np.ndarray:
        """Numbers of units that weren't known."""
        if self.v.pattern == PATTERN:  # one word or one run of white space, without asking the pattern
            single = np.fromiter(((u[1:] if u[0] == " " else u).isalpha() or u.isspace() for u in new), bool, len(new))
        else:
            single = np.zeros(len(new), bool)
        number = np.zeros(len(new), np.int64)
        words = [new[i] for i in np.flatnonzero(single).tolist()]
        number[single] = self._keep(*self._encoded(words), words)
        rest = [new[i] for i in np.flatnonzero(~single).tolist()]
        split = [self.find(u) for u in rest]
        pieces = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        flat, size = self._encoded(list(pieces))
        of = np.fromiter((pieces[w] for s in split for w in s), np.int64)
        sizes = size[of]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        number[~single] = self._keep(csr_take(flat, (np.cumsum(size) - size)[of], sizes), np.diff(np.concatenate(([0], ends))), rest)
        return number

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and where each text's tokens end."""
        if self.v.pattern == PATTERN:
            unit, upto = units(texts)
        else:  # the units of another pattern aren't known: whole texts
            unit, upto = texts.fill_null(""), np.arange(1, len(texts) + 1)
        coded = unit.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > CACHE_UNITS or self.used > CACHE_TOKENS:
            self._trim()
        get = self.known.get
        number = np.fromiter((get(u, -1) for u in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if new.size:
            number[new] = self._add([distinct[i] for i in new.tolist()])
        self.hits[number] += 1
        of = number[coded.indices.to_numpy()]
        size = self.size[of]
        return csr_take(self.flat, self.start[of], size), np.concatenate(([0], np.cumsum(size)))[upto]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text, as the bytes of an int32 array."""
        body, ends = self.tokens(pa.array(texts, pa.string()))
        raw, ends = body.astype(np.int32).tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decoded(self, tokens: np.ndarray) -> pa.Array:
        """The bytes of each token."""
        return self.table.take(pa.array(tokens))

    def round_trip(self, texts: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text: are its tokens' bytes those of the text?"""
        want, got = data(texts), self.decoded(tokens)
        _, stop = offsets(texts)
        _, token_stop = offsets(got)
        reach = np.concatenate(([0], token_stop))[ends]
        body = data(got)
        if len(want) == len(body) and (reach == stop).all():
            differ = np.concatenate(([0], np.cumsum(want != body)))
            return np.diff(np.concatenate(([0], differ[stop]))) == 0
        return np.array([np.array_equal(want[a:b], body[c:d]) for a, b, c, d in zip([0, *stop], stop, [0, *reach], reach, strict=False)], bool)


_encoders: dict[int, Encoder] = {}


def worker_encoder(v: Vocabulary) -> Encoder:
    """The encoder of this worker process, made once for each vocabulary that is broadcast."""
    if id(v) not in _encoders:
        _encoders.clear()
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a file, loaded once on the driver (executors get it broadcast)."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary.load(path, pattern)
    return _vocabularies[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every document.

    ``round_trip`` tells whether the decoded tokens are the text's bytes again. Null text:
    null in the three columns. Empty text: 0, [], true. One pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path, pattern))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_encoder(shared.value)
        texts = batch.column(1)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        tokens, ends = encoder.tokens(texts)
        at = np.concatenate(([0], ends))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens), mask=pa.array(null))
        same = encoder.round_trip(texts, tokens, ends)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at).astype(np.int32), mask=null), lists, pa.array(same, mask=null)], names=["doc_id", "n_tokens", "tokens", "round_trip"]
        )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(over_slices(run, limit=BATCH_BYTES), f"doc_id {kind_of(docs, id_col)}, {SCHEMA}")


def decode(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of tokens. Null tokens give a null text, [] an empty one.

    Bytes that aren't UTF-8, which only hand-made token lists hold, become U+FFFD. A token
    outside the vocabulary raises an error.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path).tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(1)
                if lists.flatten().null_count:
                    raise ValueError("a token is null")
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                got = table.take(lists.flatten())
                reach = np.concatenate(([0], offsets(got)[1]))[np.concatenate(([0], np.cumsum(size)))].tolist()
                body = data(got).tobytes()
                null = lists.is_null().to_pylist()
                text = [None if n else body[a:b].decode("utf-8", "replace") for n, a, b in zip(null, reach, reach[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].alias("doc_id"), tokens[tokens_col].alias("tokens")).mapInArrow(run, f"doc_id {kind_of(tokens, id_col)}, text string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to the document again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
