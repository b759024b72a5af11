import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from textlab.llm import bpe, chat, langid, records
from textlab.llm.words import hashed_words, shingles


def words_of(text):
    out, now = [], b""
    for b in text.lower().encode() + b" ":
        if b >= 128 or chr(b).isalnum():
            now += bytes([b])
        elif now:
            out.append(now)
            now = b""
    return out


TEXTS = ["One two  three", "", "  ", "été: one-two", "x" * 600 + " one", "\n", "a" * 3]


def test_hashed_words_tell_words_apart():
    h, first, end, count = hashed_words(pa.array(TEXTS))
    assert count.tolist() == [len(words_of(t)) for t in TEXTS]
    names = [w for t in TEXTS for w in words_of(t)]
    assert len(set(h.tolist())) == len(set(names)) == len({(a, b) for a, b in zip(h.tolist(), names, strict=True)})
    assert [int(n) for n in shingles(h, count, 2)[1]] == [2, 0, 0, 2, 1, 0, 1]


@pytest.fixture(scope="module")
def tiktoken_pair():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(bpe.vocabulary())


def test_tokens_are_those_of_an_exact_encoder(tiktoken_pair):
    exact, own = tiktoken_pair
    r = random.Random(7)
    texts = ["".join(r.choice("etaoin shrdlu'éßИ中\n\t 12,.　\0") for _ in range(r.randrange(80))) for _ in range(1500)]
    texts += ["", "a" * 3000, " " * 100, "don't we'll THEY'RE", "ab\r\n cd ", "<|endoftext|>", "tionthingress" * 9]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == exact.encode_ordinary(text), text
    assert 0 < own.exact < own.seen  # both paths were taken


def test_merging_side_by_side_equals_merging_one(tiktoken_pair):
    v = tiktoken_pair[1].v
    r = random.Random(1)
    words = [bytes(r.choice(b"abcdeinorst ") for _ in range(r.randrange(1, 33))) for _ in range(500)]
    want = [b"".join(v.token_bytes[p] for p in bpe.merge(w, v.rank, len(v.tokens))) for w in words]
    assert v.merge_many(words) == want


def test_encode_and_decode(spark):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello there", "x"), (None, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    out = bpe.encode(df)
    got = sorted(out.collect(), key=repr)
    assert len(got) == 5 and all(r.round_trip for r in got if r.n_tokens is not None)
    by = {r.doc_id: r for r in got}
    assert by[2].tokens is None and by[2].n_tokens is None and by[3].tokens == [] and by[3].n_tokens == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in bpe.decode(out).collect()) == sorted((a or 0, t or "") for a, t, _ in rows)
    assert bpe.encode(df.limit(0)).count() == 0


def crc(data):
    state = 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    r = random.Random(3)
    parts = [r.randbytes(n) for n in (0, 1, 3, 4, 8, 127, 128, 129, 400)] + [b"123456789"]
    lengths = np.array([len(p) for p in parts])
    got = records.crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [crc(p) for p in parts] and got[-1] == 0xE3069283


def test_records_round_trip_in_any_order(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(60)] + [(60, None), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    index = records.write_records(df, str(tmp_path / "r"))
    assert index.count() == 61
    exact = bpe.encode(df).where("tokens is not null")
    want = sorted((r.doc_id, r.tokens) for r in exact.collect())
    got = records.read_records(index.orderBy("length", "doc_id"), str(tmp_path / "r"))
    assert sorted((r.doc_id, r.tokens) for r in got.collect()) == want
    raw = bytearray(records.frame(np.arange(8, dtype=np.uint8), np.array([8]))[0])
    assert records.parse(bytes(raw)) == bytes(range(8))
    raw[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.parse(bytes(raw))
    assert records.write_records(df.limit(0), str(tmp_path / "e")).count() == 0


def test_languages(spark):
    english = ["the cat sat on the mat and the dog slept near the house"] * 4
    german = ["der hund schläft unter dem tisch und die katze sitzt auf der bank"] * 4
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in english] + [(t, "de") for t in german])]
    df = spark.createDataFrame([*rows, (90, None, "en"), (91, "", None), (92, "abc", "de"), (93, "12345 67890 1234", "en"), (None, "the dog and the cat", None)], "doc_id bigint, text string, lang string").withColumn("share", df_lit())
    found = {r.doc_id: r for r in langid.identify(df, langid.fit(langid.sample(df))).collect()}
    assert [found[i].lang for i in range(8)] == ["en"] * 4 + ["de"] * 4 and found[None].lang == "en"
    assert all(found[i].lang == "und" and found[i].share == 0 for i in (90, 91, 92))
    empty = langid.identify(df, langid.fit({}))
    assert {r.lang for r in empty.collect()} == {"und"} and langid.identify(df.limit(0), langid.fit({})).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_bit_sliced_filters_equal_sets():
    texts = {"x": ["abcdefgh abcdefgh"], "y": ["abcdxyzw abcdxyzw"]}
    f = langid.fit(texts)
    code, _, _ = langid.grams(pa.array(["abcd", "efgh", "xyzw", "qqqq"]))
    masks = [int(f.table[a] & f.table[b]) for a, b in zip(*langid.positions(code[[0, 4, 8, 12]]), strict=True)]
    assert masks == [3, 1, 2, 0]


def brute_conversation(messages):
    own, order = [], sorted(messages)
    for _, _, text in order:
        keep, quoted = [], []
        for line in text.split("\n"):
            (quoted if line.startswith(">") else keep).append(line)
        own.append(("\n".join(keep).strip(), {q[1:].strip().lower() for q in quoted if not q[1:].strip().startswith(">")} - {""}))
    parents = []
    for n, (_, quotes) in enumerate(own):
        hits = [(len(quotes & {x.strip().lower() for x in own[m][0].split("\n")}), m) for m in range(n)]
        hits = [h for h in hits if h[0]]
        parents.append(max(hits)[1] if hits else n - 1)
    out = []

    def visit(n):
        out.append(n)
        for m, p in enumerate(parents):
            if p == n:
                visit(m)

    visit(0)
    return "\n".join(f"<|{order[n][1]}|>\n{own[n][0]}" for n in out)


def test_quotations(spark):
    messages = {
        1: [(0, "a", "First line\nsecond line"), (1, "b", "> First line\nI agree"), (2, "c", ">  SECOND line\nI don't"), (3, "a", "> I agree\n>> First line\nGood"), (4, "d", "New")],
        2: [(0, "a", "Hi"), (1, "b", "> something else\n"), (2, "a", "> Hi\n> Hi\nHello")],
    }
    rows = [(c, t, r, x, 1) for c, ms in messages.items() for t, r, x in ms]
    rows += [rows[0], (None, 0, "a", "x", 1), (3, None, "a", "x", 1), (4, 0, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, n int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, 4} and got[4].text == "<|unknown|>\n"
    for c, ms in messages.items():
        assert got[c].text == brute_conversation(ms)
    assert (got[1].n_messages, got[1].n_linked) == (5, 3)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_more_than_64_languages_all_have_a_filter():
    r = np.random.default_rng(8)
    texts = {}
    for k in range(140):
        words = ["".join(map(chr, r.choice(np.arange(97, 123), 6))) for _ in range(30)]
        texts[f"l{k:03}"] = [" ".join(r.choice(words, 60)) for _ in range(4)]
    filters = langid.fit(texts)
    assert filters.languages == sorted(texts)
    got, _, _ = langid.classify(filters, pa.array([t[0] for t in texts.values()]))
    assert got == list(texts)


def test_quotes_that_are_wrapped_anew_partial_or_nested_are_linked(spark):
    texts = [
        "The first plan is to take\nthe early train. It leaves at six.",
        "I would go by car instead.",
        "Another thing altogether",
        "> The first plan\n> is to take the early train. It leaves\n> at six.\nYes",  # wrapped anew
        "> It leaves at six.\nToo early",  # a sentence of a longer line
        "On Monday Ann wrote:\n> Someone whose message is lost\n> > I would go by car instead.\nNo",  # level two alone
        "> Another thing altogether\n>> I would go by car instead.\nWell",  # level one decides
        "> nothing that anyone said\nHm",
    ]
    rows = [(1, i, "u", t) for i, t in enumerate(texts)]
    numbered = chat.messages(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    assert {r.n: r.parent for r in chat.links(chat.lines(numbered), chat.sentences(numbered)).collect()} == {3: 0, 4: 0, 5: 1, 6: 2}
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).first()
    assert got.n_linked == 4 and [x for x in got.text.split("\n") if x in ("Yes", "Too early", "No", "Well", "Hm")] == ["Well", "Hm", "No", "Yes", "Too early"]


def test_attributions_go_and_the_sql_agrees(spark):
    import duckdb

    rows = [(1, 0, "a", "Plain words"), (1, 1, "b", "On Monday a wrote:\n> Plain words\n\nYes"), (1, 2, "c", "> > Plain words\n> Yes\nNo"), (1, 3, "d", "> plain   WORDS\nMaybe"), (2, 5, "x", "")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = db.execute(chat.OP3_SQL).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "wrote" not in want[0][3] + want[1][3]
