"""Cases that every operator must stand: ids of any type, long texts, ties; and plain versions to compare with."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlab.llm import bpe, chat, common, decontam, langid, minhash, pii, quality, records, repeats, toxicity

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 8))) for _ in range(3000)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_ids_may_be_strings(spark, tmp_path):
    long = prose(120)
    rows = [("doc-a", long, "en"), ("doc-b", long + " more", "en"), ("doc-c", prose(90), "en"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    bench = spark.createDataFrame([("item", " ".join(long.split(" ")[:9]))], "item_id string, text string")
    assert {r.doc_id: r.lang for r in langid.identify(docs, langid.fit(langid.sample(docs))).collect()}["doc-a"] == "en"
    assert [tuple(r) for r in minhash.duplicates(docs).collect()] == [("doc-b", "doc-a")]
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == {("doc-a", "item"), ("doc-b", "item")}
    assert {r.doc_id for r in repeats.passages(docs).collect()} == {"doc-a", "doc-b"}
    for out in (bpe.encode(docs), pii.replace(docs), toxicity.classify(docs, None), quality.judge(docs), records.write_records(docs, str(tmp_path / "r"))):
        assert {r.doc_id for r in out.collect()} == {"doc-a", "doc-b", "doc-c", None}
    talk = spark.createDataFrame([("c", 0, "a", "Hello there"), ("c", 1, "b", "> Hello there\nYes")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.n_linked) for r in chat.format_conversations(talk).collect()] == [("c", 1)]


def test_very_long_texts(spark, tmp_path):
    r = random.Random(5)
    long = prose(160_000, r)
    passage = " ".join(long.split(" ")[70_000:70_060])
    item = " ".join(long.split(" ")[150_000:150_012])
    docs = spark.createDataFrame([(1, long, "en"), (2, long.replace(" a", " b", 3), "en"), (3, prose(30, r) + " " + passage, "en"), (4, prose(50, r), "en")], "doc_id bigint, text string, lang string")
    assert [tuple(x) for x in minhash.duplicates(docs).collect()] == [(2, 1)]
    assert {x.doc_id for x in decontam.matches(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()} == {1, 2}
    assert {x.doc_id for x in repeats.passages(docs).collect()} == {1, 2, 3}
    assert all(x.round_trip for x in bpe.encode(docs).collect())
    assert [x.n_grams for x in langid.identify(docs, langid.fit({"en": [long[:5000]]})).where("doc_id = 1").collect()] == [len(long) - 3]
    assert all(x.keep for x in quality.judge(docs).collect())
    index = records.write_records(docs.withColumn("shard", F.lit("clash")), str(tmp_path / "r"))
    assert {len(x.tokens) for x in records.read_records(index.where("doc_id = 1"), str(tmp_path / "r")).collect()} == {bpe.encode(docs.where("doc_id = 1")).first().n_tokens}


def test_classes_equal_the_links_of_all_pairs(spark):
    """Groups are those of all pairs that share a region and agree in half of their minima."""
    r = random.Random(8)
    rows = []
    for g in range(12):
        base = prose(60, r).split(" ")
        for c in range(r.randrange(1, 7)):
            w = list(base)
            for i in r.sample(range(60), r.choice([0, 0, 1, 3, 6, 10])):
                w[i] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(300)]
    texts = pa.array([t for _, t in rows])
    _, minima = minhash.signatures(texts)
    bits = ((minima ^ (minima >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    tree = bits.reshape(len(rows), minhash.TREES, minhash.DEPTH)[:, :, : minhash.LEAST_DEPTH]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        near = (tree[a + 1 :] == tree[a]).all(axis=2).any(axis=1) & (((bits[a + 1 :] & 255) == (bits[a] & 255)).sum(axis=1) >= minhash.THRESHOLD * bits.shape[1])
        for b in np.flatnonzero(near) + a + 1:
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows)) if find(i) != i}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {x.doc_id: x.kept_id for x in minhash.duplicates(docs).collect()} == want and len(want) > 310
    # an id of several texts joins their groups
    again = docs.union(spark.createDataFrame([(0, prose(60, random.Random(77))), (9000, prose(60, random.Random(77)))], "doc_id bigint, text string"))
    assert {x.doc_id: x.kept_id for x in minhash.duplicates(again).collect()} == {**want, 9000: 0}


def test_languages_equal_sets():
    r = random.Random(3)
    texts = {name: [" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(80)) for _ in range(3)] for name, letters in {"x": "abcdef", "y": "defghi", "z": "opqrst"}.items()}
    f = langid.fit(texts)
    tests = [t[0][:200] for t in texts.values()] + ["abc def", "", "abcdef defghi opq", "ooo"]
    got, share, n = langid.classify(f, pa.array(tests))
    for text, lang, s, k in zip(tests, got, share, n, strict=True):
        grams = [text.encode()[i : i + 4] for i in range(len(text) - 3)]
        assert k == len(grams)
        shares = []
        for i, false in enumerate(f.false_rate()):
            inside = 0
            for g in grams:
                code = np.array([int.from_bytes(bytes(langid._FOLD[list(g)]), "little")], np.uint32)
                inside += all(int(f.table[int(at[0])]) >> i & 1 for at in langid.positions(code))
            shares.append(max(0.0, (inside - len(grams) * false) / (1 - false)) / max(1, len(grams)))
        best = int(np.argmax(shares))  # of equal shares the first
        assert (lang, pytest.approx(s)) == ((f.languages[best], shares[best]) if shares[best] >= langid.MIN_SHARE else ("und", 0.0))


def test_pooling_equals_a_plain_loop():
    r = np.random.default_rng(2)
    filters = [r.normal(size=(w, toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    model = toxicity.Model(r.normal(size=(1 << toxicity.LOG_ROWS, toxicity.DIMENSIONS)).astype(np.float32), filters, [r.normal(size=toxicity.FILTERS).astype(np.float32) for _ in filters], r.normal(size=toxicity.FILTERS * len(filters)), 0.1)
    texts = ["one two three four", "word", "", "longerword another longerword", "a b"]
    model.compile()
    rows, which, count = toxicity.distinct_features(pa.array(texts))
    got = model.pooled(rows, which, count)
    at = 0
    for k, c in enumerate(count):
        words = [sum(model.embedding[x] for x in rows[i] if x >= 0) for i in which[at : at + c]]
        at += c
        want = []
        for f, b in zip(model.filters, model.bias, strict=True):
            responses = [sum(words[p + j] @ f[j] for j in range(f.shape[0]) if p + j < len(words)) for p in range(len(words))]
            want += (np.maximum(np.max(responses, axis=0) + b, 0) if responses else np.zeros(toxicity.FILTERS)).tolist()
        assert got[k] == pytest.approx(want, abs=1e-3)


def test_the_run_index_counts_and_is_small_for_repetitive_text():
    r = np.random.default_rng(6)
    sizes = r.integers(1, 20, 40)
    words, starts = r.integers(0, 3, sizes.sum()), np.cumsum(sizes) - sizes
    index = repeats.RunIndex(words, np.zeros(40, np.int64), starts)
    _, letters = repeats.suffixes(words, np.zeros(40, np.int64), starts)
    texts = [letters[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)]
    for _ in range(300):
        p = r.integers(1, 4, r.integers(1, 6)).tolist()
        assert index.count(p) == sum(t[i : i + len(p)] == p for t in texts for i in range(len(t)))
    runs = []
    base = r.integers(0, 1000, (5, 90))
    for copies in (20, 200):
        many = np.repeat(base, copies, axis=0)
        at = r.integers(0, 90, len(many) // 20)
        many[r.integers(0, len(many), len(at)), at] = 2000
        runs.append(len(repeats.RunIndex(many.ravel(), np.zeros(len(many), np.int64), np.arange(len(many)) * 90).first))
    # what grows with the copies are the beginnings of contexts, a run each, not their words
    assert runs[1] < 200 * 5 * 90 / 10 and runs[1] - runs[0] < 6 * 180 * 5


def test_a_template_of_many_items(spark):
    r = random.Random(4)
    template = prose(22, r)[:120]
    items = [(i, f"{template} {prose(5, r)}") for i in range(1000)]
    rows = [(i, f"{prose(20, r)} {items[r.randrange(1000)][1] if i % 2 else template + ' ' + prose(8, r)} {prose(9, r)}") for i in range(8)]
    found = decontam.Matcher([(i, t.encode()) for i, t in items]).find(pa.array([t for _, t in rows]))
    want = [(i, n, d, int(decontam.RATE * len(p))) for i, t in rows for n, p in items if (d := decontam.myers(p.encode(), t.encode())) <= int(decontam.RATE * len(p))]
    assert sorted(found) == sorted(want) and len({x[0] for x in want}) >= 4


def test_many_distances_equal_one():
    r = random.Random(9)
    ps, ts = ([bytes(r.choice(b"abc") for _ in range(r.randrange(a, 200))) for _ in range(200)] for a in (1, 0))
    assert decontam.myers_many(ps, ts) == [decontam.myers(p, t) for p, t in zip(ps, ts, strict=True)]


def test_items_without_a_budget_are_whole_words():
    m = decontam.Matcher([(0, b"no"), (1, b"yes"), (2, b"a"), (3, b"no a")])
    got = m.find(pa.array(["Yesterday nothing happened", "No, a", "", "a", None, "so no"]))
    assert [(row, n) for row, n, *_ in got] == [(1, 0), (1, 2), (1, 3), (3, 2), (5, 0)]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("at 2001:db8::8a2e:370:7334 or fe80::1ff:fe23:4567:890a", ["2001:db8::8a2e:370:7334", "fe80::1ff:fe23:4567:890a"]),
        ("std::vector, ab::cd and 10:30:45", []),
        ("mail δοκιμή@παράδειγμα.gr now", ["δοκιμή@παράδειγμα.gr"]),
        ("Tel: 612 345 678, call 01 23 45 67 89 or 0171 2345678", ["612 345 678", "01 23 45 67 89", "0171 2345678"]),
        ("There were 712 345 678 people in 2019, 0.5 of 01-02-2003", []),
    ],
)
def test_addresses_and_numbers(text, parts):
    assert [text[a:b] for a, b, _ in pii.entities(text)] == parts
    new, n = pii.replaced(text)
    assert n == len(parts) and not any(p in new for p in parts)


def test_families_keep_their_link_and_their_endings():
    new = pii.replaced("Mr Иванов and Mrs Иванова; Mr Достоевский")[0].replace(";", "").split(" ")
    assert new[4] == new[1] + "а" and new[1].endswith("ов") and new[6].endswith("ский") and new[1] != "Иванов"
    r = random.Random(1)
    names = {"".join(r.choice("абвгдеилмн") for _ in range(r.randrange(2, 4))) + e for e in ("", "ов", "ова", "ин", "ина", "лин", "лина", "лину", "ский", "ская", "ск") for _ in range(60)}
    assert len({pii.surrogate(k, n.capitalize()) for k in ("name", "name_m", "name_f") for n in names}) == 3 * len(names)


def test_the_key_comes_from_the_session(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example.com")], "doc_id bigint, text string")
    own = pii.replace(df).first().text
    assert own == pii.replaced("mail a.b@c.example.com")[0]
    spark.conf.set(pii.KEY_SETTING, "something")
    try:
        assert pii.replace(df).first().text == pii.replaced("mail a.b@c.example.com", b"something")[0] != own
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_quality_rules_each():
    names = [r.name for r in quality.RULES]
    assert len(names) == len(set(names)) == 12


def test_each_quality_rule(spark):
    cases = {
        "brackets": "a {b} <c> [d] {e} <f>",
        "few_different_words": "one two three four " * 30,
        "few_words_with_letters": " ".join(f"=- {w} ::" for w in WORDS[:40]),
        "long_words": " ".join(f"abcdefghijklmnopqrstuvwxyz{chr(97 + i)}" for i in range(26)),
        "bullets": "\n".join(f"- item {w}" for w in WORDS[:12]),
        "ellipses": "\n".join(f"read more of {w}..." for w in WORDS[:12]),
        None: "中文没有空格的句子很长很长很长很长很长很长很长很长很长。" * 5,
    }
    df = spark.createDataFrame(list(enumerate(cases.values())), "doc_id bigint, text string")
    assert [r.rejected_by for r in quality.judge(df).orderBy("doc_id").collect()] == list(cases)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):  # noqa: N802
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(type("Session", (), {"sparkContext": Context()})())


def test_tokens_don_t_depend_on_what_a_worker_remembers(monkeypatch):
    r = random.Random(12)
    texts = [prose(40, r) + " " + "".join(r.choice("éa1 .'\n") for _ in range(20)) for _ in range(60)]
    want = bpe.Encoder(bpe.vocabulary()).encode(texts)
    for units, tokens in ((200, 1 << 22), (5, 1 << 22), (10_000, 300)):
        monkeypatch.setattr(bpe, "CACHE_UNITS", units)
        monkeypatch.setattr(bpe, "CACHE_TOKENS", tokens)
        own = bpe.Encoder(bpe.vocabulary())
        assert [x for i in range(0, 60, 7) for x in own.encode(texts[i : i + 7])] == want
        assert own.encode(texts) == want
