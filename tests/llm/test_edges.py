"""Odd ids, repeated rows, clashing columns, many classes and hot strings: cases that once broke a contract."""

import random

import numpy as np
from pyspark.sql import functions as F

from upkeep.llm import chaining, decontaminate, jaccard_join, language_id, suffix_dedup, toxicity, warc
from tests.llm.test_dedup import brute_repeats


def words_of(r, n=3_000):
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(n)]


def test_decontamination_with_null_and_string_item_ids(spark):
    r = random.Random(1)
    words = words_of(r)
    items = [" ".join(r.choices(words, k=30)) for _ in range(4)]
    docs = spark.createDataFrame([("a", "x " + items[0] + " y", 1), ("a", "x " + items[0] + " y", 1), ("b", items[1], 2), (None, items[2], 3), ("c", " ".join(r.choices(words, k=2_000)), 4), ("d", None, 5)], "doc_id string, text string, item_id long")
    bench = spark.createDataFrame([("p", items[0]), (None, items[1]), ("q", items[2]), ("q", items[3]), ("z", "ab"), ("short", "qzkv jwxq")], "item_id string, text string")
    got = sorted(((g.doc_id, g.item_id) for g in decontaminate.find_contamination(docs, bench).collect()), key=str)
    assert got == sorted([("a", "p"), ("a", "p"), ("b", None), (None, "q")], key=str)
    assert [x.doc_id for x in decontaminate.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == ["c", "d"]


def test_decontamination_of_short_items(spark):
    bench = spark.createDataFrame([(1, "qzkv jwxq"), (2, "abc")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "all of QZKV, jwxq here"), (2, "qzkv jwxx and abc")], "doc_id long, text string")
    assert [(g.doc_id, g.item_id) for g in decontaminate.find_contamination(docs, bench).collect()] == [(1, 1)]


def test_jaccard_join_with_string_ids_and_a_very_long_text(spark):
    r = random.Random(2)
    base = r.choices(words_of(r), k=80)
    long_ = " ".join(r.choices(words_of(r), k=120_000))
    rows = [("b", " ".join(base), 1), ("a", " ".join([*base, "more"]), 2), ("c", "other words of a text", 3), ("z", long_, 4), ("y", long_ + " end", 5)]
    got = {g.doc_id: g.component_id for g in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id string, text string, size long")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "y": "y", "z": "y"}


def test_passages_in_rows_that_repeat_an_id(spark):
    r = random.Random(3)
    words = words_of(r)
    fresh = lambda n: r.choices(words, k=n)
    p = fresh(70)
    rows = [(1, " ".join(fresh(30) + p)), (5, " ".join(fresh(60))), (5, " ".join(fresh(20) + p + fresh(9))), (5, " ".join(fresh(60))), (None, " ".join(p))]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text", F.lit(1).alias("row"))
        got = sorted(((g.doc_id, g.start_word, g.end_word, g.ref_doc_id, g.ref_start_word) for g in chaining.find_repeated_passages(docs).collect()), key=str)
        of = int if kind == "long" else str
        assert got == sorted([(of(5), 20, 90, of(1), 30), (None, 0, 70, of(1), 30)], key=str)


def test_passage_whose_halves_come_first_in_two_others(spark):
    r = random.Random(4)
    words = words_of(r, 5_000)
    fresh = lambda n: r.choices(words, k=n)
    p = fresh(72)
    rows = [fresh(30) + p[:36] + fresh(40), fresh(20) + p[36:] + fresh(30), fresh(10) + p + fresh(10), fresh(20) + p + fresh(10)]
    got = chaining.find_repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    assert [(g.doc_id, g.start_word, g.end_word, g.ref_doc_id, g.ref_start_word) for g in got] == [(3, 20, 92, 2, 10)]


def test_every_language_is_learned(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(66):
        own = letters[k % 26] + letters[k // 26]
        rows += [(k * 10 + j, " ".join(own * r.randint(1, 3) for _ in range(12)), f"l{k}", 1, 2) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, i int, n int")
    langs, _ = language_id.fit(docs, ~language_id.held_out(), sample=2)
    assert langs == sorted({f"l{k}" for k in range(66)})
    assert language_id.predict_languages(docs.where("doc_id < 20").unionByName(docs.where("doc_id = 3"))).count() == 21


def test_pooled_probabilities_against_a_plain_network():
    w = language_id.initial(3, hidden=5)
    texts = [b"", b"ab", bytes(range(1, 100)), b"z" * 32]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id._pooled(w, np.frombuffer(b"".join(texts), np.uint8), at, 3)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def layer(d, s):
        h, out = np.zeros(5), []
        for c in s if d == "f" else s[::-1]:
            a, b = w[f"x{d}"][c].astype(float), h @ w[f"h{d}"].astype(float)
            z, r = sigmoid(a[:5] + b[:5]), sigmoid(a[5:10] + b[5:10])
            h = (1 - z) * np.tanh(a[10:] + r * (b[10:] + w[f"n{d}"])) + z * h
            out.append(h)
        return out if d == "f" else out[::-1]

    for i, t in enumerate(texts):
        p = []
        for s in range(0, len(t), language_id.STEPS):
            part = t[s : s + language_id.STEPS]
            # a short stretch is padded with zero bytes, which the way back reads first
            full = part + b"\0" * (language_id.STEPS - len(part))
            for f, b in list(zip(layer("f", full), layer("b", full), strict=True))[: len(part)]:
                e = np.exp(np.concatenate([f, b]) @ w["o"] + w["c"])
                p.append(e / e.sum())
        assert np.allclose(got[i], np.mean(p, axis=0) if p else 0, atol=1e-4)


def test_ordinal_fit_lowers_the_loss_against_plain_descent():
    r = np.random.default_rng(6)
    grades = np.array([0, 0, 1, 2] * 30)
    feats = [(np.unique(np.array([1 + g, 10 + r.integers(5), 20 + r.integers(5)], np.uint64)), None) for g in grades]
    feats = [(f, np.ones(len(f))) for f, _ in feats]
    m = toxicity.fit(feats, grades, penalty=0.0, rounds=400)
    vocab = np.array(sorted({int(x) for f, _ in feats for x in f}), np.uint64)
    x = np.array([[float(v in f) for v in vocab] for f, _ in feats])
    share = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())
    above = grades[:, None] > np.arange(2)[None, :]

    def loss(w, t):
        p = np.clip((x @ w)[:, None] - t[None, :], -30, 30)
        return (share[:, None] * (np.logaddexp(0, p) - above * p)).sum()

    w, t = np.zeros(len(vocab)), np.array([1.0, 2.0])
    for _ in range(400):
        p = np.clip((x @ w)[:, None] - t[None, :], -30, 30)
        e = share[:, None] * (1 / (1 + np.exp(-p)) - above)
        w, t = w - 0.5 * x.T @ e.sum(1), np.maximum.accumulate(t + 0.5 * e.sum(0))
    full = np.zeros(len(vocab))
    full[np.searchsorted(vocab, m.features)] = m.weights
    assert loss(full, m.thresholds) <= loss(w, t) + 1e-6
    score = np.array([m.weights[np.isin(m.features, f)].sum() for f, _ in feats])
    assert ((m.grades(score) >= 0.5).sum(1) == grades).mean() > 0.95


def test_toxicity_with_repeated_and_contrary_labels(spark):
    docs = spark.createDataFrame([(i, ("bad words here " if i % 2 else "good things there ") * 3 + f"n{i}") for i in range(60)] + [(1, "bad"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, 0), (3, 1, 1), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 62 and all(g.toxic == bool(g.doc_id % 2) for g in got if g.doc_id is not None and g.doc_id > 5)


def test_archives_of_no_pages_and_of_repeated_ids(spark):
    kind = "page_id long, url string, html string"
    assert warc.revisit_pages(spark.createDataFrame([], kind)).count() == 0
    long_ = "z" * 300_000
    got = sorted((g.page_id, g.record_type, g.refers_to, g.payload_bytes) for g in warc.revisit_pages(spark.createDataFrame([(1, "u", long_), (1, "u", long_), (2, "u", long_), (3, None, None), (4, "u", None)], kind)).collect())
    assert got == [(1, "response", None, 300_000), (1, "response", None, 300_000), (2, "revisit", 1, 300_000), (3, "response", None, 0), (4, "response", None, 0)]


def test_very_many_surroundings_of_one_string(spark):
    r = random.Random(7)
    line = "".join(r.choices("abcdefgh", k=90))
    some = ["".join(r.choices("xyz", k=30)) for _ in range(40)]
    rows = [(i, "".join(r.choices("mnopqrstuvw", k=80)) + r.choice(some)[: r.randint(0, 30)] + line + r.choice(some)[: r.randint(0, 30)] + "".join(r.choices("mnopqrstuvw", k=80))) for i in range(6_000)]
    want = brute_repeats(rows)
    for g in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want[g.doc_id]


def test_fifty_thousand_surroundings_in_one_go():
    r = np.random.default_rng(8)
    m, side = 50_000, suffix_dedup.SIDE
    before = r.integers(0, 3, (m, side)).astype(np.uint8)
    after = r.integers(0, 3, (m, side)).astype(np.uint8)
    after[1_000:3_000] = after[:2_000]
    before[40_000:, :50] = before[:10_000, :50]
    n = np.full(m, side)
    got = suffix_dedup.repeated_windows(np.zeros(m, np.int64), before, after, n, n)
    for k in (0, 3, 20, 50, side):
        seen, want = set(), []
        for b, a in zip(before[:, :k], after[:, : side - k], strict=True):
            key = b.tobytes() + a.tobytes()
            want.append(key in seen)
            seen.add(key)
        assert got[:, k].tolist() == want
