"""Exact dedup, Jaccard join, suffix-array dedup and fuzzy passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from upkeep.llm import chaining, exact_dedup, jaccard_join, suffix_dedup

DOCS = "doc_id long, text string, row int, size string, words string, anchor long"


def frame(spark, rows, parts=3):
    """Rows (doc_id, text) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], DOCS).repartition(parts)


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choices(words, k=70))
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "x" * 9_000), (6, "x" * 9_000)]
    while len(out) < n:
        t = " ".join(r.choices(words, k=r.randint(1, 160)))
        kind = r.random()
        if kind < 0.2 and len(out) > 10:
            t = r.choice(out)[1] or ""
        elif kind < 0.5 and len(out) > 10:
            w = (r.choice(out)[1] or "a").split() or ["a"]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind < 0.6:
            t = t + "\n" + passage + " é ß " + t[:50]
        out.append((len(out), t))
    return out


@pytest.mark.parametrize("keep,block", [("last", 1 << 14), ("first", 7)])
def test_exact_dedup(spark, keep, block):
    rows = texts(120, 1)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, rows), keep=keep, block_bytes=block).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        g = groups[t or ""]
        stays = max(g) if keep == "last" else min(g)
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (stays, len(g), i == stays, hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (3, "b"), (3, "c"), (None, None)]
    got = sorted((str(r.doc_id), r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect())
    assert len(got) == 7
    assert sum(g[3] == 4 and g[2] == 2 for g in got) == 4 and sum(g[4] for g in got if g[3] == 4) == 1


def brute_sets(rows, n):
    out = {}
    for i, t in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return out


@pytest.mark.parametrize("n,percent,region", [(4, 85, 2_000), (5, 80, 8)])
def test_jaccard_join(spark, monkeypatch, n, percent, region):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    rows = texts(160, 2)
    sets = brute_sets(rows, n)
    up = jaccard_join.Unions(len(rows))
    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up.join(a, b)
    for r in jaccard_join.link_documents(frame(spark, rows), n=n, percent=percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), up.find(r.doc_id))


def test_large_regions_are_split(spark, monkeypatch):
    """Near copies in one region, some linked, some far apart and some connected in chains only."""
    r = random.Random(5)
    base, rows = [f"w{k}" for k in range(200)], []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 8, 12])):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((1_000 - i, " ".join(w)))
    for k in range(40):  # a chain: each links with its neighbours only
        rows.append((k, " ".join([f"c{j}" for j in range(k * 3, k * 3 + 100)])))
    sets = brute_sets(rows, 4)
    ids = sorted(sets)
    up = jaccard_join.Unions(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if 100 * len(x & y) >= 85 * len(x | y):
                up.join(a, b)
    want = {i: ids[up.find(k)] for k, i in enumerate(ids)}
    monkeypatch.setattr(jaccard_join, "REGION", 20)
    monkeypatch.setattr(jaccard_join, "DEPTH", 2)
    assert {g.doc_id: g.component_id for g in jaccard_join.link_documents(frame(spark, rows)).collect()} == want


def test_regions_that_windows_cannot_part_are_not_copied(spark, monkeypatch):
    """Near copies too far apart to link and too close for any window: rounds must not multiply them."""
    r = random.Random(6)
    base, rows = [f"w{k}" for k in range(200)], []
    for i in range(120):
        w = list(base)
        for p in r.sample(range(0, 200, 4), 9 if i % 3 else 2):
            w[p] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = brute_sets(rows, 4)
    up = jaccard_join.Unions(len(rows))
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up.join(a, b)
    monkeypatch.setattr(jaccard_join, "REGION", 20)
    held, write = [], jaccard_join.scratch.table

    def table(df, name):
        out = write(df, name)
        if name == "members":
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.scratch, "table", table)
    got = {g.doc_id: g.component_id for g in jaccard_join.link_documents(frame(spark, rows)).collect()}
    assert got == {i: up.find(i) for i, _ in rows} and 1 < len(set(got.values())) < 120
    assert len(held) > 1 and max(held) <= held[0]


def test_jaccard_null_id(spark):
    got = jaccard_join.link_documents(frame(spark, [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(2, 2), (2, 2), (None, None)]


def test_region_recursion_is_exact():
    import numpy as np

    r = random.Random(3)
    base = [r.sample(range(10**6), 60) for _ in range(6)]
    sets = []
    for _ in range(300):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 12)):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(10**6))
        sets.append(np.array(sorted(s), np.uint64))
    up = jaccard_join.Unions(300)
    for a in range(300):
        for b in range(a):
            x = len(np.intersect1d(sets[a], sets[b]))
            if 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                up.join(a, b)
    assert jaccard_join.join_region(sets, 85).tolist() == [up.find(i) for i in range(300)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(letters):
    s = [*letters, 0]
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            h = b[p : p + 100]
            if h in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(h)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [4_000, 2])
def test_suffix_dedup(spark, limit):
    rows = texts(90, 4)
    rows[5] = (5, "x" * 700)
    rows[6] = (6, "x" * 900 + "y" * 150 + "\0" * 120)
    want = brute_repeats(rows)
    for r in suffix_dedup.remove_repeats(frame(spark, rows), limit=limit, with_text=True).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_suffix_dedup_repeated_and_null_ids(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    got = suffix_dedup.remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, "short")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(t), len(t)]


def test_fuzzy_passages(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(5_000)]
    fresh = lambda n: r.choices(words, k=n)
    passage = fresh(90)
    edited = list(passage)
    for k in (22, 45, 70):
        edited[k] = "changed"
    del edited[30]
    rows = [(0, " ".join(fresh(40) + passage + fresh(50))), (1, " ".join(passage)), (2, " ".join(fresh(10) + edited + fresh(99))), (3, " ".join(fresh(300))), (4, None), (5, " ".join(fresh(200) + passage[:20] + fresh(100)))]
    rows += [(6, "of " * 200), (7, "of " * 150), (8, "")]
    got = {r.doc_id: r for r in chaining.find_repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 7}
    assert (got[1].start_word, got[1].end_word, got[1].ref_doc_id, got[1].ref_start_word, got[1].similarity) == (0, 90, 0, 40, 1.0)
    assert got[2].ref_doc_id == 0 and abs(got[2].start_word - 10) <= 2 and abs(got[2].end_word - 99) <= 2 and 0.9 < got[2].similarity < 1


@pytest.mark.parametrize("f", [exact_dedup.exact_duplicates, jaccard_join.link_documents, suffix_dedup.remove_repeats, chaining.find_repeated_passages])
def test_empty_table(spark, f):
    assert f(frame(spark, [], 1)).count() == 0


@pytest.mark.parametrize("gap,other", [(13, 13), (30, 30), (40, 33), (20, 38)])
def test_fuzzy_passages_of_one_pair_close_to_each_other(spark, gap, other):
    r = random.Random(gap)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(5_000)]
    fresh = lambda n: r.choices(words, k=n)
    some = [fresh(80), fresh(52), fresh(60)]
    join = lambda gap: " ".join(sum((fresh(gap) + p for p in some), []) + fresh(30))
    got = chaining.find_repeated_passages(frame(spark, [(1, join(other)), (2, join(gap))])).collect()
    at = 0
    for p in some:
        at += gap
        assert any(g.start_word <= at + 2 and g.end_word >= at + len(p) - 2 for g in got), (at, got)
        at += len(p)
    assert all(g.similarity >= 0.8 and g.end_word - g.start_word >= 50 for g in got)
    if gap >= 30:
        assert len(got) == 3 and all(g.similarity > 0.9 for g in got)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_fuzzy_passages_down_to_the_similarity(spark, similarity):
    r = random.Random(int(100 * similarity))
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(5_000)]
    fresh = lambda n: r.choices(words, k=n)
    rows, n = [], 40
    for i in range(n):
        w = fresh(50 + 5 * (i % 5))
        v, edits = list(w), int(len(w) * (1 - similarity) + 1e-9)
        for k in sorted(r.sample(range(len(w)), edits) if i % 2 else [(k + 1) * len(w) // edits - 1 for k in range(edits)], reverse=True):
            v[k : k + 1] = [] if i % 4 == 3 and edits > 1 and k % 3 == 0 else ["changed"]
        rows += [(i, " ".join(fresh(60) + w + fresh(60))), (n + i, " ".join(fresh(70) + v + fresh(60)))]
    got = {(g.doc_id, g.ref_doc_id): g for g in chaining.find_repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {(n + i, i) for i in range(n)}
    assert all(g.similarity >= 0.8 - 1e-9 and g.start_word < 90 and g.end_word > 100 for g in got.values())


def test_fuzzy_passages_whose_parts_come_first_elsewhere(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(5_000)]
    fresh = lambda n: r.choices(words, k=n)
    whole, twice = fresh(60), fresh(70)
    parts = [fresh(40) + whole[:30] + fresh(40), fresh(20) + whole[30:] + fresh(40)]
    rows = [*parts, fresh(10) + whole + fresh(10), *parts, fresh(33) + whole + fresh(44), fresh(9) + twice, twice + fresh(80) + twice + fresh(25) + twice]
    got = chaining.find_repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()
    assert [(g.start_word, g.end_word, g.ref_doc_id, g.ref_start_word) for g in got if g.doc_id == 5] == [(33, 93, 2, 10)]
    assert sorted((g.start_word, g.end_word, g.ref_doc_id, g.ref_start_word) for g in got if g.doc_id == 7) == [(0, 70, 6, 9), (150, 220, 6, 9), (245, 315, 6, 9)]
