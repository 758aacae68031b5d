"""Grammar extensions and runs against brute force, planted documents, and edge cases."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from upkeep.llm import periodic_runs as PR
from upkeep.llm import recompression as RC


def brute_runs(w):
    """All runs, period by period."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= 12:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plainly(doc_id, text):
    """The report's row, word for word."""
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_extensions_are_exact():
    r = random.Random(3)
    for _ in range(150):
        k, n = r.choice([1, 2, 3, 5]), r.randint(1, 120)
        body = [r.randint(2, 1 + k) for _ in range(n)]
        if r.random() < 0.5:
            p = r.randint(1, 9)
            body = [body[z % min(p, n)] if r.random() < 0.98 else body[z] for z in range(n)]
        a = [0, *body, 1]
        pairs = [(i, j) for i, j in ((r.randint(1, n), r.randint(1, n)) for _ in range(50)) if i != j]
        if not pairs:
            continue
        levels = RC.grammar(np.array(a), n, r.choice([1, 4, 8]))
        for step in (1, -1):
            want = []
            for i, j in pairs:
                m = 0
                while a[i + step * m] == a[j + step * m]:
                    m += 1
                want.append(m)
            i, j = np.array(pairs).T
            assert RC.extend(levels, i, j, step == 1).tolist() == want


def test_runs_in_many_parts(monkeypatch):
    r = random.Random(4)
    for pairs in (7, 1 << 20):
        monkeypatch.setattr(PR, "PAIRS", pairs)
        texts = []
        for _ in range(80):
            w = r.choices("abc"[: r.randint(1, 3)], k=r.randint(0, 70))
            for _ in range(r.randint(0, 2)):
                p = r.choices("abcdef", k=r.randint(1, 9))
                w += (p * 9)[: r.randint(0, 60)]
            texts.append(" ".join(w))
        size, at, start, length, period, _ = PR._batch(texts, 12)
        for k, t in enumerate(texts):
            got = list(zip(start[at[k] : at[k + 1]].tolist(), length[at[k] : at[k + 1]].tolist(), period[at[k] : at[k + 1]].tolist(), strict=True))
            assert got == brute_runs(t.split()) and size[k] == len(t.split())


def test_report_of_planted_documents(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=3)) for _ in range(40)]
    rows = [(i, r.choice([" ", "\n", " \t "]).join(r.choices(words, k=r.randint(0, 90)))) for i in range(250)]
    rows += [(7, None), (7, ""), (7, " \x0b"), (None, "tick tock " * 40), (8, "same " * 30_000), (9, "é x é " * 20), (9, "é x é " * 20), (10, "no repeats")]
    rows += [(i, "a\x1cb " * 13) for i in (11, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("clash")})
    cheap = [x for x in rows if len(x[1] or "") < 10_000]
    report = PR.run_report(PR.find_runs(PR.plant_runs(docs)))
    got = sorted((tuple(g) for g in report.where("not doc_id <=> 8 or n_runs <> 1").collect()), key=str)
    assert got == sorted((plainly(*x) for x in cheap if x[0] != 8 or plainly(*x)[1] != 1), key=str)
    long_ = report.where("doc_id = 8 and n_runs = 1 and length > 20000").collect()
    assert [(g.start, g.length, g.period, g.collapsed_sha256) for g in long_] == [(0, 30_000, 1, hashlib.sha256(b"same").hexdigest())]
    assert sum(g[1] > 0 for g in got) > 15
    assert PR.run_report(PR.find_runs(docs.where("false"))).count() == 0
