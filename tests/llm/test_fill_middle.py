"""Rotation, the way back, and edge cases of the fill-in-the-middle transformation."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from upkeep.llm import fill_middle as FM

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), out[0], len(p), len(m), out[1]


def test_rotation_changes_two_blocks_in_place(monkeypatch):
    monkeypatch.setattr(FM, "BLOCK", 3)
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(0, 40)
        low, mid, high = sorted(r.randint(0, n) for _ in range(3))
        data = bytes(r.choices(range(256), k=n))
        buffer = bytearray(data)
        FM.rotate(buffer, low, mid, high)
        assert buffer == data[:low] + data[mid:high] + data[low:mid] + data[high:]


def test_every_cut_comes_back():
    text = "a <<P <S  é>\n<M".encode()
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            for form, want in (("psm", b"<P>" + text[:a] + b"<S>" + text[b:] + b"<M>" + text[a:b]), ("spm", b"<S>" + text[b:] + b"<P>" + text[:a] + b"<M>" + text[a:b])):
                out = FM.transform(text, a, b, form)
                assert out == want and FM.restore(bytes(out), form) == text


def test_documents_against_the_plain_rule(spark):
    r = random.Random(2)
    pieces = ["word", "élan", "日本", " ", "\t\n", "\x0b", " ", " ", "<P", ">", "<", "M>", "😀", "\x1c"]
    rows = [(i, "".join(r.choices(pieces, k=r.randint(0, 30)))) for i in range(300)]
    rows += [(1, None), (1, ""), (1, ""), (None, "no id here"), (2, "has <M> inside"), (-7, " \t"), (3, "long text " * 60_000), (4, "x" * 700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("clash"), "output": F.lit(1)})
    got = sorted(((g.doc_id, (g.n, g.form, g.prefix_chars, g.middle_chars, g.output), g.restored) for g in FM.restore_texts(FM.fill_in_middle(docs)).collect()), key=str)
    assert got == sorted(((i, plainly(i, t), t or "") for i, t in rows), key=str)
    assert {g[1][1] for g in got} == {"plain", "psm", "spm"}
    assert FM.round_trip(docs.where("false")).count() == 0
