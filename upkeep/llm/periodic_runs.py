"""Runs of words that repeat with a period, found on recompression grammars.

The words of a batch of documents are named and one grammar is built over all of them. For
every period q, places a multiple of q apart (the harmonic grid) are compared with their
neighbours on the grid: a run of period q covers two of them at least, and the grammar's longest common extensions
from there, on and back, give its exact ends. A stretch found with several periods keeps the smallest.

Documents are work of their own: nothing is shuffled, and a batch holds a few megabytes or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.functions import scalars
from upkeep.llm import recompression, scratch

#: A run has this many words or more.
LEAST = 12
#: Pairs of grid places that are compared together; bounds memory, not work.
PAIRS = 1 << 20


def _first_of(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start and end."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs(names: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs in the parts ``begin, size`` of ``names``.

    ``least`` is at least 12. Two symbols that nothing equals must stand before the first part and behind the last,
    and one between parts.
    """
    found = [np.zeros((3, 0), np.int64)]
    levels = recompression.grammar(names, int(size.max(initial=0)))
    half = size // 2
    part = np.repeat(np.arange(len(size)), half)
    q = np.arange(len(part)) - np.repeat(np.cumsum(half) - half, half) + 1
    places = (size[part] - 1) // q
    upto = np.cumsum(places)
    low = 0
    while low < len(q):
        before = upto[low] - places[low]
        high = max(low + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        for shift in range(0, int(upto[high - 1] - before), PAIRS):  # one period of a very long text may have more
            n = places[low:high] if high - low > 1 else np.array([min(PAIRS, int(places[low]) - shift)])
            qs = np.repeat(q[low:high], n)
            i = np.repeat(begin[part[low:high]], n) + (np.arange(len(qs)) - np.repeat(np.cumsum(n) - n, n) + shift * (high - low == 1)) * qs
            same = names[i] == names[i + qs]
            i, qs = i[same], qs[same]
            # places q apart agree over 6 words or more around a run's grid place: with two words on, or with two words back
            on = (names[i + 1] == names[i + qs + 1]) & (names[i + 2] == names[i + qs + 2])
            back = (names[i - 1] == names[i + qs - 1]) & (names[i - 2] == names[i + qs - 2])
            i, qs = i[on | back], qs[on | back]
            if len(i):
                fwd = recompression.extend(levels, i, i + qs)
                bwd = recompression.extend(levels, i - 1, i + qs - 1, ahead=False)
                ok = (fwd + bwd >= qs) & (fwd + bwd + qs >= least)
                found.append(np.stack(_first_of((i - bwd)[ok], (i + qs + fwd)[ok], qs[ok])))
            if high - low > 1:
                break
        low = high
    return _first_of(*np.concatenate(found, axis=1))


def _batch(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, runs before each text, their starts, lengths and periods, and the texts without repeats."""
    split = [(t or "").encode().split() for t in texts]  # at blanks, tabs and the four bytes after it
    every = list(chain.from_iterable(split))
    known = dict(zip(dict.fromkeys(every), count(), strict=False))
    size = np.array([len(w) for w in split], np.int64)
    begin = np.cumsum(size + 1) - size + 1
    total = int(size.sum()) + len(split) + 3
    names = np.full(total, -1, np.int64)
    word = np.arange(len(every)) + np.repeat(begin - (np.cumsum(size) - size), size)
    names[word] = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
    gaps = np.flatnonzero(names < 0)
    names[gaps] = len(known) + np.arange(len(gaps))
    start, end, period = runs(names, begin, size, least)
    of = np.searchsorted(begin, start, "right") - 1
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change) > 0
    kept = []
    for b, w in zip(begin, split, strict=True):
        mask = gone[b : b + len(w)]
        kept.append(b" ".join([x for x, g in zip(w, mask.tolist(), strict=True) if not g] if mask.any() else w))
    order = np.lexsort((period, start))
    start, end, period, of = start[order], end[order], period[order], of[order]
    return size, np.searchsorted(of, np.arange(len(texts) + 1)), start - begin[of], end - start, period, kept


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    Words are what stands between blanks, tabs and the four characters after it. A run is a stretch of
    ``least`` (12 or more) words and of twice its smallest period that can't be made longer; ``runs`` lists ``start, length, period`` by
    start, then period. ``collapsed`` is the text, a blank between words, without the words that a
    run holds after its first period. Null and empty texts have no words. Rows that repeat an id, null ones included,
    are documents of their own. Texts may have any length. Other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, start, length, period, kept = _batch(batch["text"].to_pylist(), least)
            one = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), one)
            texts = pa.array(kept, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(take, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic end in about every tenth document, chosen by the checksum of its id."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    text = F.when((h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), scalars.let(words, planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """``find_runs``'s rows with the number of runs, the longest one (ties: smallest start, then period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
