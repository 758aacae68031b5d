"""Benchmark decontamination by the q-gram lemma and banded alignment.

Every text is scanned against all segments of the benchmark. A segment of m characters
that occurs with at most e edits shares at least m + 1 - q - q e of its q-grams with the
place, and all on e + 1 neighbouring diagonals. The scan counts shared q-grams in bands
of diagonals that overlap, keeps bands that reach the bound, and verifies these by an
alignment inside the band. Texts pass once, without a shuffle; the benchmark goes to the
tasks in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm import scratch
from upkeep.llm import words as wd

Q = 8
SEGMENT = 100
RATE = 0.1
#: Shorter segments with fewer edits, one every ``STEP`` characters: every passage of 80 characters holds a whole one.
SHORT = 60
STEP = 20
SHORT_EDITS = 2
#: Bytes of benchmark text that go to the tasks at once (an index of about 45 MB each for the long segments, an estimated 110 with the short ones); a larger benchmark takes several passes.
BLOCK_BYTES = 1 << 20
_KEEP = wd._LETTER_OR_DIGIT


def normal(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes where every run of other bytes than letters and digits is one blank.

    Returns the bytes, where each came from, and the text offsets. Each text begins and
    ends without a blank.
    """
    if not len(flat):
        return flat, np.zeros(0, np.int64), np.zeros_like(at)
    low = wd._LOWER[flat]
    word = _KEEP[low]
    first = np.zeros(len(flat), bool)
    first[at[:-1][at[:-1] < len(flat)]] = True
    # a blank stands for the last byte before a word, unless the word begins its text
    gap = ~word
    gap[:-1] &= word[1:] & ~first[1:]
    gap[-1] = False
    inner = np.maximum.accumulate(np.where(word, np.arange(len(flat)), -1))
    start = np.repeat(at[:-1], np.diff(at))
    gap &= inner >= start
    keep = np.flatnonzero(word | gap)
    out = np.where(word[keep], low[keep], np.uint8(32))
    return out, keep, np.searchsorted(keep, at)


def grams(text: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from every position as one integer, q at most 8."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    codes = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()
    return codes & np.uint64((1 << (8 * q)) - 1)


@dataclass
class Index:
    segments: list[np.ndarray]
    item: np.ndarray
    start: np.ndarray  # of the segment in its item
    item_length: np.ndarray
    edits: np.ndarray
    bound: np.ndarray  # shared q-grams that a place must have
    codes: np.ndarray  # sorted, with the next two
    of: np.ndarray
    at: np.ndarray
    filter: np.ndarray  # by the hash of a code


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)


def build(items: list[tuple[int, str]], segment: int = SEGMENT, rate: float = RATE, q: int = Q, common: int = 8) -> Index:
    """Segments of the items and their q-grams.

    Items are cut into segments that overlap by half, so every passage of one and a half
    segments holds a whole one, and again into short ones, which overlap by two thirds and may have
    fewer edits. Grams that more than ``common`` long segments have, or half as many again of the short ones, are left
    out of such a segment's count where its bound, less their number, stays above 0: the lemma
    then holds for the grams that are left.
    """
    segs, item, start, size, short = [], [], [], [], []
    for i, text in items:
        body = normal(*wd.buffers(pa.array([text])))[0]
        n = len(body)
        if n < q:
            continue
        starts = [0] if n <= segment else [*range(0, n - segment, segment // 2), n - segment]
        close = [*range(0, n - SHORT, STEP), n - SHORT] if n > SHORT and segment > SHORT else []
        for s, m in [*((s, segment) for s in starts), *((s, SHORT) for s in close)]:
            segs.append(body[s : s + m])
            item.append(i)
            start.append(s)
            size.append(n)
            short.append(m < segment)
    length = np.array([len(s) for s in segs], np.int64)
    edits = np.minimum((length * rate).astype(np.int64), (length - q) // q)
    short = np.array(short, bool)
    edits = np.where(short, np.minimum(edits, SHORT_EDITS), edits)
    bound = length + 1 - q - q * edits
    code = np.concatenate([grams(s, q) for s in segs]) if segs else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(segs)), length - q + 1)
    at = np.concatenate([np.arange(n - q + 1) for n in length]) if segs else np.zeros(0, np.int64)
    frequent = np.zeros(len(code), bool)
    for kind, most in ((short, common * 3 // 2), (~short, common)):
        mine = kind[of] if len(of) else frequent
        _, inverse, times = np.unique(code[mine], return_inverse=True, return_counts=True)
        frequent[mine] = times[inverse] > most
    dropped = np.bincount(of[frequent], minlength=len(segs))
    drop = bound > dropped
    bound = np.where(drop, bound - dropped, bound)
    keep = ~(frequent & drop[of]) if len(of) else np.zeros(0, bool)
    order = np.argsort(code[keep], kind="stable")
    code, of, at = code[keep][order], of[keep][order], at[keep][order]
    seen = np.zeros(1 << 22, bool)
    seen[_slot(code)] = True
    return Index(segs, np.array(item, np.int64), np.array(start, np.int64), np.array(size, np.int64), edits, bound, code, of, at, seen)


def align(patterns: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each pattern against any part of its text, with the part's start and end.

    All pairs advance together, a pattern byte a step; the texts are the bands cut out of
    the documents, so their length bounds the width.
    """
    count, width = len(patterns), max(len(t) for t in texts)
    text = np.zeros((count, width), np.uint8)
    for i, t in enumerate(texts):
        text[i, : len(t)] = t
    inside = np.arange(width + 1)[None, :] <= np.array([len(t) for t in texts])[:, None]
    length = np.array([len(p) for p in patterns])
    pattern = np.full((count, length.max()), 255, np.uint8)
    for i, p in enumerate(patterns):
        pattern[i, : len(p)] = p
    column = np.arange(width + 1, dtype=np.int64)
    # cost above, start of the part below, so that one minimum settles both
    row = np.where(inside, column[None, :], 1 << 50)
    final = row.copy()
    one, shift = 1 << 32, np.int64(32)
    for j in range(pattern.shape[1]):
        diagonal = row[:, :-1] + np.where(text == pattern[:, j : j + 1], 0, one)
        nxt = row + one
        np.minimum(nxt[:, 1:], diagonal, out=nxt[:, 1:])
        nxt = np.minimum.accumulate(nxt - column * one, axis=1) + column * one
        row = np.where(inside, nxt, 1 << 50)
        ends = length == j + 1
        final[ends] = row[ends]
    end = final.argmin(axis=1)
    best = final[np.arange(count), end]
    return best >> shift, best & (one - 1), end


def scan(text: np.ndarray, by_text: np.ndarray, index: Index, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """Verified places in normal texts: (row, segment, start, end, edits)."""
    codes = grams(text, q)
    where = np.flatnonzero(index.filter[_slot(codes)])
    low = np.searchsorted(index.codes, codes[where], "left")
    times = np.searchsorted(index.codes, codes[where], "right") - low
    where, low, times = where[times > 0], low[times > 0], times[times > 0]
    row = np.searchsorted(by_text, where, "right") - 1
    fits = where + q <= by_text[row + 1]
    where, low, times, row = where[fits], low[fits], times[fits], row[fits]
    if not len(where):
        return []
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    pos, row = np.repeat(where, times), np.repeat(row, times)
    edits, longest = int(index.edits.max(initial=0)), max(len(x) for x in index.segments)
    seg, diagonal = index.of[entry], pos - index.at[entry] + longest
    wide = edits + 1  # bands of twice this width, starting at every multiple: any edits + 1 diagonals lie in one
    band = diagonal // wide
    key = np.concatenate([band, band - 1]) * len(index.segments) + np.concatenate([seg, seg])
    r2 = np.concatenate([row, row])
    order = np.lexsort((r2, key))
    key, r2 = key[order], r2[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (r2[1:] != r2[:-1])]))
    n = np.diff(np.concatenate([new, [len(key)]]))
    s = key[new] % len(index.segments)
    good = n >= index.bound[s]
    found = []
    key, s, r = key[new][good], s[good], r2[new][good]
    start = key // len(index.segments) * wide - longest
    for lo in range(0, len(s), 512):
        part = slice(lo, lo + 512)
        a = np.maximum(by_text[r[part]], start[part] - edits)
        size = np.array([len(index.segments[x]) for x in s[part]])
        b = np.minimum(by_text[r[part] + 1], start[part] + 2 * wide + size + edits)
        e, p0, p1 = align([index.segments[x] for x in s[part]], [text[x:y] for x, y in zip(a, b, strict=True)])
        ok = e <= index.edits[s[part]]
        found += zip(r[part][ok].tolist(), s[part][ok].tolist(), (a + p0)[ok].tolist(), (a + p1)[ok].tolist(), e[ok].tolist(), strict=True)
    return found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment: int = SEGMENT,
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Places where a document holds text of a benchmark item; a row per document row and item.

    Columns: ``doc_id, item_id, start_byte, end_byte, n_segments, edits, coverage``. A place
    counts when a segment of ``segment`` normal characters of the item (a shorter item
    whole) is there with at most ``rate`` edits a character, or one of ``SHORT`` with at most ``SHORT_EDITS``. Bytes are those of the UTF-8
    text from the first to the last place, ``edits`` the fewest of a segment, ``coverage``
    the share of the item inside found segments. Null and empty texts hold nothing, and
    null ids of either table stay null; rows that repeat an id give a row each; items that are null or
    shorter than ``Q`` normal characters hold no gram and are left out, items below ``2 * Q`` must be there
    without an edit, and repeated item ids are items of their own, of any type. An empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item}, start_byte long, end_byte long, n_segments int, edits int, coverage double"
    scratch.small_batches(spark)
    out = None
    for ids, items in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast((ids, build(items, segment, rate)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ids, known = index.value
            for b in batches:
                found = _rows(b, known)
                yield found.set_column(1, "item_id", ids.take(found["item_id"]))

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", segment: int = SEGMENT, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold text of a benchmark item.

    What counts is as in ``find_contamination``. Rows are judged where they are read, so
    nothing is joined or shuffled. Null and empty texts stay.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    at = docs.columns.index(text_col)
    for _, items in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(build(items, segment, rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], names=["doc_id", "text"])
                clean = np.ones(b.num_rows, bool)
                clean[_rows(numbered, index.value)["doc_id"].to_numpy()] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[pa.Array, list[tuple[int, str]]]]:
    """Items in blocks of about ``block_bytes``: their ids and, numbered from 0, their texts; the driver holds one block at a time."""
    kind = benchmark.limit(0).select("item_id").toArrow().schema.field(0).type
    ids, block, size = [], [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((len(block), row[1]))
        ids.append(row[0])
        size += len(row[1])
        if size >= block_bytes:
            yield pa.array(ids, kind), block
            ids, block, size = [], [], 0
    if block:
        yield pa.array(ids, kind), block


def _rows(b: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    flat, at = wd.buffers(b.column(1))
    rows, out = [], []
    for i, j in wd.slices(at):
        text, origin, by_text = normal(flat[at[i] : at[j]], at[i : j + 1] - at[i])
        places: dict[tuple[int, int], list] = {}
        for r, s, a, z, e in scan(text, by_text, index):
            places.setdefault((r, int(index.item[s])), []).append((s, a, z, e))
        for (r, item), found in sorted(places.items()):
            segs = sorted({s for s, *_ in found})
            covered, reach = 0, 0
            for s in sorted(segs, key=lambda s: index.start[s]):
                end = int(index.start[s]) + len(index.segments[s])
                covered += max(0, end - max(reach, int(index.start[s])))
                reach = max(reach, end)
            first, last = min(a for _, a, _, _ in found), max(z for *_, z, _ in found)
            base = int(at[i + r] - at[i])
            rows.append(i + r)
            out.append((item, int(origin[first]) - base, int(origin[last - 1]) + 1 - base, len(segs), min(e for *_, e in found), covered / int(index.item_length[segs[0]])))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns], names=["doc_id", "item_id", "start_byte", "end_byte", "n_segments", "edits", "coverage"])
