"""Removal of repeated byte strings with suffix arrays built by linear grouping.

Texts are sampled at anchors: of every ``LENGTH`` bytes the 32-byte string with the
smallest hash, so equal strings of that length hold equal anchors at equal places.
Occurrences of an anchor with all bytes around it equal are settled by their order
alone. Where an anchor stands in different surroundings, the sides of the first
occurrence of each, eight bytes a letter, are put in order by a suffix array built by
linear grouping, for very many anchors at a time. Neighbours in that order tell how
far any two sides agree, so that windows with equal bytes come together; of each group the
earliest stays and the others are repeats.

An anchor with more than ``LIMIT`` different surroundings is replaced by longer strings
around it, each of which stands for some of the windows, until no group is larger.
So a task sorts a bounded number of bytes at once, however often a string occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.llm import scratch
from upkeep.llm import words as wd

LENGTH = 100
K = 32
#: Positions of an anchor in a string of LENGTH bytes, less one: so many bytes on either side matter.
SIDE = LENGTH - K
#: A string with more different surroundings than this is made longer, which deals them to several groups.
LIMIT = 4_096
#: Into how many parts the windows of such a string are dealt.
SPLIT = 4
#: Surroundings that a task sorts at once (about 1.2 MB).
SLICE = 8_192
#: Surroundings a partition.
PARTITION = 50_000
#: Places that may be broadcast to cut out their surroundings (100 MB); beyond it, a shuffled join does.
BROADCAST_PLACES = 4_000_000
#: Anchors that a task looks at together to settle repeats among them.
CHUNK = 500_000


def suffix_array(letters: np.ndarray | list[int]) -> list[int]:
    """Suffix array by linear grouping; the last letter must be smaller than all others.

    First, groups of suffixes are refined from the largest down: every suffix of a group
    points to the nearest one before it in a smaller group, and the suffixes pointed to,
    apart by how often, leave their group for one just above it. In the end a group holds
    the suffixes with one Lyndon prefix. Then the array fills from its start: behind each
    suffix, the chain of pointers from its left neighbour names suffixes that come next in
    their groups. A group is known by its first place in the array. A suffix that left a group
    stays in that group's list and is passed over, so all lists together hold as many entries as there are moves.
    """
    s = np.asarray(letters, np.int64)
    n = len(s)
    by_letter = np.argsort(s, kind="stable")
    starts = np.flatnonzero(np.diff(s[by_letter], prepend=s[by_letter[0]] - 1))
    ends = np.append(starts[1:], n)
    of = np.empty(n, np.int64)
    of[by_letter] = np.repeat(starts, ends - starts)
    group, by_letter = of.tolist(), by_letter.tolist()
    members, size, begin = {}, {}, {}
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        members[a], size[a], begin[b] = by_letter[a:b], b - a, a
    prev = [-1] * n
    top = n
    while top:
        g = begin[top]
        found: dict[int, int] = {}
        for i in members.pop(g):
            if group[i] == g:
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
        if found:
            split: dict[tuple[int, int], list[int]] = {}
            for p, times in found.items():
                key = (times, group[p])
                if key in split:
                    split[key].append(p)
                else:
                    split[key] = [p]
            for times, old in sorted(split, reverse=True) if len(split) > 1 else list(split):
                moved, have = split[times, old], size[old]
                m = len(moved)
                if m == have:
                    continue
                new, end = old + have - m, old + have
                begin[end], begin[new] = new, old
                size[old], size[new] = have - m, m
                if m > 1:
                    moved.sort()
                members[new] = moved
                for p in moved:
                    group[p] = new
        top = g
    sa, filled, placed = [-1] * n, list(range(n)), bytearray(n)
    sa[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = filled[g]
            sa[k], placed[j] = j, 1
            filled[g] = k + 1
            j = prev[j]
    return sa


class Sides:
    """One side of surroundings in byte order inside each group: how far neighbours in that order agree."""

    def __init__(self, group: np.ndarray, sides: np.ndarray):
        """``group`` is a number a row, ``sides`` bytes (rows, length), both padded alike where a text ends."""
        m, length = sides.shape
        wide = np.zeros((m, max(1, -(-length // 8)) * 8), np.uint8)
        wide[:, :length] = sides
        words = wide.view(">u8").astype(np.uint64)
        key = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for c in range(words.shape[1]):
            key = wd.mix(key + words[:, c])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if not ((words[first][inverse] == words).all() and (group[first][inverse] == group).all()):
            rows = np.concatenate([group.astype(np.uint64)[:, None], words], axis=1)  # two contents with one hash
            _, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        group, words, sides = group[first], words[first], sides[first]
        order = np.lexsort((self._ranks(group, words), group))
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.at = self.at[inverse.ravel()]
        unlike = sides[order[1:]] != sides[order[:-1]]
        agree = np.where(unlike.any(axis=1), unlike.argmax(axis=1), length) if length else np.zeros(len(order) - 1, np.int64)
        self.agree = np.where(group[order[1:]] == group[order[:-1]], agree, -1)

    @staticmethod
    def _ranks(group: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Ranks of the sides among all of groups that have several; a side is a string of letters of eight bytes."""
        rank = np.zeros(len(group), np.int64)
        _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[inverse] > 1)
        if not len(some):
            return rank
        values, letter, times = np.unique(words[some], return_inverse=True, return_counts=True)
        letter = letter.reshape(len(some), -1)
        # behind a letter that nothing else has, a string need not go on
        alone = times[letter] == 1
        size = np.where(alone.any(axis=1), alone.argmax(axis=1) + 1, letter.shape[1])
        s = np.concatenate([letter + 2, np.ones((len(some), 1), np.int64)], axis=1)
        use = np.arange(s.shape[1])[None, :] < size[:, None]
        use[:, -1] = True
        sa = suffix_array(np.append(s[use], 0))
        place = np.empty(len(sa), np.int64)
        place[sa] = np.arange(len(sa))
        rank[some] = place[np.cumsum(size + 1) - size - 1]
        return rank

    def classes(self, depth: int) -> np.ndarray:
        """Equal for rows of one group that agree in ``depth`` bytes, unequal for others."""
        return np.concatenate([[0], np.cumsum(self.agree < depth)])[self.at]


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray) -> np.ndarray:
    """For surroundings of strings, ``group`` by ``group`` and in order of occurrence: whether an earlier row has the same window.

    The result has a column for each number of bytes taken on the left; the rest come from the right.
    ``before`` is reversed, and both sides are padded; ``n_before`` and ``n_after`` are their real lengths.
    """
    side = before.shape[1]
    out = np.zeros((len(group), side + 1), bool)
    if not len(group):
        return out
    left, right = Sides(group, before), Sides(group, after)
    for n in range(side + 1):
        rows = np.flatnonzero((n_before >= n) & (n_after >= side - n))
        key = left.classes(n)[rows] * np.int64(len(group)) + right.classes(side - n)[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        out[rows[order[1:][key[1:] == key[:-1]]], n] = True
    return out


def _anchors(src: DataFrame) -> DataFrame:
    """``anchor, around, row, pos`` of one occurrence of each, and ``row, lo, hi`` of what repeats inside a task's chunk.

    The first have ``lo`` null. A later occurrence of an anchor with equal surroundings
    in the same chunk is settled at once, so a passage that very many texts hold sends a row per
    chunk, not per text. Rows of the second kind have their text's number for an anchor, which spreads them.
    """
    names = ["anchor", "around", "row", "pos", "lo", "hi"]

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(parts)
        order = np.lexsort((a["pos"], a["row"], a["around"], a["anchor"]))
        a = a[order]
        again = np.zeros(len(a), bool)
        again[1:] = (a["anchor"][1:] == a["anchor"][:-1]) & (a["around"][1:] == a["around"][:-1])
        wide = a["hi"] - a["lo"] >= LENGTH
        a, again = a[wide], again[wide]
        span = lambda c: pa.array(a[c], mask=~again)
        columns = [np.where(again, a["row"], a["anchor"]), np.where(again, 0, a["around"]), a["row"], a["pos"]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), span("lo"), span("hi")], names=names)

    kind = np.dtype([("anchor", "i8"), ("around", "i8"), ("row", "i8"), ("pos", "i4"), ("lo", "i4"), ("hi", "i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            flat, at = wd.buffers(b.column(1))
            ids = b.column(0).to_numpy()
            for r in np.flatnonzero(np.diff(at) >= LENGTH):
                x = flat[at[r] : at[r + 1]]
                h = wd.rolling(x, K)
                pos = wd.winnow(h, SIDE + 1)
                lo, hi = np.maximum(0, pos - SIDE), np.minimum(len(x), pos + LENGTH)
                out = np.empty(len(pos), kind)
                out["anchor"], out["row"], out["pos"], out["lo"], out["hi"] = h[pos].view(np.int64), ids[r], pos, lo, hi
                around = wd.spans(x, lo, hi)
                shape = (pos - lo).astype(np.uint64) * np.uint64(1009) + (hi - pos).astype(np.uint64)
                out["around"] = wd.mix(around + shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                parts.append(out)
                held += len(out)
                if held >= CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return src.mapInArrow(run, "anchor long, around long, row long, pos int, lo int, hi int")


def _shared(found: DataFrame) -> DataFrame:
    """Occurrences of anchors that occur twice, ``anchor, kinds, row, pos``, and repeats, ``row, lo, hi``.

    The first in each kind of surroundings has the anchor and its number of kinds, where that is two
    or more; for later ones, and what is settled already, there are the ends of what repeats. One shuffle and one sort serve both windows; an anchor has at
    most a row for each kind and chunk of a task, and a window keeps what exceeds memory on disk.
    """
    spread = found.repartition("anchor")
    open_ = F.col("lo").isNull()
    kind = W.partitionBy("lo", "anchor", "around").orderBy("row", "pos")
    rows = spread.withColumn("first", (F.row_number().over(kind) == 1) & open_)
    rows = rows.withColumn("kinds", F.count(F.when(F.col("first"), 1)).over(W.partitionBy("lo", "anchor")))
    rows = rows.where(~F.col("first") | (F.col("kinds") > 1))
    # a later occurrence in equal surroundings repeats all of them, as far as its text goes
    lo = F.coalesce("lo", F.greatest(F.col("pos") - SIDE, F.lit(0)))
    hi = F.coalesce("hi", F.col("pos") + LENGTH)
    first = lambda c: F.when(F.col("first"), F.col(c)).alias(c)
    later = lambda c, name: F.when(~F.col("first"), c).alias(name)
    return scratch.table(rows.select(first("anchor"), first("kinds"), "row", first("pos"), later(lo, "lo"), later(hi, "hi")), "shared")


def _surroundings(src: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes on both sides of each place: ``anchor, kinds, row, pos, before (reversed), after``."""
    per_row = places.groupBy("row").agg(F.collect_list(F.struct("anchor", "kinds", "pos")).alias("at"))  # bounded by the text's length
    few = places.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    asked = src.join(F.broadcast(per_row) if few else per_row, "row").select("row", "text", F.col("at.anchor").alias("anchor"), F.col("at.kinds").alias("kinds"), F.col("at.pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = wd.buffers(b["text"])
            n = np.diff(b["pos"].offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), n)
            pos, step = b["pos"].flatten().to_numpy(), np.arange(SIDE)
            n_before, n_after = np.minimum(SIDE, pos), np.clip(np.diff(at)[of] - pos - K, 0, SIDE)
            start = at[of] + pos
            for lo in range(0, max(1, len(pos)), 1 << 14):  # a bounded number of places at once
                cut = slice(lo, lo + (1 << 14))
                use = step[None, :] < n_before[cut, None], step[None, :] < n_after[cut, None]
                before = np.where(use[0], flat[np.where(use[0], start[cut, None] - 1 - step[None, :], 0)], 0) if len(flat) else np.zeros((0, SIDE), np.uint8)
                after = np.where(use[1], flat[np.where(use[1], start[cut, None] + K + step[None, :], 0)], 0) if len(flat) else np.zeros((0, SIDE), np.uint8)
                columns = [b["anchor"].flatten()[cut], b["kinds"].flatten()[cut], b["row"].take(pa.array(of[cut])), pa.array(pos[cut])]
                columns += [_binary(before, n_before[cut]), _binary(after, n_after[cut])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "kinds", "row", "pos", "before", "after"])

    return asked.mapInArrow(run, "anchor long, kinds long, row long, pos int, before binary, after binary")


def _binary(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` bytes of each row."""
    data = rows[np.arange(rows.shape[1])[None, :] < size[:, None]].astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _padded(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``side`` bytes, padded, and their real lengths."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    size = np.diff(at).astype(np.int64)
    out = np.zeros((n, side), np.uint8)
    if n and at[-1] > at[0]:
        out[np.arange(side)[None, :] < size[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return out, size


def _by_suffix_array(places: DataFrame, side: int) -> DataFrame:
    """``row, lo, hi`` of repeats among surroundings of equal strings, ``anchor, row, pos, before, after``."""
    parts = 1 + places.count() // PARTITION
    spread = places.select("anchor", "row", "pos", "before", "after").repartition(parts, "anchor").sortWithinPartitions("anchor", "row", "pos")

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        anchor, row, pos = (b[c].to_numpy() for c in ("anchor", "row", "pos"))
        (before, n_before), (after, n_after) = _padded(b["before"], side), _padded(b["after"], side)
        again = np.zeros((b.num_rows, side + 3), np.int8)
        again[:, 1:-1] = repeated_windows(np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0), before, after, n_before, n_after)
        edge = np.diff(again, axis=1)
        of, low = np.nonzero(edge == 1)  # the least number of bytes on the left in each run of windows
        _, high = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(row[of]), pa.array((pos[of] - high + 1).astype(np.int32)), pa.array((pos[of] - low + LENGTH).astype(np.int32))], names=["row", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= SLICE:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = whole["anchor"].to_numpy()
                last = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if last:
                    yield spans(whole.slice(0, last))
                held, n = [whole.slice(last)], len(anchor) - last
        if n:
            yield spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return spread.mapInArrow(run, "row long, lo int, hi int")


def _narrower(side: int) -> int:
    """Bytes on either side of the strings that take the place of one with ``side``."""
    return -(-(side + 1) // SPLIT) - 1


def _longer(places: DataFrame, side: int) -> DataFrame:
    """Longer strings in place of each: every one holds all bytes that some neighbouring windows share."""
    narrow = _narrower(side)
    starts = sorted({min(k * (narrow + 1), side - narrow) for k in range(SPLIT)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (before, n_before), (after, n_after) = _padded(b["before"], side), _padded(b["after"], side)
            for a in starts:
                z = side - narrow - a  # with a bytes of one side and z of the other, the string is LENGTH - narrow long
                left, right = np.clip(n_before - a, 0, narrow), np.clip(n_after - z, 0, narrow)
                use = np.flatnonzero((n_before >= a) & (n_after >= z) & (left + right >= narrow))
                core = np.concatenate([before[use, :a], after[use, :z]], axis=1)
                core = np.concatenate([core, np.zeros((len(use), -core.shape[1] % 8), np.uint8)], axis=1).view(">u8").astype(np.uint64)
                key = wd.mix(b["anchor"].to_numpy()[use].view(np.uint64) + np.uint64(a + 1) * np.uint64(0x9E3779B97F4A7C15))
                for c in range(core.shape[1]):
                    key = wd.mix(key * np.uint64(0x9DDFEA08EB382D69) + core[:, c])
                columns = [pa.array(key.view(np.int64)), b["row"].take(pa.array(use)), pa.array((b["pos"].to_numpy()[use] - a).astype(np.int32))]
                columns += [_binary(before[use, a : a + narrow], left[use]), _binary(after[use, z : z + narrow], right[use])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "row", "pos", "before", "after"])

    return places.select("anchor", "row", "pos", "before", "after").mapInArrow(run, "anchor long, row long, pos int, before binary, after binary")


def _settled(items: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Repeats in equal surroundings, ``row, lo, hi``, and the first of each kind where a string has several, with their number."""
    keys = ["anchor", "before", "after"]
    first = items.groupBy(*keys).agg(F.min(F.struct("row", "pos")).alias("f"))
    later = items.join(first, keys).where(F.struct("row", "pos") > F.col("f"))
    later = later.select("row", (F.col("pos") - F.length("before")).alias("lo"), (F.col("pos") + LENGTH - side + F.length("after")).alias("hi"))
    kinds = first.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    return later, scratch.table(first.join(kinds, "anchor").select("anchor", "k", "f.*", "before", "after"), "surroundings")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the remaining bytes ``kept`` with ``with_text``.

    Removed is each byte covered by a string of ``LENGTH`` bytes that also starts earlier: in a
    document with a smaller id, or earlier in the same one. Strings are judged on the input.
    Null counts as empty. Rows that repeat an id are told apart by their text, null ids come
    last; rows equal in both are one after the other. Bytes that remain need not be valid UTF-8.
    ``limit`` bounds the different surroundings of a string that are sorted together; it changes no result.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = dict(docs.select(F.col(id_col)).dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint")
    if plain and not src.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        src = src.withColumn("row", F.col("doc_id").cast("bigint"))
    else:
        src = scratch.table(src.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    shared = _shared(_anchors(src.select("row", "text")))
    spans = shared.where("lo IS NOT NULL").select("row", "lo", "hi")
    places = _surroundings(src.select("row", "text"), shared.where("kinds IS NOT NULL").select("anchor", "kinds", "row", "pos"))
    places, side = scratch.table(places.withColumnRenamed("kinds", "k"), "surroundings"), SIDE
    while True:
        spans = spans.unionByName(_by_suffix_array(places.where(F.col("k") <= limit), side))
        large = places.where(F.col("k") > limit)
        if not side or large.isEmpty():
            break
        items, side = scratch.table(_longer(large, side), "longer"), _narrower(side)
        later, places = _settled(items, side)
        spans = spans.unionByName(later)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # bounded by the text's length
    rows = src.join(per_row, "row", "left").select("doc_id", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            flat, at = wd.buffers(b["text"])
            for i in range(b.num_rows):
                x = flat[at[i] : at[i + 1]]
                gone, n_spans = np.zeros(len(x) + 1, np.int64), 0
                if b["lo"][i].is_valid:
                    lo, hi = b["lo"][i].values.to_numpy(), np.minimum(b["hi"][i].values.to_numpy(), len(x))
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi, -1)
                mask = np.cumsum(gone[:-1]) > 0
                n_spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(x) else 0
                kept = x[~mask].tobytes()
                out.append((len(x), int(mask.sum()), n_spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return rows.mapInArrow(cut, schema)
