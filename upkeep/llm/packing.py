"""Best-fit packing of documents into token sequences by minimum bin slack.

The largest piece that is left opens a bin, and a subset-sum dynamic program over the
lengths that are left, kept as the bits of one integer, finds the fullest combination
that fits beside it, which is then removed. There are at most ``capacity`` lengths, so
the plan needs their counts only: a combination is taken as often as the counts allow,
and there are no more combinations than lengths. Spark counts lengths, ranks the
pieces of each length, and looks every piece up in the plan.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.llm import scratch

CAPACITY = 2048
END_ID = 0
END_OF_TEXT = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    """The tokenizer of the file, and a faster encoder of the same vocabulary and merges.

    Ids of a byte-level vocabulary are given in the order of its merges, so they serve as
    ranks. The two agree (tests compare them); texts that spell out a special token go to
    the first one.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t != END_OF_TEXT}
    return Tokenizer.from_file(vocabulary), tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str) -> np.ndarray:
    """Token ids of a text, then the end id."""
    exact, fast = _encoders(vocabulary)
    text = text or ""
    ids = exact.encode(text, add_special_tokens=False).ids if END_OF_TEXT in text else fast.encode_ordinary(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and end of the pieces of ``n`` ids; only the first can be short of ``capacity``."""
    start, end = 0, n % capacity or capacity
    while start < n:
        yield start, end
        start, end = end, end + capacity


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best, by subset sums held as bits; larger lengths first."""
    reach, stages, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        stages.append((length, reach))
        left, chunk = min(counts[length], room // length), 1
        while left > 0:  # counts in powers of two
            take = min(chunk, left)
            reach |= reach << (length * take) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many bins take each; together they use all counts."""
    counts, plan = {k: v for k, v in counts.items() if v}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        bin_ = fullest({k: v for k, v in counts.items() if v}, capacity - largest)
        counts[largest] += 1
        bin_[largest] = bin_.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        plan.append((times, bin_))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which bins: sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, bins = [], 0
    for times, bin_ in plan:
        at = 0
        for length in sorted(bin_, reverse=True):
            n, first = bin_[length], taken.get(length, 0)
            rows.append((length, first, n, bins, at))
            taken[length] = first + n * times
            at += n * length
        bins += times
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": out[:, 0], "first": out[:, 1], "per_bin": out[:, 2], "bin": out[:, 3], "at": out[:, 4], "bins": np.array([bins])}


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, keep_ids: bool) -> DataFrame:
    """A row per piece; ``part`` and ``nth`` number the pieces of each length inside a task."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    scratch.small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, rest = [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py(), vocabulary)
                for piece, (a, b) in enumerate(cut(len(ids), capacity)):
                    data = ids[a:b].tobytes()
                    row.append(i)
                    rest.append((piece, a, b - a, zlib.crc32(data), part, seen[b - a], *([data] * keep_ids)))
                    seen[b - a] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * keep_ids]
            columns = [pa.array(c, k) for c, k in zip(zip(*rest, strict=True), kinds, strict=True)] if rest else [pa.array([], k) for k in kinds]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=names)

    return src.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; a row per piece.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and with
    ``keep_ids`` the piece's ids as little-endian unsigned 32-bit integers. A document is
    its token ids and an end id; a null text counts as empty and is the end id alone. Only
    documents longer than ``capacity`` are cut. Pieces of a sequence lie without gaps from
    offset 0. Rows that repeat an id, and null ids, are packed like others. An empty table
    gives no rows. ``vocabulary`` is a path that every executor can open.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = scratch.table(tokenized(docs, id_col, text_col, vocabulary, capacity, keep_ids), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = scratch.table(per_part.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))), "length-starts")
    # at most ``capacity`` rows, whatever the input
    counts = {r["length"]: r["c"] for r in starts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))
    ranked = pieces.join(starts.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("part", "nth")], (F.col("before") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        keys = (s["length"] << 48) + s["first"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            k = rank - s["first"][i]
            rest = batch.drop_columns("rank") if hasattr(batch, "drop_columns") else batch.select([c for c in batch.schema.names if c != "rank"])
            out = [*rest.columns, pa.array(s["bin"][i] + k // s["per_bin"][i]), pa.array(s["at"][i] + k % s["per_bin"][i] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*rest.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
