"""Fill-in-the-middle texts by in-place block rotation, and the exact way back.

A text is cut into prefix, middle and suffix between tokens. Sentinels go into a bytearray
that holds ``<P>prefix<M>middle<S>suffix``; the last two segments change places by a
rotation of three reversals, which gives the psm form, and ``<P>prefix`` and ``<S>suffix``
by another one, which gives spm. The way back scans for the sentinels and inverts the rotations. Reversals work
on the bytearray in blocks of fixed size, so a text is held once whatever its length.

Every row is work of its own: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm import scratch

P, S, M = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def reverse(view: np.ndarray, low: int, high: int) -> None:
    """Reverse ``view[low:high]`` in place, a block at each end at a time."""
    while high - low > 1:
        n = min(BLOCK, (high - low) // 2)
        left = view[low : low + n].copy()
        view[low : low + n] = view[high - n : high][::-1]
        view[high - n : high] = left[::-1]
        low, high = low + n, high - n


def rotate(buffer: bytearray, low: int, mid: int, high: int) -> None:
    """Let ``buffer[low:mid]`` and ``buffer[mid:high]`` change places, by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, low, mid)
    reverse(view, mid, high)
    reverse(view, low, high)


def token_ends(body: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens: spaces with the word that follows, and spaces at the end."""
    space = _SPACE[body]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(body)) if len(body) else ends


def chars(body: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((body & 0xC0) != 0x80))


def transform(body: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its middle between the two byte offsets moved behind, as ``form`` says."""
    out = bytearray(body)
    out[second:second] = S
    out[first:first] = M
    out[0:0] = P
    a, b = len(P) + first, len(P) + len(M) + second
    rotate(out, a, b, len(out))
    if form == "spm":
        rotate(out, 0, a, a + len(out) - b)
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``transform`` was given; plain texts come back as they are."""
    out = bytearray(output)
    if form == "plain":
        return out
    m = out.index(M)
    if form == "spm":
        p = out.index(P)
        rotate(out, 0, p, m)
        s = m - p
    else:
        s = out.index(S)
    # prefix, suffix, middle
    rotate(out, s, m, len(out))
    m = s
    s = out.index(S)
    del out[s : s + len(S)], out[m : m + len(M)], out[: len(P)]
    return out


def _form(body: bytes, h3: int, h4: int, rate: int, spm_rate: int) -> str:
    if not body or P in body or S in body or M in body or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm_rate else "psm"


_MADE = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text has ``n`` tokens: spaces (blank, tab and the four after it) with the word behind them, and spaces at its end. The cuts, whether a text
    changes at all (``rate`` in 100) and the order (``spm_rate`` in 100 put the suffix first)
    come from the SHA-256 of ``seed:id``. Null texts count as empty; empty texts and those that hold a sentinel stay
    plain, without ``prefix_chars`` and ``middle_chars``. A null id counts as an empty string. Rows that repeat an id
    are cut at the same numbers and come out as often as they went in. Texts may have any length; one is held in memory at a time, beside its
    batch. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("key"), "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                body = text.as_buffer().to_pybytes() if text.as_buffer() else b""
                flat = np.frombuffer(body, np.uint8)
                ends = token_ends(flat)
                h = [int(key.as_py()[i : i + 8], 16) for i in (0, 8, 16, 24)]
                form = _form(body, h[2], h[3], rate, spm_rate)
                if form == "plain":
                    made.append((len(ends), form, None, None, body))
                    continue
                cuts = sorted(x % (len(ends) + 1) for x in h[:2])
                a, b = (int(ends[c - 1]) if c else 0 for c in cuts)
                made.append((len(ends), form, chars(flat[:a]), chars(flat[a:b]), bytes(transform(body, a, b, form))))
            columns = list(zip(*made, strict=True)) or [[]] * len(_MADE)
            arrays = [pa.array(c, f.type) if f.name != "output" else pa.array(c, pa.large_binary()).cast(pa.large_string()) for c, f in zip(columns, _MADE, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *_MADE.names])

    return rows.mapInArrow(take, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_texts(rows: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bytes(restore(o.encode(), f)) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
            texts = pa.array(found, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "restored"])

    scratch.small_batches(rows.sparkSession)
    return rows.mapInArrow(take, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], "restored string"]))


def round_trip(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    rows = restore_texts(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
numbers AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM hashed),
cut AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM numbers),
parts AS (SELECT doc_id, text, n, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:n], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
