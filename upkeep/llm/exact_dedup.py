"""Exact deduplication by deterministic block naming.

Every text gets one integer name that no other text has. A text is cut into blocks of
fixed size; the sorted distinct blocks are numbered, then the distinct pairs of
neighbouring names are sorted and numbered, and so on until one name is left. Equal
texts get equal names and different texts different ones: names stand for whole
contents, so no hash can collide.

A 64-bit hash and the length come first, and only rows that share both are named: a
text whose hash nobody shares differs from all others. The names decide about the rest.
DataFrame functions do all the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm import scratch

BLOCK_BYTES = 1 << 14


def _numbered(distinct: DataFrame, by: list[str], ranges: list[Column] | None = None) -> DataFrame:
    """Add ``name``: a number that rises with the sorted rows. ``by`` must tell rows apart.

    ``ranges`` are short keys to range-partition by, so that the sample of keys that the
    driver sees stays small; rows are sorted by these keys and then by ``by``.
    """
    keys = ranges or [F.col(c) for c in by]
    spread = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys, *by)
    return spread.withColumn("name", F.monotonically_increasing_id())


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Name whole texts: ``texts(row_id, body binary)`` to ``(row_id, n_blocks, name)``.

    Two rows have equal ``(n_blocks, name)`` exactly if their bodies are equal. Empty
    bodies are one empty block. ``row_id`` must be unique. Every round halves the number
    of names a text has; a round is a distinct, a sort and a join, all spread by content.
    """
    n = F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes)).cast("int")
    cut = texts.select(
        "row_id",
        n.alias("n_blocks"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))
        ).alias("at", "block"),
    )
    cut = scratch.table(cut, "blocks")
    short = [F.substring("block", 1, 16), F.xxhash64("block")]
    names = scratch.table(_numbered(cut.select("block").distinct(), ["block"], short), "block-names")
    level = scratch.table(cut.join(names, "block").select("row_id", "n_blocks", "at", "name"), "level")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, width = level.where("n_blocks = 1").select("row_id", "n_blocks", "name"), 1
    while width < most:
        half = F.col("at") % 2 == 0
        pairs = (
            level.where(F.col("n_blocks") > width)
            .groupBy("row_id", "n_blocks", F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(F.max(F.when(half, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("right"))
        )
        names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        # the numbers are written before they are joined, so that a task that runs again can't see others
        names = scratch.table(names, "pair-names")
        level = scratch.table(pairs.join(names, ["left", "right"]).select("row_id", "n_blocks", "at", "name"), "level")
        width *= 2
        done = done.unionByName(level.where(F.col("n_blocks") <= width).select("row_id", "n_blocks", "name"))
    return done


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "last",
    normalize: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are, after ``normalize`` (a Column over the
    input; by default the text as it is). Null counts as empty. Of equal texts the row
    with the largest id stays (``keep="last"``), or the smallest (``"first"``). A null id
    is below all others and stays only if no row of the group has one; rows that repeat
    an id and a text count each in ``group_size`` and are all kept or all dropped. Other columns are
    not read, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(normalize if normalize is not None else F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    body = F.col("t").cast("binary")
    facts = scratch.table(
        src.select(
            "doc_id",
            F.xxhash64("t").alias("h"),
            F.octet_length("t").alias("n"),
            F.sha2(body, 256).alias("text_sha256"),
        ),
        "facts",
    )
    shared = facts.groupBy("h", "n").agg(F.count("*").alias("c")).where("c > 1").select("h", "n")
    # one row per id and hash is named; repeated rows share it
    wanted = facts.join(shared, ["h", "n"], "left_semi").select("doc_id", "h", "n").distinct()
    texts = src.select("doc_id", F.xxhash64("t").alias("h"), F.octet_length("t").alias("n"), body.alias("body"))
    same_id = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["h"] == wanted["h"]) & (texts["n"] == wanted["n"])
    texts = texts.join(wanted, same_id, "left_semi").select(F.struct("doc_id", "h", "n").alias("row_id"), "body")
    texts = texts.groupBy("row_id").agg(F.first("body").alias("body")) if _repeats(docs, id_col) else texts
    named = block_names(texts, block_bytes).select("row_id.*", "n_blocks", "name")
    pick = F.max if keep == "last" else F.min
    left, right = facts.alias("l"), named.alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h")) & (F.col("l.n") == F.col("r.n"))
    rows = left.join(right, on, "left").select("l.doc_id", "l.text_sha256", "r.n_blocks", "r.name")
    groups = rows.where("name is not null").groupBy("n_blocks", "name").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    alone = rows.where("name is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = rows.where("name is not null").join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id comes twice (one narrow aggregation)."""
    return bool(docs.groupBy(id_col).count().where("count > 1").limit(1).count())


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
