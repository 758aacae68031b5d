"""Which pages of a manual matter, and samples of their text. Pages are ``(manual_id, page_no, text, tables)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.functions import rules as R
from upkeep.functions import scalars as S
from upkeep.operators.ranges import bounded, dealt
from upkeep.sources.files import shared_table

FALLBACK_PAGES = 600
#: Rows of packed page numbers up to which they are sent to all executors (some 30 MB).
PACKED_ROWS = 250_000


def classification_sample(pages: DataFrame, max_pages: int | None = 50, enough: int = 60_000, cut: int = 15_000) -> DataFrame:
    """Start of each manual's text: pages until ``enough`` characters are reached, joined by line ends."""
    order = W.partitionBy("manual_id").orderBy("page_no")
    before = F.coalesce(F.sum(F.length("t") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)
    rows = rows.select("manual_id", "page_no", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("before", before).where(F.col("before") < enough)
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda x: x["t"]), "\n"), F.lit("\n"))
    return rows.groupBy("manual_id").agg(F.substring(joined, 1, cut).alias("sample"))


def candidate_keys(pages: DataFrame, fallback_pages: int | None = FALLBACK_PAGES) -> DataFrame:
    """``manual_id, page_no`` of pages with maintenance words, of the page before and two after; of manuals without any, of their first pages.

    Texts are read once, where they lie; only page numbers are shuffled. The result is a written table, in which pages that
    don't exist may be named. Pages without a number are left out.
    """
    hit = F.rlike(F.coalesce("text", F.lit("")), F.lit(f"(?iu){R.CANDIDATE}"))
    marks = shared_table(pages.where("page_no IS NOT NULL").select("manual_id", "page_no", hit.alias("hit")), "page-marks")
    near = marks.where("hit").select("manual_id", F.explode(F.sequence(F.col("page_no") - 1, F.col("page_no") + 2)).alias("page_no"))
    none = marks.groupBy("manual_id").agg(F.max("hit").alias("any_hit")).where("not any_hit").select("manual_id")
    early = F.lit(True) if fallback_pages is None else F.col("page_no") <= fallback_pages
    first = marks.where(early).join(none, "manual_id", "left_semi").select("manual_id", "page_no")
    return shared_table(near.unionByName(first).distinct(), "page-keys")


def packed_keys(keys: DataFrame) -> DataFrame:
    """``manual_id, pages_, bits_``: the numbers that ``keys`` names, 64 neighbouring ones as the bits of one row; a written table."""
    bit = F.expr("shiftleft(1L, cast(pmod(page_no, 64) AS int))")
    return shared_table(keys.groupBy("manual_id", F.floor(F.col("page_no") / 64).alias("pages_")).agg(F.bit_or(bit).alias("bits_")), "packed-keys")


def pm_candidate_pages(pages: DataFrame, fallback_pages: int | None = FALLBACK_PAGES) -> DataFrame:
    """Pages with maintenance words, the page before and two after; manuals without any keep their first pages (all, with None).

    Chosen pages are picked by number, of which 64 neighbours are one row: where these rows fit in memory (they are counted), no page is shuffled.
    """
    pages = dealt(pages, "manual_id", "page_no")
    keys = bounded(packed_keys(candidate_keys(pages, fallback_pages)), PACKED_ROWS)
    rows = pages.withColumn("pages_", F.floor(F.col("page_no") / 64)).join(keys, ["manual_id", "pages_"])
    return rows.where(F.expr("shiftright(bits_, cast(pmod(page_no, 64) AS int)) & 1 = 1")).select(*pages.columns)


def pm_page_pool(pages: DataFrame, pool: DataFrame, first: int = 120) -> DataFrame:
    """Candidate pages that the pool doesn't cover, put in front of it: ``manual_id, ord, text, page_start, page_end``."""
    rows = pm_candidate_pages(pages).where(F.length(S.strip(F.coalesce("text", F.lit("")))) >= 50)
    rows = rows.select("manual_id", F.col("page_no").alias("page_start"), F.substring("text", 1, 3000).alias("text"))
    rows = rows.join(pool.select("manual_id", "page_start").distinct(), ["manual_id", "page_start"], "left_anti")
    rn = F.row_number().over(W.partitionBy("manual_id").orderBy("page_start"))
    new = rows.withColumn("ord", rn).where(F.col("ord") <= first).select("manual_id", F.col("ord").cast("bigint").alias("ord"), "text", "page_start", F.col("page_start").alias("page_end"))
    return new.unionByName(pool.select("manual_id", (F.col("ord") + first).cast("bigint").alias("ord"), "text", "page_start", "page_end"))


def table_scan_pages(pages: DataFrame, first: int | None = 80) -> DataFrame:
    """Early pages that name maintenance work, with the interval the page's text names."""
    low = F.lower(F.coalesce("text", F.lit("")))
    near = F.lit(True) if first is None else F.col("page_no") <= first
    return pages.where(near & S.any_match(low, R.TABLE_SCAN_WORDS)).withColumn("page_interval", S.detect_interval(low))


def fallback_citations(pages: DataFrame, citations: DataFrame, first_pages: int | None = 150, most: int = 25) -> DataFrame:
    """Evidence for manuals without citations: their first pages that name maintenance work."""
    rows = pages if first_pages is None else pages.where(F.col("page_no") <= first_pages)
    rows = rows.join(citations.select("manual_id").distinct(), "manual_id", "left_anti")
    rows = rows.where(S.any_match(F.lower(F.coalesce("text", F.lit(""))), R.EVIDENCE_WORDS))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("manual_id").orderBy("page_no"))).where(F.col("rn") <= most)
    return rows.select("manual_id", F.concat(F.lit("fallback_p"), F.col("page_no").cast("string")).alias("chunk_id"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), F.lit("procedure").alias("content_type"), F.substring("text", 1, 500).alias("text_excerpt"))
