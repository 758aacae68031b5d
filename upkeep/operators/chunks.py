"""Chunks of manuals: sliding windows, sections, list items, table rows, Markdown and layout output, and balanced pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.functions import rules as R
from upkeep.functions import scalars as S
from upkeep.operators.extract import TABLE, table_rows
from upkeep.operators.pages import table_scan_pages
from upkeep.operators.ranges import RANGE, bounded, carried, dealt, numbered
from upkeep.sources.files import shared_table

CHUNK = ["manual_id", "chunk_type", "section_heading", "text", "page_start", "page_end", "char_start", "char_end", "interval_hint", "content_type", "ord"]


def char_to_page(position: Column, offsets: Column) -> Column:
    """Last page whose start isn't beyond the position, 1 if there is none; 0 without offsets. ``offsets`` is an array of (page, start)."""
    page = F.array_max(F.transform(F.filter(offsets, lambda o: o["start"] <= position), lambda o: o["page"]))
    return F.when(F.coalesce(F.size(offsets), F.lit(0)) <= 0, 0).otherwise(F.coalesce(page, F.lit(1)))


def _windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a text as an array of their text ``t`` and start ``a``: the first place of the first word in the whole text."""
    words = F.filter(F.split(S.strip(text), r"(?U)\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(max(1, size - overlap))))
        return F.transform(starts, lambda s: F.struct(F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("t"), (F.position(F.element_at(w, s + 1), text) - 1).alias("a")))

    return S.let(words, cut)


def sliding_chunks(texts: DataFrame, size: int = 500, overlap: int = 103) -> DataFrame:
    """Windows of ``size`` words that overlap by ``overlap``; ``texts`` has manual_id, text and may have offsets.

    A window's start is the first place of its first word in the whole text. Null and empty texts have none.
    """
    more = ["offsets"] if "offsets" in texts.columns else []
    rows = texts.select("manual_id", *more, F.posexplode(_windows(F.col("text"), size, overlap)).alias("ord", "c"))
    rows = rows.select("*", F.col("c.t").alias("chunk"), F.col("c.a").alias("char_start"), (F.col("c.a") + F.length("c.t")).alias("char_end"))
    page = lambda c: char_to_page(F.col(c), F.col("offsets")) if more else F.lit(0)
    return rows.select("manual_id", "ord", F.col("chunk").alias("text"), "char_start", "char_end", page("char_start").alias("page_start"), page("char_end").alias("page_end"), F.lit("text").alias("chunk_type"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(S.strip(text), r"(?U)\s+"), lambda w: w != ""))


def _lines(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """Each page's lines that aren't blank; of pages beyond ``max_pages`` none."""
    near = F.lit(True) if max_pages is None else F.col("page_no") <= max_pages
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), S.strip), lambda x: x != "")
    return pages.where(F.col("page_no").isNotNull()).select("manual_id", "page_no", F.when(near, lines).otherwise(F.array().cast("array<string>")).alias("lines"))


def section_chunks(pages: DataFrame, min_words: int = 20, max_pages: int | None = 120) -> DataFrame:
    """Text under each heading of the first pages (all, with None), with the heading in front; sections of too few words are left out.

    Headings are counted by page and summed up over ranges of pages; every page is then cut by itself, and what its parts
    add to sections of one number is put together. No window runs over the lines of a manual. A section is a row, however many pages it has.
    Pages without a number are left out.
    """
    cut = _lines(dealt(pages, "manual_id", "page_no"), max_pages)
    heads = F.filter(F.transform("lines", lambda x, i: F.when(S.is_heading(x), i)), lambda i: i.isNotNull())
    places = cut.select("manual_id", "page_no", heads.alias("heads")).groupBy("manual_id", "page_no").agg(F.max("heads").alias("heads"))
    counts = shared_table(places.withColumn("n_heads", F.size("heads")), "headings")
    before = bounded(shared_table(carried(counts, ["manual_id"], "page_no", sums={"before": "n_heads"}).select("manual_id", "page_no", "heads", "before"), "sections-before"))
    empty = "named_struct('page_no', CAST(NULL AS INT), 'lines', CAST(NULL AS ARRAY<STRING>))"
    # part k of a page starts below its heading k; part 0 goes on with the section before
    starts = F.concat(F.array(F.lit(-1)), "heads")
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    part = lambda s, k: F.struct(
        (F.col("before") + k).alias("section"), F.when(k > 0, F.get("lines", s)).alias("heading"), F.when(k > 0, F.col("page_no")).alias("head_page"),
        F.lit(None).cast("int").alias("next_page"), F.struct(F.col("page_no").cast("int").alias("page_no"), F.slice("lines", s + 2, end(k) - s - 1).alias("lines")).alias("body"),
    )
    # a heading also tells the section before it where the next one starts
    close = lambda s, k: F.struct((F.col("before") + k).alias("section"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("head_page"), F.col("page_no").cast("int").alias("next_page"), F.expr(empty).alias("body"))
    kind = "array<struct<section:bigint,heading:string,head_page:int,next_page:int,body:struct<page_no:int,lines:array<string>>>>"
    rows = cut.join(before, ["manual_id", "page_no"]).withColumn("starts", starts)
    rows = rows.select("manual_id", F.explode(F.concat(F.transform("starts", part).cast(kind), F.transform("heads", close).cast(kind))).alias("x")).select("manual_id", "x.*")
    last = counts.groupBy("manual_id").agg(F.sum("n_heads").alias("section"), F.max("page_no").cast("int").alias("last_page"))
    rows = rows.unionByName(last, allowMissingColumns=True)
    grouped = rows.groupBy("manual_id", "section").agg(
        F.array_sort(F.collect_list(F.when(F.size("body.lines") > 0, F.col("body")))).alias("of"),
        *[F.max(c).alias(c) for c in ("heading", "head_page", "next_page", "last_page")],
    )
    lines = F.flatten(F.transform("of", lambda x: x["lines"]))
    rows = grouped.where(F.size("of") > 0).withColumn("body", lines).withColumn("body_text", F.array_join("body", "\n")).where(word_count(F.col("body_text")) >= min_words)
    heading = F.coalesce("heading", F.lit(""))
    text = F.concat(F.when(heading != "", F.concat(F.lit("[SECTION: "), heading, F.lit("]\n"))).otherwise(""), "body_text")
    hint = F.coalesce(S.detect_interval(heading), F.get(F.filter(F.transform("body", S.detect_interval), lambda v: v.isNotNull()), F.lit(0)))
    return rows.select(
        "manual_id", F.lit("section").alias("chunk_type"), heading.alias("section_heading"), text.alias("text"),
        F.coalesce("head_page", F.lit(1)).alias("page_start"), F.coalesce("next_page", "last_page").alias("page_end"),
        F.lit(0).alias("char_start"), F.length(text).alias("char_end"), hint.alias("interval_hint"),
        S.content_type(F.col("body_text"), heading, F.lit("section")).alias("content_type"), F.col("section").cast("bigint").alias("ord"),
    )


def split_long_sections(sections: DataFrame, max_words: int = 800) -> DataFrame:
    """Sections over ``max_words`` packed greedily from their paragraphs (parted by blank lines), each with the heading in front."""
    paragraphs = F.filter(F.transform(F.split("text", "\n{2,}"), S.strip), lambda p: p != "")
    state = "struct<done:array<array<string>>,buf:array<string>,n:int>"
    start = F.lit(None).cast(state)
    empty = F.array().cast("array<string>")

    def take(acc: Column, p: Column) -> Column:
        n, pw = F.coalesce(acc["n"], F.lit(0)), word_count(p)
        buf, done = F.coalesce(acc["buf"], empty), F.coalesce(acc["done"], F.array().cast("array<array<string>>"))
        full = (n + pw > max_words) & (F.size(buf) > 0)
        return F.struct(
            F.when(full, F.concat(done, F.array(buf))).otherwise(done).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(buf, F.array(p))).alias("buf"),
            F.when(full, pw).otherwise(n + pw).cast("int").alias("n"),
        ).cast(state)

    packed = F.aggregate(paragraphs, start, take, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["buf"])), lambda b: F.size(b) > 0))
    head = F.when(F.col("section_heading") != "", F.concat(F.lit("[SECTION: "), F.col("section_heading"), F.lit("]\n"))).otherwise("")
    rows = sections.withColumn("long_", word_count(F.col("text")) > max_words)
    pieces = F.when(F.col("long_"), F.transform(packed, lambda x: F.concat(head, F.array_join(x, "\n\n")))).otherwise(F.array("text"))
    rows = rows.select("*", F.posexplode(pieces).alias("part", "piece"))
    kind, end = F.when(F.col("long_"), "paragraph").otherwise(F.col("chunk_type")), F.when(F.col("long_"), 0).otherwise(F.col("char_end"))
    return rows.withColumns({"text": F.col("piece"), "chunk_type": kind, "char_end": end}).drop("piece", "long_")


def checkbox_chunks(sections: DataFrame) -> DataFrame:
    """Sections with two list items or more become one chunk an item; others stay."""
    item = r"(?m)^[ \t]*(?:[□☐☑✓✔○●]|\[\s*\]|\(\s*\)|[•\-\*])\s+(.{5,})$"
    rows = sections.withColumn("items", F.regexp_extract_all("text", F.lit(item), F.lit(1)))
    rows = rows.withColumn("listed", F.size("items") >= 2)
    rows = rows.select("*", F.posexplode(F.when(F.col("listed"), F.col("items")).otherwise(F.array("text"))).alias("item", "t"))
    head = F.when(F.col("section_heading") != "", F.concat(F.col("section_heading"), F.lit(": "))).otherwise("")
    place = (F.position(F.col("t"), F.col("text")) - 1).cast("int")
    for_items = {
        "char_start": place, "char_end": (place + F.length("t")).cast("int"), "chunk_type": F.lit("checkbox"),
        "text": F.concat(F.lit("[TASK ITEM] "), head, S.strip("t")),
    }
    return rows.withColumns({c: F.when(F.col("listed"), v).otherwise(F.col(c)) for c, v in for_items.items()}).drop("items", "listed", "t")


def table_row_chunks(pages: DataFrame, first_pages: int | None = 80) -> DataFrame:
    """A chunk for each row of the tables on pages that name maintenance work; two-column label tables are one chunk.

    What a whole table decides (its width, kind, heading row and number column) are windows over the table, so rows are dealt once.
    """
    rows = table_rows(table_scan_pages(pages, first_pages), "page_interval").where("n_rows >= 2")
    table = W.partitionBy(*TABLE).orderBy("row_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earliest = lambda ok, value: F.first(F.when(ok, value), ignorenulls=True).over(table)
    label, value = F.lower(F.get("cells", F.lit(0))), F.get("cells", F.lit(1))
    rows = rows.withColumns({"width": F.max(F.size("cells")).over(table), "known": F.count(F.when(label.isin(*R.KEY_LABELS), 1)).over(table)}).where("width >= 2")
    rows = rows.withColumn("is_kv", (F.col("width") == 2) & (F.col("known") >= 2))
    named = F.col("is_kv") & (F.size("cells") >= 2) & (label != "") & (value != "")
    filled = F.size(F.filter("cells", lambda c: c != "")) >= 2
    number = lambda c: F.when(F.rlike(c, F.lit(r"^\d+$")), c.try_cast("int"))
    spot = F.filter(F.sequence(F.lit(0), F.size("cells") - 2), lambda i: number(F.get("cells", i)).isin(*R.NUMBER_COLUMN_INTERVALS) & S.any_match(F.lower(F.get("cells", i + 1)), R.NUMBER_COLUMN_ACTIONS))
    spot = F.when(~F.col("is_kv") & (F.col("row_idx") < 3) & (F.size("cells") >= 2), F.get(spot, F.lit(0)))
    rows = rows.withColumns({
        "kv": F.collect_list(F.when(named, F.struct(label.alias("k"), value.alias("v")))).over(table),
        "kv_row": earliest(named, F.col("row_idx")),
        "head": earliest(~F.col("is_kv") & (F.col("row_idx") < 4) & filled, F.struct("row_idx", F.transform("cells", F.lower).alias("h"))),
        "number_col": F.first(spot, ignorenulls=True).over(table),
    })
    # a label that comes twice keeps its first place and its last value
    keys = F.array_distinct(F.transform("kv", lambda x: x["k"]))
    lasting = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter("kv", lambda x: x["k"] == k), -1)["v"].alias("v")))
    auto = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    names = F.coalesce("head.h", auto)
    zipped = F.filter(F.transform("cells", lambda c, i: F.struct(F.get(names, i).alias("k"), c.alias("v"))), lambda x: x["k"].isNotNull() & (x["v"] != ""))
    below = F.col("head").isNull() | (F.col("row_idx") > F.col("head.row_idx"))
    rows = rows.withColumn("pairs", F.when(F.col("is_kv"), F.when(F.col("row_idx") == F.col("kv_row"), lasting)).when(below, zipped)).where(F.size("pairs") > 0)
    total = F.aggregate("pairs", F.lit(0), lambda n, x: n + word_count(x["v"]))
    rows = rows.where(F.col("is_kv") | F.col("head").isNotNull() | (total >= 5))
    by_column = number(F.get("cells", F.col("number_col")))
    body = F.array_join(F.transform("pairs", lambda x: F.concat(x["k"], F.lit(": "), x["v"])), " | ")
    out = rows.withColumns({"body": body, "number_iv": F.when(~F.col("is_kv") & by_column.isin(*R.NUMBER_COLUMN_INTERVALS), by_column), "at": F.when(F.col("is_kv"), 0).otherwise(F.col("row_idx"))})
    return out.select(
        "manual_id", F.lit("table_row").alias("chunk_type"), F.lit("").alias("section_heading"), F.concat(F.lit("[TABLE ROW] "), "body").alias("text"),
        F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), F.lit(0).alias("char_start"), F.length("body").alias("char_end"),
        F.coalesce(F.nullif(S.detect_interval(F.col("body")), F.lit(0)), "number_iv", "page_interval").alias("interval_hint"), F.lit("table").alias("content_type"),
        (F.col("page_no").cast("bigint") * 1_000_000_000 + F.col("table_idx") * 100_000 + F.col("at")).alias("ord"), F.to_json("pairs").alias("table_data"),
    )


def chunk_pages(pages: DataFrame, max_words: int = 800) -> DataFrame:
    """Table rows, then sections with their list items; manuals with neither get sliding windows.

    Chunks are written once; they are numbered by counts for each thousand pages, and the manuals that have none are found
    without making chunks again. Windows run over a manual's whole text, which is one row.
    """
    tables = table_row_chunks(pages).select(*CHUNK).withColumns({"part": F.lit(0), "item": F.lit(0), "grp": F.lit(0)})
    sections = checkbox_chunks(split_long_sections(section_chunks(pages), max_words)).withColumn("grp", F.lit(1))
    found = shared_table(tables.unionByName(sections.select(*tables.columns)), "chunks")
    # within tables and within sections, page_start never falls as ord rises
    coarse = [F.col("grp"), F.floor(F.col("page_start") / RANGE)]
    done = numbered(found.withColumnRenamed("ord", "ord_"), ["manual_id"], coarse, ["ord_", "part", "item"], "ord").select(*CHUNK)
    has = bounded(shared_table(found.select("manual_id").distinct(), "manuals-with-chunks"))
    rest = pages.join(has, "manual_id", "left_anti").groupBy("manual_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))).alias("of"))
    whole = F.array_join(F.transform("of", lambda x: x["t"]), "\n")
    rest = rest.select("manual_id", F.posexplode(_windows(whole, 500, 103)).alias("ord", "c"))
    plain = {
        "chunk_type": F.lit("text"), "section_heading": F.lit(""), "text": F.col("c.t"), "page_start": F.lit(0), "page_end": F.lit(0), "char_start": F.col("c.a"),
        "char_end": F.col("c.a") + F.length("c.t"), "interval_hint": F.lit(None), "content_type": F.lit("procedure"), "ord": F.col("ord"),
    }
    return done.unionByName(rest.select("manual_id", *[v.cast(done.schema[c].dataType).alias(c) for c, v in plain.items()]))


def markdown_chunks(docs: DataFrame, words_per_chunk: int = 400) -> DataFrame:
    """Chunks of Markdown: pipe tables whole, paragraphs of 20 characters or more in pieces, the heading above each kept."""
    lines = docs.select("manual_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    kind = F.when(F.startswith("line", F.lit("#")), "head").when(F.startswith("line", F.lit("|")), "table").when(S.strip("line") == "", "blank").otherwise("text")
    order = W.partitionBy("manual_id").orderBy("line_no")
    lines = lines.withColumn("kind", kind)
    lines = lines.withColumn("new", F.when(F.col("kind") == F.lag("kind").over(order), 0).otherwise(1))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum("new").over(upto))
    heading = F.last(F.when(F.col("kind") == "head", S.strip(F.regexp_replace("line", "^#+", ""))), ignorenulls=True).over(upto)
    lines = lines.withColumn("heading", F.coalesce(heading, F.lit(""))).where(F.col("kind").isin("table", "text"))
    blocks = lines.groupBy("manual_id", "block", "kind", "heading").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("ls"))
    separator = r"^\|[\s\-:|]+\|"
    tables = blocks.where((F.col("kind") == "table") & F.exists("ls", lambda r: ~F.rlike(r, F.lit(separator))))
    tables = tables.select("manual_id", "block", F.lit(0).alias("part"), F.lit("table_row").alias("chunk_type"), "heading", F.concat(F.lit("[TABLE]\n"), F.array_join("ls", "\n")).alias("text"), F.lit("table").alias("content_type"))
    para = S.strip(F.array_join(F.transform("ls", S.strip), " "))
    texts = blocks.where("kind = 'text'").withColumn("para", para).where(F.length("para") >= 20)
    kind = F.when(F.rlike("para", F.lit(r"[☐☑☒✓✔□■]|^\s*[-*]\s+")), "checkbox").otherwise("paragraph")
    words = F.split("para", r"\s+")
    texts = texts.withColumns({"chunk_type": kind, "w": words})
    pieces = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(words_per_chunk)), lambda s: F.array_join(F.slice("w", s + 1, F.lit(words_per_chunk)), " "))
    texts = texts.withColumn("content_type", S.content_type(F.col("para"), F.col("heading"), F.col("chunk_type"))).select("manual_id", "block", "chunk_type", "heading", "content_type", F.posexplode(pieces).alias("part", "text"))
    rows = tables.unionByName(texts.select(*tables.columns))
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("manual_id").orderBy("block", "part"))).drop("block", "part").withColumnRenamed("heading", "section_heading")


def layout_chunks(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """Chunks of a layout service's output: paragraphs under the last heading, then table rows joined from their cells."""
    order = W.partitionBy("manual_id").orderBy("para_no").rowsBetween(W.unboundedPreceding, 0)
    rows = paragraphs.where(S.strip(F.coalesce("text", F.lit(""))) != "").withColumn("is_head", F.coalesce(F.col("role").isin("title", "sectionHeading", "heading"), F.lit(False)))
    rows = rows.withColumn("heading", F.coalesce(F.last(F.when(F.col("is_head"), S.strip("text")), ignorenulls=True).over(order), F.lit("")))
    last = rows.groupBy("manual_id").agg(F.max_by("heading", "para_no").alias("heading"))
    rows = rows.select("manual_id", F.when(F.col("is_head"), "text").otherwise("section").alias("chunk_type"), "heading", "text", F.col("page_no").alias("page_start"), S.detect_interval(F.col("text")).alias("interval_hint"), S.content_type(F.col("text"), F.col("heading"), F.lit("section")).alias("content_type"), F.lit(0).alias("grp"), F.col("para_no").cast("bigint").alias("k"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", S.strip(F.coalesce("content", F.lit(""))).alias("c")))), lambda x: x["c"]), lambda c: c != ""), " | ")
    tables = cells.groupBy("manual_id", "page_no", "table_idx", "row_idx").agg(joined.alias("text")).where(F.length("text") >= 5).join(last, "manual_id", "left")
    tables = tables.select("manual_id", F.lit("table_row").alias("chunk_type"), F.coalesce("heading", F.lit("")).alias("heading"), "text", F.col("page_no").alias("page_start"), S.detect_interval(F.col("text")).alias("interval_hint"), F.lit("table").alias("content_type"), F.lit(1).alias("grp"), (F.col("table_idx").cast("bigint") * 100_000 + F.col("row_idx")).alias("k"))
    out = rows.unionByName(tables)
    return out.withColumn("ord", F.row_number().over(W.partitionBy("manual_id").orderBy("grp", "k"))).drop("grp", "k").withColumnRenamed("heading", "section_heading")


EMBED_CAPS = {"table_row": 80, "section": 60, "checkbox": 50, "other": 10}
EXTRACT_CAPS = {"table_row": 80, "section": 60, "checkbox": 30, "other": 10}


def balanced_pool(chunks: DataFrame, caps: dict[str, int] = EXTRACT_CAPS, useful_only: bool = True) -> DataFrame:
    """The first chunks of each kind and manual, tables first, then sections, list items and others; ``ord`` counts anew."""
    rows = chunks.where(S.useful_for_extraction(F.col("text"), F.col("chunk_type"))) if useful_only else chunks
    kind = F.when(F.col("chunk_type").isin("table_row", "checkbox"), F.col("chunk_type")).when(F.col("chunk_type").isin("section", "paragraph"), "section").otherwise("other")
    rows = rows.withColumn("bucket", kind).withColumn("rn", F.row_number().over(W.partitionBy("manual_id", "bucket").orderBy("ord")))
    place, most = None, None
    for i, name in enumerate(("table_row", "section", "checkbox", "other")):
        hit = F.col("bucket") == name
        place = F.when(hit, i) if place is None else place.when(hit, i)
        most = F.when(hit, caps[name]) if most is None else most.when(hit, caps[name])
    rows = rows.where(F.col("rn") <= most).withColumn("place", place)
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("manual_id").orderBy("place", "rn")).cast("bigint")).drop("bucket", "rn", "place")


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("manual_id", "chunk_type").agg(F.count("*").alias("n"))


def interval_hints(chunks: DataFrame, manuals: DataFrame) -> DataFrame:
    """Intervals that a manual's chunks name (8 hours or more) with the usual ones of its maker, sorted."""
    seen = chunks.where("interval_hint >= 8").groupBy("manual_id").agg(F.collect_set("interval_hint").alias("seen"))
    rows = manuals.select("manual_id", "manufacturer").join(seen, "manual_id", "left")
    both = F.array_union(F.coalesce("seen", F.array().cast("array<int>")), S.guess_intervals(F.col("manufacturer")))
    return rows.select("manual_id", F.array_sort(both).alias("intervals"))
