"""Tasks from tables and text of candidate pages. Rows keep explicit ordinals; every strategy is plain DataFrame work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.functions import rules as R
from upkeep.functions import scalars as S
from upkeep.operators.pages import pm_candidate_pages
from upkeep.operators.ranges import carried
from upkeep.operators.tasks import finalize_tasks, merge_places
from upkeep.sources.files import passing_tables, shared_table


TABLE = ["manual_id", "page_no", "table_idx"]
#: What a strategy makes of a row: an ordinal, and the task.
NO_TASKS = "array<struct<ord:struct<strategy:int,page_no:int,i:int,j:int,k:int>,task:struct<area:string,action:string,description:string,machine_state:string,safety_flag:boolean,part_number:string,interval_hours:int>>>"


def table_rows(pages: DataFrame, *more: str) -> DataFrame:
    """``manual_id, page_no, table_idx, row_idx, n_rows, cells`` and columns ``more``; cells stripped, null cells empty."""
    cell = lambda c: S.strip(F.coalesce(c, F.lit("")))
    row = lambda t, ti: lambda cells, ri: F.struct(ti.alias("table_idx"), ri.alias("row_idx"), F.size(t).alias("n_rows"), F.transform(F.coalesce(cells, F.array().cast("array<string>")), cell).alias("cells"))
    rows = F.flatten(F.transform("tables", lambda t, ti: F.transform(t, row(t, ti))))
    return pages.select("manual_id", "page_no", *more, F.explode(rows).alias("r")).select("manual_id", "page_no", *more, "r.*")


def _ord(strategy: int, *parts: str | Column) -> Column:
    """Ordinals as one value that sorts like them."""
    at = [F.col(p) if isinstance(p, str) else p for p in parts] + [F.lit(0)] * (4 - len(parts))
    return F.struct(F.lit(strategy).alias("strategy"), *[c.cast("int").alias(n) for c, n in zip(at, ("page_no", "i", "j", "k"), strict=True)])


def _made(ord_: Column, area: Column, action: Column, text: Column, interval: Column, part: Column | None = None) -> Column:
    """A task with its ordinal; none for signs and labels."""
    task = F.struct(ord_.alias("ord"), S.build_task(area, action, text, interval, part).alias("task"))
    return F.when(~S.is_non_pm(text), task)


def _several(tasks: Column) -> Column:
    return F.filter(tasks, lambda x: x.isNotNull()).cast(NO_TASKS)


def _exploded(rows: DataFrame, *arrays: str) -> DataFrame:
    rows = rows.select("manual_id", "page_no", F.explode(F.concat(*arrays)).alias("x"))
    return rows.select("manual_id", F.col("x.ord").alias("ord"), "page_no", "x.task.*")


def _part(cells: str = "cells") -> Column:
    return F.get(F.filter(cells, lambda c: F.rlike(c, F.lit(R.PART_NUMBER))), F.lit(0))


def _running(rows: DataFrame) -> W:
    return W.partitionBy(*TABLE).orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)


def _with_header_tasks(rows: DataFrame) -> DataFrame:
    """Add ``by_header``, the task of a row below a heading row.

    Heading and carried interval are running values along a table, so nothing is joined, and rows that lie together by manual stay so.
    """
    low = F.transform("cells", F.lower)
    role = lambda name: F.array_position(F.transform(low, lambda c: S.any_match(c, R.HEADER_WORDS[name])), True) - 1
    may = (F.col("row_idx") < 4) & (F.col("n_rows") >= 2)
    roles = F.when(may, F.struct("row_idx", *[role(n).cast("int").alias(f"c_{n}") for n in R.HEADER_WORDS]))
    rows = rows.withColumn("roles", roles)
    named = sum(((F.col(f"roles.c_{n}") >= 0).cast("int") for n in R.HEADER_WORDS), F.lit(0))
    is_head = (named >= 2) & ((F.col("roles.c_interval") >= 0) | (F.col("roles.c_action") >= 0))
    rows = rows.withColumn("h", F.first(F.when(is_head, F.col("roles")), ignorenulls=True).over(_running(rows)))
    have = lambda n: F.col(f"h.c_{n}") >= 0
    at = lambda i: F.get("cells", i)
    i_action = F.when(have("action"), F.col("h.c_action")).when(have("desc"), F.col("h.c_desc")).otherwise(0)
    i_desc = F.when(have("desc"), F.col("h.c_desc")).when(have("action"), F.col("h.c_action")).otherwise(0)
    last = F.greatest(i_action, i_desc, F.col("h.c_interval"), F.col("h.c_area"))
    under = (F.col("row_idx") > F.col("h.row_idx")) & F.exists("cells", lambda c: c != "") & (F.size("cells") > last)
    raw = F.when(have("interval"), at(F.greatest(F.col("h.c_interval"), F.lit(0)))).otherwise("")

    def found(r: Column) -> Column:
        bare = F.regexp_replace(F.element_at(F.split(r, "\n"), 1), r"[,\s]", "")
        number = F.when(F.rlike(bare, F.lit(r"^[+-]?\d+$")), bare.try_cast("int"))
        return S.snap_interval(F.coalesce(S.detect_interval(r), F.when(number.between(8, 50_000), number)))

    rows = rows.withColumn("snapped", F.when(under, S.let(raw, found)))
    rows = rows.withColumn("interval", F.last(F.when(F.col("snapped") >= 8, F.col("snapped")), ignorenulls=True).over(_running(rows)))
    desc, work = at(i_desc), at(i_action)
    given = F.when(have("area"), at(F.greatest(F.col("h.c_area"), F.lit(0)))).otherwise("")
    area = F.when(given != "", F.substring(F.upper(given), 1, 30)).otherwise(S.detect_area(desc))
    text = F.when(desc != "", desc).otherwise(work)
    task = F.when(under & F.col("interval").isNotNull() & ~F.coalesce(F.col("snapped") < 8, F.lit(False)), _made(_ord(0, "page_no", "table_idx", "row_idx"), area, S.detect_action(work), text, F.col("interval"), _part()))
    return rows.withColumn("by_header", _several(F.array(task)))


def _with_interval_column_tasks(rows: DataFrame) -> DataFrame:
    """Add ``by_column``, a task for each marked cell below an interval of the first row."""
    def hours(c: Column) -> Column:
        found, digits = S.detect_interval(c), F.regexp_replace(c, "[,.]", "")
        number = F.when(F.rlike(digits, F.lit(r"^\d{2,6}$")), digits.try_cast("int"))
        snapped = S.snap_interval(number)
        return F.when((found > 0) & (found >= 8), found).when(S.is_valid_interval(number) | S.is_valid_interval(snapped), snapped)

    top = F.when((F.col("row_idx") == 0) & (F.col("n_rows") >= 3), F.transform("cells", hours))
    rows = rows.withColumn("iv", F.first(top, ignorenulls=True).over(_running(rows)))
    many = F.size(F.filter("iv", lambda v: v.isNotNull())) >= 2
    d = F.greatest(F.array_position(F.transform("iv", lambda v: v.isNull()), True) - 1, F.lit(0)).cast("int")
    text = F.get("cells", d)
    mark = lambda c: F.rlike(c, F.lit(R.CHECK_MARK)) | F.lower(c).isin(*R.CHECK_WORDS)
    one = lambda v, i: F.when(v.isNotNull() & mark(F.get("cells", i)), _made(_ord(1, "page_no", "table_idx", "row_idx", i), S.detect_area(text), S.detect_action(text), text, v))
    tasks = F.when(many & (F.col("row_idx") > 0) & (F.length(text) >= 5), _several(F.transform("iv", one)))
    return rows.withColumn("by_column", F.coalesce(tasks, F.array().cast(NO_TASKS)))


def _with_generic_tasks(rows: DataFrame) -> DataFrame:
    """Add ``by_number``, the task of a row with a bare number near a valid interval."""
    fits = lambda v: S.is_valid_interval(S.snap_interval(v))
    numbers = F.transform(F.filter("cells", lambda c: F.rlike(c, F.lit(r"^\d{2,6}$"))), lambda c: c.cast("int"))
    rows = rows.withColumn("number", F.when(F.size("cells") >= 3, S.snap_interval(F.get(F.filter(numbers, fits), F.lit(0)))))
    parts = F.filter("cells", lambda c: (F.length(c) > 3) & (c != F.col("number").cast("string")))
    rows = rows.withColumn("joined", F.when(F.col("number").isNotNull(), F.array_join(F.slice(parts, 1, 4), " - ")))
    text = F.col("joined")
    task = F.when(text != "", _made(_ord(2, "page_no", "table_idx", "row_idx"), S.detect_area(text), S.detect_action(text), text, F.col("number"), _part()))
    return rows.withColumn("by_number", _several(F.array(task)))


def header_table_tasks(pages: DataFrame) -> DataFrame:
    """Tasks of tables with a heading row: one of the first four rows whose cells name two roles, interval or action among them.

    A row without an interval takes the last one of its table. Rows too short for the
    columns that the heading names are left out.
    """
    return _exploded(_with_header_tasks(table_rows(pm_candidate_pages(pages))), "by_header")


def interval_column_tasks(pages: DataFrame) -> DataFrame:
    """Tasks of tables whose first row has two interval headings or more: a task for each marked cell."""
    return _exploded(_with_interval_column_tasks(table_rows(pm_candidate_pages(pages))), "by_column")


def generic_table_tasks(pages: DataFrame) -> DataFrame:
    """Tasks of rows with a bare number near a valid interval, whatever the table's heading."""
    return _exploded(_with_generic_tasks(table_rows(pm_candidate_pages(pages))), "by_number")


# Patterns that name an interval and a task in running text; group 1 is the number, group 2 the task.
END = r"(?=\n|every|alle|\z|$)"
TEXT_PATTERNS = [
    (r"(?:every|alle|each|after|nach)\s+(\d{1,6}[,.]?\d{0,3})\s*(?:operating\s+)?(?:hours?|hrs?|h\b|betriebsstunden|stunden)\s*[:\-–]?\s*(.{10,200}?)" + END, 1),
    (r"(?:^|\n)\s*(\d{2,6})\s*h(?:rs?)?\s*[-:–]\s*(.{10,200}?)(?=\n|\z|$)", 1),
    (r"(?:every|alle|each|nach)\s+(\d{1,2})\s*months?\b\s*[:\-–]?\s*(.{10,200}?)" + END, R.HOURS_PER_MONTH),
    (r"(?:every|alle|each|nach)\s+(\d{1,2})\s*weeks?\b\s*[:\-–]?\s*(.{10,200}?)" + END, R.HOURS_PER_WEEK),
    (r"(?:approx\.?\s+)?(?:every\s+)?(\d+)\s*[-–]?\s*years?\b\s*[:\-–]?\s*(.{10,200}?)(?=\n|every|\z|$)", R.HOURS_PER_YEAR),
]
SECTION_PATTERN = r"(\d{1,6}[,.]?\d{0,3})\s*[-–]?\s*(?:hour|hr|h)\s*(?:preventive\s+)?(?:maintenance|service|inspection|pm)\b"
BULLET_PATTERN = r"(?:^|\n)\s*(?:[•–\-\*]|\d{1,2}[\.\)])\s*(.{10,200}?)(?=\n|\z|$)"


def _hit(unit: int):
    """A match as its interval and task."""
    return lambda x: F.struct(S.snap_interval(F.regexp_replace(x["n"], "[,.]", "").try_cast("int") * unit).alias("iv"), S.strip(x["t"]).alias("t"))


def _ranked(k: int):
    """A match with its pattern and place."""
    return lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["iv"].cast("int").alias("iv"), x["t"].alias("t"))


def _text_hits(pages: DataFrame) -> DataFrame:
    """What each page's text gives by itself: ``found`` tasks with their interval, ``bullets`` without one, and the last interval named.

    Every pattern runs once over a page, its groups are taken from the matches. Pages that give nothing are left out.
    """
    rows = pages.select("manual_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    flags, has_digit = "(?iud)", F.rlike("text", F.lit(r"\d"))
    anchors, found = {}, []

    def pairs(p: str) -> Column:
        whole = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, p, 1).alias("n"), F.regexp_extract(m, p, 2).alias("t")))

    for k, (pattern, unit) in enumerate(TEXT_PATTERNS, 1):
        hits = F.transform(pairs(("(?iudm)" if k == 2 else flags) + pattern), _hit(unit))
        hits = F.filter(hits, lambda x: x["iv"].isNotNull())
        if k < 5:
            hits = F.filter(hits, lambda x: S.is_valid_interval(x["iv"]))
        rows = rows.withColumn(f"h{k}", F.when(has_digit, hits).otherwise(F.array().cast("array<struct<iv:int,t:string>>")))
        long_ = F.filter(f"h{k}", lambda x: F.length(x["t"]) > 10)
        anchor = F.col(f"h{k}") if k == 1 else F.filter(long_, lambda x: ~S.is_non_pm(x["t"])) if k == 5 else long_
        anchors[k] = F.try_element_at(anchor, F.lit(-1))["iv"]
        found.append(F.transform(long_, _ranked(k)))
    sections = F.filter(F.transform(F.regexp_extract_all("text", F.lit(flags + SECTION_PATTERN), F.lit(1)), lambda x: S.snap_interval(F.regexp_replace(x, "[,.]", "").try_cast("int"))), S.is_valid_interval)
    anchors[6] = F.when(has_digit, F.try_element_at(sections, F.lit(-1)))
    bullets = F.filter(F.transform(F.regexp_extract_all("text", F.lit(flags + BULLET_PATTERN), F.lit(1)), S.strip), lambda t: F.length(t) > 10)
    page = F.struct(F.concat(*found).alias("found"), bullets.alias("bullets"), F.coalesce(*[anchors[k] for k in (6, 5, 4, 3, 2, 1)]).cast("int").alias("page_anchor"))
    # a filter on the columns would be pushed below them and run the patterns again
    full = F.filter(F.array(page), lambda x: (F.size(x["found"]) > 0) | (F.size(x["bullets"]) > 0) | x["page_anchor"].isNotNull())
    return rows.select("manual_id", "page_no", F.explode(full).alias("x")).select("manual_id", "page_no", "x.*")


def _text_tasks(candidates: DataFrame) -> DataFrame:
    """Tasks of running text. What pages give is written once; the last interval named before a page is carried over ranges of pages."""
    rows = carried(shared_table(_text_hits(candidates), "page-hits"), ["manual_id"], "page_no", lasts={"anchor": "page_anchor"})
    rows = rows.withColumn("anchor", F.coalesce("page_anchor", "anchor"))
    under = F.transform("bullets", lambda t, i: F.struct(F.lit(7).alias("k"), i.alias("i"), F.col("anchor").alias("iv"), t.alias("t")))
    hits = F.concat("found", F.when(F.col("anchor").isNotNull(), under).otherwise(F.array().cast("array<struct<k:int,i:int,iv:int,t:string>>")))
    everything = F.transform(hits, lambda x: _made(_ord(3, "page_no", x["k"], x["i"]), S.detect_area(x["t"]), S.detect_action(x["t"]), x["t"], x["iv"]))
    return _exploded(rows.withColumn("by_text", _several(everything)), "by_text")


def text_pattern_tasks(pages: DataFrame) -> DataFrame:
    """Tasks that running text names with their interval, and bullets under the last interval named, over pages in order."""
    return _text_tasks(pm_candidate_pages(pages))


def extract_from_pages(pages: DataFrame) -> DataFrame:
    """All strategies together: each finalized, then finalized again; tables come before text.

    No step needs a manual in one task: candidate pages are chosen by number, a page's text is read by itself, tables are spread by page,
    intervals are carried over ranges of pages, and tasks are merged and numbered by what they hold.
    """
    with passing_tables(pages.sparkSession, "merged-tasks"):
        candidates = pm_candidate_pages(pages)
        # pages are dealt out before their tables are taken apart, which is less to shuffle
        tables = table_rows(candidates.where(F.size("tables") > 0).select("manual_id", "page_no", "tables").repartition("manual_id", "page_no"))
        for add in (_with_header_tasks, _with_interval_column_tasks, _with_generic_tasks):
            tables = add(tables)
        rows = _exploded(tables, "by_header", "by_column", "by_number").unionByName(_text_tasks(candidates))
        # headings and interval columns are one strategy
        rows = rows.withColumn("source", F.greatest(F.col("ord.strategy"), F.lit(1)))
        # both mergers find their tasks together after one shuffle
        rows = rows.withColumn("core", F.substring("description", 1, 100)).repartition("manual_id", "interval_hours", "area", "core")
        done = merge_places(rows, "source")
        return finalize_tasks(done.withColumn("ord", F.struct("source", "interval_hours", "area", "core")).drop("source"))


def pmrspl_tasks(pages: DataFrame) -> DataFrame:
    """Tasks of wide tables that have a column for each field and a section phrase on their first page."""
    rows = table_rows(pages)
    table = ["manual_id", "page_no", "table_idx"]
    number = lambda c: F.when(F.rlike(F.regexp_replace(c, "[,.]", ""), F.lit(r"^\d+$")), F.regexp_replace(c, "[,.]", "").try_cast("int"))
    wide = W.partitionBy(*table)
    rows = rows.withColumn("width", F.max(F.size("cells")).over(wide))
    works = lambda c: S.any_match(F.lower(c), R.WIDE_ACTIONS) & (F.length(c) < 30)
    at = F.filter(F.sequence(F.lit(0), F.size("cells") - 2), lambda i: number(F.get("cells", i)).isin(*R.WIDE_INTERVALS) & works(F.get("cells", i + 1)))
    spots = rows.where((F.col("width") >= 10) & (F.size("cells") >= 2)).select(*table, "row_idx", F.explode(at).alias("iv_col"))
    per = spots.groupBy(*table, "iv_col").agg(F.count("*").alias("n"), F.min(F.struct("row_idx", "iv_col")).alias("seen"))
    best = per.groupBy(*table).agg(F.max_by(F.struct("iv_col", "n"), F.struct("n", -F.col("seen.row_idx"), -F.col("seen.iv_col"))).alias("b")).where("b.n >= 2").select(*table, F.col("b.iv_col").alias("own_col"))
    phrase = pages.where((F.col("page_no") <= 150) & F.contains(F.lower("text"), F.lit(R.WIDE_PHRASE))).select("manual_id", "page_no")
    start = best.join(phrase, ["manual_id", "page_no"]).groupBy("manual_id").agg(F.min(F.struct("page_no", "table_idx")).alias("s"))
    rows = rows.join(start, "manual_id").where(F.col("page_no").between(F.col("s.page_no"), F.col("s.page_no") + 9))
    # of the first page only the first table that qualifies is read
    rows = rows.where((F.col("page_no") > F.col("s.page_no")) & (F.size("cells") > 0) | (F.col("page_no") == F.col("s.page_no")) & (F.col("table_idx") == F.col("s.table_idx")))
    tables = rows.select(*table, F.col("n_rows"), F.col("s.page_no").alias("first")).distinct().join(best, table, "left")
    tables = tables.where((F.col("n_rows") >= 2) | (F.col("page_no") == F.col("first")))
    tables = tables.withColumn("iv_col", F.last("own_col", ignorenulls=True).over(W.partitionBy("manual_id").orderBy("page_no", "table_idx").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(tables.select(*table, "iv_col"), table).where(F.size("cells") > F.col("iv_col") + 1)
    cell = lambda i: F.get("cells", i)
    iv, action = number(cell(F.col("iv_col"))), F.lower(cell(F.col("iv_col") + 1))
    comp = F.coalesce(cell(F.greatest(F.col("iv_col") - 4, F.lit(0))), F.lit(""))
    rows = rows.withColumns({"interval_hours": iv, "comp": comp, "label": F.coalesce(cell(F.lit(1)), F.lit("")), "part": cell(F.col("iv_col") + 2), "does": F.when(S.any_match(action, ["change", "replace"]), "REPLACE").otherwise("CHECK")})
    rows = rows.where(F.col("interval_hours").isin(*R.WIDE_INTERVALS) & S.any_match(action, R.WIDE_ACTIONS)).withColumn("kept", ~S.any_match(F.lower("comp"), R.WIDE_SKIP))
    rows = rows.withColumn("ord", _ord(0, "page_no", "table_idx", "row_idx"))
    key = W.partitionBy("manual_id", "label", "interval_hours")
    rows = rows.withColumn("first_ord", F.min(F.when(F.col("kept"), F.col("ord"))).over(key)).where(F.col("ord") >= F.col("first_ord"))
    firsts = rows.where("ord = first_ord").select("manual_id", "page_no").distinct().withColumn("adds", F.lit(True))
    # a run of two pages that add nothing ends the section
    span = start.select("manual_id", F.explode(F.sequence(F.col("s.page_no"), F.col("s.page_no") + 9)).alias("page_no"))
    span = span.join(pages.select("manual_id", "page_no"), ["manual_id", "page_no"], "left_semi").join(firsts, ["manual_id", "page_no"], "left")
    empty = F.col("adds").isNull()
    order = W.partitionBy("manual_id").orderBy("page_no")
    span = span.withColumn("two", empty & F.lag(empty, 1, False).over(order)).withColumn("stopped", F.max(F.col("two").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(span.where("stopped = 0").select("manual_id", "page_no"), ["manual_id", "page_no"], "left_semi")
    upgraded = F.max(F.when(F.col("does") == "REPLACE", 1).otherwise(0)).over(key)
    rows = rows.withColumn("upgraded", upgraded).where("ord = first_ord")
    area = S.first_match(F.lower("comp"), R.WIDE_AREAS, "GENERAL")
    return rows.select(
        "manual_id", (F.row_number().over(W.partitionBy("manual_id").orderBy("ord")) * 10).alias("task_no"), area.alias("area"),
        F.when(F.col("upgraded") == 1, "REPLACE").otherwise("CHECK").alias("action"),
        S.wide_description(F.col("does"), F.col("comp"), F.col("label"), F.col("part")).alias("description"),
        F.lit("STOPPED").alias("machine_state"), F.lit(False).alias("safety_flag"), F.nullif("part", F.lit("")).alias("part_number"),
        "interval_hours", F.lit("VERIFIED").alias("validation_status"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"),
        F.substring(F.array_join(F.filter("cells", lambda c: (c != "") & (c != "None")), " | "), 1, 500).alias("raw_text"), "ord",
    )
