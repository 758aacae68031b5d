"""Running values and numbers over ranges, and manuals of very many pages: spread, with the rows of plain windows."""

import pathlib
import random

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.operators import chunks, extract, pages, ranges, tasks


def test_running_values_equal_windows(spark):
    r = random.Random(1)
    rows = [(m, i, r.randint(0, 5), r.choice([None, r.randint(1, 99)])) for m in ("a", "b", None) for i in r.sample(range(-30, 200), 90)]
    df = spark.createDataFrame(rows, "m string, at int, n int, v int").where("m is not null")
    got = {tuple(x) for x in ranges.carried(df, ["m"], "at", {"s": "n"}, {"l": "v"}, size=7).select("m", "at", "s", "l").collect()}
    w = W.partitionBy("m").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    want = {tuple(x) for x in df.select("m", "at", F.coalesce(F.sum("n").over(w), F.lit(0)), F.last("v", True).over(w)).collect()}
    assert got == want and len(got) == 180


def test_numbers_equal_windows_with_nulls_and_empty_tables(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice("xy"), r.choice([None, 8, 500]), r.choice([None, "", "A", "B"]), i) for i in range(300)], "m string, h int, a string, i int")
    got = {(x.i, x.no) for x in ranges.numbered(df, ["m"], [F.col("h"), F.col("a")], ["i"], "no").collect()}
    w = W.partitionBy("m").orderBy("h", "a", "i")
    assert got == {(x.i, x.no) for x in df.select("i", F.row_number().over(w).alias("no")).collect()}
    assert ranges.numbered(df.where("false"), ["m"], [F.col("h")], ["i"], "no").count() == 0
    assert ranges.carried(df.where("false"), ["m"], "i", {"s": "h"}).count() == 0


def test_page_numbers_are_packed(spark):
    text = lambda m, n: "preventive maintenance" if (m, n) in {("a", 62), ("a", 127), ("a", 500), ("b", 64), ("c", 3_000), ("d", -1)} else "x"
    numbers = [(m, n) for m in "abcd" for n in range(-3, 1_300)] + [("c", 3_000)]
    rows = spark.createDataFrame([(m, n, text(m, n), None) for m, n in numbers], "manual_id string, page_no int, text string, tables array<array<array<string>>>")
    got = sorted((x.manual_id, x.page_no) for x in pages.pm_candidate_pages(rows).collect())
    assert got == sorted((m, n) for m, n in numbers if any(text(m, n + i) != "x" for i in (-2, -1, 0, 1)))
    keys = pages.candidate_keys(rows.withColumn("text", F.lit("preventive maintenance")))
    assert keys.count() > 5_000 and pages.packed_keys(keys).count() <= 4 * 24


def big(spark, n=40_000):
    """A manual of n pages: an interval every 5,000 pages, a heading every 700, bullets everywhere."""
    page = F.col("id").cast("int") + 1
    text = F.concat(
        F.when(page % 5_000 == 17, F.concat(F.lit("Every "), ((page / 5_000).cast("int") + 1).cast("string"), F.lit("000 hours: replace the main oil filter\n"))).otherwise(""),
        F.when(page % 700 == 3, F.concat(F.lit("CHAPTER "), page.cast("string"), F.lit(" MAINTENANCE\n"))).otherwise(""),
        F.lit("- check the preventive maintenance drive of unit "), (page % 97).cast("string"), F.lit(" with many more words so that a section is long enough\n"),
    )
    rows = spark.range(n).select(F.lit("giant").alias("manual_id"), page.alias("page_no"), text.alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    return rows.unionByName(rows.where("page_no <= 30").withColumn("manual_id", F.lit("small")))


def busiest(df):
    """Share of the rows of the largest part when rows are dealt by their columns as the operator deals them."""
    sizes = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_a_giant_manual_gives_the_rows_of_plain_windows(spark):
    p = big(spark, 12_000)
    got = extract.text_pattern_tasks(p).groupBy("manual_id", "interval_hours").count()
    hits = extract._text_hits(pages.pm_candidate_pages(p))
    w = W.partitionBy("manual_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    hits = hits.withColumn("a", F.last("page_anchor", True).over(w))
    want = hits.select("manual_id", F.explode(F.concat(F.transform("found", lambda x: x["iv"]), F.when(F.col("a").isNotNull(), F.transform("bullets", lambda _: F.col("a"))).otherwise(F.array().cast("array<int>")))).alias("interval_hours"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.groupBy("manual_id", "interval_hours").count().collect()))
    done = tasks.finalize_tasks(extract.text_pattern_tasks(p))
    order = W.partitionBy("manual_id").orderBy("interval_hours", "area", F.substring("description", 1, 100))
    assert done.withColumn("n", F.row_number().over(order) * 10).where("n <> task_no").count() == 0 and done.count() > 100
    s = chunks.section_chunks(p, max_pages=None).where("manual_id = 'giant'").orderBy("ord").collect()
    assert [x.page_start for x in s] == [1, *range(3, 12_001, 700)] and [x.page_end for x in s] == [*range(3, 12_001, 700), 12_000]
    assert s[1].section_heading == "CHAPTER 3 MAINTENANCE" and s[1].text.count("\n") >= 700 - 2


def test_no_task_holds_a_giant_manual(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        p = big(spark)
        assert busiest(pages.pm_candidate_pages(p)) < 0.5
        per = extract.shared_table(extract._text_hits(pages.pm_candidate_pages(p)), "hits")
        assert busiest(ranges.carried(per, ["manual_id"], "page_no", lasts={"anchor": "page_anchor"})) < 0.5
        assert busiest(tasks.finalize_tasks(extract.text_pattern_tasks(p))) < 0.7
        assert busiest(chunks.section_chunks(p, max_pages=None)) < 0.5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def made_since(spark, before=frozenset()):
    """Kinds of written tables that are there now and weren't before."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {p for p in pathlib.Path(folder).glob("upkeep-*/*")} - set(before)


def test_extraction_leaves_its_merged_tasks_only(spark):
    rows = spark.createDataFrame([("m", 1, "Every 500 hours: replace the main oil filter", [[["Interval", "Action", "Description"], ["500", "Check", "check the pump"], ["1000", "Clean", "clean the belt"]]])], "manual_id string, page_no int, text string, tables array<array<array<string>>>")
    before = made_since(spark)
    done = extract.extract_from_pages(rows)
    assert {p.name.rsplit("-", 1)[0] for p in made_since(spark, before)} == {"merged-tasks"}
    assert sorted((r.interval_hours, r.task_no) for r in done.collect()) == [(500, 10), (500, 20), (500, 30), (1000, 40), (1000, 50)]
