"""Streams against batch: any order of arrival, restarts, batches that run again, and buckets that become empty."""

import itertools
import pathlib

from pyspark.sql import functions as F

from upkeep.operators.extract import extract_from_pages
from upkeep.operators.history import due_schedule
from upkeep.sources import files
from upkeep.streaming import streams, tables

PAGES = [
    ("m", "f", 1, 3, "Preventive maintenance schedule\nEvery 500 hours: replace the main oil filter\n", None),
    ("m", "f", 2, 3, "- clean the conveyor chain and its guard\n", None),
    ("m", "f", 3, 3, "Every 1000 hours: check the belt tension of the drive\n", None),
    ("n", "g", 1, 2, "Every 250 hours: lubricate the drive bearing\n", None),
]


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_manuals_in_any_order_and_after_a_restart(spark, tmp_path):
    cols = ("manual_id", "task_no", "interval_hours", "description", "page_no")
    want = sorted_rows(extract_from_pages(spark.createDataFrame(PAGES, files.PAGES)), *cols)
    assert len(want) == 4
    for k, order in enumerate(list(itertools.permutations(PAGES))[::13]):
        at = f"{tmp_path}/{k}"
        for page in order[:2]:
            spark.createDataFrame([page], files.PAGES).coalesce(1).write.mode("append").parquet(f"{at}/in")
        run = lambda at=at: streams.stream_manuals(spark, f"{at}/in", f"{at}/out", f"{at}/cp", 1, buckets=2).awaitTermination()
        run()
        assert {r.manual_id: r.complete for r in streams.manual_progress(spark, f"{at}/out").collect()}.get("m", False) is False
        for page in order[2:]:
            spark.createDataFrame([page], files.PAGES).coalesce(1).write.mode("append").parquet(f"{at}/in")
        run()
        run()
        assert sorted_rows(tables.current(spark, f"{at}/out"), *cols) == want
        assert {(r.manual_id, r.arrived, r.complete) for r in streams.manual_progress(spark, f"{at}/out").collect()} == {("m", 3, True), ("n", 1, False)}


def test_a_page_that_comes_again_replaces_the_earlier_one(spark, tmp_path):
    for page in (PAGES[0], ("m", "f", 1, 3, "nothing here any more", None)):
        spark.createDataFrame([page], files.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_manuals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", buckets=2).awaitTermination()
    assert tables.current(spark, f"{tmp_path}/out").count() == 0


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    path, rank = f"{tmp_path}/t", F.struct("at", "v")
    batches = [[("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 4, "older")], [("c", 1, None), ("a", 2, "late")]]
    put = lambda k: tables.upsert(spark.createDataFrame(batches[k], "k string, at int, v string"), path, ["k"], rank, k, buckets=2)
    assert tables.current(spark, path) is None
    for k in (0, 1, 1, 2, 2):
        put(k)
    want = [("a", 3, "z"), ("b", 5, "y"), ("c", 1, None)]
    assert sorted_rows(tables.current(spark, path), "k", "at", "v") == want
    tables.upsert(spark.createDataFrame([], "k string, at int, v string"), path, ["k"], rank, 3, buckets=2)
    assert sorted_rows(tables.current(spark, path), "k", "at", "v") == want
    gone = spark.createDataFrame([("b",), ("c",), ("a",)], "k string")
    tables.upsert(spark.createDataFrame([], "k string, at int, v string"), path, ["k"], rank, 4, replace=gone, buckets=2)
    assert tables.current(spark, path).count() == 0


def test_schedule_equals_the_batch_after_every_batch(spark, tmp_path):
    machines = spark.createDataFrame([("a", "A", True), ("b", "B", True), ("c", "C", False)], "machine_id string, name string, is_active boolean")
    intervals = spark.createDataFrame([(m, h, f"{h}hr") for m in "abc" for h in (8, 500)], "machine_id string, hours int, label string")
    kind = "machine_id string, reading struct<entry_id:bigint,current_hours:bigint,recorded_at:timestamp>, record struct<record_id:bigint,interval_hours:int,status:string,completed_at:date,revision:int>"
    import datetime as dt

    at = lambda d: dt.datetime(2026, 1, d)
    batches = [
        [("a", (1, 400, at(2)), None), ("b", None, (7, 8, "PENDING", None, 0))],
        [("a", (2, 300, at(1)), None), ("b", None, (7, 8, "COMPLETED", dt.date(2026, 1, 3), 1)), ("c", (3, 9, at(1)), None)],
        [("a", (4, 600, at(5)), None), ("b", None, (7, 8, "PENDING", None, 0)), ("zz", (5, 1, at(1)), None)],
        [("b", None, (7, 8, "CANCELLED", dt.date(2026, 1, 4), 2)), ("b", (6, 700, at(1)), None)],
    ]
    target, seen = f"{tmp_path}/due", []
    streams.start_due_schedule(machines, intervals, target, buckets=2)
    for batch in batches:
        seen += batch
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.stream_due_schedule(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), machines, intervals, target, f"{tmp_path}/cp", buckets=2).awaitTermination()
        every = spark.createDataFrame(seen, kind)
        last = every.where("record is not null").select("machine_id", "record.*").groupBy("machine_id", "record_id").agg(F.max_by(F.struct("interval_hours", "status", "completed_at"), "revision").alias("r")).select("machine_id", "record_id", "r.*")
        want = due_schedule(machines, intervals, every.where("reading is not null").select("machine_id", "reading.*"), last)
        assert sorted_rows(tables.current(spark, target), *want.columns) == sorted_rows(want, *want.columns)


def test_batches_leave_keyed_tables_only(spark, tmp_path):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("upkeep-*/*"))
    for page in PAGES[:2]:
        spark.createDataFrame([page], files.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    streams.stream_manuals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", 1, buckets=2).awaitTermination()
    assert tables.current(spark, f"{tmp_path}/out").count() == 2
    assert set(folder.glob("upkeep-*/*")) <= before
