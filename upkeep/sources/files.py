"""Reading manuals and schedules, gates for uploads, exports, and partitioned results."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.functions import rules as R
from upkeep.functions import scalars as S

PAGES = "manual_id string, source_file string, page_no int, n_pages int, text string, tables array<array<array<string>>>"


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A page corpus with a fixed schema, from Parquet or JSON lines."""
    return spark.read.schema(PAGES).format(format).load(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``; on one machine a temporary one will do.

    What is written there goes when the application ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="upkeep-")
    context = spark.sparkContext
    folder = f"{folder.rstrip('/')}/upkeep-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back, so that what made it isn't computed again."""
    path, spark, schema = shared_path(df.sparkSession, name), df.sparkSession, df.schema
    df.write.parquet(path)
    del df
    if getattr(_passing, "made", None) is not None:
        _passing.made.append((name, path))
    # shuffle files of what has been written go once the driver collects its garbage, which may be late
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


_passing = threading.local()


@contextmanager
def passing_tables(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Tables of ``shared_table`` that are made inside go at the end, but for those named ``kept``, which go with the next context around, if any."""
    outer, _passing.made = getattr(_passing, "made", None), []
    try:
        yield
    finally:
        made, _passing.made = _passing.made, outer
        context = spark.sparkContext
        for name, path in made:
            if name not in kept:
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            elif outer is not None:
                outer.append((name, path))
        context._jvm.System.gc()


def remove_table(table: DataFrame) -> None:
    """Remove a table of ``shared_table`` before the application ends."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches carry about ``size`` bytes, so that long texts don't fill a Python worker; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Raw files below ``path`` as ``path, length, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def validate_uploads(files: DataFrame, most_mb: int = 100) -> DataFrame:
    """``path, accepted, reason``: the first test that a file fails."""
    head = F.decode(F.substring("content", 1, 16384), "ISO-8859-1")
    reason = (
        F.when(~F.endswith(F.lower("path"), F.lit(".pdf")), "not a PDF name")
        .when(F.col("length") > most_mb * 1024 * 1024, "too large")
        .when(F.coalesce(F.length("content"), F.lit(0)) < 5, "too short")
        .when(~F.startswith(head, F.lit("%PDF")), "not a PDF")
        .when(S.any_match(head, R.EXPLOIT_MARKS), "active content")
    )
    return files.select("path", reason.isNull().alias("accepted"), reason.alias("reason"))


def calendar_schedule_tasks(rows: DataFrame) -> DataFrame:
    """Rows of a calendar workbook ``(sheet_ord, sheet, row_no, cells)`` as tasks, numbered 10, 20, ... over all sheets.

    Sheets whose label names no interval are left out. Data start after the first "seq"
    in the first cell of rows 1 to 4, else in row 2. Rows of several workbooks carry a column ``workbook`` and are numbered in each.
    """
    book = ["workbook"] if "workbook" in rows.columns else []
    hours = F.lit(None)
    for label, value in R.CALENDAR_HOURS.items():
        hours = F.when(F.upper(F.trim("sheet")) == label, value).otherwise(hours)
    rows = rows.withColumn("interval_hours", hours.cast("int")).where("interval_hours IS NOT NULL")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    heads = rows.where(F.col("row_no").between(1, 4) & (F.lower(cell(0)) == "seq")).groupBy(*book, "sheet_ord").agg((F.min("row_no") + 1).alias("start"))
    rows = rows.join(heads, [*book, "sheet_ord"], "left").where(F.col("row_no") >= F.coalesce("start", F.lit(2)))
    rows = rows.withColumns({"short": cell(1), "long": cell(2)}).where("short <> '' OR long <> ''")
    words = F.split("short", r"\s+")
    first = F.regexp_replace(F.upper(F.get(words, F.lit(0))), ":+$", "")
    has_verb = first.isin(*R.CALENDAR_VERBS) & (F.size(words) > 1)
    area = F.when(has_verb, F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(F.col("short"))
    order = W.partitionBy(*book).orderBy("sheet_ord", "row_no")  # a workbook has a few hundred rows
    return rows.select(
        *book,
        (F.row_number().over(order) * 10).alias("task_no"), area.alias("area"), F.when(has_verb, first).otherwise("CHECK").alias("action"),
        F.coalesce(F.nullif("long", F.lit("")), "short").alias("description"), "interval_hours", F.lit("STOPPED").alias("machine_state"),
        (F.upper("short") == "SAFETY").alias("safety_flag"), F.concat(F.lit("Calendar schedule, "), "sheet").alias("source_chapter"),
    )


def _yes(c: str) -> Column:
    return F.when(F.col(c), "YES").otherwise("NO")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _iso(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def history_export(records: DataFrame, machines: DataFrame, limit: int = 10_000) -> DataFrame:
    """Flat rows of the history, newest first."""
    rows = records.orderBy(F.desc("created_at"), F.desc("record_id")).limit(limit).join(machines.select("machine_id", "name"), "machine_id", "left")
    return rows.select(_text("record_id").alias("Record ID"), "machine_id", F.coalesce("name", "machine_id").alias("Machine"), F.concat(_text("interval_hours"), F.lit("hr")).alias("Interval"), _text("work_order").alias("Work Order"), _text("status").alias("Status"), _iso("completed_at").alias("Completed"), _iso("created_at").alias("Created")).orderBy(F.desc("Created"), F.desc(F.col("Record ID").cast("bigint")))


def library_export(register: DataFrame) -> DataFrame:
    """Flat rows of the register, in its order."""
    rows = register.select(_text("machine_id").alias("Machine ID"), _text("name").alias("Machine"), F.col("interval_hours").alias("Interval Hours"), _text("label").alias("Label"), F.col("task_no").alias("Task No"), _text("area").alias("Area"), _text("action").alias("Action"), _text("description").alias("Description"), _text("machine_state").alias("State"), _yes("safety_flag").alias("Safety"), _text("part_number").alias("Part Number"))
    return rows.orderBy("Machine", "Machine ID", "Interval Hours", "Task No")


def audit_export(logs: DataFrame, limit: int = 50_000) -> DataFrame:
    rows = logs.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(limit)
    return rows.select(_text("log_id").alias("Log ID"), _text("action").alias("Action"), _text("resource_type").alias("Resource Type"), _text("resource_id").alias("Resource ID"), _text("details").alias("Details"), _iso("logged_at").alias("Timestamp")).orderBy(F.desc("Timestamp"), F.desc(F.col("Log ID").cast("bigint")))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with headings; the order of ``rows`` is that of the files and their lines."""
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_checklists(rows: DataFrame, path: str) -> None:
    """Checklist rows in a folder per year, month and interval, each checklist in one file, by machine and row.

    Machines are a column and no folders, so that there are at most as many files in a folder as tasks that write, however many machines there are;
    rows of a machine lie together, and Parquet's statistics tell where.
    """
    folders = ["year", "month", "interval_hours"]
    rows.repartition("machine_id", *folders).sortWithinPartitions(*folders, "machine_id", "row_no").write.mode("overwrite").partitionBy(*folders).parquet(path)


def replace_chunk_index(chunks: DataFrame, path: str) -> None:
    """Replace the chunks of every manual in ``chunks`` below ``path``; of equal chunk ids the last (by ``ord``) stays, other manuals are untouched."""
    last = chunks.withColumn("rn", F.row_number().over(W.partitionBy("manual_id", "chunk_id").orderBy(F.desc("ord")))).where("rn = 1").drop("rn")
    last.repartition("manual_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("manual_id").parquet(path)


def generation_log(checklists: DataFrame, run_time: Column, prefix: str = "AUTO") -> tuple[DataFrame, DataFrame]:
    """A finished record and an audit row for each checklist (machine, interval) produced."""
    per = checklists.groupBy("machine_id", "interval_hours").agg(F.count("*").alias("task_count"))
    stamp = F.date_format(run_time, "yyyyMMddHHmmss")
    records = per.select("machine_id", "interval_hours", F.concat(F.lit(f"{prefix}-"), stamp).alias("work_order"), F.lit("COMPLETED").alias("status"), run_time.alias("started_at"), run_time.alias("completed_at"),
                         F.concat(F.lit("PM_"), F.translate("machine_id", " -./", "__"), F.lit("_"), S.interval_file_label(F.col("interval_hours")), F.lit(".xlsx")).alias("file_name"), "task_count")
    audit = records.select(F.lit("GENERATE").alias("action"), F.lit("pm_record").alias("resource_type"), F.col("machine_id").alias("resource_id"), F.to_json(F.struct("interval_hours", "work_order", "task_count")).alias("details"), run_time.alias("logged_at"))
    return records, audit
