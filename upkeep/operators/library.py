"""The task library: registers, summaries, checklists to print, seeding and approval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.functions import rules as R

STATES = ("RUNNING", "STOPPED", "POWERED_OFF")


def library_register(machines: DataFrame, intervals: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active machines with their registered intervals and active tasks, by machine name, hours and number."""
    rows = machines.where("is_active").select("machine_id", "name", "manufacturer").join(intervals.select("machine_id", F.col("hours").alias("interval_hours"), "label"), "machine_id")
    rows = tasks.where("is_active").join(rows, ["machine_id", "interval_hours"])
    return rows.select("name", "machine_id", "interval_hours", "label", "task_no", "area", "action", "description", "machine_state", "safety_flag", "part_number").orderBy("name", "machine_id", "interval_hours", "task_no")


def interval_tasks(machines: DataFrame, intervals: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active tasks with machine name and interval label; a label that isn't registered is ``<h>hr``."""
    labels = intervals.select("machine_id", F.col("hours").alias("interval_hours"), "label")
    rows = tasks.where("is_active").join(machines.select("machine_id", "name"), "machine_id").join(labels, ["machine_id", "interval_hours"], "left")
    label = F.coalesce("label", F.concat(F.col("interval_hours").cast("string"), F.lit("hr")))
    return rows.select("machine_id", F.col("name").alias("machine_name"), "interval_hours", label.alias("label"), "task_no", "action", "description")


def library_summary(tasks: DataFrame) -> DataFrame:
    """Active tasks per (machine, interval), and per machine with a null interval."""
    live = tasks.where("is_active")
    return live.groupingSets([["machine_id", "interval_hours"], ["machine_id"]], "machine_id", "interval_hours").agg(F.count("*").alias("task_count"))


def library_overview(machines: DataFrame, intervals: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per active machine its intervals with task counts and their total; unregistered intervals don't count."""
    per = tasks.where("is_active").groupBy("machine_id", F.col("interval_hours").alias("hours")).agg(F.count("*").alias("n"))
    rows = intervals.select("machine_id", "hours", "label").join(per, ["machine_id", "hours"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    grouped = rows.groupBy("machine_id").agg(F.sort_array(F.collect_list(F.struct("hours", "label", F.col("n").alias("task_count")))).alias("intervals"), F.sum("n").alias("total_tasks"))
    live = machines.where("is_active").select("machine_id", "name")
    return live.join(grouped, "machine_id", "left").select("machine_id", "name", F.coalesce("intervals", F.array().cast(grouped.schema["intervals"].dataType)).alias("intervals"), F.coalesce("total_tasks", F.lit(0).cast("bigint")).alias("total_tasks"))


def library_totals(machines: DataFrame, intervals: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: active machines, all active tasks, intervals of active machines."""
    live = machines.where("is_active").select("machine_id")
    return (
        live.agg(F.count("*").alias("machines"))
        .crossJoin(tasks.where("is_active").agg(F.count("*").alias("tasks")))
        .crossJoin(intervals.join(live, "machine_id", "left_semi").agg(F.count("*").alias("intervals")))
    )


def parts_list(tasks: DataFrame, known: DataFrame | None = None, by: list[str] = ("machine_id", "interval_hours")) -> DataFrame:
    """Distinct part numbers of each checklist in the order of their first task, with a description."""
    parts = tasks.where("is_active AND part_number IS NOT NULL AND part_number <> ''").groupBy(*by, "part_number").agg(F.min("task_no").alias("first_task_no"))
    if known is not None:
        parts = parts.join(known.select("part_number", "part_description"), "part_number", "left")
    text = F.coalesce("part_description", F.lit("Replacement Part")) if known is not None else F.lit("Replacement Part")
    return parts.select(*by, "part_number", text.alias("part_description"), F.row_number().over(W.partitionBy(*by).orderBy("first_task_no", "part_number")).alias("ord"))


def checklist_rows(tasks: DataFrame) -> DataFrame:
    """Rows of each checklist: running work first, then stopped, then powered off; part numbers in the text."""
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("machine_state"))
    order = W.partitionBy("machine_id", "interval_hours").orderBy(F.when(state > 0, state).otherwise(9), "task_no")
    text = F.concat(F.col("description"), F.coalesce(F.concat(F.lit(" [PART: "), F.nullif("part_number", F.lit("")), F.lit("]")), F.lit("")))
    rows = tasks.where("is_active")
    return rows.select("machine_id", "interval_hours", F.row_number().over(order).alias("row_no"), "task_no", "area", "action", text.alias("text"), "machine_state", "safety_flag")


def seed_library(library: DataFrame, machines: DataFrame, intervals: DataFrame, tasks: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """New rows of a nested library file (``machines``, ``intervals``, ``tasks`` arrays) and their counts by table.

    Defaults are filled in, the first of equal keys in the file wins, and keys that are
    stored already are left alone.
    """
    def fresh(column: str, keys: list[str], stored: DataFrame, defaults: dict) -> DataFrame:
        rows = library.select(F.posexplode(column).alias("ord", "r")).select("ord", "r.*")
        for name, value in defaults.items():
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
        first = rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("ord"))).where("rn = 1").drop("rn", "ord")
        return first.join(stored.select(*keys), keys, "left_anti")

    out = {
        "machines": fresh("machines", ["machine_id"], machines, {"type": "THIRD_PARTY", "is_hour_based": True}),
        "intervals": fresh("intervals", ["machine_id", "hours"], intervals, {}),
        "tasks": fresh("tasks", ["machine_id", "interval_hours", "task_no"], tasks, {"safety_flag": False}),
    }
    counts = None
    for name, rows in out.items():
        part = rows.agg(F.lit(name).alias("table"), F.count("*").alias("added"))
        counts = part if counts is None else counts.unionByName(part)
    return out, counts


def approve_into_library(extracted: DataFrame, uploads: DataFrame, library: DataFrame, machines: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks to insert from uploads in review, and per upload how many were added and skipped.

    A task needs an interval and a machine that exists; of equal (machine, interval, number)
    the first in (upload, ord) order counts, unless any task of the library has the key.
    """
    open_ = uploads.where("status = 'PENDING_REVIEW'").select("manual_id", F.col("machine_id").alias("upload_machine"))
    machine = F.lit(target) if target is not None else F.col("upload_machine")
    rows = extracted.join(open_, "manual_id").withColumn("machine_id", machine).drop("upload_machine")
    rows = rows.join(machines.select("machine_id"), "machine_id", "left_semi").where(F.coalesce("interval_hours", F.lit(0)) > 0)
    key = ["machine_id", "interval_hours", "task_no"]
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("manual_id", "ord")))
    stored = library.select(*key, F.lit(True).alias("stored")).distinct()
    rows = rows.join(stored, key, "left").withColumn("new", (F.col("rn") == 1) & F.col("stored").isNull())
    added = rows.where("new").select(
        *key, F.substring("area", 1, 64).alias("area"), F.substring("action", 1, 64).alias("action"),
        F.substring("description", 1, 2000).alias("description"), "machine_state", "safety_flag", F.substring("part_number", 1, 64).alias("part_number"), "manual_id",
    )
    return added, rows.groupBy("manual_id").agg(F.count(F.when(F.col("new"), 1)).alias("added"), F.count(F.when(~F.col("new"), 1)).alias("skipped"))


def library_fallback(uploads: DataFrame, machines: DataFrame, tasks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Library tasks for uploads that have none: of their machine, else of the first active machine (by name) whose name holds the manufacturer."""
    empty = uploads.join(extracted.select("manual_id").distinct(), "manual_id", "left_anti").select("manual_id", "machine_id", "detected_manufacturer")
    own = empty.join(machines.select("machine_id"), "machine_id", "left_semi").select("manual_id", "machine_id")
    rest = empty.join(own.select("manual_id"), "manual_id", "left_anti").where("detected_manufacturer IS NOT NULL")
    makers = rest.select(F.lower("detected_manufacturer").alias("maker")).distinct()  # a handful of names, joined instead of every upload
    named = machines.where("is_active").select("machine_id", "name")
    match = makers.join(named, F.contains(F.lower("name"), F.col("maker"))).groupBy("maker").agg(F.min_by("machine_id", F.struct("name", "machine_id")).alias("machine_id"))
    other = rest.join(match, F.lower("detected_manufacturer") == F.col("maker")).select("manual_id", match["machine_id"])
    rows = own.unionByName(other).join(tasks, "machine_id")
    fill = {"area": "GENERAL", "action": "CHECK", "machine_state": "STOPPED", "interval_hours": 500}
    return rows.select("manual_id", "machine_id", "task_no", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()], "description")


def interval_counts(tasks: DataFrame) -> DataFrame:
    """Per manual its intervals with the number of tasks and a short label."""
    return tasks.where("interval_hours <> 0").groupBy("manual_id", "interval_hours").agg(F.count("*").alias("task_count")).withColumn("label", F.concat(F.col("interval_hours").cast("string"), F.lit("h")))


def interval_sheet_rows(tasks: DataFrame, machines: DataFrame, notes: dict[str, list[str]] = R.NOTES) -> DataFrame:
    """Rows of a sheet for each machine and interval, numbered anew, with title, file name, area label and a rotating note.

    Missing values count as GENERAL, CHECK and interval 0.
    """
    from upkeep.functions import scalars as S

    rows = tasks.where("is_active").join(machines.select("machine_id", "name"), "machine_id")
    rows = rows.withColumns({"interval_hours": F.coalesce("interval_hours", F.lit(0)), "area": F.upper(F.trim(F.coalesce("area", F.lit("GENERAL")))), "action": F.upper(F.trim(F.coalesce("action", F.lit("")))), "text": F.upper(F.trim(F.coalesce("description", F.lit(""))))})
    seq = F.row_number().over(W.partitionBy("machine_id", "interval_hours").orderBy("task_no"))
    rows = rows.withColumn("seq", seq).withColumn("verb", F.element_at(F.split("action", r"\s+"), 1))
    whole = F.when((F.col("action") != "") & ~F.startswith("text", F.col("action")), F.trim(F.concat("action", F.lit(" "), "text"))).otherwise(F.col("text"))
    note = F.lit(None).cast("string")
    for verb, lines in notes.items():
        note = F.when(F.col("verb") == verb, F.element_at(F.array(*map(F.lit, lines)), (F.pmod(F.col("seq") - 1, F.lit(len(lines))) + 1).cast("int"))).otherwise(note)
    hours = F.col("interval_hours")
    return rows.select(
        "machine_id", "interval_hours", (F.col("seq") * 10).alias("task_no"), S.sheet_title(F.col("machine_id"), F.col("name"), hours).alias("title"),
        S.sheet_file_name(F.col("machine_id"), F.col("name"), hours).alias("file_name"), S.interval_label(hours).alias("label"),
        S.function_area_label(F.col("verb"), F.col("area"), F.col("text")).alias("area_label"),
        F.concat(whole, F.coalesce(F.concat(F.lit("\n"), note), F.lit(""))).alias("action_text"),
    )
