"""Service history: latest readings, due schedule, risk, checklists in progress, paging and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DONE = ("COMPLETED", "APPROVED")


def latest_machine_hours(hours: DataFrame) -> DataFrame:
    """Newest reading of each machine; of readings at one time the largest entry_id wins."""
    newest = F.max_by(F.struct("entry_id", "current_hours", "recorded_at"), F.struct("recorded_at", "entry_id"))
    return hours.groupBy("machine_id").agg(newest.alias("r")).select("machine_id", "r.*")


def last_pm(records: DataFrame) -> DataFrame:
    """Newest finished record of each (machine, interval); one without a date is older than any."""
    picked = F.max_by(F.struct("record_id", "completed_at", "status"), F.struct(F.col("completed_at").isNotNull(), "completed_at", "record_id"))
    done = records.where(F.col("status").isin(*DONE))
    return done.groupBy("machine_id", "interval_hours").agg(picked.alias("r")).select("machine_id", "interval_hours", "r.*")


def due_schedule(machines: DataFrame, intervals: DataFrame, hours: DataFrame, records: DataFrame) -> DataFrame:
    """Every active machine and registered interval with its last service, status and next due hours.

    Without a reading: NEVER_DONE, or ON_TRACK when done before. With one and never done:
    OVERDUE from the interval on, DUE_SOON below it. Done before: ON_TRACK. Next due hours
    are the interval where the last service has a date, else what is left of it, and null
    without a reading. ``hours_overdue`` would need a last service and is always null.
    """
    reading = latest_machine_hours(hours).select("machine_id", "current_hours")
    last = last_pm(records).select("machine_id", F.col("interval_hours").alias("hours"), "record_id", "completed_at")
    rows = (
        machines.where("is_active").select("machine_id", "name").join(intervals.select("machine_id", "hours", "label"), "machine_id")
        .join(reading, "machine_id", "left").join(last, ["machine_id", "hours"], "left")
    )
    done, dated = F.col("record_id").isNotNull(), F.col("completed_at").isNotNull()
    now = F.col("current_hours")
    status = (
        F.when(done, "ON_TRACK").when(now.isNull(), "NEVER_DONE").when(now >= F.col("hours"), "OVERDUE").otherwise("DUE_SOON")
    )
    due = F.when(now.isNotNull(), F.when(dated, F.col("hours")).otherwise(F.greatest(F.lit(0), F.col("hours") - now)))
    return rows.select(
        "machine_id", "name", F.col("hours").alias("interval_hours"), "label", F.col("completed_at").alias("last_completed"),
        "current_hours", status.alias("status"), due.cast("bigint").alias("predicted_next_due"), F.lit(None).cast("bigint").alias("hours_overdue"),
    )


def overdue(schedule: DataFrame) -> DataFrame:
    return schedule.where("status = 'OVERDUE'")


def dashboard_stats(machines: DataFrame, tasks: DataFrame, schedule: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals; "this month" counts among the 1,000 newest records only."""
    done = F.col("status").isin(*DONE) & (F.trunc("completed_at", "month") == F.trunc(as_of, "month"))
    recent = records.orderBy(F.desc("created_at"), F.desc("record_id")).limit(1000)
    parts = [
        records.agg(F.count("*").alias("total_records")),
        recent.agg(F.count(F.when(done, 1)).alias("completed_this_month")),
        schedule.agg(F.count(F.when(F.col("status") == "OVERDUE", 1)).alias("overdue"), F.count(F.when(F.col("status") == "DUE_SOON", 1)).alias("due_soon")),
        machines.where("is_active").agg(F.count("*").alias("machines")),
        tasks.where("is_active").agg(F.count("*").alias("total_tasks")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def pm_risk(records: DataFrame, machines: DataFrame, hours: DataFrame, interval_list: list[int] = (8, 500), newest: int | None = 100) -> DataFrame:
    """Risk of each machine and interval of the list, from the newest records (``None``: all of them).

    Never done and beyond the interval: HIGH; beyond 0.8 of it: MEDIUM; else none.
    """
    used = records if newest is None else records.orderBy(F.desc("created_at"), F.desc("record_id")).limit(newest)
    done = used.where(F.col("status").isin(*DONE) & F.col("completed_at").isNotNull())
    per = done.groupBy("machine_id", "interval_hours").agg(F.max("completed_at").alias("last_completed"), F.count("*").alias("completions"))
    now = latest_machine_hours(hours).select("machine_id", "current_hours")
    rows = machines.where("is_active").select("machine_id", "name", F.explode(F.array(*map(F.lit, interval_list))).alias("interval_hours"))
    rows = rows.join(now, "machine_id", "left").join(per, ["machine_id", "interval_hours"], "left")
    current = F.coalesce("current_hours", F.lit(0).cast("bigint"))
    never = F.coalesce("completions", F.lit(0)) == 0
    risk = F.when(never & (current > F.col("interval_hours")), "HIGH").when(never & (current * 10 > F.col("interval_hours") * 8), "MEDIUM")
    reason = F.when(risk == "HIGH", F.concat(F.lit("Never done, "), current.cast("string"), F.lit("h run, due at "), F.col("interval_hours").cast("string"), F.lit("h"))).when(
        risk == "MEDIUM", F.concat(F.lit("Never done, nearing "), F.col("interval_hours").cast("string"), F.lit("h"))
    )
    return rows.select("machine_id", "name", "interval_hours", current.alias("current_hours"), "last_completed", F.coalesce("completions", F.lit(0).cast("bigint")).alias("completions"), risk.alias("risk"), reason.alias("reason"))


def pm_predictions(risk: DataFrame, first: int = 10) -> DataFrame:
    """When work that was done before is due again: hours + interval, in interval // 8 days; the first ten in order."""
    rows = risk.where("completions > 0").orderBy("machine_id", "interval_hours").limit(first)
    return rows.select("machine_id", "interval_hours", (F.col("current_hours") + F.col("interval_hours")).alias("due_at_hours"), F.floor(F.col("interval_hours") / 8).cast("int").alias("days"))


def pm_patterns_and_advice(risk: DataFrame, most: int = 5) -> DataFrame:
    """Observations on machines whose largest interval was done more than once, then recommendations; ``kind, ord, text``."""
    largest = risk.groupBy("machine_id").agg(F.max_by(F.struct("interval_hours", "completions", "name"), "interval_hours").alias("r"))
    seen = largest.where("r.completions > 1").orderBy("machine_id").limit(most)
    numbered = seen.withColumn("ord", F.row_number().over(W.orderBy("machine_id")))
    patterns = numbered.select(
        F.lit("pattern").alias("kind"), "ord",
        F.concat(F.col("r.name"), F.lit(": "), F.col("r.completions").cast("string"), F.lit(" completions of the "), F.col("r.interval_hours").cast("string"), F.lit("h service")).alias("text"),
    )
    total = risk.agg(F.count(F.when(F.col("risk") == "HIGH", 1)).alias("high"), F.coalesce(F.sum("completions"), F.lit(0)).alias("done"))
    tips = total.select(F.array_compact(F.array(
        F.when(F.col("high") > 0, F.concat(F.lit("Schedule "), F.col("high").cast("string"), F.lit(" overdue services"))),
        F.when(F.col("done") == 0, F.lit("Record services to build a history")),
        F.lit("Update hour readings weekly"),
    )).alias("t")).select(F.posexplode("t").alias("p", "text"))
    return patterns.unionByName(tips.select(F.lit("advice").alias("kind"), (F.col("p") + 1).alias("ord"), "text").where(F.col("ord") <= most))


def query_history(records: DataFrame, machine_id: str | None = None, technician_id: str | None = None, start: str | None = None, end: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of records, newest first, and the number of rows before paging as a one-row frame. Dates include both ends."""
    rows = records
    for name, value in (("machine_id", machine_id), ("technician_id", technician_id), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("created_at") <= F.lit(end).cast("date"))
    return rows.orderBy(F.desc("created_at"), F.desc("record_id")).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def query_audit(logs: DataFrame, resource_type: str | None = None, resource_id: int | None = None, limit: int = 100) -> DataFrame:
    rows = logs
    if resource_type is not None:
        rows = rows.where(F.col("resource_type") == resource_type)
    if resource_id is not None:
        rows = rows.where(F.col("resource_id") == resource_id)
    return rows.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(limit)


def list_uploads(uploads: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest uploads with their number of extracted tasks and what the status means for a user."""
    rows = uploads if status is None else uploads.where(F.col("status") == status)
    state = F.col("status")
    progress = F.when(state.isin("PENDING_REVIEW", "APPROVED"), 100).when(state == "PROCESSING", 50).otherwise(0)
    label = F.when(state == "PENDING_REVIEW", "Ready for review").when(state == "APPROVED", "Approved").when(state == "PROCESSING", "Processing").when(state == "FAILED", "Failed").otherwise("Uploaded")
    rows = rows.orderBy(F.desc("created_ord"), F.desc("manual_id")).limit(limit)
    n = F.coalesce(F.json_array_length(F.coalesce("extracted_tasks", F.lit("[]"))), F.lit(0))
    return rows.select("manual_id", "status", n.alias("task_count"), progress.alias("progress"), label.alias("label"), state.isin("PENDING_REVIEW", "APPROVED").alias("ready"))


def list_citations(citations: DataFrame, manual_id=None, content_type: str | None = None) -> DataFrame:
    """Citations in order of manual and page, of one manual or kind if asked for; a missing interval is 0."""
    rows = citations
    for name, value in (("manual_id", manual_id), ("content_type", content_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.withColumn("interval_hours", F.coalesce("interval_hours", F.lit(0))).orderBy("manual_id", "page_start", "citation_id")


def approve_records(records: DataFrame, ids: DataFrame, approver: str, notes: str | None, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Records after approval of the listed ids, and the listed ones that were turned down with a reason.

    All other records keep the approval they have; columns for it that ``records`` lacks are added as nulls.
    """
    listed = ids.select(F.col("record_id").alias("listed")).distinct()
    rows = records.join(listed, F.col("record_id") == F.col("listed"), "left")
    hit, may = F.col("listed").isNotNull(), F.col("status").isin("COMPLETED", "PENDING")
    new = {"status": F.lit("APPROVED"), "approved_by": F.lit(approver), "approved_at": as_of, "approval_notes": F.lit(notes).cast("string")}
    stored = lambda c: F.col(c) if c in records.columns else F.lit(None)
    out = rows.withColumns({c: F.when(hit & may, value).otherwise(stored(c)) for c, value in new.items()}).drop("listed")
    bad = listed.join(records.select("record_id", "status"), F.col("listed") == F.col("record_id"), "left").where(F.col("status").isNull() | ~may)
    reason = F.when(F.col("status").isNull(), "not found").otherwise(F.concat(F.lit("status is "), F.col("status")))
    return out, bad.select(F.col("listed").alias("record_id"), reason.alias("reason"))


def records_with_machine(records: DataFrame, machines: DataFrame, limit: int | None = None) -> DataFrame:
    """Records with the name of their machine (or its id) and the label of the interval, newest first."""
    rows = records if limit is None else records.orderBy(F.desc("created_at"), F.desc("record_id")).limit(limit)
    names = machines.select("machine_id", "name")
    return rows.join(names, "machine_id", "left").select("record_id", "machine_id", F.coalesce("name", "machine_id").alias("machine_name"), F.concat(F.col("interval_hours").cast("string"), F.lit("hr")).alias("label"), "status", "created_at")


def machines_with_records(machines: DataFrame, records: DataFrame) -> DataFrame:
    """Machines that have a record, with their number."""
    per = records.groupBy("machine_id").agg(F.count("*").alias("documents"))
    return machines.select("machine_id", "name").join(per, "machine_id")


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without the listed keys, and how many listed rows there were."""
    listed = ids.select(key).distinct()
    return df.join(listed, key, "left_anti"), df.join(listed, key, "left_semi").agg(F.count("*").alias("deleted"))


def latest_items(items: DataFrame) -> DataFrame:
    """Newest submission of each (record, task); of equal times the later ordinal, then the done one, wins."""
    value = F.struct("task_no", "is_done", "initialed_by", "submitted_at")
    return items.groupBy("record_id", "task_id").agg(F.max_by(value, F.struct("submitted_at", "is_done", "initialed_by")).alias("v")).select("record_id", "task_id", "v.*")


def checklist_status(records: DataFrame, tasks: DataFrame, completed: DataFrame) -> DataFrame:
    """Per record: tasks of its interval, how many are done, and the percentage to one decimal (half to even)."""
    active = tasks.where("is_active").groupBy("machine_id", "interval_hours").agg(F.count("*").alias("total"))
    ids = tasks.where("is_active").select("machine_id", "interval_hours", "task_id")
    done = latest_items(completed).where("is_done").select("record_id", "task_id")
    keys = records.select("record_id", "machine_id", "interval_hours")
    # only submitted items are joined to tasks; records without any keep their totals
    n = done.join(keys, "record_id").join(ids, ["machine_id", "interval_hours", "task_id"]).groupBy("record_id").agg(F.count("*").alias("done"))
    rows = keys.join(active, ["machine_id", "interval_hours"]).join(n, "record_id", "left")
    count = F.coalesce("done", F.lit(0).cast("bigint"))
    return rows.select("record_id", "total", count.alias("done"), F.bround(count * 100.0 / F.col("total"), 1).alias("percent"))


def checklist_progress(records: DataFrame, tasks: DataFrame, stored: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take submitted items in: stored items after the upsert, progress of the records, and rejected records.

    Progress counts the items of this submission only. Items of approved records are rejected.
    """
    open_ = records.where("status <> 'APPROVED'").select("record_id", "machine_id", "interval_hours")
    fresh = latest_items(submitted).join(open_.select("record_id"), "record_id", "left_semi")
    fresh = fresh.withColumn("completed_at", F.when(F.col("is_done"), F.col("submitted_at")))
    old = latest_items(stored).withColumn("completed_at", F.when(F.col("is_done"), F.col("submitted_at")))
    merged = old.join(fresh.select("record_id", "task_id"), ["record_id", "task_id"], "left_anti").unionByName(fresh)
    totals = tasks.where("is_active").groupBy("machine_id", "interval_hours").agg(F.count("*").alias("total"))
    per = fresh.groupBy("record_id").agg(F.count(F.when(F.col("is_done"), 1)).alias("done"))
    rows = per.join(open_, "record_id").join(totals, ["machine_id", "interval_hours"], "left")
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    status = F.when((total > 0) & (F.col("done") == total), "COMPLETED").otherwise("IN_PROGRESS")
    percent = F.when(total > 0, F.bround(F.col("done") * 100.0 / total, 1)).otherwise(F.lit(0.0))
    rejected = submitted.select("record_id").distinct().join(records.where("status = 'APPROVED'"), "record_id", "left_semi").withColumn("reason", F.lit("record is approved"))
    return merged, rows.select("record_id", total.alias("total"), "done", percent.alias("percent"), status.alias("status")), rejected


def latest_approval(approvals: DataFrame) -> DataFrame:
    """Newest decision of each (manual, interval)."""
    return approvals.groupBy("manual_id", "interval_hours").agg(F.max_by(F.struct("approval_id", "status", "comment", "created_at"), F.struct("created_at", "approval_id")).alias("a")).select("manual_id", "interval_hours", "a.*")


def approval_history(approvals: DataFrame, manual_id: int) -> DataFrame:
    """All decisions on a manual, newest first."""
    return approvals.where(F.col("manual_id") == manual_id).orderBy(F.desc("created_at"), F.desc("approval_id"))


def valid_rejections(decisions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rejections that count: with a comment that isn't blank, on an upload that can be reviewed."""
    bad = (F.col("status") == "REJECTED") & (F.length(F.trim(F.coalesce("comment", F.lit("")))) == 0)
    open_ = uploads.where(F.col("status").isin("PENDING_REVIEW", "APPROVED")).select("manual_id")
    return decisions.where(~bad).join(open_, "manual_id", "left_semi")
