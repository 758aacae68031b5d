"""Every operator as a query over the given tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.functions import rules as R
from upkeep.functions import scalars as S
from upkeep.operators import chunks, extract, history, library, pages, retrieve, tasks, validate
from upkeep.plans import sql as Q
from upkeep.sources import files
from upkeep.sources.adapters import domain_table, with_domain
from upkeep.streaming import streams, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The day that reports are made for.
AS_OF = "1996-06-15"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_domain(sql)
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [domain_table(spark, d, n) for n in names]


# history

HOURS_SQL = "(SELECT machine_id, arg_max(current_hours, struct_pack(a := recorded_at, b := entry_id)) AS current_hours FROM {machine_hours} GROUP BY machine_id)"
LAST_SQL = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, interval_hours ORDER BY completed_at DESC NULLS LAST, record_id DESC) AS rn
    FROM {pm_records} WHERE status IN ('COMPLETED', 'APPROVED')) WHERE rn = 1)"""
DUE_SQL = f"""(SELECT m.machine_id, m.name, i.hours AS interval_hours, i.label, l.completed_at AS last_completed, h.current_hours,
    CASE WHEN l.record_id IS NOT NULL THEN 'ON_TRACK' WHEN h.current_hours IS NULL THEN 'NEVER_DONE' WHEN h.current_hours >= i.hours THEN 'OVERDUE' ELSE 'DUE_SOON' END AS status,
    CASE WHEN h.current_hours IS NOT NULL THEN CASE WHEN l.completed_at IS NOT NULL THEN i.hours ELSE greatest(0, i.hours - h.current_hours) END END AS predicted_next_due,
    CAST(NULL AS BIGINT) AS hours_overdue
    FROM {{machines}} m JOIN {{pm_intervals}} i ON m.machine_id = i.machine_id LEFT JOIN {HOURS_SQL} h ON h.machine_id = m.machine_id
    LEFT JOIN {LAST_SQL} l ON l.machine_id = m.machine_id AND l.interval_hours = i.hours WHERE m.is_active)"""


@query("""SELECT machine_id, entry_id, current_hours, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY recorded_at DESC, entry_id DESC) AS rn FROM {machine_hours}) WHERE rn = 1""")
def w1_latest_machine_hours(spark, d):
    return history.latest_machine_hours(*_t(spark, d, "machine_hours"))


@query(f"SELECT machine_id, interval_hours, record_id, completed_at, status FROM {LAST_SQL}")
def w2_last_pm(spark, d):
    return history.last_pm(*_t(spark, d, "pm_records"))


@query(f"SELECT * FROM {DUE_SQL}")
def w6_due_schedule(spark, d):
    return history.due_schedule(*_t(spark, d, "machines", "pm_intervals", "machine_hours", "pm_records"))


@query(f"SELECT machine_id, interval_hours, current_hours FROM {DUE_SQL} WHERE status = 'OVERDUE'")
def w6_overdue(spark, d):
    return history.overdue(w6_due_schedule(spark, d)).select("machine_id", "interval_hours", "current_hours")


@query("""SELECT manual_id, interval_hours, approval_id, status, comment, created_at FROM (SELECT *, row_number() OVER (PARTITION BY manual_id, interval_hours ORDER BY created_at DESC, approval_id DESC) AS rn FROM {approvals}) WHERE rn = 1""")
def w3_latest_approval(spark, d):
    return history.latest_approval(*_t(spark, d, "approvals"))


@query("""SELECT a.* FROM {approvals} a WHERE NOT (a.status = 'REJECTED' AND (a.comment IS NULL OR trim(a.comment) = ''))
    AND EXISTS (SELECT 1 FROM {manual_uploads} u WHERE u.manual_id = a.manual_id AND u.status IN ('PENDING_REVIEW', 'APPROVED'))""")
def w3_valid_rejections(spark, d):
    return history.valid_rejections(*_t(spark, d, "approvals", "manual_uploads"))


@query(f"""SELECT (SELECT count(*) FROM {{pm_records}}) AS total_records,
    (SELECT count(*) FROM (SELECT * FROM {{pm_records}} ORDER BY created_at DESC, record_id DESC LIMIT 1000) WHERE status IN ('COMPLETED', 'APPROVED') AND date_trunc('month', completed_at) = DATE '1996-06-01') AS completed_this_month,
    (SELECT count(*) FROM {DUE_SQL} WHERE status = 'OVERDUE') AS overdue, (SELECT count(*) FROM {DUE_SQL} WHERE status = 'DUE_SOON') AS due_soon,
    (SELECT count(*) FROM {{machines}} WHERE is_active) AS machines, (SELECT count(*) FROM {{tasks}} WHERE is_active) AS total_tasks""")
def a3_dashboard_stats(spark, d):
    m, t, r = _t(spark, d, "machines", "tasks", "pm_records")
    return history.dashboard_stats(m, t, w6_due_schedule(spark, d), r, F.lit(AS_OF).cast("date"))


RISK_SQL = f"""(SELECT m.machine_id, m.name, i.h AS interval_hours, coalesce(c.current_hours, 0) AS current_hours, r.last_completed, coalesce(r.n, 0) AS completions,
    CASE WHEN r.n IS NULL AND coalesce(c.current_hours, 0) > i.h THEN 'HIGH' WHEN r.n IS NULL AND coalesce(c.current_hours, 0) * 10 > i.h * 8 THEN 'MEDIUM' END AS risk
    FROM {{machines}} m CROSS JOIN (VALUES (8), (500)) AS i(h) LEFT JOIN {HOURS_SQL} c ON c.machine_id = m.machine_id
    LEFT JOIN (SELECT machine_id, interval_hours, max(completed_at) AS last_completed, count(*) AS n FROM {{pm_records}} WHERE status IN ('COMPLETED', 'APPROVED') AND completed_at IS NOT NULL GROUP BY ALL) r
      ON r.machine_id = m.machine_id AND r.interval_hours = i.h WHERE m.is_active)"""


def _risk(spark, d):
    r, m, h = _t(spark, d, "pm_records", "machines", "machine_hours")
    return history.pm_risk(r, m, h, newest=None)


@query(f"SELECT machine_id, name, interval_hours, current_hours, last_completed, completions, risk, CASE risk WHEN 'HIGH' THEN concat('Never done, ', CAST(current_hours AS VARCHAR), 'h run, due at ', CAST(interval_hours AS VARCHAR), 'h') WHEN 'MEDIUM' THEN concat('Never done, nearing ', CAST(interval_hours AS VARCHAR), 'h') END AS reason FROM {RISK_SQL}")
def a4_pm_risk(spark, d):
    return _risk(spark, d)


@query(f"SELECT machine_id, interval_hours, current_hours + interval_hours AS due_at_hours, CAST(interval_hours // 8 AS INT) AS days FROM {RISK_SQL} WHERE completions > 0 ORDER BY machine_id, interval_hours LIMIT 10")
def a5_pm_predictions(spark, d):
    return history.pm_predictions(_risk(spark, d))


@query(f"""SELECT * FROM (WITH risk AS (SELECT * FROM {RISK_SQL}), totals AS (SELECT count(*) FILTER (WHERE risk = 'HIGH') AS high, coalesce(sum(completions), 0) AS done FROM risk)
    SELECT 'pattern' AS kind, CAST(row_number() OVER (ORDER BY machine_id) AS INT) AS ord, concat(name, ': ', CAST(completions AS VARCHAR), ' completions of the 500h service') AS text FROM (SELECT * FROM risk WHERE interval_hours = 500 AND completions > 1 ORDER BY machine_id LIMIT 5)
    UNION ALL SELECT 'advice', CAST(row_number() OVER (ORDER BY k) AS INT), text FROM (SELECT 1 AS k, concat('Schedule ', CAST(high AS VARCHAR), ' overdue services') AS text FROM totals WHERE high > 0
        UNION ALL SELECT 2, 'Record services to build a history' FROM totals WHERE done = 0 UNION ALL SELECT 3, 'Update hour readings weekly'))""")
def a6_pm_patterns_and_advice(spark, d):
    return history.pm_patterns_and_advice(_risk(spark, d))


@query("""SELECT * FROM {pm_records} WHERE status = 'COMPLETED' AND created_at >= DATE '1995-01-01' AND created_at <= DATE '1996-12-31' ORDER BY created_at DESC, record_id DESC LIMIT 50 OFFSET 10""")
def f5_query_history(spark, d):
    return history.query_history(*_t(spark, d, "pm_records"), status="COMPLETED", start="1995-01-01", end="1996-12-31", limit=50, offset=10)[0]


@query("""SELECT count(*) AS total FROM {pm_records} WHERE status = 'COMPLETED'""")
def f5_history_total(spark, d):
    return history.query_history(*_t(spark, d, "pm_records"), status="COMPLETED")[1]


@query("""SELECT * FROM {audit_logs} WHERE resource_type = 'TASK' ORDER BY logged_at DESC, log_id DESC LIMIT 100""")
def f7_query_audit(spark, d):
    return history.query_audit(*_t(spark, d, "audit_logs"), resource_type="TASK")


@query("""SELECT manual_id, status, CAST(manual_id % 3 AS INT) AS task_count, CASE WHEN status IN ('PENDING_REVIEW', 'APPROVED') THEN 100 WHEN status = 'PROCESSING' THEN 50 ELSE 0 END AS progress,
    CASE status WHEN 'PENDING_REVIEW' THEN 'Ready for review' WHEN 'APPROVED' THEN 'Approved' WHEN 'PROCESSING' THEN 'Processing' WHEN 'FAILED' THEN 'Failed' ELSE 'Uploaded' END AS label,
    status IN ('PENDING_REVIEW', 'APPROVED') AS ready FROM {manual_uploads} ORDER BY created_ord DESC, manual_id DESC LIMIT 50""")
def f6_list_uploads(spark, d):
    (u,) = _t(spark, d, "manual_uploads")
    return history.list_uploads(u.withColumn("extracted_tasks", F.when(F.col("manual_id") % 3 > 0, F.to_json(F.array_repeat(F.struct(F.col("manual_id").alias("task")), (F.col("manual_id") % 3).cast("int"))))))


@query("""SELECT r.record_id, r.machine_id, coalesce(m.name, r.machine_id) AS machine_name, concat(CAST(r.interval_hours AS VARCHAR), 'hr') AS label, r.status, r.created_at
    FROM {pm_records} r LEFT JOIN {machines} m ON r.machine_id = m.machine_id""")
def j8_records_with_machine(spark, d):
    return history.records_with_machine(*_t(spark, d, "pm_records", "machines"))


@query("""SELECT m.machine_id, m.name, count(*) AS documents FROM {machines} m JOIN {pm_records} r ON r.machine_id = m.machine_id GROUP BY ALL""")
def j10_machines_with_records(spark, d):
    return history.machines_with_records(*_t(spark, d, "machines", "pm_records"))


@query("""SELECT * FROM {pm_records} WHERE record_id NOT IN (SELECT event_id FROM events WHERE event_id IS NOT NULL)""")
def j11_delete_by_ids(spark, d):
    (r,) = _t(spark, d, "pm_records")
    ids = domain_table(spark, d, "events").select(F.col("event_id").alias("record_id"))
    return history.delete_by_ids(r, ids, "record_id")[0]


@query("""SELECT count(*) AS deleted FROM {pm_records} WHERE record_id IN (SELECT event_id FROM events)""")
def j11_deleted(spark, d):
    (r,) = _t(spark, d, "pm_records")
    ids = domain_table(spark, d, "events").select(F.col("event_id").alias("record_id"))
    return history.delete_by_ids(r, ids, "record_id")[1]


# records of inactive machines are approved; those approved before keep their approver, date and note
APPROVAL_SQL = """(SELECT *, CASE WHEN status = 'APPROVED' THEN concat('u', CAST(record_id % 9 AS VARCHAR)) END AS approved_by, CASE WHEN status = 'APPROVED' THEN created_at END AS approved_at,
    CASE WHEN status = 'APPROVED' AND record_id % 2 = 0 THEN concat('note ', CAST(record_id AS VARCHAR)) END AS approval_notes,
    status IN ('COMPLETED', 'PENDING') AND machine_id IN (SELECT machine_id FROM {machines} WHERE NOT is_active) AS hit FROM {pm_records})"""


def _approval(spark, d):
    r, m = _t(spark, d, "pm_records", "machines")
    ids = r.join(m.where("NOT is_active").select("machine_id"), "machine_id", "left_semi").select("record_id")
    before = F.col("status") == "APPROVED"
    n = F.col("record_id")
    stored = r.withColumns({
        "approved_by": F.when(before, F.concat(F.lit("u"), (n % 9).cast("string"))), "approved_at": F.when(before, F.col("created_at")),
        "approval_notes": F.when(before & (n % 2 == 0), F.concat(F.lit("note "), n.cast("string"))),
    })
    return history.approve_records(stored, ids.unionByName(spark.range(3).select((-F.col("id") - 1).alias("record_id"))), "lead", None, F.lit(AS_OF).cast("date"))


@query(f"""SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'APPROVED' ELSE status END AS status, CASE WHEN hit THEN 'lead' ELSE approved_by END AS approved_by,
    CASE WHEN hit THEN DATE '{AS_OF}' ELSE approved_at END AS approved_at, CASE WHEN NOT hit THEN approval_notes END AS approval_notes) FROM {APPROVAL_SQL}""")
def f10_approve_records(spark, d):
    return _approval(spark, d)[0]


@query("""SELECT record_id, concat('status is ', status) AS reason FROM {pm_records} WHERE status = 'APPROVED' AND machine_id IN (SELECT machine_id FROM {machines} WHERE NOT is_active)
    UNION ALL SELECT -x, 'not found' FROM (VALUES (1), (2), (3)) AS v(x)""")
def f10_turned_down(spark, d):
    return _approval(spark, d)[1]


@query("""SELECT r.record_id, t.total, coalesce(c.done, 0) AS done, round_even(coalesce(c.done, 0) * 100.0 / t.total, 1) AS percent
    FROM {pm_records} r JOIN (SELECT machine_id, interval_hours, count(*) AS total FROM {tasks} WHERE is_active GROUP BY ALL) t ON r.machine_id = t.machine_id AND r.interval_hours = t.interval_hours
    LEFT JOIN (SELECT s.record_id, count(*) AS done FROM {submissions} s WHERE s.is_done GROUP BY ALL) c ON c.record_id = r.record_id""")
def j7_checklist_status(spark, d):
    return history.checklist_status(*_t(spark, d, "pm_records", "tasks", "submissions")).withColumn("percent", F.col("percent").cast("double"))


@query("""SELECT r.record_id, t.total, c.done, round_even(c.done * 100.0 / t.total, 1) AS percent, CASE WHEN c.done = t.total THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status
    FROM (SELECT record_id, count(*) FILTER (WHERE is_done) AS done FROM {submissions} GROUP BY ALL) c JOIN {pm_records} r ON r.record_id = c.record_id
    JOIN (SELECT machine_id, interval_hours, count(*) AS total FROM {tasks} WHERE is_active GROUP BY ALL) t ON r.machine_id = t.machine_id AND r.interval_hours = t.interval_hours
    WHERE r.status <> 'APPROVED'""")
def a12_checklist_progress(spark, d):
    r, t, s = _t(spark, d, "pm_records", "tasks", "submissions")
    return history.checklist_progress(r, t, s.where("task_no % 8 = 2"), s)[1].withColumn("percent", F.col("percent").cast("double"))


# library

@query("""SELECT m.name, m.machine_id, i.hours AS interval_hours, i.label, t.task_no, t.area, t.action, t.description, t.machine_state, t.safety_flag, t.part_number
    FROM {machines} m JOIN {pm_intervals} i ON m.machine_id = i.machine_id JOIN {tasks} t ON t.machine_id = m.machine_id AND t.interval_hours = i.hours WHERE m.is_active AND t.is_active""")
def j5_library_register(spark, d):
    return library.library_register(*_t(spark, d, "machines", "pm_intervals", "tasks"))


@query("""SELECT t.machine_id, m.name AS machine_name, t.interval_hours, coalesce(i.label, concat(CAST(t.interval_hours AS VARCHAR), 'hr')) AS label, t.task_no, t.action, t.description
    FROM {tasks} t JOIN {machines} m ON m.machine_id = t.machine_id LEFT JOIN {pm_intervals} i ON i.machine_id = t.machine_id AND i.hours = t.interval_hours WHERE t.is_active""")
def j6_interval_tasks(spark, d):
    return library.interval_tasks(*_t(spark, d, "machines", "pm_intervals", "tasks"))


@query("""SELECT machine_id, interval_hours, count(*) AS task_count FROM {tasks} WHERE is_active GROUP BY GROUPING SETS ((machine_id, interval_hours), (machine_id))""")
def a1_library_summary(spark, d):
    return library.library_summary(*_t(spark, d, "tasks"))


@query("""SELECT m.machine_id, m.name, CAST(count(i.hours) AS INT) AS n_intervals, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS total_tasks FROM {machines} m LEFT JOIN {pm_intervals} i ON i.machine_id = m.machine_id
    LEFT JOIN (SELECT machine_id, interval_hours, count(*) AS n FROM {tasks} WHERE is_active GROUP BY ALL) p ON p.machine_id = i.machine_id AND p.interval_hours = i.hours WHERE m.is_active GROUP BY ALL""")
def a2_library_overview(spark, d):
    return library.library_overview(*_t(spark, d, "machines", "pm_intervals", "tasks")).select("machine_id", "name", F.size("intervals").alias("n_intervals"), "total_tasks")


@query("""SELECT (SELECT count(*) FROM {machines} WHERE is_active) AS machines, (SELECT count(*) FROM {tasks} WHERE is_active) AS tasks,
    (SELECT count(*) FROM {pm_intervals} WHERE machine_id IN (SELECT machine_id FROM {machines} WHERE is_active)) AS intervals""")
def a2_library_totals(spark, d):
    return library.library_totals(*_t(spark, d, "machines", "pm_intervals", "tasks"))


@query("""SELECT machine_id, interval_hours, part_number, 'Replacement Part' AS part_description, CAST(row_number() OVER (PARTITION BY machine_id, interval_hours ORDER BY f, part_number) AS INT) AS ord
    FROM (SELECT machine_id, interval_hours, part_number, min(task_no) AS f FROM {tasks} WHERE is_active AND part_number IS NOT NULL GROUP BY ALL)""")
def a11_parts_list(spark, d):
    return library.parts_list(*_t(spark, d, "tasks"))


@query("""SELECT machine_id, interval_hours, CAST(row_number() OVER (PARTITION BY machine_id, interval_hours ORDER BY CASE machine_state WHEN 'RUNNING' THEN 1 WHEN 'STOPPED' THEN 2 ELSE 3 END, task_no) AS INT) AS row_no,
    task_no, area, action, concat(description, CASE WHEN part_number IS NULL THEN '' ELSE concat(' [PART: ', part_number, ']') END) AS text, machine_state, safety_flag FROM {tasks} WHERE is_active""")
def w7_checklist_rows(spark, d):
    return library.checklist_rows(*_t(spark, d, "tasks"))


@query(Q.SHEET)
def w8_interval_sheet_rows(spark, d):
    t, m = _t(spark, d, "tasks", "machines")
    hyphens = F.when(F.col("task_no") % 20 == 0, F.translate("description", " ", "-")).otherwise(F.col("description"))
    return library.interval_sheet_rows(t.withColumn("description", hyphens), m)


APPROVE_SQL = """(SELECT e.*, u.machine_id, row_number() OVER (PARTITION BY u.machine_id, e.interval_hours, e.task_no + 5 ORDER BY e.manual_id, e.ord) AS rn
    FROM {extracted} e JOIN {manual_uploads} u ON u.manual_id = e.manual_id WHERE u.status = 'PENDING_REVIEW' AND u.machine_id IN (SELECT machine_id FROM {machines}))"""


def _approve(spark, d):
    e, u, t, m = _t(spark, d, "extracted", "manual_uploads", "tasks", "machines")
    return library.approve_into_library(e.withColumn("task_no", F.col("task_no") + 5), u, t, m)


@query(f"SELECT machine_id, interval_hours, task_no + 5 AS task_no, description, manual_id FROM {APPROVE_SQL} WHERE rn = 1")
def j4_approve_into_library(spark, d):
    return _approve(spark, d)[0].select("machine_id", "interval_hours", "task_no", "description", "manual_id")


@query(f"SELECT manual_id, count(*) FILTER (WHERE rn = 1) AS added, count(*) FILTER (WHERE rn > 1) AS skipped FROM {APPROVE_SQL} GROUP BY manual_id")
def j4_approval_counts(spark, d):
    return _approve(spark, d)[1]


@query(Q.FALLBACK)
def j9_library_fallback(spark, d):
    u, m, t, e = _t(spark, d, "manual_uploads", "machines", "tasks", "extracted")
    return library.library_fallback(u.where("status = 'FAILED'"), m, t, e)


@query("""SELECT manual_id, interval_hours, count(*) AS task_count, concat(CAST(interval_hours AS VARCHAR), 'h') AS label FROM {extracted} GROUP BY ALL""")
def a7_interval_counts(spark, d):
    return library.interval_counts(*_t(spark, d, "extracted"))


@query("""SELECT 'tasks' AS "table", count(*) AS added FROM (SELECT DISTINCT machine_id, interval_hours, task_no + 3 FROM {tasks})
    UNION ALL SELECT 'machines', count(*) FROM {machines} UNION ALL SELECT 'intervals', count(*) FROM {pm_intervals}""")
def io4_seed_library(spark, d):
    m, i, t = _t(spark, d, "machines", "pm_intervals", "tasks")
    part = lambda df, name: df.groupBy(F.pmod(F.xxhash64("machine_id"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    file = part(m, "machines").join(part(i, "intervals"), "part", "full").join(part(t.withColumn("task_no", F.col("task_no") + 3), "tasks"), "part", "full")
    return library.seed_library(file, m.where("false"), i.where("false"), t)[1]


@query("""SELECT machine_id, task_no, machine_state IN ('RUNNING', 'STOPPED', 'POWERED_OFF') AND task_no >= 10 AND length(area) BETWEEN 1 AND 64 AS ok FROM {tasks}""")
def f9_validate_task_rows(spark, d):
    good, bad = validate.validate_task_rows(*_t(spark, d, "tasks"))
    return good.select("machine_id", "task_no", F.lit(True).alias("ok")).unionByName(bad.select("machine_id", "task_no", F.lit(False).alias("ok")))


@query("""SELECT machine_id, manufacturer FROM {machines} WHERE regexp_matches(machine_id, '^[A-Z0-9][A-Z0-9\\-]{0,63}$')""".replace("{0,63}", "*"))
def f9_validate_machine_rows(spark, d):
    return validate.validate_machine_rows(*_t(spark, d, "machines"))[0].select("machine_id", "manufacturer")


@query("""SELECT machine_id, entry_id FROM {machine_hours} WHERE current_hours >= 0""")
def f9_validate_hours_rows(spark, d):
    return validate.validate_hours_rows(*_t(spark, d, "machine_hours"))[0].select("machine_id", "entry_id")


# sinks

@query("""SELECT CAST(log_id AS VARCHAR) AS "Log ID", action AS "Action", resource_type AS "Resource Type", CAST(resource_id AS VARCHAR) AS "Resource ID", coalesce(details, '') AS "Details", strftime(logged_at, '%Y-%m-%dT%H:%M:%S') AS "Timestamp"
    FROM {audit_logs} ORDER BY logged_at DESC, log_id DESC LIMIT 50000""")
def io6_audit_export(spark, d):
    return files.audit_export(*_t(spark, d, "audit_logs"))


@query("""SELECT CAST(r.record_id AS VARCHAR) AS "Record ID", r.machine_id, coalesce(m.name, r.machine_id) AS "Machine", concat(CAST(interval_hours AS VARCHAR), 'hr') AS "Interval", work_order AS "Work Order", status AS "Status",
    coalesce(strftime(completed_at, '%Y-%m-%dT%H:%M:%S'), '') AS "Completed", strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS "Created"
    FROM (SELECT * FROM {pm_records} ORDER BY created_at DESC, record_id DESC LIMIT 10000) r LEFT JOIN {machines} m ON m.machine_id = r.machine_id""")
def io6_history_export(spark, d):
    return files.history_export(*_t(spark, d, "pm_records", "machines"))


@query("""SELECT m.machine_id AS "Machine ID", m.name AS "Machine", i.hours AS "Interval Hours", i.label AS "Label", t.task_no AS "Task No", t.area AS "Area", t.action AS "Action", t.description AS "Description", t.machine_state AS "State",
    CASE WHEN t.safety_flag THEN 'YES' ELSE 'NO' END AS "Safety", coalesce(t.part_number, '') AS "Part Number"
    FROM {machines} m JOIN {pm_intervals} i ON m.machine_id = i.machine_id JOIN {tasks} t ON t.machine_id = m.machine_id AND t.interval_hours = i.hours WHERE m.is_active AND t.is_active""")
def io6_library_export(spark, d):
    return files.library_export(j5_library_register(spark, d))


@query(f"""SELECT machine_id, interval_hours, 'AUTO-19960615000000' AS work_order, concat('PM_', translate(machine_id, ' -./', '__'), '_', {Q.file_label('interval_hours')}, '.xlsx') AS file_name, 'COMPLETED' AS status, count(*) AS task_count FROM {{tasks}} WHERE is_active GROUP BY ALL""")
def io9_generation_log(spark, d):
    return files.generation_log(w7_checklist_rows(spark, d), F.lit(AS_OF).cast("timestamp"))[0].select("machine_id", "interval_hours", "work_order", "file_name", "status", "task_count")


@query("""SELECT 'GENERATE' AS action, 'pm_record' AS resource_type, machine_id AS resource_id, concat('{"interval_hours":', CAST(interval_hours AS VARCHAR), ',"work_order":"AUTO-19960615000000","task_count":', CAST(count(*) AS VARCHAR), '}') AS details FROM {tasks} WHERE is_active GROUP BY machine_id, interval_hours""")
def io9_generation_audit(spark, d):
    return files.generation_log(w7_checklist_rows(spark, d), F.lit(AS_OF).cast("timestamp"))[1].drop("logged_at")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents""")
def io3_content_hash(spark, d):
    return domain_table(spark, d, "documents").select("doc_id", S.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


# pages

def _pages(spark, d):
    return domain_table(spark, d, "pages")


@query("""SELECT manual_id, substr(concat(string_agg(text, chr(10) ORDER BY page_no), chr(10)), 1, 15000) AS sample FROM
    (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY manual_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {pages} WHERE page_no <= 50) WHERE before < 60000 GROUP BY manual_id""")
def io1_classification_sample(spark, d):
    return pages.classification_sample(_pages(spark, d))


CANDIDATE_SQL = """(SELECT manual_id, page_no, text FROM (SELECT *, max(hit) OVER (PARTITION BY manual_id ORDER BY page_no RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, max(hit) OVER (PARTITION BY manual_id) AS any_hit
    FROM (SELECT *, CAST(regexp_matches(text, '(?i)""" + R.CANDIDATE.replace("{3,5}", "[0-9][0-9][0-9]?[0-9]?").replace(r"\d[0-9][0-9][0-9]?[0-9]?", r"\d\d\d\d?\d?") + """') AS INT) AS hit FROM {pages})) WHERE near = 1 OR any_hit = 0 AND page_no <= 600)"""


@query(f"SELECT manual_id, page_no FROM {CANDIDATE_SQL}")
def f1_pm_candidate_pages(spark, d):
    return pages.pm_candidate_pages(_pages(spark, d)).select("manual_id", "page_no")


WORDS_SQL = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(f"SELECT manual_id, page_no, {Q.detect_interval('lower(text)')} AS page_interval FROM {{pages}} WHERE page_no <= 80 AND {WORDS_SQL(R.TABLE_SCAN_WORDS)}")
def f4_table_scan_pages(spark, d):
    return pages.table_scan_pages(_pages(spark, d)).select("manual_id", "page_no", "page_interval")


@query(f"""SELECT manual_id, concat('fallback_p', CAST(page_no AS VARCHAR)) AS chunk_id, substr(text, 1, 500) AS text_excerpt FROM (SELECT *, row_number() OVER (PARTITION BY manual_id ORDER BY page_no) AS rn
    FROM {{pages}} WHERE page_no <= 150 AND {WORDS_SQL(R.EVIDENCE_WORDS)} AND manual_id NOT IN ('m1', 'm2')) WHERE rn <= 25""")
def w9_fallback_citations(spark, d):
    p = _pages(spark, d)
    return pages.fallback_citations(p, p.where("manual_id IN ('m1', 'm2')").select("manual_id")).select("manual_id", "chunk_id", "text_excerpt")


@query(f"""SELECT manual_id, page_start, substr(text, 1, 3000) AS text FROM (SELECT manual_id, page_no AS page_start, text, row_number() OVER (PARTITION BY manual_id ORDER BY page_no) AS rn FROM {CANDIDATE_SQL}
    WHERE length(trim(text)) >= 50 AND page_no % 10 <> 0) WHERE rn <= 120 UNION ALL SELECT manual_id, page_no, text FROM {{pages}} WHERE page_no % 10 = 0""")
def f2_pm_page_pool(spark, d):
    p = _pages(spark, d)
    pool = p.where("page_no % 10 = 0").select("manual_id", F.col("page_no").alias("ord"), "text", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"))
    return pages.pm_page_pool(p, pool).select("manual_id", "page_start", "text")


@query()
def x10_text_pattern_tasks(spark, d):
    return extract.text_pattern_tasks(_pages(spark, d))


@query()
def a10_finalize_tasks(spark, d):
    return tasks.finalize_tasks(extract.text_pattern_tasks(_pages(spark, d)))


def _table_pages(spark, d):
    """Pages with a maintenance table each: a machine's tasks of an interval, a heading row first."""
    t = domain_table(spark, d, "tasks").where("is_active")
    row = F.array(F.col("interval_hours").cast("string"), "action", "description", "area", F.coalesce("part_number", F.lit("")))
    table = F.transform(F.array_sort(F.collect_list(F.struct("task_no", row.alias("r")))), lambda x: x["r"])
    head = F.array(*map(F.lit, ("Interval", "Action", "Description", "Component", "Part No")))
    per = t.groupBy("machine_id", "interval_hours").agg(F.concat(F.array(head), table).alias("table"))
    page = F.array_position(F.array(*map(F.lit, (8, 120, 500, 1500, 3000, 6000, 12000))), F.col("interval_hours")).cast("int")
    return per.select(F.col("machine_id").alias("manual_id"), page.alias("page_no"), F.lit("Maintenance schedule with service interval").alias("text"), F.array("table").alias("tables"))


@query("""SELECT manual_id, interval_hours, area, CASE WHEN n > 1 THEN concat(description, ' (', CAST(n AS VARCHAR), ' LOCATIONS)') ELSE description END AS description,
    CAST(10 * row_number() OVER (PARTITION BY manual_id ORDER BY interval_hours, area, description) AS INT) AS task_no
    FROM (SELECT machine_id AS manual_id, interval_hours, substr(area, 1, 30) AS area, description, count(*) AS n FROM {tasks} WHERE is_active GROUP BY ALL)""")
def x7_header_table_tasks(spark, d):
    return tasks.finalize_tasks(extract.header_table_tasks(_table_pages(spark, d))).select("manual_id", "interval_hours", "area", "description", "task_no")


@query(Q.GENERIC)
def x9_generic_table_tasks(spark, d):
    return extract.generic_table_tasks(_table_pages(spark, d)).drop("ord")


@query(Q.INTERVAL_COLUMNS)
def x8_interval_column_tasks(spark, d):
    p = _table_pages(spark, d)
    marked = F.transform(F.get("tables", F.lit(0)), lambda r, i: F.when(i == 0, F.array(F.lit("Task"), F.lit("Daily"), F.lit("500 h"), F.lit("2,500"))).otherwise(F.array(F.get(r, F.lit(2)), F.when(i % 2 == 0, F.lit("x")).otherwise(""), F.when(i % 3 == 0, F.lit("✓")).otherwise(""), F.when(i % 5 == 0, F.lit("yes")).otherwise(""))))
    return extract.interval_column_tasks(p.withColumn("tables", F.array(marked))).drop("ord")


@query()
def x11_pmrspl_tasks(spark, d):
    t = domain_table(spark, d, "tasks").where("is_active AND interval_hours IN (3000, 6000, 12000)")
    row = F.array(F.lit("1"), F.concat(F.lit("L"), F.col("task_no").cast("string")), F.lit(""), "area", F.lit(""), F.lit(""), F.lit(""), F.col("interval_hours").cast("string"), F.when(F.col("action") == "REPLACE", "Change").otherwise("Check"), F.coalesce("part_number", F.lit("-")), F.lit(""))
    table = F.transform(F.array_sort(F.collect_list(F.struct("task_no", row.alias("r")))), lambda x: x["r"])
    p = t.groupBy(F.col("machine_id").alias("manual_id"), (F.col("interval_hours") / 3000).cast("int").alias("page_no")).agg(F.array(table).alias("tables"))
    return extract.pmrspl_tasks(p.withColumn("text", F.when(F.col("page_no") == 1, "Preventive maintenance recommendations").otherwise("")))


@query()
def u1_extract_from_pages(spark, d):
    t, p = _table_pages(spark, d), _pages(spark, d)
    # pages are files in practice; what stands in for them is made once
    every = t.unionByName(p.withColumn("tables", F.lit(None).cast("array<array<array<string>>>")))
    every = files.shared_table(every.repartition(4 * spark.sparkContext.defaultParallelism, "manual_id", "page_no"), "manual-pages")
    return extract.extract_from_pages(every)


@query(Q.TABLE_CHUNKS)
def x5_table_row_chunks(spark, d):
    return chunks.table_row_chunks(_table_pages(spark, d))


@query(f"SELECT * FROM {Q.SECTIONS}")
def x2_section_chunks(spark, d):
    return chunks.section_chunks(_pages(spark, d))


@query(f"""SELECT manual_id, CAST(ord AS INT) AS ord, chunk AS text, a AS char_start, a + length(chunk) AS char_end, 0 AS page_start, 0 AS page_end, 'text' AS chunk_type FROM {Q.windows('(SELECT doc_id AS manual_id, text FROM documents)')}""")
def x1_sliding_chunks(spark, d):
    docs = domain_table(spark, d, "documents").select(F.col("doc_id").alias("manual_id"), "text")
    return chunks.sliding_chunks(docs)


@query(f"SELECT * FROM {Q.CHUNKS}")
def u2_chunk_pages(spark, d):
    return chunks.chunk_pages(_pages(spark, d).withColumn("tables", F.lit(None).cast("array<array<array<string>>>")))


@query(Q.MARKDOWN)
def x6_markdown_chunks(spark, d):
    return chunks.markdown_chunks(domain_table(spark, d, "documents").select(F.col("doc_id").alias("manual_id"), "text"))


@query(f"SELECT * FROM {Q.POOL}")
def w5_balanced_pool(spark, d):
    return chunks.balanced_pool(u2_chunk_pages(spark, d))


@query(f"SELECT manual_id, chunk_type, count(*) AS n FROM {Q.CHUNKS} GROUP BY ALL")
def a8_chunk_type_counts(spark, d):
    return chunks.chunk_type_counts(u2_chunk_pages(spark, d))


@query(f"""SELECT DISTINCT manual_id, hours FROM (SELECT manual_id, interval_hint AS hours FROM {Q.CHUNKS} WHERE interval_hint >= 8 UNION ALL SELECT manual_id, unnest([500, 1000, 2000, 5000, 10000]) FROM (SELECT DISTINCT manual_id FROM {{pages}}))""")
def a13_interval_hints(spark, d):
    made = _pages(spark, d).select("manual_id", F.lit("SIG").alias("manufacturer")).distinct()
    return chunks.interval_hints(u2_chunk_pages(spark, d), made).select("manual_id", F.explode("intervals").alias("hours"))


@query(Q.PROMPTS)
def b1_prompt_batches(spark, d):
    return tasks.prompt_batches(w5_balanced_pool(spark, d))


@query(Q.EMBED)
def b2_embed_batches(spark, d):
    return tasks.embed_batches(w5_balanced_pool(spark, d)).select("manual_id", "batch_no", F.posexplode("inputs").alias("item", "input"))


# tasks


@query("""SELECT manual_id, interval_hours, CAST(interval_hours * 10 + row_number() OVER (PARTITION BY manual_id, interval_hours ORDER BY ord) AS INT) AS task_no, description FROM {extracted}""")
def w4_renumber_by_interval(spark, d):
    return tasks.renumber_by_interval(domain_table(spark, d, "extracted")).select("manual_id", "interval_hours", "task_no", "description")


@query("""SELECT manual_id, interval_hours, description, CAST(10 * row_number() OVER (PARTITION BY manual_id ORDER BY ord) AS INT) AS task_no FROM
    (SELECT *, row_number() OVER (PARTITION BY manual_id, upper(substr(description, 1, 80)), interval_hours ORDER BY ord) AS rn FROM {extracted}) WHERE rn = 1""")
def a9_dedup_model_tasks(spark, d):
    return tasks.dedup_model_tasks(domain_table(spark, d, "extracted")).select("manual_id", "interval_hours", "description", "task_no")


@query("""SELECT manual_id, task_no, description, 'pdf_table' AS _source FROM {extracted} WHERE task_no <= 100 UNION ALL
    SELECT manual_id, task_no, description, 'ai_extracted' FROM {extracted} e WHERE task_no > 100 AND NOT EXISTS
    (SELECT 1 FROM {extracted} p WHERE p.task_no <= 100 AND p.manual_id = e.manual_id AND substr(p.description, 1, 80) = substr(e.description, 1, 80))""")
def j1_merge_task_sources(spark, d):
    e = domain_table(spark, d, "extracted")
    return tasks.merge_task_sources(e.where("task_no <= 100"), e.where("task_no > 100")).select("manual_id", "task_no", "description", "_source")


def _chunk_pool(spark, d):
    p = domain_table(spark, d, "pages")
    return p.select(F.regexp_extract("manual_id", r"(\d+)$", 1).cast("bigint").alias("manual_id"), F.col("page_no").alias("ord"), "text", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"))


@query(Q.CITED)
def j2_assign_citations(spark, d):
    return tasks.assign_citations(domain_table(spark, d, "extracted"), _chunk_pool(spark, d))


@query("""SELECT manual_id, count(*) FILTER (WHERE manual_id % 20 <> 0) AS unverified FROM {extracted} GROUP BY manual_id""")
def j3_mark_verified(spark, d):
    return tasks.mark_verified(domain_table(spark, d, "extracted"), domain_table(spark, d, "manual_uploads").select("manual_id").where("manual_id % 20 = 0"))[1]


@query("""SELECT manual_id, interval_hours, task_no, area, action, description, machine_state, safety_flag FROM {extracted}""")
def s17_parse_and_repair_model_output(spark, d):
    e = domain_table(spark, d, "extracted")
    one = F.struct("task_no", "area", "action", "description", "machine_state", "safety_flag", "part_number", "interval_hours")
    raw = e.groupBy("manual_id").agg(F.concat(F.lit("Here are the tasks:\n```json\n"), F.to_json(F.array_sort(F.collect_list(one))), F.lit("\n``` [end]")).alias("raw"))
    rows = tasks.normalize_model_tasks(tasks.parse_model_json(raw))
    return rows.select("manual_id", "interval_hours", "task_no", "area", F.col("action"), "description", "machine_state", "safety_flag")


# scalars over whole tables

@query(f"SELECT doc_id, {Q.detect_interval('text')} AS hours FROM documents")
def s1_detect_interval(spark, d):
    return domain_table(spark, d, "documents").select("doc_id", S.detect_interval(F.col("text")).alias("hours"))


@query(Q.CLASSES)
def s8_classify_text(spark, d):
    return pages.classification_sample(_pages(spark, d)).select("manual_id", S.classify_text(F.col("sample")).alias("c")).select("manual_id", "c.*").withColumn("detected_chapters", F.array_join("detected_chapters", ","))


@query(Q.TYPES)
def s6_content_type(spark, d):
    return domain_table(spark, d, "documents").select("doc_id", S.content_type(F.coalesce("text", F.lit("")), F.lit(""), F.lit("section")).alias("content_type"), S.manual_version(F.coalesce("text", F.lit(""))).alias("version"))


@query(Q.SNAPPED)
def s2_snap_interval(spark, d):
    return domain_table(spark, d, "orders").select("o_orderkey", S.snap_interval(F.col("o_custkey").cast("int")).alias("snapped"), S.snap_interval_strict(F.col("o_custkey").cast("int")).alias("strict"))


@query("""SELECT machine_id, name, substr(sha256(concat(machine_id, '|500|WO|', name)), 1, 16) AS signature FROM {machines}""")
def s16_document_signature(spark, d):
    (m,) = _t(spark, d, "machines")
    return m.select("machine_id", "name", S.document_signature(F.col("machine_id"), F.lit(500), F.lit("WO"), F.col("name")).alias("signature"))


@query(Q.NAMES)
def s9_names_and_labels(spark, d):
    t, m = _t(spark, d, "tasks", "machines")
    per = t.select("machine_id", "interval_hours").distinct().join(m.select("machine_id", "name", "manufacturer"), "machine_id")
    a = (F.col("machine_id"), F.col("name"))
    return per.select("machine_id", "interval_hours", S.interval_label(F.col("interval_hours")).alias("label"), S.sheet_file_name(*a, F.col("interval_hours")).alias("file_name"), S.sheet_title(*a, F.col("interval_hours")).alias("title"), S.archive_stem(*a).alias("stem"), S.infer_machine_id(F.col("manufacturer"), F.lit(None), F.lit("")).alias("inferred"), F.array_join(S.guess_intervals(F.col("manufacturer")), ",").alias("usual"))


# retrieval

def _vectors(spark, d):
    return domain_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("manual_id"))


@query("""SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
    (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def t1_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return retrieve.cosine_topk(v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), v)


@query("""SELECT manual_id, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT label AS manual_id, arg_min(embedding, vec_id) AS embedding FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label), (SELECT unnest(range(1, 2000)) AS i) WHERE i <= len(embedding)""")
def t2_proxy_query(spark, d):
    v = _vectors(spark, d).withColumns({"ord": F.col("chunk_id"), "chunk_type": F.when(F.col("chunk_id") % 3 == 0, "table_row").otherwise("text")})
    return retrieve.proxy_query(v).select("manual_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT * FROM {Q.bm25('(SELECT item_id AS query_id, text FROM benchmark)', '(SELECT doc_id AS chunk_id, text FROM documents)', 10)}")
def t3_bm25_topk(spark, d):
    docs = domain_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.bm25_topk(domain_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs)


@query(f"SELECT * FROM {Q.bm25('(SELECT item_id AS query_id, text FROM benchmark)', '(SELECT doc_id AS chunk_id, text FROM documents)', 10)}")
def t3_search_index(spark, d):
    path = files.shared_path(spark, "inverted")
    retrieve.write_index(domain_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), path)
    return retrieve.search_index(domain_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), spark, path)


@query(Q.hybrid("(SELECT * FROM (SELECT vec_id AS query_id, text, embedding FROM embeddings JOIN documents ON doc_id = vec_id) WHERE query_id % 100 = 0)", "(SELECT vec_id AS chunk_id, text, embedding FROM embeddings JOIN documents ON doc_id = vec_id)"))
def t3_hybrid_topk(spark, d):
    docs = domain_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = _vectors(spark, d).join(docs, "chunk_id")
    return retrieve.hybrid_topk(rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "text", "embedding"), rows)


# listings, gates and writers

@query("""SELECT citation_id, manual_id, chunk_id, page_start, page_end, section, content_type, text_excerpt, coalesce(interval_hours, 0) AS interval_hours FROM {citations} WHERE content_type = 'warning'""")
def f8_list_citations(spark, d):
    return history.list_citations(domain_table(spark, d, "citations"), content_type="warning")


@query("""SELECT approval_id, manual_id, interval_hours, status, comment, created_at FROM {approvals} WHERE manual_id = 7""")
def w3_approval_history(spark, d):
    return history.approval_history(domain_table(spark, d, "approvals"), 7)


@query(f"""SELECT path, reason IS NULL AS accepted, reason FROM (SELECT path, CASE WHEN NOT ends_with(lower(path), '.pdf') THEN 'not a PDF name' WHEN length > 104857600 THEN 'too large' WHEN strlen(content) < 5 THEN 'too short'
    WHEN NOT starts_with(content, '%PDF') THEN 'not a PDF' WHEN {Q.REASONS} THEN 'active content' END AS reason FROM {{uploads}})""")
def io2_validate_uploads(spark, d):
    return files.validate_uploads(domain_table(spark, d, "uploads").withColumn("content", F.col("content").cast("binary")))


@query(Q.CALENDAR)
def io5_calendar_schedule_tasks(spark, d):
    c = domain_table(spark, d, "calendar")
    return files.calendar_schedule_tasks(c.withColumn("cells", F.array("c0", "c1", "c2")).drop("c0", "c1", "c2"))


@query("""SELECT machine_id, 1996 AS year, 6 AS month, interval_hours, CAST(row_number() OVER (PARTITION BY machine_id, interval_hours ORDER BY CASE machine_state WHEN 'RUNNING' THEN 1 WHEN 'STOPPED' THEN 2 ELSE 3 END, task_no) AS INT) AS row_no, task_no, area, action FROM {tasks} WHERE is_active""")
def io7_write_checklists(spark, d):
    path = files.shared_path(spark, "checklists")
    files.write_checklists(w7_checklist_rows(spark, d).withColumns({"year": F.lit(1996), "month": F.lit(6)}), path)
    return spark.read.parquet(path).select("machine_id", "year", "month", "interval_hours", "row_no", "task_no", "area", "action")


@query("""SELECT manual_id, page_no AS chunk_id, CASE WHEN page_no % 2 = 0 THEN concat('new ', text) ELSE text END AS text, page_no + CASE WHEN page_no % 2 = 0 THEN 100 ELSE 0 END AS ord FROM {pages}""")
def io8_replace_chunk_index(spark, d):
    path, p = files.shared_path(spark, "index"), _pages(spark, d)
    index = p.select("manual_id", F.col("page_no").alias("chunk_id"), "text", F.col("page_no").alias("ord"))
    files.replace_chunk_index(index.withColumn("text", F.lit("old")), path)
    again = index.where("chunk_id % 2 = 0").select("manual_id", "chunk_id", F.concat(F.lit("new "), "text").alias("text"), (F.col("ord") + 100).alias("ord"))
    files.replace_chunk_index(index.unionByName(again), path)
    return spark.read.parquet(path)


@query("""SELECT manual_id, page_no, greatest(1, (SELECT coalesce(max(o.page_no), 1) FROM {pages} o WHERE o.manual_id = p.manual_id AND (o.page_no - 1) * 1000 <= length(p.text))) AS page FROM {pages} p""")
def j12_char_to_page(spark, d):
    p = _pages(spark, d)
    offsets = p.groupBy("manual_id").agg(F.collect_list(F.struct(F.col("page_no").alias("page"), ((F.col("page_no") - 1) * 1000).alias("start"))).alias("offsets"))
    return p.join(offsets, "manual_id").select("manual_id", "page_no", chunks.char_to_page(F.length("text"), F.col("offsets")).alias("page"))


@query(Q.LAYOUT)
def x6_layout_chunks(spark, d):
    docs = domain_table(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("m"), F.floor(F.col("doc_id") / 100).cast("string")).alias("manual_id"), (F.col("doc_id") % 100).cast("int").alias("para_no"), F.when(F.col("doc_id") % 10 == 3, "title").when(F.col("doc_id") % 10 == 7, "footer").alias("role"), F.substring("text", 1, 200).alias("text"))
    rows = rows.withColumn("page_no", F.col("para_no") + 1)
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.substring("text", 20 * i + 1, 20).alias("content")) for i in (0, 1)]))
    cells = rows.where("para_no % 4 = 0").select("manual_id", "page_no", F.col("para_no").alias("table_idx"), F.lit(0).alias("row_idx"), cell.alias("c")).select("manual_id", "page_no", "table_idx", "row_idx", "c.*")
    return chunks.layout_chunks(rows, cells)


@query("""SELECT doc_id, CASE WHEN k AND (contains(low, 'chapter 12') OR contains(low, 'kapitel 12') OR contains(low, '12. maintenance') OR contains(low, '12 maintenance')) THEN 12
        WHEN k AND (contains(low, 'chapter 11') OR contains(low, 'kapitel 11') OR contains(low, '11. maintenance') OR contains(low, '11 maintenance')) THEN 11 ELSE found END AS chapter,
    CASE WHEN k AND (contains(low, 'chapter 12') OR contains(low, 'kapitel 12') OR contains(low, '12. maintenance') OR contains(low, '12 maintenance') OR contains(low, 'chapter 11') OR contains(low, 'kapitel 11') OR contains(low, '11. maintenance') OR contains(low, '11 maintenance')) THEN 'krones_auto'
        WHEN found IS NOT NULL THEN 'toc_pattern' ELSE 'not_found' END AS method FROM
    (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(low, '(\\d+)[.\\s]+(?:maintenance|service|inspection|lubrication|wartung|instandhaltung)', 1), '') AS INT),
        TRY_CAST(nullif(regexp_extract(low, 'chapter\\s+(\\d+)[\\s\\S]{0,50}(?:maintenance|service|inspection)', 1), '') AS INT)) AS found FROM
    (SELECT doc_id, doc_id % 2 = 0 AS k, lower(concat('Chapter ', CAST(doc_id % 14 AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN ' - maintenance ' ELSE ' parts ' END, text)) AS low FROM documents))""")
def s12_maintenance_chapter(spark, d):
    n = F.col("doc_id")
    text = F.concat(F.lit("Chapter "), (n % 14).cast("string"), F.when(n % 3 == 0, " - maintenance ").otherwise(" parts "), F.col("text"))
    found = S.maintenance_chapter(text, F.when(n % 2 == 0, "KRONES").otherwise("SIG"))
    return domain_table(spark, d, "documents").select("doc_id", found.alias("m")).select("doc_id", "m.*")


@query("""SELECT doc_id, concat('Chapter ', CAST(doc_id % 9 + 1 AS VARCHAR), ' ', CAST(n_chars AS VARCHAR), ' a ') AS part FROM documents""")
def s12_chapter_text(spark, d):
    n = (F.col("doc_id") % 9 + 1).cast("int")
    made = F.concat(F.lit("Chapter "), n.cast("string"), F.lit(" "), F.col("n_chars").cast("string"), F.lit(" a Chapter "), (n + 1).cast("string"), F.lit(" rest"))
    return domain_table(spark, d, "documents").select("doc_id", S.chapter_text(made, n).alias("part"))


@query("""SELECT manual_id, CASE WHEN contains(m, 'TETRA') THEN 'TETRAPAK-ASEPTIC-L3' WHEN contains(f, 'HYPET') THEN '' WHEN contains(f, 'SHRINK') THEN 'SHRINK-TUNNEL-L3' WHEN contains(f, 'CONTIFORM') THEN 'CONTIFORM-C3-L3' WHEN contains(m, 'KRONES') THEN 'VARIOPAC-PRO-L3' ELSE '' END AS machine,
    contains(m, 'TETRA') OR contains(m, 'TEM') AS tetra, contains(f, 'HYPET') AS hypet FROM
    (SELECT manual_id, upper(coalesce(detected_manufacturer, '')) AS m, concat(CASE manual_id % 4 WHEN 0 THEN 'HYPET ' WHEN 1 THEN 'SHRINK ' WHEN 2 THEN 'CONTIFORM ' ELSE '' END, upper(original_filename)) AS f FROM {manual_uploads})""")
def s13_s14_machine_of_upload(spark, d):
    u, n = domain_table(spark, d, "manual_uploads"), F.col("manual_id") % 4
    name = F.concat(F.when(n == 0, "hypet ").when(n == 1, "Shrink ").when(n == 2, "contiform ").otherwise(""), "original_filename")
    of = (F.col("detected_manufacturer"), name)
    return u.select("manual_id", S.infer_machine_id(of[0], F.lit(None), of[1]).alias("machine"), S.is_tetra(*of).alias("tetra"), S.is_hypet(*of).alias("hypet"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS detail, CAST(event_id % 4 AS INT) AS n_tasks, CAST(event_id % 100 + 3 AS INT) AS chapter FROM events""")
def s19_json_fields(spark, d):
    e, n = domain_table(spark, d, "events"), (F.col("event_id") % 4).cast("int")
    listed = F.when(n > 0, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), n), ","), F.lit("]")))
    chapters = F.concat(F.lit("[1,"), (F.col("event_id") % 100 + 3).cast("string"), F.lit("]"))
    return e.select("event_id", S.json_detail(F.col("props"), "k").alias("detail"), S.json_task_count(listed).alias("n_tasks"), S.json_chapters(chapters)[1].alias("chapter"))


@query(f"SELECT manual_id, batch_no, CAST(length(text) AS VARCHAR) AS raw FROM ({Q.PROMPTS})")
def b3_apply_model(spark, d):
    return tasks.apply_model(b1_prompt_batches(spark, d), lambda text: str(len(text)))


# the model fails on one batch in three in the first run
@query(f"SELECT manual_id, batch_no, CAST(length(text) AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS error FROM ({Q.PROMPTS})")
def b3_run_model(spark, d):
    path, batches = files.shared_path(spark, "answers"), b1_prompt_batches(spark, d)
    tasks.run_model(batches, lambda text: str(len(text) + 0 // (len(text) % 3)), path, waves=2)
    return tasks.run_model(batches, lambda text: str(len(text)), path, waves=2).select("manual_id", "batch_no", "raw", "error")


@query(Q.FROM_TABLES)
def u1_extract_from_tables(spark, d):
    return extract.extract_from_pages(_table_pages(spark, d))


@query(f"SELECT manual_id, task_no, interval_hours, area, action, description FROM ({Q.FROM_TABLES})")
def st1_stream_manuals(spark, d):
    source, target, state = (files.shared_path(spark, n) for n in ("manuals", "extracted", "state"))
    kind = {f.split()[0]: f.split()[1] for f in files.PAGES.split(", ")}
    pages_ = _table_pages(spark, d).withColumns({"source_file": F.lit("f"), "n_pages": F.lit(7)})
    # pages of a manual come in two batches, later ones first
    rows = pages_.select(*[F.col(c).cast(t) for c, t in kind.items()]).withColumn("late", (F.col("page_no") < 4).cast("int"))
    for late in (0, 1):
        rows.where(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(source)
    streams.stream_manuals(spark, source, target, state, 1, buckets=8).awaitTermination()
    return tables.current(spark, target).select("manual_id", "task_no", "interval_hours", "area", "action", "description")


@query("""SELECT machine_id AS manual_id, count(DISTINCT interval_hours) AS arrived, 7 AS n_pages, count(DISTINCT interval_hours) >= 7 AS complete FROM {tasks} WHERE is_active GROUP BY machine_id""")
def st1_manual_progress(spark, d):
    target = files.shared_path(spark, "progress")
    rows = _table_pages(spark, d).withColumns({"source_file": F.lit("f"), "n_pages": F.lit(7)})
    for version, part in enumerate((rows.where("page_no % 2 = 0"), rows)):
        tables.upsert(part.withColumn("arrived", F.lit(version)), f"{target}-pages", ["manual_id", "page_no"], F.col("arrived"), version, spread_by=["manual_id"])
    return streams.manual_progress(spark, target)


def _arriving(spark, rows, batches: int):
    """``rows`` as a stream of a file a batch."""
    source = files.shared_path(spark, "arriving")
    rows.repartition(batches).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


@query("""SELECT machine_id, entry_id, current_hours, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY recorded_at DESC, entry_id DESC) AS rn FROM {machine_hours}) WHERE rn = 1""")
def st2_stream_latest_hours(spark, d):
    target, state = (files.shared_path(spark, n) for n in ("latest-hours", "state"))
    streams.stream_latest_hours(_arriving(spark, domain_table(spark, d, "machine_hours"), 3), target, state, buckets=8).awaitTermination()
    return tables.current(spark, target).drop("bucket")


@query(f"SELECT * FROM {DUE_SQL}")
def st2_stream_due_schedule(spark, d):
    m, i, h, r = _t(spark, d, "machines", "pm_intervals", "machine_hours", "pm_records")
    target, state = (files.shared_path(spark, n) for n in ("due", "state"))
    reading = F.struct("entry_id", "current_hours", "recorded_at").alias("reading")
    record = F.struct("record_id", "interval_hours", "status", "completed_at", F.lit(1).alias("revision")).alias("record")
    first = F.struct("record_id", "interval_hours", F.lit("PENDING").alias("status"), F.lit(None).cast("date").alias("completed_at"), F.lit(0).alias("revision")).alias("record")
    changes = h.select("machine_id", reading).unionByName(r.select("machine_id", record), allowMissingColumns=True).unionByName(r.where("record_id % 3 = 0").select("machine_id", first), allowMissingColumns=True)
    streams.start_due_schedule(m, i, target, buckets=8)
    streams.stream_due_schedule(_arriving(spark, changes, 3), m, i, target, state, buckets=8).awaitTermination()
    return tables.current(spark, target).drop("bucket")
