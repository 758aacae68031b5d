"""The given tables as tables of the maintenance domain.

Each mapping is one SELECT that Spark SQL and DuckDB read alike, so that a query and
its check start from the same rows. ``{name}`` stands for a table or another mapping. Every row of a table is
mapped; where two tables are joined, a key that both have decides which rows meet, so results grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A table's name in a mapping; numbers and upper-case letters in braces belong to patterns.
NAME = r"\{([a-z]\w*)\}"

MAPPINGS = {
    "machines": """
        SELECT concat('M', lpad(cast(s_suppkey AS string), 5, '0')) AS machine_id, s_name AS name,
               CASE s_suppkey % 6 WHEN 0 THEN 'KRONES' WHEN 1 THEN 'TETRA PAK' WHEN 2 THEN 'EISBAR'
                    WHEN 3 THEN 'SIG' WHEN 4 THEN 'CON L3' ELSE 'THIRD_PARTY' END AS manufacturer,
               CASE WHEN s_suppkey % 6 = 0 THEN 'KRONES' ELSE 'THIRD_PARTY' END AS machine_type,
               s_suppkey % 10 <> 9 AS is_active
        FROM {supplier}""",
    "pm_intervals": """
        SELECT concat('M', lpad(cast(s_suppkey AS string), 5, '0')) AS machine_id, h.hours AS hours,
               concat(cast(h.hours AS string), 'hr') AS label
        FROM {supplier} CROSS JOIN (VALUES (1, 8), (2, 120), (3, 500), (4, 1500), (5, 3000), (6, 6000), (7, 12000)) AS h(i, hours)
        WHERE (s_suppkey + h.i) % 5 <> 0""",
    "tasks": """
        SELECT concat(machine_id, '-', cast(interval_hours AS string), '-', cast(task_no AS string)) AS task_id, *
        FROM (SELECT concat('M', lpad(cast(l_suppkey AS string), 5, '0')) AS machine_id,
               CASE l_linenumber WHEN 1 THEN 8 WHEN 2 THEN 120 WHEN 3 THEN 500 WHEN 4 THEN 1500 WHEN 5 THEN 3000
                    WHEN 6 THEN 6000 ELSE 12000 END AS interval_hours,
               cast(10 * row_number() OVER (PARTITION BY l_suppkey, l_linenumber
                    ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS int) AS task_no,
               upper(p_type) AS area,
               CASE l_returnflag WHEN 'A' THEN 'CHECK' WHEN 'N' THEN 'REPLACE' ELSE 'CLEAN' END AS action,
               upper(concat(CASE l_returnflag WHEN 'A' THEN 'CHECK' WHEN 'N' THEN 'REPLACE' ELSE 'CLEAN' END, ' ', p_name)) AS description,
               CASE WHEN l_orderkey % 5 = 0 THEN 'POWERED_OFF' WHEN l_linestatus = 'O' THEN 'RUNNING' ELSE 'STOPPED' END AS machine_state,
               l_orderkey % 5 = 0 AS safety_flag,
               CASE WHEN l_partkey % 3 = 0 THEN concat('PN-', lpad(cast(l_partkey AS string), 6, '0')) END AS part_number,
               l_orderkey % 11 <> 0 AS is_active
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) AS t""",
    "pm_records": """
        SELECT o_orderkey AS record_id,
               concat('M', lpad(cast(o_custkey % 100 AS string), 5, '0')) AS machine_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 8 WHEN '2' THEN 120 WHEN '3' THEN 500 WHEN '4' THEN 1500 ELSE 3000 END AS interval_hours,
               concat('WO-', cast(o_orderkey AS string)) AS work_order,
               concat('T', cast(o_custkey % 17 AS string)) AS technician_id,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'APPROVED' ELSE 'PENDING' END AS status,
               CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 10 <> 0 THEN cast(o_orderdate AS date) END AS completed_at,
               cast(o_orderdate AS date) AS created_at
        FROM {orders}""",
    "machine_hours": """
        SELECT event_id AS entry_id,
               concat('M', lpad(cast(user_id % 100 AS string), 5, '0')) AS machine_id,
               cast(floor(value * 100) AS bigint) AS current_hours, ts AS recorded_at
        FROM {events} WHERE (user_id % 100) % 8 <> 0""",
    "submissions": """
        SELECT r.record_id AS record_id, t.task_id AS task_id, t.task_no AS task_no, t.task_no % 3 = 0 AS is_done,
               concat('I', cast(t.task_no % 7 AS string)) AS initialed_by, r.created_at AS submitted_at
        FROM {pm_records} r JOIN {tasks} t ON r.machine_id = t.machine_id AND r.interval_hours = t.interval_hours
             AND t.task_no % 80 = (r.record_id % 8) * 10
        WHERE t.is_active""",
    "audit_logs": """
        SELECT event_id AS log_id, event_type AS action,
               CASE event_id % 3 WHEN 0 THEN 'TASK' WHEN 1 THEN 'MACHINE' ELSE 'RECORD' END AS resource_type,
               event_id % 100 AS resource_id, props AS details, ts AS logged_at
        FROM {events}""",
    "manual_uploads": """
        SELECT doc_id AS manual_id, concat('M', lpad(cast(doc_id % 100 AS string), 5, '0')) AS machine_id,
               concat('manual ', cast(doc_id AS string), '.pdf') AS original_filename,
               CASE doc_id % 5 WHEN 0 THEN 'PENDING_REVIEW' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'FAILED' ELSE 'PENDING_REVIEW' END AS status,
               CASE WHEN doc_id % 3 = 0 THEN 'KRONES' WHEN doc_id % 3 = 1 THEN 'TETRA PAK' END AS detected_manufacturer,
               n_chars AS created_ord
        FROM {documents}""",
    "extracted": """
        SELECT u.manual_id AS manual_id, t.interval_hours AS interval_hours, t.task_no AS task_no, t.area AS area, t.action AS action,
               t.description AS description, t.machine_state AS machine_state, t.safety_flag AS safety_flag, t.part_number AS part_number,
               t.task_id AS ord
        FROM {manual_uploads} u JOIN {tasks} t ON u.machine_id = t.machine_id AND u.status <> 'FAILED' AND t.interval_hours =
             CASE u.manual_id % 7 WHEN 1 THEN 8 WHEN 2 THEN 120 WHEN 3 THEN 500 WHEN 4 THEN 1500 WHEN 5 THEN 3000 WHEN 6 THEN 6000 ELSE 12000 END""",
    "citations": """
        SELECT doc_id AS citation_id, concat('m', cast(cast(floor(doc_id / 100) AS bigint) AS string)) AS manual_id, concat('c', cast(doc_id AS string)) AS chunk_id,
               cast(doc_id % 100 + 1 AS int) AS page_start, cast(doc_id % 100 + 1 AS int) AS page_end, lang AS section,
               CASE doc_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'loto' WHEN 2 THEN 'ppe' ELSE 'procedure' END AS content_type,
               substr(text, 1, 500) AS text_excerpt, CASE WHEN doc_id % 3 <> 0 THEN cast(doc_id % 7 AS int) * 500 END AS interval_hours
        FROM {documents}""",
    "uploads": """
        SELECT concat('f', cast(doc_id AS string), CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END) AS path, n_chars * 20000 AS length,
               concat(CASE doc_id % 5 WHEN 0 THEN '' ELSE '%PDF-1.7 ' END, CASE doc_id % 11 WHEN 0 THEN '/JavaScript ' ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END) AS content
        FROM {documents}""",
    "calendar": """
        SELECT p_size AS workbook, cast(p_partkey % 4 AS int) AS sheet_ord, CASE p_partkey % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN '2 YEAR ' WHEN 2 THEN 'Notes' ELSE 'quarterly' END AS sheet,
               cast(row_number() OVER (PARTITION BY p_size, p_partkey % 4 ORDER BY p_partkey) AS int) AS row_no,
               CASE p_partkey % 5 WHEN 0 THEN 'SEQ' ELSE cast(p_partkey AS string) END AS c0, CASE p_partkey % 3 WHEN 0 THEN concat('Check: ', p_name) WHEN 1 THEN 'SAFETY' ELSE p_name END AS c1,
               CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS c2
        FROM {part}""",
    "approvals": """
        SELECT event_id AS approval_id, user_id AS manual_id, (event_id % 3) * 500 AS interval_hours,
               CASE WHEN event_id % 4 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS status,
               CASE WHEN event_id % 8 <> 0 THEN concat('note ', cast(event_id AS string)) END AS comment, ts AS created_at
        FROM {events}""",
    "pages": """
        SELECT concat('m', cast(cast(floor(doc_id / 100) AS bigint) AS string)) AS manual_id, cast(doc_id % 100 + 1 AS int) AS page_no,
               concat(CASE doc_id % 9 WHEN 0 THEN concat('Replace the oil filter every 500 hours: replace the main oil filter and gasket', chr(10),
                                                         '1000h - clean the conveyor chain and sensor', chr(10))
                                      WHEN 1 THEN concat('Every 3 months: lubricate the drive bearing with grease', chr(10)) ELSE '' END, text) AS text
        FROM {documents}""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(NAME, sql)))


def domain_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the domain; a name that isn't mapped is read as it is."""
    if name not in MAPPINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = MAPPINGS[name]
    return spark.sql(sql, **{n: domain_table(spark, sf_dir, n) for n in _names(sql)})


def with_domain(sql: str) -> str:
    """``sql`` with the mappings that its ``{names}`` ask for put before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in MAPPINGS and n not in order:
                visit(MAPPINGS[n])
                order.append(n)

    visit(sql)
    bare = lambda s: re.sub(NAME, lambda m: f"d_{m[1]}" if m[1] in MAPPINGS else m[1], s)
    ctes = ",\n".join(f"d_{n} AS ({bare(MAPPINGS[n])})" for n in order)
    return (f"WITH {ctes}\n" if ctes else "") + bare(sql)
