"""Golden rows of the maintenance operators, and all queries against their SQL on the smallest tables."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from upkeep.functions import rules as R
from upkeep.functions import scalars as S
from upkeep.operators import chunks, extract, history, library, pages, retrieve, tasks, validate
from upkeep.plans import registry
from upkeep.sources import files

SF = "/root/testdata/sf0.001"
PAGE = "manual_id string, page_no int, text string, tables array<array<array<string>>>"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def of(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted(str(tuple(key(r[c]) for c in sorted(got.columns))) for r in got.collect())
    place = {c: i for i, c in enumerate(want.columns)}
    assert rows == sorted(str(tuple(key(r[place[c]]) for c in sorted(place))) for r in want.fetchall())


def test_intervals(spark):
    texts = ["Semi-Annual check", "every 45,000 h", "4.000 Betriebsstunden", "approx. every 7-year", "Täglich", "3 months", "13 months", "", None, "500", "2 weeks", "every 2 weeks, monthly"]
    assert of(spark, S.detect_interval, texts) == [3000, 45000, 4000, 42000, 8, 1500, 1500, None, None, None, 240, 240]


def test_snapping(spark):
    snap = lambda t: S.snap_interval(t.cast("int"))
    assert of(spark, snap, ["110", "509", "60", "70", "200000", "8", None]) == [100, 500, 60, 70, 200000, 8, None]
    for h in random.Random(1).sample(range(1, 50_000), 60):
        near = min(R.VALID_INTERVALS, key=lambda v: (abs(v - h), v))
        assert value(spark, S.snap_interval(F.lit(h))) == (near if abs(near - h) / max(h, 1) < 0.2 else h)
        assert value(spark, S.snap_interval_strict(F.lit(h))) == min(R.STRICT_INTERVALS, key=lambda v: (abs(v - h), v))


def test_keyword_rules(spark):
    assert of(spark, S.detect_area, ["Coil of wire", "Oil filter", "nothing", "Guard rail"]) == ["LUBRICATION", "FILTERS", "GENERAL", "SAFETY"]
    assert of(spark, S.detect_action, ["Renew belts", "please INSPECT", "do"]) == ["REPLACE", "INSPECT", "CHECK"]
    assert of(spark, S.machine_state, ["Lockout, then listen", "check vibration", "replace"]) == ["POWERED_OFF", "RUNNING", "STOPPED"]
    assert of(spark, S.is_heading, ["12.5.1 Title", "Chapter 3", "500 - HOURS", "täglich prüfen", "abc", "the end", "x" * 130]) == [True, True, True, True, False, False, False]
    assert of(spark, lambda t: S.content_type(t, F.lit(""), F.lit("section")), ["machine stopped", "DANGER of death", "Spare part list", "plain"]) == ["ppe", "warning", "parts_list", "procedure"]
    assert of(spark, S.manual_version, ["Rev. A-1 text", "Issue 2", "edition 3.1", "none"]) == ["A-1", "2", "3.1", ""]
    assert of(spark, S.sanitize_filename, ["a/../b c.pdf", "", "ü*?.txt"]) == ["a..b_c.pdf", "file", "ü.txt"]


def test_names_and_labels(spark):
    assert value(spark, S.interval_label(F.lit(500))) == "500hr (Monthly)" and value(spark, S.interval_file_label(F.lit(500))) == "500hr_Monthly"
    assert value(spark, S.interval_label(F.lit(77))) == "77hr" and value(spark, S.interval_file_label(F.lit(3840))) == "SEMI_ANNUAL"
    assert value(spark, S.safe_name(F.lit("Füller_Straße 2.0 (neu)"))) == "FULLER STRASSE 20 NEU"
    assert value(spark, S.sheet_title(F.lit("X"), F.lit("Press 1"), F.lit(160))) == "CON L3 PRESS 1 WEEKLY PM"
    label = lambda v, a, d: value(spark, S.function_area_label(F.lit(v), F.lit(a), F.lit(d)))
    assert label("INSPECT", "BEARINGS", "INSPECT - THE MAIN DRIVE BEARING, (LEFT) OF IT") == "Inspect Main Drive Bearing Left)" or label("INSPECT", "BEARINGS", "INSPECT THE MAIN BEARING") == "Inspect Main Bearing"
    assert label("LOCKOUT", "PUMP", "LOCKOUT") == "Safety" and label("CLEAN", "PUMP", "CLEAN") == "Clean Pump" and label("", "PUMP", "X") == "General"
    assert value(spark, S.chapter_text(F.lit("Chapter 1 a Chapter 2 b Chapter 3 c"), F.lit(2))) == "Chapter 2 b "


def test_classification(spark):
    c = of(spark, S.classify_text, ["Krones Contiform C3 line", "eisbär dryer", "Bottle coder", "Tetra Pak Pasteurizer maintenance service", "chapter 4 on maintenance"])
    assert [(x.manufacturer, x.model, round(x.confidence, 2)) for x in c] == [("KRONES", "Contiform C3 SAN", 0.7), ("EISBAR", "DAS", 0.85), ("CON L3", "BOTTLE CODER", 0.85), ("TETRA PAK", "Pasteurizer", 0.46), ("THIRD_PARTY", None, 0.38)]
    assert [list(x.detected_chapters) for x in c] == [[12], [9], [1], [], [4]]


def page_frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, PAGE).repartition(parts)


def test_candidate_pages(spark):
    rows = [("a", i, "Maintenance schedule" if i == 5 else "x", None) for i in range(1, 11)] + [("b", i, "x", None) for i in range(1, 4)]
    got = {(r.manual_id, r.page_no) for r in pages.pm_candidate_pages(page_frame(spark, rows)).collect()}
    assert got == {("a", i) for i in (4, 5, 6, 7)} | {("b", i) for i in (1, 2, 3)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_text_patterns(spark, parts):
    text = "Every 500 hours: replace the main oil filter\n1000h - clean the conveyor chain\nevery 3 months: grease the bearing points\nalle 2.000 Betriebsstunden: Ventil und Dichtung wechseln\n"
    rows = [("m", 1, text, None), ("m", 2, "interval list\n- check the belt tension now\n2) fix the safety sign labels\n", None), ("m", 3, "250 Hour Maintenance\n• tighten all of the bolts\n", None)]
    got = extract.text_pattern_tasks(page_frame(spark, rows, parts)).orderBy("ord").collect()
    assert [(r.page_no, r.interval_hours, r.description) for r in got] == [
        (1, 500, "REPLACE THE MAIN OIL FILTER"), (1, 2000, "VENTIL UND DICHTUNG WECHSELN"), (1, 1000, "CLEAN THE CONVEYOR CHAIN"), (1, 1500, "GREASE THE BEARING POINTS"),
        (2, 1500, "CHECK THE BELT TENSION NOW"), (3, 250, "TIGHTEN ALL OF THE BOLTS"),
    ]


def test_header_table(spark):
    t = [["Plan", None], ["Interval", "Work", "Description", "Component", "Part"], ["500 h", "Check", "Check the belt tension", "Drive", "AB-1234"], [None, "Change", "Change the oil", None, ""], ["2,500", "Clean"], ["2,500", "Clean", "Clean the pump", "Pump", "-"], ["1 h", "Check", "Too often", "", ""], ["", "Check", "Follows on", "", ""]]
    got = extract.header_table_tasks(page_frame(spark, [("m", 1, "pm table", [t])])).orderBy("ord").collect()
    assert [(r.interval_hours, r.area, r.action, r.description, r.part_number) for r in got] == [
        (500, "DRIVE", "CHECK", "CHECK THE BELT TENSION", "AB-1234"), (500, "LUBRICATION", "REPLACE", "CHANGE THE OIL", None),
        (2500, "PUMP", "CLEAN", "CLEAN THE PUMP", None), (2500, "GENERAL", "CHECK", "FOLLOWS ON", None),
    ]


def test_interval_columns_and_generic_rows(spark):
    t = [["Task", "Daily", "500 h", "2,500"], ["Check the oil level", "x", "", "yes"], ["abc", "x", "x", "x"], ["Clean all filters", "", "✓", "no"]]
    got = extract.interval_column_tasks(page_frame(spark, [("m", 1, "pm table", [t])])).orderBy("ord").collect()
    assert [(r.interval_hours, r.description) for r in got] == [(8, "CHECK THE OIL LEVEL"), (2500, "CHECK THE OIL LEVEL"), (500, "CLEAN ALL FILTERS")]
    g = [["1", "510", "Replace the seal", "Pump side"], ["70", "no interval", "xxxx"], ["a", "b"]]
    got = extract.generic_table_tasks(page_frame(spark, [("m", 1, "pm table", [g])])).collect()
    assert [(r.interval_hours, r.description) for r in got] == [(500, "REPLACE THE SEAL - PUMP SIDE")]


def test_finalize_counts_places(spark):
    rows = [("m", i, 500, a, d, "CHECK") for i, (a, d) in enumerate([("B", "x"), ("A", "y"), ("B", "x"), ("A", "z")])]
    got = tasks.finalize_tasks(spark.createDataFrame(rows, "manual_id string, ord long, interval_hours int, area string, description string, action string")).orderBy("task_no").collect()
    assert [(r.task_no, r.area, r.description) for r in got] == [(10, "A", "y"), (20, "A", "z"), (30, "B", "x (2 LOCATIONS)")]


def test_wide_tables(spark):
    row = lambda label, comp, iv, act, part="P1": ["1", label, "", comp, "", "", "", iv, act, part, ""]
    t1 = [row("V1", "Seat valve", "3000", "Check"), row("V1", "Seat valve", "3000", "Change"), row("F1", "Air filter", "6000", "Change"), row("S", "Safety sign", "3000", "Check")]
    t2 = [row("F2", "Air filter", "6000", "Check")]
    rows = [("m", 1, "Preventive maintenance recommendations ... 3", [[["toc"]]]), ("m", 2, "Preventive maintenance recommendations", [t1]), ("m", 3, "", [t2 + t2[:0] + [["x"]]]), ("m", 4, "", []), ("m", 5, "", []), ("m", 6, "", [[row("Z", "Pump", "3000", "Check"), ["x"]]])]
    got = extract.pmrspl_tasks(page_frame(spark, rows)).orderBy("task_no").collect()
    assert [(r.task_no, r.area, r.action, r.interval_hours, r.page_start) for r in got] == [(10, "VALVES", "REPLACE", 3000, 2), (20, "FILTERS", "REPLACE", 6000, 2), (30, "FILTERS", "CHECK", 6000, 3)]
    assert got[0].description.startswith("CHECK SEAT VALVE V1. VERIFY VALVE OPENS") and "USE PART NUMBER P1 FOR REPLACEMENT." in got[1].description


def test_chunks(spark):
    text = "intro words here\n12.1 Daily tasks\n" + "do this and that now please with care " * 4 + "\n- check oil level\n- clean the filter\n"
    rows = [("m", 1, text, None), ("m", 2, "13.2 Weekly tasks\nshort\n", None)]
    s = chunks.section_chunks(page_frame(spark, rows))
    (one,) = s.collect()
    assert (one.section_heading, one.page_start, one.page_end, one.interval_hint) == ("12.1 Daily tasks", 1, 2, 8)
    items = chunks.checkbox_chunks(chunks.split_long_sections(s)).orderBy("item").collect()
    assert [x.text for x in items] == ["[TASK ITEM] 12.1 Daily tasks: check oil level", "[TASK ITEM] 12.1 Daily tasks: clean the filter"]
    long_ = spark.createDataFrame([("m", "section", "H", "a " * 30 + "\n\n" + "b " * 30 + "\n\n" + "c " * 10, 1, 1, 0, 9, None, "procedure", 1)], "manual_id string, chunk_type string, section_heading string, text string, page_start int, page_end int, char_start int, char_end int, interval_hint int, content_type string, ord long")
    parts = chunks.split_long_sections(long_, 50).orderBy("part").collect()
    assert [(p.part, len(p.text.split()), p.chunk_type) for p in parts] == [(0, 32, "paragraph"), (1, 42, "paragraph")]
    w = chunks.sliding_chunks(spark.createDataFrame([("m", " ".join(f"w{i}" for i in range(25)))], "manual_id string, text string"), 10, 2).orderBy("ord").collect()
    assert [(x.ord, x.text.split()[0], len(x.text.split())) for x in w] == [(0, "w0", 10), (1, "w8", 10), (2, "w16", 9), (3, "w24", 1)]


def test_table_rows(spark):
    t = [["Component", "Interval"], ["Pump", "500 h"], ["", ""], ["Belt", None]]
    kv = [["Component", "Pump"], ["Work", "Check it"], ["Interval", "weekly"]]
    rows = [("m", 1, "maintenance of 120 hours", [t, kv, [["x"]]])]
    got = chunks.table_row_chunks(page_frame(spark, rows)).orderBy("ord").collect()
    assert [(x.text, x.interval_hint) for x in got] == [
        ("[TABLE ROW] component: Pump | interval: 500 h", 500), ("[TABLE ROW] component: Belt", 120), ("[TABLE ROW] component: Pump | work: Check it | interval: weekly", 120)]


def test_markdown_and_layout(spark):
    md = "# Pump\nCheck the pump for leaks and noise daily.\n\n| a | b |\n|---|---|\n| 1 | 2 |\nshort\n"
    got = chunks.markdown_chunks(spark.createDataFrame([("m", md)], "manual_id string, text string")).orderBy("ord").collect()
    assert [(x.chunk_type, x.section_heading) for x in got] == [("paragraph", "Pump"), ("table_row", "Pump")] and got[1].text.count("\n") == 3
    paras = spark.createDataFrame([("m", 1, "title", "Pump", 1), ("m", 2, None, "Check daily", 1)], "manual_id string, para_no int, role string, text string, page_no int")
    cells = spark.createDataFrame([("m", 2, 0, 0, 1, "b"), ("m", 2, 0, 0, 0, "aaaa")], "manual_id string, page_no int, table_idx int, row_idx int, col_idx int, content string")
    got = chunks.layout_chunks(paras, cells).orderBy("ord").collect()
    assert [(x.chunk_type, x.text, x.section_heading) for x in got] == [("text", "Pump", "Pump"), ("section", "Check daily", "Pump"), ("table_row", "aaaa | b", "Pump")]


def test_pools_and_batches(spark):
    rows = [("m", "table_row" if i % 2 else "section", f"{i} " + "word " * 30, i) for i in range(200)]
    pool = chunks.balanced_pool(spark.createDataFrame(rows, "manual_id string, chunk_type string, text string, ord long")).orderBy("ord").collect()
    assert len(pool) == 140 and pool[0].chunk_type == "table_row" and pool[80].chunk_type == "section"
    b = tasks.prompt_batches(spark.createDataFrame(pool)).orderBy("batch_no").collect()
    assert [x.n_chunks for x in b] == [30, 30, 30, 30, 20]
    answers = tasks.apply_model(spark.createDataFrame(b), lambda t: 1 / 0 if "159 " in t else "[]").collect()
    assert sorted(a.raw for a in answers) == ["", "[]", "[]", "[]", "[]"]


@pytest.mark.parametrize("raw,items", [
    ('```json\n[{"description": "a"}]\n```', 1), ('x [{"description": "a [b] \\" c"}] [1]', 1), ('[{"description": "a"}, {"description": "b"}, {"descr', 2), ("none", 0), (None, 0), ('{"description": "z"}', 1),
])
def test_model_answers(spark, raw, items):
    rows = tasks.parse_model_json(spark.createDataFrame([("m", raw)], "manual_id string, raw string")).collect()
    assert len(rows) == items


def test_model_repair(spark):
    raw = '[{"interval_hours": "x", "safety_flag": "false", "action": "dance", "area": "pump"}, {"description": " listen to it ", "interval_hours": 130, "task_no": 7}]'
    rows = tasks.normalize_model_tasks(tasks.parse_model_json(spark.createDataFrame([("m", raw)], "manual_id string, raw string"))).orderBy("item").collect()
    assert [(r.task_no, r.area, r.action, r.description, r.machine_state, r.safety_flag, r.interval_hours) for r in rows] == [
        (10, "PUMP", "CHECK", "CHECK PUMP", "STOPPED", False, 500), (7, "GENERAL", "CHECK", "LISTEN TO IT", "RUNNING", False, 120)]


def test_citations(spark):
    t = spark.createDataFrame([("m", 10, 500, "check pump seals", "PUMP"), ("n", 10, 8, "x", "y")], "manual_id string, task_no int, interval_hours int, description string, area string")
    c = spark.createDataFrame([("m", 1, "nothing", 3, 3), ("m", 2, "The pump: 500 h", 4, 0), ("m", 3, "pump seals check", 5, 5)], "manual_id string, ord long, text string, page_start int, page_end int")
    got = {r.manual_id: r for r in tasks.assign_citations(t, c).collect()}
    assert (got["m"].page_start, got["m"].page_end, got["n"].page_start, got["n"].text_excerpt) == (4, 4, 0, "x")


def test_citations_of_repeated_and_empty_tasks(spark):
    rows = [("m", 10, None, "check pump", None), ("m", 10, None, "check pump", None), ("m", 20, None, None, None), (None, 30, 500, "check pump", "PUMP")]
    t = spark.createDataFrame(rows, "manual_id string, task_no int, interval_hours int, description string, area string")
    c = spark.createDataFrame([("m", 2, "pump check", 2, 2), ("m", 1, None, 1, 1), ("m", 3, "check pump", 3, 3), ("m", 2, "check pump a", 9, 9), (None, 1, "check pump", 4, 4)], "manual_id string, ord long, text string, page_start int, page_end int")
    got = sorted((r.task_no, r.page_start, r.text_excerpt) for r in tasks.assign_citations(t, c).collect())
    assert got == [(10, 2, "pump check"), (10, 2, "pump check"), (20, 1, ""), (30, 0, "check pump")]


def test_uploads_and_calendar(spark):
    f = spark.createDataFrame([("a.PDF", 9, bytearray(b"%PDF-1.7 ok")), ("b.txt", 9, bytearray(b"%PDF")), ("c.pdf", 9, bytearray(b"MZ.....")), ("d.pdf", 9, bytearray(b"%PDF eval(")), ("e.pdf", 2 * 10**8, bytearray(b"%PDF.")), ("f.pdf", 20_000, bytearray(b"%PDF" + b" " * 16_384 + b"eval("))], "path string, length long, content binary")
    assert {r.path: r.reason for r in files.validate_uploads(f).collect()} == {"a.PDF": None, "b.txt": "not a PDF name", "c.pdf": "not a PDF", "d.pdf": "active content", "e.pdf": "too large", "f.pdf": None}
    rows = spark.createDataFrame([(1, "Weekly", 1, ["title"]), (1, "Weekly", 2, ["seq", "d"]), (1, "Weekly", 3, ["1", "Check: oil level", "Long text"]), (1, "Weekly", 4, ["2", "SAFETY", None]), (2, "other", 2, ["1", "x", "y"]), (3, "2 YEAR", 2, ["1", "Pump", ""])], "sheet_ord int, sheet string, row_no int, cells array<string>")
    got = files.calendar_schedule_tasks(rows).orderBy("task_no").collect()
    assert [(r.task_no, r.area, r.action, r.description, r.interval_hours, r.safety_flag) for r in got] == [(10, "oil level", "CHECK", "Long text", 160, False), (20, "SAFETY", "CHECK", "SAFETY", 160, True), (30, "Pump", "CHECK", "Pump", 16000, False)]


def test_partitioned_results_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2026, 1, 500, 1, "x"), ("b", 2026, 1, 500, 1, "y")], "machine_id string, year int, month int, interval_hours int, row_no int, text string")
    files.write_checklists(rows, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    index = lambda m, i, t, o: spark.createDataFrame([(m, i, t, o)], "manual_id string, chunk_id int, text string, ord int")
    files.replace_chunk_index(index("m", 1, "old", 1).union(index("n", 1, "keep", 1)), f"{tmp_path}/i")
    files.replace_chunk_index(index("m", 2, "first", 1).union(index("m", 2, "last", 2)), f"{tmp_path}/i")
    assert sorted((r.manual_id, r.text) for r in spark.read.parquet(f"{tmp_path}/i").collect()) == [("m", "last"), ("n", "keep")]
    files.write_csv(rows.select("machine_id"), f"{tmp_path}/v")
    assert spark.read.csv(f"{tmp_path}/v", header=True).count() == 2


def test_checklists_of_many_machines(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("lpad(cast(id % 1000 as string), 4, '0') AS machine_id", "2026 AS year", "1 AS month", "cast(500 * (1 + id % 2) as int) AS interval_hours", "cast(id / 2000 as int) AS row_no")
    files.write_checklists(rows, f"{tmp_path}/c")
    kept = spark.read.parquet(f"{tmp_path}/c")
    assert kept.exceptAll(rows.select(*kept.columns)).count() == 0 and kept.count() == 4_000  # machines stay as they are written, leading noughts too
    per = kept.withColumn("file", F.input_file_name()).groupBy("machine_id", "interval_hours").agg(F.countDistinct("file").alias("n"))
    assert per.where("n > 1").count() == 0 and kept.select(F.input_file_name()).distinct().count() <= 8


def test_validation(spark):
    rows = spark.createDataFrame([(10, "A", "CHECK", "d", "STOPPED"), (5, "A" * 65, None, "d", "X")], "task_no int, area string, action string, description string, machine_state string")
    good, bad = validate.validate_task_rows(rows)
    assert good.count() == 1 and bad.first().broken == ["task_no", "area", "action", "machine_state"]


def test_transitions(spark):
    r = spark.createDataFrame([(1, "COMPLETED"), (2, "APPROVED"), (3, "PENDING")], "record_id int, status string")
    out, bad = history.approve_records(r, spark.createDataFrame([(1,), (2,), (9,)], "record_id int"), "me", None, F.current_timestamp())
    assert {x.record_id: x.status for x in out.collect()} == {1: "APPROVED", 2: "APPROVED", 3: "PENDING"}
    assert {x.record_id: x.reason for x in bad.collect()} == {2: "status is APPROVED", 9: "not found"}


def test_fallback_by_maker(spark):
    u = spark.createDataFrame([(1, "M1", None), (2, None, "Krones"), (3, None, "none")], "manual_id int, machine_id string, detected_manufacturer string")
    m = spark.createDataFrame([("M1", "z", True), ("M2", "b KRONES line", True), ("M3", "a krones", False)], "machine_id string, name string, is_active boolean")
    t = spark.createDataFrame([("M1", 10, None, None, None, None, "d"), ("M2", 10, 8, "A", "CLEAN", "RUNNING", "e")], "machine_id string, task_no int, interval_hours int, area string, action string, machine_state string, description string")
    got = {r.manual_id: r for r in library.library_fallback(u, m, t, spark.createDataFrame([], "manual_id int")).collect()}
    assert set(got) == {1, 2} and got[2].machine_id == "M2" and (got[1].area, got[1].interval_hours) == ("GENERAL", 500)


def test_cosine_in_blocks(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("manual_id"))
    q = v.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "embedding", "manual_id")
    rows = lambda b: sorted(map(tuple, retrieve.cosine_topk(q, v, 3, True, block=b).collect()))
    assert rows(2) == rows(100) and len(rows(2)) == 21
    zero = spark.createDataFrame([(0, [0.0] * 64, 1)], "query_id int, embedding array<float>, manual_id int")
    assert {r.score for r in retrieve.cosine_topk(zero, v, 2).collect()} == {0.0}


def plain_text_tasks(rows):
    """What the text patterns find, page by page with Python's own regular expressions: (manual, page, interval, task)."""
    snap = lambda h: (n if abs((n := min(R.VALID_INTERVALS, key=lambda v: (abs(v - h), v))) - h) / max(h, 1) < 0.2 else h)
    end = r"(?=\n|every|alle|\Z|$)"
    hits = [re.compile(p.replace(extract.END, end).replace(r"\z", r"\Z"), re.I | (re.M if k == 1 else 0)) for k, (p, _) in enumerate(extract.TEXT_PATTERNS)]
    section, bullet = re.compile(extract.SECTION_PATTERN, re.I), re.compile(extract.BULLET_PATTERN.replace(r"\z", r"\Z"), re.I)
    no_work, candidate = re.compile(R.NOT_WORK, re.I), re.compile(R.CANDIDATE, re.I)
    number = lambda n: int(re.sub("[,.]", "", n))
    out, manuals = [], {}
    for manual, page, text in rows:
        manuals.setdefault(manual, {})[page] = text or ""
    for manual, texts in manuals.items():
        marked = {p for p, t in texts.items() if candidate.search(t)}
        near = {p for p in texts if any(p + d in marked for d in (-2, -1, 0, 1))} if marked else {p for p in texts if p <= 600}
        anchor = None
        for page in sorted(near):
            last = {}
            for k, (p, (_, unit)) in enumerate(zip(hits, extract.TEXT_PATTERNS, strict=True), 1):
                for m in p.finditer(texts[page]):
                    iv, t = snap(number(m[1]) * unit), m[2].strip()
                    if k < 5 and iv not in R.VALID_INTERVALS:
                        continue
                    if k == 1 or len(t) > 10 and (k < 5 or not no_work.search(t)):
                        last[k] = iv
                    if len(t) > 10 and not no_work.search(t):
                        out.append((manual, page, iv, t))
            for m in section.finditer(texts[page]):
                if snap(number(m[1])) in R.VALID_INTERVALS:
                    last[6] = snap(number(m[1]))
            anchor = last[max(last)] if last else anchor
            if anchor is not None:
                out += [(manual, page, anchor, t) for t in (m[1].strip() for m in bullet.finditer(texts[page])) if len(t) > 10 and not no_work.search(t)]
    return sorted((m, p, iv, re.sub(r"\s+", " ", t.upper()).strip()[:250]) for m, p, iv, t in out)


def test_text_patterns_against_plain_python(spark):
    r = random.Random(4)
    parts = ["Every {n} hours: {t}\n", "{n}h - {t}\n", "each {m} months {t}. ", "alle {n} Stunden {t} every {n} hrs {t}\n", "approx. {m} years: {t}\n", "- {t}\n", "{m}) {t}\n", "{n} hour maintenance\n", "every {m} weeks: {t}\n", "no work here. ", "nach {n},000 Betriebsstunden: {t}\n", "\u2022 {t}\n", "maintenance schedule\n"]
    words = "check clean replace the main belt oil filter of drive safety sign label pump sensor 12 every now".split()
    fill = lambda p: p.format(n=r.choice([8, 100, 110, 500, 509, 1000, 77, 2500]), m=r.randint(1, 30), t=" ".join(r.choices(words, k=r.randint(1, 9))))
    rows = [(f"m{i // 12}", i % 12 + 1, "".join(fill(r.choice(parts)) for _ in range(r.randint(0, 9)))) for i in range(240)]
    got = extract.text_pattern_tasks(page_frame(spark, [(m, p, t, None) for m, p, t in rows])).collect()
    assert sorted((g.manual_id, g.page_no, g.interval_hours, g.description) for g in got) == plain_text_tasks(rows)


def test_text_pattern_query_against_plain_python(spark):
    rows = [(p.manual_id, p.page_no, p.text) for p in registry._pages(spark, SF).collect()]
    got = sorted((g.manual_id, g.page_no, g.interval_hours, g.description) for g in registry.QUERIES["x10_text_pattern_tasks"](spark, SF).collect())
    assert got == plain_text_tasks(rows)
    # finalizing keeps the first of equal ones and counts places
    kept = {(m, iv, S_AREA(t), t[:100]) for m, _, iv, t in got}
    done = registry.QUERIES["a10_finalize_tasks"](spark, SF).collect()
    assert len(done) == len(kept) and {(d.manual_id, d.interval_hours, d.area) for d in done} == {k[:3] for k in kept}
    both = registry.QUERIES["u1_extract_from_pages"](spark, SF)
    names = [r.manual_id for r in both.select("manual_id").distinct().collect()]
    assert set(m for m, *_ in got) <= set(names) and both.count() == registry.QUERIES["u1_extract_from_tables"](spark, SF).count() + len(kept)


def S_AREA(text):
    return next((v for w, v in R.AREA_WORDS if w in text.lower()), "GENERAL")


def test_caps_can_be_left_out(spark):
    rows = page_frame(spark, [("m", i, f"12.{i} Part\ncheck the oil " * 9, None) for i in (1, 700)])
    assert {r.page_start for r in chunks.section_chunks(rows, max_pages=None).collect()} == {1, 700}
    assert pages.table_scan_pages(rows, None).count() == 2 and pages.pm_candidate_pages(page_frame(spark, [("m", 700, "x", None)]), None).count() == 1
    assert len(pages.classification_sample(rows, None).first().sample) > len(pages.classification_sample(rows).first().sample)
    assert pages.fallback_citations(rows, spark.createDataFrame([], "manual_id string"), None).count() == 2


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_nothing_imports_the_subpackage():
    root = os.path.join(os.path.dirname(__file__), "..", "upkeep")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"upkeep\.llm|from upkeep import llm", f.read())
