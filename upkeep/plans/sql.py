"""The domain's rules as SQL expressions for DuckDB, written from the fixed values alone, to check the jobs with."""

from __future__ import annotations

from upkeep.functions import rules as R

#: What (?U)\s and \b mean to the jobs, in a pattern language that knows ASCII only.
SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
END = r"(?:[^\p{L}\p{N}_]|$)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def first_match(x: str, table: list[tuple], default: str = "NULL") -> str:
    """``x`` is a column, named once for each keyword."""
    value = lambda v: q(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {value(v)}" for w, v in table) + f" ELSE {default} END"


def any_match(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def count_matches(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INT)" for w in words) + ")"


def detect_interval(x: str) -> str:
    years = rf"TRY_CAST(nullif(regexp_extract({x}, '(?i)(\d+)\s*[-–]?\s*years?', 1), '') AS INT) * {R.HOURS_PER_YEAR}"
    unit = rf"(?:hours?|hrs?|h{END}|betriebsstunden|stunden)"
    hours = rf"TRY_CAST(regexp_replace(nullif(regexp_extract({x}, '(?i)(\d{{1,6}}[,.]?\d{{0,3}})\s*(?:operating\s+)?{unit}', 1), ''), '[,.]', '', 'g') AS INT)"
    return f"coalesce({first_match(f'lower({x})', R.INTERVAL_WORDS)}, {years}, {hours})"


def area(x: str) -> str:
    return first_match(f"lower({x})", R.AREA_WORDS, "'GENERAL'")


def action(x: str) -> str:
    return first_match(f"lower({x})", R.VERB_WORDS, "'CHECK'")


def task(x: str) -> str:
    """Description, state and safety of a task, from its text."""
    low = f"lower({x})"
    state = f"CASE WHEN {any_match(low, R.POWERED_OFF_WORDS)} THEN 'POWERED_OFF' WHEN {any_match(low, R.RUNNING_WORDS)} THEN 'RUNNING' ELSE 'STOPPED' END"
    clean = f"substr({strip(f'''regexp_replace(upper({x}), '{SPACE}+', ' ', 'g')''')}, 1, 250)"
    return f"{clean} AS description, {state} AS machine_state, regexp_matches({x}, '(?i){R.SAFETY}') AS safety_flag"


def is_work(x: str) -> str:
    return f"NOT regexp_matches({x}, '(?i){R.NOT_WORK}')"


def content_type(head: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_match(head, words)} THEN {q(name)}" for name, words in R.CONTENT_TYPES) + " ELSE 'procedure' END"


def labels(hours: str, suffix=lambda s: s) -> str:
    return f"CASE {hours} " + " ".join(f"WHEN {h} THEN {q(suffix(s))}" for h, s in R.INTERVAL_LABELS.items()) + f" ELSE concat(CAST({hours} AS VARCHAR), 'hr') END"


def file_label(hours: str) -> str:
    return labels(hours, lambda s: s.replace(" (", "_").replace(")", "").replace(" ", "_"))


def safe_name(x: str) -> str:
    plain = f"replace(translate({x}, 'äöüÄÖÜ_.', 'aouAOU '), 'ß', 'ss')"
    return f"upper({strip(f'''regexp_replace(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g')''')})"


def heading(x: str) -> str:
    rest = "|".join(p.replace(r"\b", END).replace("(?:", "(?:") for p in R.HEADINGS[1:])
    return f"(length({x}) BETWEEN 4 AND 120 AND (regexp_matches({x}, '^(?:{R.HEADINGS[0]})') OR regexp_matches({x}, '(?i)^(?:{rest})')))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '{SPACE}+'), lambda w: w <> '')"


def windows(source: str, size: int = 500, overlap: int = 103) -> str:
    """Rows (manual_id, ord, chunk, a) of the windows of (manual_id, text) in ``source``."""
    return f"""(SELECT manual_id, k // {size - overlap} AS ord, array_to_string(w[k + 1 : k + {size}], ' ') AS chunk, strpos(text, w[k + 1]) - 1 AS a
        FROM (SELECT *, unnest(range(0, len(w), {size - overlap})) AS k FROM (SELECT manual_id, text, {words('text')} AS w FROM {source})))"""


TABLE_ROWS = """(SELECT machine_id AS manual_id, CASE interval_hours WHEN 8 THEN 1 WHEN 120 THEN 2 WHEN 500 THEN 3 WHEN 1500 THEN 4 WHEN 3000 THEN 5 WHEN 6000 THEN 6 ELSE 7 END AS page_no,
    row_number() OVER w AS row_idx, count(*) OVER (PARTITION BY machine_id, interval_hours) AS n, interval_hours, CAST(interval_hours AS VARCHAR) AS iv, action, description, area, coalesce(part_number, '') AS part
    FROM {tasks} WHERE is_active WINDOW w AS (PARTITION BY machine_id, interval_hours ORDER BY task_no))"""
_PART = " ".join(f"WHEN regexp_matches({c}, '{R.PART_NUMBER}') THEN {c}" for c in ("iv", "action", "description", "area", "part"))
GENERIC = f"""SELECT manual_id, page_no, {area('t')} AS area, {action('t')} AS action, {task('t')}, part_number, interval_hours FROM
    (SELECT *, CASE {_PART} END AS part_number, array_to_string(list_filter([action, description, area, part], lambda c: length(c) > 3), ' - ') AS t FROM {TABLE_ROWS} WHERE length(iv) > 1) WHERE t <> '' AND {is_work('t')}"""
INTERVAL_COLUMNS = f"""SELECT manual_id, page_no, {area('description')} AS area, {action('description')} AS action, {task('description')}, CAST(NULL AS VARCHAR) AS part_number, m.hours AS interval_hours
    FROM {TABLE_ROWS} r JOIN (VALUES (2, 8), (3, 500), (5, 2500)) AS m(every, hours) ON row_idx % every = 0 WHERE n >= 2 AND length(description) >= 5 AND {is_work('description')}"""
_PAIRS = "list_filter([struct_pack(k := 'interval', v := iv), struct_pack(k := 'action', v := action), struct_pack(k := 'description', v := description), struct_pack(k := 'component', v := area), struct_pack(k := 'part no', v := part)], lambda x: x.v <> '')"
TABLE_CHUNKS = f"""SELECT manual_id, 'table_row' AS chunk_type, '' AS section_heading, concat('[TABLE ROW] ', body) AS text, page_no AS page_start, page_no AS page_end, 0 AS char_start, length(body) AS char_end,
    coalesce(nullif({detect_interval('body')}, 0), CASE WHEN interval_hours IN ({', '.join(map(str, R.NUMBER_COLUMN_INTERVALS))}) AND first_number THEN interval_hours END) AS interval_hint, 'table' AS content_type,
    CAST(page_no AS BIGINT) * 1000000000 + row_idx AS ord, table_data FROM
    (SELECT *, array_to_string(list_transform({_PAIRS}, lambda x: concat(x.k, ': ', x.v)), ' | ') AS body, concat('[', array_to_string(list_transform({_PAIRS}, lambda x: concat('{{"k":"', x.k, '","v":"', x.v, '"}}')), ','), ']') AS table_data,
        max(row_idx < 3 AND {any_match('lower(action)', R.NUMBER_COLUMN_ACTIONS)}) OVER (PARTITION BY manual_id, page_no) AS first_number FROM {TABLE_ROWS})"""

_LINES = f"""(SELECT manual_id, page_no, line_no, line, last_page, {heading('line')} AS head, {detect_interval('line')} AS iv FROM
    (SELECT manual_id, page_no, last_page, line_no, {strip('lines[line_no]')} AS line FROM
        (SELECT *, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT manual_id, page_no, max(page_no) OVER (PARTITION BY manual_id) AS last_page, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{pages}})) WHERE page_no <= 120)
    WHERE line <> '')"""
_GROUPED = f"""(SELECT *, lead(head_page) OVER (PARTITION BY manual_id ORDER BY section) AS next_page FROM
    (SELECT manual_id, section, max(line) FILTER (WHERE head) AS heading, max(page_no) FILTER (WHERE head) AS head_page, max(last_page) AS last_page,
        string_agg(line, chr(10) ORDER BY page_no, line_no) FILTER (WHERE NOT head) AS body, first(iv ORDER BY page_no, line_no) FILTER (WHERE NOT head AND iv IS NOT NULL) AS iv FROM
        (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY manual_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) AS section FROM {_LINES}) GROUP BY manual_id, section))"""
SECTIONS = f"""(SELECT manual_id, 'section' AS chunk_type, coalesce(heading, '') AS section_heading, text, coalesce(head_page, 1) AS page_start, coalesce(next_page, last_page) AS page_end,
    0 AS char_start, length(text) AS char_end, coalesce(heading_iv, iv) AS interval_hint, {content_type('h')} AS content_type, section AS ord FROM
    (SELECT *, concat(CASE WHEN coalesce(heading, '') <> '' THEN concat('[SECTION: ', heading, ']', chr(10)) ELSE '' END, body) AS text, lower(concat(coalesce(heading, ''), ' ', substr(body, 1, 400))) AS h,
        {detect_interval("coalesce(heading, '')")} AS heading_iv FROM {_GROUPED} WHERE len({words('body')}) >= 20))"""
_SPLIT = f"""(SELECT * REPLACE (CASE WHEN long_ THEN concat(CASE WHEN section_heading <> '' THEN concat('[SECTION: ', section_heading, ']', chr(10)) ELSE '' END, {strip('text')}) ELSE text END AS text,
    CASE WHEN long_ THEN 'paragraph' ELSE chunk_type END AS chunk_type, CASE WHEN long_ THEN 0 ELSE char_end END AS char_end) FROM (SELECT *, len({words('text')}) > 800 AS long_ FROM {SECTIONS}))"""
_ITEM = r"(?m)^[ \t]*(?:[□☐☑✓✔○●]|\[\s*\]|\(\s*\)|[•\-\*])\s+(.{5,})$"
_ITEMS = f"""(SELECT * EXCLUDE (items, item_no), item_no AS item, len(items) >= 2 AS listed, CASE WHEN len(items) >= 2 THEN items[item_no + 1] ELSE text END AS t FROM
    (SELECT *, unnest(range(0, CASE WHEN len(items) >= 2 THEN len(items) ELSE 1 END)) AS item_no FROM (SELECT *, regexp_extract_all(text, '{_ITEM}', 1) AS items FROM {_SPLIT})))"""
_CHUNKS = f"""(SELECT manual_id, CASE WHEN listed THEN 'checkbox' ELSE chunk_type END AS chunk_type, section_heading,
    CASE WHEN listed THEN concat('[TASK ITEM] ', CASE WHEN section_heading <> '' THEN concat(section_heading, ': ') ELSE '' END, {strip('t')}) ELSE text END AS text, page_start, page_end,
    CASE WHEN listed THEN strpos(text, t) - 1 ELSE char_start END AS char_start, CASE WHEN listed THEN strpos(text, t) - 1 + length(t) ELSE char_end END AS char_end, interval_hint, content_type,
    row_number() OVER (PARTITION BY manual_id ORDER BY ord, item) AS ord FROM {_ITEMS})"""
_REST = f"(SELECT manual_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS text FROM {{pages}} WHERE manual_id NOT IN (SELECT manual_id FROM {_CHUNKS}) GROUP BY manual_id)"
CHUNKS = f"""(SELECT manual_id, chunk_type, section_heading, text, page_start, page_end, char_start, char_end, interval_hint, content_type, ord FROM {_CHUNKS}
    UNION ALL SELECT manual_id, 'text', '', chunk, 0, 0, a, a + length(chunk), NULL, 'procedure', ord FROM {windows(_REST)})"""
_USEFUL = f"(length(s) >= CASE chunk_type WHEN 'checkbox' THEN 30 ELSE 80 END AND NOT regexp_matches(s, '(?i)^(?:fig(?:ure)?|table|see{SPACE}|refer to|page|p\\.){SPACE}'))"
POOL = f"""(SELECT * EXCLUDE (s, bucket, place, most, rn) REPLACE (row_number() OVER (PARTITION BY manual_id ORDER BY place, rn) AS ord) FROM
    (SELECT *, row_number() OVER (PARTITION BY manual_id, bucket ORDER BY ord) AS rn FROM
        (SELECT *, CASE bucket WHEN 'table_row' THEN 0 WHEN 'section' THEN 1 WHEN 'checkbox' THEN 2 ELSE 3 END AS place, CASE bucket WHEN 'table_row' THEN 80 WHEN 'section' THEN 60 WHEN 'checkbox' THEN 30 ELSE 10 END AS most FROM
            (SELECT *, CASE WHEN chunk_type IN ('table_row', 'checkbox') THEN chunk_type WHEN chunk_type IN ('section', 'paragraph') THEN 'section' ELSE 'other' END AS bucket, {strip("coalesce(text, '')")} AS s FROM {CHUNKS}) WHERE {_USEFUL}))
    WHERE rn <= most)"""
_BATCH = lambda size: f"(SELECT *, CAST((row_number() OVER (PARTITION BY manual_id ORDER BY ord) - 1) // {size} AS INT) AS batch_no FROM {POOL})"
PROMPTS = f"""SELECT manual_id, batch_no, string_agg(substr(text, 1, 1500), concat(chr(10), chr(10), '--- SECTION BREAK ---', chr(10), chr(10)) ORDER BY ord) AS text, count(*) AS n_chunks,
    CAST(sum(least(length(text), 1500)) + 25 * (count(*) - 1) AS INT) AS n_chars FROM {_BATCH(30)} GROUP BY manual_id, batch_no"""
EMBED = f"SELECT manual_id, batch_no, CAST(row_number() OVER (PARTITION BY manual_id, batch_no ORDER BY ord) - 1 AS INT) AS item, substr(text, 1, 1800) AS input FROM {_BATCH(25)}"

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def bm25(queries: str, chunks: str, k: int) -> str:
    return f"""(SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
        (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM
            (SELECT DISTINCT query_id, unnest({_TOKENS}) AS term FROM {queries}) JOIN
            (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM (SELECT chunk_id, {_TOKENS} AS w FROM {chunks})) GROUP BY ALL)) USING (term),
            (SELECT count(*) AS n, avg(len({_TOKENS})) AS avgdl FROM {chunks}) GROUP BY query_id, chunk_id)) WHERE rank <= {k})"""


def cosine(queries: str, chunks: str, k: int) -> str:
    return f"""(SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
        (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM {queries} q, {chunks} c)) WHERE rank <= {k})"""


def hybrid(queries: str, chunks: str, k: int = 10, depth: int = 50) -> str:
    part = lambda r: f"coalesce(CAST(1 AS DOUBLE) / (60 + {r}), 0)"
    return f"""SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
        (SELECT query_id, chunk_id, round({part('a.rank')} + {part('b.rank')}, 9) AS score FROM {bm25(queries, chunks, depth)} a FULL JOIN {cosine(queries, chunks, depth)} b USING (query_id, chunk_id))) WHERE rank <= {k}"""


CITED = f"""SELECT manual_id, interval_hours, task_no, area, action, description, machine_state, safety_flag, part_number, ord, concat('task_', CAST(task_no AS VARCHAR)) AS chunk_id,
    coalesce(best.page_start, 0) AS page_start, coalesce(nullif(best.page_end, 0), best.page_start, 0) AS page_end, substr(CASE WHEN best IS NOT NULL THEN coalesce(best.text, '') ELSE description END, 1, 500) AS text_excerpt FROM
    (SELECT e.*, (SELECT arg_max(struct_pack(page_start := p.page_start, page_end := p.page_end, text := p.text), struct_pack(
            s := CASE WHEN contains(lower(p.text), CAST(e.interval_hours AS VARCHAR)) THEN 10 ELSE 0 END + len(list_filter(e.w, lambda w: contains(lower(p.text), w))), o := -p.ord)) FROM
        (SELECT CAST(regexp_extract(manual_id, '(\\d+)$', 1) AS BIGINT) AS manual_id, page_no AS ord, text, page_no AS page_start, page_no AS page_end FROM {{pages}}) p WHERE p.manual_id = e.manual_id) AS best
     FROM (SELECT *, list_distinct(list_filter(string_split_regex(lower(concat(coalesce(description, ''), ' ', coalesce(area, ''))), '\\s+'), lambda w: length(w) > 3)) AS w FROM {{extracted}}) e)"""

_NOTE = "CASE verb " + " ".join(f"WHEN {q(v)} THEN [{', '.join(map(q, lines))}][(seq - 1) % {len(lines)} + 1]" for v, lines in R.NOTES.items()) + " END"


def title_case(text: str) -> str:
    """Every letter after something else than a letter in upper case, the others in lower case."""
    return f"array_to_string(list_transform(regexp_extract_all({text}, '\\p{{L}}+|\\P{{L}}+'), lambda w: concat(upper(w[1]), lower(w[2:]))), '')"


_COMPONENT = "CASE area " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.COMPONENT_NAMES.items()) + " ELSE " + title_case("area") + " END"
_REST_WORDS = r"""list_filter(list_transform(list_filter(string_split_regex(trim(CASE WHEN starts_with(text, verb) THEN regexp_replace(substr(text, length(verb) + 1), '^[ \-:.,]+|[ \-:.,]+$', '', 'g') ELSE text END), '\s+'), lambda w: w <> '')[1:10],
    lambda w: regexp_replace(w, '[.,;:\-/]+$', '')), lambda w: w <> '' AND w NOT IN (""" + ", ".join(map(q, R.STOP_WORDS)) + """) AND NOT starts_with(w, '('))[1:4]"""
SHEET = f"""SELECT machine_id, interval_hours, CAST(seq * 10 AS INT) AS task_no, concat('CON L3 ', safe, ' ', CASE WHEN contains(lower(label), 'hr') THEN concat(CAST(interval_hours AS VARCHAR), ' HOURS PM') ELSE concat(upper(label), ' PM') END) AS title,
    concat('PM_', translate(safe, ' -', '__'), '_', {file_label('interval_hours')}, '.xlsx') AS file_name, label,
    CASE WHEN area = 'SAFETY' OR verb IN ('LOCKOUT', 'CONFIRM') THEN 'Safety' WHEN area = 'GENERAL' OR verb = '' THEN 'General'
         ELSE concat({title_case('verb')}, ' ', CASE WHEN len(ws) > 0 THEN {title_case("array_to_string(ws, ' ')")} ELSE {_COMPONENT} END) END AS area_label,
    concat(CASE WHEN action <> '' AND NOT starts_with(text, action) THEN trim(concat(action, ' ', text)) ELSE text END, coalesce(concat(chr(10), nullif({_NOTE}, '')), '')) AS action_text FROM
    (SELECT *, {labels('interval_hours')} AS label, {_REST_WORDS} AS ws FROM
        (SELECT t.machine_id, t.interval_hours, upper(trim(coalesce(t.area, 'GENERAL'))) AS area, upper(trim(t.action)) AS action, string_split_regex(upper(trim(t.action)), '\\s+')[1] AS verb, upper(trim(CASE WHEN t.task_no % 20 = 0 THEN translate(t.description, ' ', '-') ELSE t.description END)) AS text,
            {safe_name('m.name')} AS safe, row_number() OVER (PARTITION BY t.machine_id, t.interval_hours ORDER BY t.task_no) AS seq FROM {{tasks}} t JOIN {{machines}} m ON m.machine_id = t.machine_id WHERE t.is_active))"""
NAMES = f"""SELECT machine_id, interval_hours, {labels('interval_hours')} AS label, concat('PM_', translate(safe, ' -', '__'), '_', {file_label('interval_hours')}, '.xlsx') AS file_name,
    concat('CON L3 ', safe, ' ', CAST(interval_hours AS VARCHAR), ' HOURS PM') AS title, array_to_string(list_transform(string_split(safe, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), '_') AS stem,
    CASE WHEN contains(manufacturer, 'EISBAR') THEN 'DEHUMIDIFIER-L3' WHEN contains(manufacturer, 'TETRA') THEN 'TETRAPAK-ASEPTIC-L3' WHEN contains(manufacturer, 'CON L3') THEN 'BOTTLECODER-L3' WHEN contains(manufacturer, 'KRONES') THEN 'VARIOPAC-PRO-L3' ELSE '' END AS inferred,
    CASE {' '.join(f"WHEN {any_match('manufacturer', w)} THEN {q(','.join(map(str, v)))}" for w, v in R.USUAL_INTERVALS[:-1])} ELSE {q(','.join(map(str, R.USUAL_INTERVALS[-1][1])))} END AS usual
    FROM (SELECT DISTINCT t.machine_id, t.interval_hours, m.manufacturer, {safe_name('m.name')} AS safe FROM {{tasks}} t JOIN {{machines}} m ON m.machine_id = t.machine_id)"""

SAMPLE = """(SELECT manual_id, substr(concat(string_agg(text, chr(10) ORDER BY page_no), chr(10)), 1, 15000) AS sample FROM
    (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY manual_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {pages} WHERE page_no <= 50) WHERE before < 60000 GROUP BY manual_id)"""
_KIND = f"CASE WHEN n >= 1 THEN 'K' WHEN {any_match('low', R.EISBAR_WORDS)} THEN 'E' WHEN {any_match('low', R.CON_L3_WORDS)} THEN 'C' ELSE 'O' END"
CLASSES = f"""SELECT manual_id, CASE kind WHEN 'K' THEN 'KRONES' WHEN 'E' THEN 'EISBAR' WHEN 'C' THEN 'CON L3' ELSE maker END AS manufacturer,
    CASE kind WHEN 'K' THEN {first_match('low', R.KRONES_MODELS, "'Krones Machine'")} WHEN 'E' THEN 'DAS' WHEN 'C' THEN 'BOTTLE CODER' ELSE CASE WHEN contains(maker, 'TETRA') THEN {first_match('low', R.TETRA_MODELS)} END END AS model,
    CASE kind WHEN 'K' THEN 'KRONES' ELSE 'THIRD_PARTY' END AS machine_type,
    CAST(CASE kind WHEN 'K' THEN least(0.95, round(0.5 + n * 0.1, 6)) WHEN 'E' THEN 0.85 WHEN 'C' THEN 0.85 ELSE least(0.7, round(0.3 + {count_matches('low', R.MAINTENANCE_WORDS)} * 0.08, 6)) END AS DOUBLE) AS confidence, 'keyword' AS method,
    CASE kind WHEN 'K' THEN CASE WHEN contains(low, 'contiform') THEN '12' WHEN contains(low, 'variopac') THEN '11,12,13' WHEN contains(low, 'shrink') THEN '9' ELSE '9,12' END WHEN 'E' THEN '9' WHEN 'C' THEN '1' ELSE found END AS detected_chapters FROM
    (SELECT *, {_KIND} AS kind, {first_match('substr(low, 1, 1000)', R.HEADER_MAKERS, "'THIRD_PARTY'")} AS maker, '' AS found FROM (SELECT *, {count_matches('low', R.KRONES_WORDS)} AS n FROM (SELECT manual_id, lower(coalesce(sample, '')) AS low FROM {SAMPLE})))"""
_VERSION = ", ".join(f"nullif({strip(f'''regexp_extract(head, '(?i){p}', 1)''')}, '')" for p in R.VERSION_PATTERNS)
TYPES = f"""SELECT doc_id, {content_type('h')} AS content_type, coalesce({_VERSION}, '') AS version FROM (SELECT doc_id, lower(concat(' ', substr(coalesce(text, ''), 1, 400))) AS h, substr(coalesce(text, ''), 1, 3000) AS head FROM documents)"""
_MIDPOINT = lambda valid: f"(SELECT arg_min(v, abs(v - h) * CAST(1000000 AS BIGINT) + v) FROM (VALUES {', '.join(f'({v})' for v in valid)}) AS n(v))"
SNAPPED = f"""SELECT o_orderkey, CASE WHEN abs(near - h) * 5 < greatest(h, 1) THEN near ELSE h END AS snapped, strict FROM
    (SELECT o_orderkey, h, {_MIDPOINT(R.VALID_INTERVALS)} AS near, {_MIDPOINT(R.STRICT_INTERVALS)} AS strict FROM (SELECT o_orderkey, CAST(o_custkey AS INT) AS h FROM orders))"""
FALLBACK = """SELECT * FROM (WITH u AS (SELECT manual_id, machine_id, lower(detected_manufacturer) AS maker, machine_id IN (SELECT machine_id FROM {machines}) AS own FROM {manual_uploads}
        WHERE status = 'FAILED' AND manual_id NOT IN (SELECT manual_id FROM {extracted})),
    named AS (SELECT maker, arg_min(m.machine_id, struct_pack(a := m.name, b := m.machine_id)) AS machine_id FROM (SELECT DISTINCT maker FROM u) JOIN {machines} m ON m.is_active AND contains(lower(m.name), maker) GROUP BY maker)
    SELECT u.manual_id, t.machine_id, t.task_no, coalesce(t.area, 'GENERAL') AS area, coalesce(t.action, 'CHECK') AS action, coalesce(t.machine_state, 'STOPPED') AS machine_state, coalesce(t.interval_hours, 500) AS interval_hours, t.description
    FROM u LEFT JOIN named USING (maker) JOIN {tasks} t ON t.machine_id = CASE WHEN own THEN u.machine_id ELSE named.machine_id END)"""


def finalized(source: str, first_by: str, apart: str = "") -> str:
    """Tasks of ``source`` grouped and numbered; ``first_by`` decides which of equal ones is kept."""
    key = f"manual_id, {apart}interval_hours, area, substr(description, 1, 100)"
    return f"""(SELECT {apart}manual_id, page_no, interval_hours, area, action, CASE WHEN n > 1 THEN concat(description, ' (', CAST(n AS VARCHAR), ' LOCATIONS)') ELSE description END AS description, machine_state, safety_flag, part_number,
        CAST(10 * row_number() OVER (PARTITION BY {apart}manual_id ORDER BY interval_hours, area, substr(description, 1, 100)) AS INT) AS task_no FROM
        (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {first_by}) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) WHERE rn = 1)"""


_FROM_HEADER = f"""SELECT 1 AS source, row_idx, manual_id, page_no, substr(area, 1, 30) AS area, {action('action')} AS action, {task('description')}, CASE {_PART} END AS part_number, interval_hours FROM {TABLE_ROWS} WHERE {is_work('description')}"""
_FROM_NUMBER = f"""SELECT 2 AS source, row_idx, manual_id, page_no, {area('t')} AS area, {action('t')} AS action, {task('t')}, part_number, interval_hours FROM
    (SELECT *, CASE {_PART} END AS part_number, array_to_string(list_filter([action, description, area, part], lambda c: length(c) > 3), ' - ') AS t FROM {TABLE_ROWS} WHERE length(iv) > 1) WHERE t <> '' AND {is_work('t')}"""
FROM_TABLES = f"SELECT *, CAST(task_no AS BIGINT) AS ord FROM {finalized(finalized(f'({_FROM_HEADER} UNION ALL {_FROM_NUMBER})', 'row_idx', 'source, '), 'source, task_no')}"

_MD = f"""(SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS heading FROM
    (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS new, CASE WHEN kind = 'head' THEN {strip("regexp_replace(line, '^#+', '')")} END AS head FROM
        (SELECT doc_id, line_no, lines[line_no] AS line, CASE WHEN starts_with(lines[line_no], '#') THEN 'head' WHEN starts_with(lines[line_no], '|') THEN 'table' WHEN {strip('lines[line_no]')} = '' THEN 'blank' ELSE 'text' END AS kind FROM
            (SELECT *, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS lines FROM documents)))))"""
_MD_BLOCKS = f"(SELECT doc_id, block, kind, heading, list(line ORDER BY line_no) AS ls FROM {_MD} WHERE kind IN ('table', 'text') GROUP BY ALL)"
_MD_JOINED = f"array_to_string(list_transform(ls, lambda x: {strip('x')}), ' ')"
_MD_TEXTS = f"(SELECT *, string_split_regex(para, '\\s+') AS w FROM (SELECT *, {strip(_MD_JOINED)} AS para FROM {_MD_BLOCKS} WHERE kind = 'text') WHERE length(para) >= 20)"
MARKDOWN = rf"""SELECT doc_id AS manual_id, chunk_type, heading AS section_heading, text, content_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, part) AS INT) AS ord FROM
    (SELECT doc_id, block, 0 AS part, 'table_row' AS chunk_type, heading, concat('[TABLE]', chr(10), array_to_string(ls, chr(10))) AS text, 'table' AS content_type FROM {_MD_BLOCKS}
        WHERE kind = 'table' AND len(list_filter(ls, lambda r: NOT regexp_matches(r, '^\|[\s\-:|]+\|'))) > 0
     UNION ALL SELECT doc_id, block, k // 400, CASE WHEN regexp_matches(para, '[☐☑☒✓✔□■]|^\s*[-*]\s+') THEN 'checkbox' ELSE 'paragraph' END, heading, array_to_string(w[k + 1 : k + 400], ' '), kind_of FROM
        (SELECT *, {content_type('h')} AS kind_of, unnest(range(0, len(w), 400)) AS k FROM (SELECT *, lower(concat(heading, ' ', substr(para, 1, 400))) AS h FROM {_MD_TEXTS})))"""
_PARAS = "(SELECT concat('m', CAST(doc_id // 100 AS VARCHAR)) AS manual_id, CAST(doc_id % 100 AS INT) AS no, CASE WHEN doc_id % 10 = 3 THEN 'title' WHEN doc_id % 10 = 7 THEN 'footer' END AS role, substr(text, 1, 200) AS text FROM documents)"
LAYOUT = f"""SELECT manual_id, chunk_type, heading AS section_heading, text, page_start, interval_hint, content_type, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY grp, k) AS INT) AS ord FROM
    (SELECT manual_id, CASE WHEN is_head THEN 'text' ELSE 'section' END AS chunk_type, heading, text, no + 1 AS page_start, {detect_interval('text')} AS interval_hint, {content_type('h')} AS content_type, 0 AS grp, no AS k FROM
        (SELECT *, lower(concat(heading, ' ', substr(text, 1, 400))) AS h FROM (SELECT *, coalesce(role = 'title', false) AS is_head, coalesce(last_value(CASE WHEN role = 'title' THEN {strip('text')} END IGNORE NULLS) OVER (PARTITION BY manual_id ORDER BY no ROWS UNBOUNDED PRECEDING), '') AS heading
            FROM {_PARAS} WHERE {strip("coalesce(text, '')")} <> ''))
     UNION ALL SELECT manual_id, 'table_row', coalesce(h, ''), t, no + 1, {detect_interval('t')}, 'table', 1, CAST(no AS BIGINT) * 100000 FROM
        (SELECT manual_id, no, array_to_string(list_filter([{strip("substr(text, 1, 20)")}, {strip("substr(text, 21, 20)")}], lambda c: c <> ''), ' | ') AS t FROM {_PARAS} WHERE no % 4 = 0)
        LEFT JOIN (SELECT manual_id, arg_max({strip('text')}, no) AS h FROM {_PARAS} WHERE role = 'title' AND {strip("coalesce(text, '')")} <> '' GROUP BY manual_id) USING (manual_id) WHERE length(t) >= 5)"""
REASONS = " ".join(f"OR contains(substr(content, 1, 16384), {q(m)})" for m in R.EXPLOIT_MARKS)[3:]
CALENDAR = rf"""SELECT workbook, CAST(10 * row_number() OVER (PARTITION BY workbook ORDER BY sheet_ord, row_no) AS INT) AS task_no, CASE WHEN verb THEN array_to_string(w[2:], ' ') ELSE short END AS area, CASE WHEN verb THEN first ELSE 'CHECK' END AS action,
    coalesce(nullif(long, ''), short) AS description, interval_hours, 'STOPPED' AS machine_state, upper(short) = 'SAFETY' AS safety_flag, concat('Calendar schedule, ', sheet) AS source_chapter FROM
    (SELECT *, first IN ({', '.join(map(q, R.CALENDAR_VERBS))}) AND len(w) > 1 AS verb FROM (SELECT *, string_split_regex(short, '\s+') AS w, regexp_replace(upper(string_split_regex(short, '\s+')[1]), ':+$', '') AS first FROM
        (SELECT *, trim(c1) AS short, trim(c2) AS long, CASE upper(trim(sheet)) {' '.join(f"WHEN {q(k)} THEN {v}" for k, v in R.CALENDAR_HOURS.items())} END AS interval_hours,
            coalesce(min(CASE WHEN row_no BETWEEN 1 AND 4 AND lower(trim(c0)) = 'seq' THEN row_no + 1 END) OVER (PARTITION BY workbook, sheet_ord), 2) AS start FROM {{calendar}})
        WHERE interval_hours IS NOT NULL AND row_no >= start AND (short <> '' OR long <> '')))"""
