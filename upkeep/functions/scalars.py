"""Column functions of the maintenance domain: Column in, Column out, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upkeep.functions import rules as R


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if value is None else str(value)


def _words(words: list[str]) -> Column:
    """A constant array; one expression however many words there are."""
    return F.expr("array(" + ", ".join(map(_sql, words)) + ")")


def first_match(text: Column, table: list[tuple], default=None) -> Column:
    """Value of the first keyword of ``table`` that ``text`` contains; text is taken as it is."""
    known = F.expr("array(" + ", ".join(f"named_struct('w', {_sql(w)}, 'v', {_sql(v)})" for w, v in table) + ")")
    found = let(text, lambda t: F.get(F.filter(known, lambda x: F.contains(t, x["w"])), F.lit(0))["v"])
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def any_match(text: Column, words: list[str]) -> Column:
    """Whether ``text`` contains one of ``words``; no words match nothing."""
    if not words:
        return F.lit(False)
    return let(text, lambda t: F.exists(_words(words), lambda w: F.contains(t, w)))


def count_matches(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: F.size(F.filter(_words(words), lambda w: F.contains(t, w))))


def _digits(text: Column, pattern: str) -> Column:
    """First group of a pattern without thousands marks, as a number; null without a match."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), "[,.]", "").try_cast("int")


def detect_interval(text: Column) -> Column:
    """Hours that a text names: a calendar word, else years, else a number of hours; null if none."""
    def find(t: Column) -> Column:
        years = F.try_multiply(F.nullif(F.regexp_extract(t, r"(?i)(\d+)\s*[-–]?\s*years?", 1), F.lit("")).try_cast("int"), F.lit(R.HOURS_PER_YEAR))
        hours = _digits(t, r"(?iu)(\d{1,6}[,.]?\d{0,3})\s*(?:operating\s+)?(?:hours?|hrs?|h\b|betriebsstunden|stunden)")
        return F.coalesce(first_match(F.lower(t), R.INTERVAL_WORDS), years, hours)

    return let(text, find)


def _nearest(hours: Column, valid: list[int]) -> Column:
    """Nearest of a sorted list by its midpoints; of two equally near the smaller."""
    tops = [low + high for low, high in zip(valid, valid[1:], strict=False)] + [2**62]
    known = F.expr("array(" + ", ".join(f"named_struct('twice', {t}L, 'v', {v})" for t, v in zip(tops, valid, strict=True)) + ")")
    return F.get(F.filter(known, lambda x: hours * F.lit(2).cast("bigint") <= x["twice"]), F.lit(0))["v"]


def snap_interval(hours: Column) -> Column:
    """Nearest valid interval if it is less than a fifth away, else the hours as they are; of two equally near the smaller."""
    def snap(h: Column) -> Column:
        return let(_nearest(h, R.VALID_INTERVALS), lambda near: F.when(F.abs(near - h) * 5 < F.greatest(h, F.lit(1)), near).otherwise(h))

    return let(hours, snap)


def snap_interval_strict(hours: Column) -> Column:
    return let(hours, lambda h: _nearest(h, R.STRICT_INTERVALS))


def is_valid_interval(hours: Column) -> Column:
    return hours.isin(*R.VALID_INTERVALS)


def detect_area(text: Column) -> Column:
    return first_match(F.lower(text), R.AREA_WORDS, "GENERAL")


def detect_action(text: Column) -> Column:
    return first_match(F.lower(text), R.VERB_WORDS, "CHECK")


def machine_state(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_match(low, R.POWERED_OFF_WORDS), "POWERED_OFF").when(any_match(low, R.RUNNING_WORDS), "RUNNING").otherwise("STOPPED")


def safety_flag(text: Column) -> Column:
    return F.rlike(text, F.lit(f"(?i){R.SAFETY}"))


def is_non_pm(text: Column) -> Column:
    """Signs and labels, which are no work."""
    return F.rlike(text, F.lit(f"(?i){R.NOT_WORK}"))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def build_task(area: Column, action: Column, text: Column, interval: Column, part: Column | None = None) -> Column:
    """A task as a struct: upper-case text with single blanks cut to 250, state and safety from its words."""
    return let(text, lambda t: _task(area, action, t, interval, part))


def _task(area: Column, action: Column, text: Column, interval: Column, part: Column | None) -> Column:
    clean = F.substring(strip(F.regexp_replace(F.upper(text), r"(?U)\s+", " ")), 1, 250)
    number = F.nullif(part, F.lit("")) if part is not None else F.lit(None).cast("string")
    return F.struct(
        area.alias("area"), action.alias("action"), clean.alias("description"), machine_state(text).alias("machine_state"),
        safety_flag(text).alias("safety_flag"), number.alias("part_number"), interval.cast("int").alias("interval_hours"),
    )


def content_type(text: Column, heading: Column, chunk_type: Column) -> Column:
    head = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), F.substring(text, 1, 400)))

    def chain(h: Column) -> Column:
        out = F.when(chunk_type == "table_row", "table")
        for name, words in R.CONTENT_TYPES:
            out = out.when(any_match(h, words), name)
        return out.otherwise("procedure")

    return let(head, chain)


def is_heading(line: Column) -> Column:
    s = strip(line)
    plain = F.rlike(s, F.lit("^(?:" + R.HEADINGS[0] + ")"))
    rest = F.rlike(s, F.lit("(?iu)^(?:" + "|".join(R.HEADINGS[1:]) + ")"))
    return F.length(s).between(4, 120) & (plain | rest)


def useful_for_extraction(text: Column, chunk_type: Column) -> Column:
    """Long enough to hold a task, and no reference to a figure, table or page."""
    s = strip(F.coalesce(text, F.lit("")))
    return (F.length(s) >= F.when(chunk_type == "checkbox", 30).otherwise(80)) & ~F.rlike(s, F.lit(r"(?iU)^(?:fig(?:ure)?|table|see\s|refer to|page|p\.)\s"))


def classify_text(sample: Column) -> Column:
    """Maker, model, type, confidence, method and chapters of a manual from a sample of its text."""
    low = F.lower(F.coalesce(sample, F.lit("")))
    n = count_matches(low, R.KRONES_WORDS)
    ints = lambda *v: F.array(*map(F.lit, v))
    krones_chapters = F.when(F.contains(low, F.lit("contiform")), ints(12)).when(F.contains(low, F.lit("variopac")), ints(11, 12, 13)).when(F.contains(low, F.lit("shrink")), ints(9)).otherwise(ints(9, 12))
    found = F.transform(F.regexp_extract_all(low, F.lit(R.CHAPTER), F.lit(1)), lambda x: x.try_cast("int"))
    chapters = F.slice(F.array_distinct(found), 1, 3)
    maker = first_match(F.substring(low, 1, 1000), R.HEADER_MAKERS, "THIRD_PARTY")

    def result(maker, model, kind, confidence, chapters):
        return F.struct(maker.alias("manufacturer"), model.cast("string").alias("model"), F.lit(kind).alias("machine_type"), confidence.cast("double").alias("confidence"), F.lit("keyword").alias("method"), chapters.alias("detected_chapters"))

    tetra = F.when(F.contains(maker, F.lit("TETRA")), first_match(low, R.TETRA_MODELS, None))
    confidence = lambda start, step, hits, most: F.least(F.lit(most), F.round(F.lit(start) + hits * step, 6))
    return (
        F.when(n >= 1, result(F.lit("KRONES"), first_match(low, R.KRONES_MODELS, "Krones Machine"), "KRONES", confidence(0.5, 0.1, n, 0.95), krones_chapters))
        .when(any_match(low, R.EISBAR_WORDS), result(F.lit("EISBAR"), F.lit("DAS"), "THIRD_PARTY", F.lit(0.85), ints(9)))
        .when(any_match(low, R.CON_L3_WORDS), result(F.lit("CON L3"), F.lit("BOTTLE CODER"), "THIRD_PARTY", F.lit(0.85), ints(1)))
        .otherwise(result(maker, tetra, "THIRD_PARTY", confidence(0.3, 0.08, count_matches(low, R.MAINTENANCE_WORDS), 0.7), chapters))
    )


def _labels(hours: Column, suffix) -> Column:
    out = None
    for h, label in R.INTERVAL_LABELS.items():
        out = F.when(hours == h, suffix(label)) if out is None else out.when(hours == h, suffix(label))
    return out.otherwise(F.concat(hours.cast("string"), F.lit("hr")))


def interval_label(hours: Column) -> Column:
    return _labels(hours, lambda s: s)


def interval_file_label(hours: Column) -> Column:
    """The label fit for a file name."""
    return _labels(hours, lambda s: s.replace(" (", "_").replace(")", "").replace(" ", "_"))


def safe_name(name: Column) -> Column:
    """Upper-case machine name without umlauts and punctuation."""
    s = F.regexp_replace(F.translate(name, "äöüÄÖÜ_.", "aouAOU "), "ß", "ss")
    return F.upper(strip(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s\-]", ""), r"(?U)\s+", " ")))


def _machine(machine_id: Column, k: int, default: Column) -> Column:
    out = None
    for key, pair in R.MACHINE_NAMES.items():
        out = F.when(machine_id == key, pair[k]) if out is None else out.when(machine_id == key, pair[k])
    return out.otherwise(default)


def display_name(machine_id: Column, name: Column) -> Column:
    return _machine(machine_id, 0, safe_name(name))


def archive_stem(machine_id: Column, name: Column) -> Column:
    return _machine(machine_id, 1, F.replace(F.initcap(safe_name(name)), F.lit(" "), F.lit("_")))


def sheet_file_name(machine_id: Column, name: Column, hours: Column) -> Column:
    stem = F.translate(display_name(machine_id, name), " -", "__")
    return F.concat(F.lit("PM_"), stem, F.lit("_"), interval_file_label(hours), F.lit(".xlsx"))


def sheet_title(machine_id: Column, name: Column, hours: Column) -> Column:
    """Title of an interval's sheet: calendar labels stand in for hours."""
    label = interval_label(hours)
    head = F.concat(F.lit("CON L3 "), F.upper(display_name(machine_id, name)), F.lit(" "))
    return F.when(F.contains(F.lower(label), F.lit("hr")), F.concat(head, hours.cast("string"), F.lit(" HOURS PM"))).otherwise(F.concat(head, F.upper(label), F.lit(" PM")))


def machine_label(machine_id: Column, manufacturer: Column, filename: Column, generic: list[str] = ("", "GENERIC", "UNKNOWN")) -> Column:
    own = F.when(~F.upper(F.trim(F.coalesce(machine_id, F.lit("")))).isin(*generic), machine_id)
    stem = F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")
    return F.coalesce(own, F.nullif(manufacturer, F.lit("")), F.nullif(stem, F.lit("")), F.lit("EQUIPMENT"))


def title_case(text: Column) -> Column:
    """Every letter after something else than a letter in upper case, the others in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def function_area_label(verb: Column, area: Column, description: Column) -> Column:
    """Safety, General, or the verb with up to four words of the text, else with the area's component."""
    rest = F.when(F.startswith(description, verb), F.regexp_replace(F.substr(description, F.length(verb) + 1), r"^[ \-:.,]+|[ \-:.,]+$", "")).otherwise(description)
    words = F.slice(F.filter(F.split(strip(rest), r"\s+"), lambda w: w != ""), 1, 10)
    words = F.transform(words, lambda w: F.regexp_replace(w, r"[.,;:\-/]+$", ""))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*R.STOP_WORDS) & ~F.startswith(w, F.lit("(")))
    words = F.slice(words, 1, 4)
    component = None
    for k, v in R.COMPONENT_NAMES.items():
        component = F.when(area == k, v) if component is None else component.when(area == k, v)
    component = component.otherwise(title_case(area))
    named = F.when(F.size(words) > 0, title_case(F.array_join(words, " "))).otherwise(component)
    return F.when((area == "SAFETY") | verb.isin("LOCKOUT", "CONFIRM"), "Safety").when((area == "GENERAL") | (F.coalesce(verb, F.lit("")) == ""), "General").otherwise(F.concat(title_case(verb), F.lit(" "), named))


def manual_version(text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    found = [F.nullif(strip(F.regexp_extract(head, "(?i)" + p, 1)), F.lit("")) for p in R.VERSION_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def maintenance_chapter(text: Column, manufacturer: Column) -> Column:
    """Number of the chapter on maintenance and how it was found."""
    low = F.lower(text)
    made = lambda n, how: F.struct(n.cast("int").alias("chapter"), F.lit(how).alias("method"))
    named = lambda n: (manufacturer == "KRONES") & any_match(low, [f"chapter {n}", f"kapitel {n}", f"{n}. maintenance", f"{n} maintenance"])
    found = F.coalesce(
        F.regexp_extract(low, r"(\d+)[.\s]+(?:maintenance|service|inspection|lubrication|wartung|instandhaltung)", 1).try_cast("int"),
        F.regexp_extract(low, r"chapter\s+(\d+)[\s\S]{0,50}(?:maintenance|service|inspection)", 1).try_cast("int"),
    )
    return F.when(named(12), made(F.lit(12), "krones_auto")).when(named(11), made(F.lit(11), "krones_auto")).when(found.isNotNull(), made(found, "toc_pattern")).otherwise(made(F.lit(None), "not_found"))


def chapter_text(text: Column, chapter: Column) -> Column:
    """Text from the heading of a chapter to the next one, else from its first numbered section to the next chapter's, else the last 30 %."""
    n, m = chapter.cast("string"), (chapter + 1).cast("string")
    one = F.concat(F.lit(r"(?i)((?:chapter|kapitel)\s+"), n, F.lit(r"[\s\S]*?)(?=(?:chapter|kapitel)\s+"), m, F.lit(r"|\z)"))
    two = F.concat(F.lit("(?i)("), n, F.lit(r"\.[0-9][\s\S]*?)(?="), m, F.lit(r"\.[0-9]|\z)"))
    found = [F.nullif(F.regexp_substr(text, p), F.lit("")) for p in (one, two)]
    return F.coalesce(*found, F.substr(text, F.floor(F.length(text) * 0.7).cast("int") + 1))


def infer_machine_id(manufacturer: Column, model: Column, filename: Column) -> Column:
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    mfr, mod, name = up(manufacturer), up(model), up(filename)
    either = lambda words: any_match(mfr, words) | any_match(name, words)
    inside = lambda w: F.contains(mod, F.lit(w)) | F.contains(name, F.lit(w))
    krones = F.when(inside("SHRINK"), "SHRINK-TUNNEL-L3").when(inside("VARIOPAC"), "VARIOPAC-PRO-L3").when(inside("CONTIFORM"), "CONTIFORM-C3-L3").otherwise("VARIOPAC-PRO-L3")
    return (
        F.when(any_match(mfr, ["EISBAR", "DEHUMID"]) | F.contains(name, F.lit("DEHUMID")), "DEHUMIDIFIER-L3")
        .when(F.contains(mfr, F.lit("TETRA")) | any_match(name, ["TETRA", "TEM-", "TETRAPAK"]), "TETRAPAK-ASEPTIC-L3")
        .when(either(["HUSKY", "HYPET", "HPP5E", "HPET"]), "")
        .when(either(["CON L3", "CON-L3", "BOTTLE CODER", "BOTTLE CODING", "BOTTLECODER"]), "BOTTLECODER-L3")
        .when(either(["KRONES", "VARIOPAC", "CONTIFORM", "SHRINK"]), krones)
        .otherwise("")
    )


def is_tetra(manufacturer: Column, filename: Column) -> Column:
    return any_match(F.upper(F.coalesce(manufacturer, F.lit(""))), ["TETRA", "TEM"]) | any_match(F.upper(F.coalesce(filename, F.lit(""))), ["TETRA", "TEM-", "TETRAPAK"])


def is_hypet(manufacturer: Column, filename: Column) -> Column:
    return any_match(F.upper(F.coalesce(filename, F.lit(""))), ["HYPET", "HPET", "HPP5E", "HYPET5"]) | any_match(F.upper(F.coalesce(manufacturer, F.lit(""))), ["HUSKY", "HYPET"])


def guess_intervals(manufacturer: Column) -> Column:
    up, out = F.upper(F.coalesce(manufacturer, F.lit(""))), None
    for words, hours in R.USUAL_INTERVALS[:-1]:
        value = F.array(*map(F.lit, hours))
        out = F.when(any_match(up, words), value) if out is None else out.when(any_match(up, words), value)
    return out.otherwise(F.array(*map(F.lit, R.USUAL_INTERVALS[-1][1])))


def wide_description(action: Column, component: Column, label: Column, part: Column) -> Column:
    """Instruction for a row of a wide table: what, how before, how, how after."""
    low, number = F.lower(component), F.trim(F.coalesce(part, F.lit("")))
    use = F.when(~F.lower(number).isin("none", "-", ""), F.concat(F.lit(" USE PART NUMBER "), number, F.lit(" FOR REPLACEMENT."))).otherwise("")
    name = F.trim(F.concat(F.upper(component), F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(" "), label)).otherwise("")))

    def body(kind: str) -> Column:
        out = None
        for words, lines in R.WIDE_TEXTS[kind]:
            text = F.concat(F.lit(f" {lines[0]} {lines[1]}"), use if kind == "REPLACE" else F.lit(""), F.lit(f" {lines[2]}"))
            if not words:
                return out.otherwise(text)
            out = F.when(any_match(low, words), text) if out is None else out.when(any_match(low, words), text)
        return out

    text = F.when(action == "REPLACE", F.concat(F.lit("REPLACE "), name, F.lit("."), body("REPLACE"))).otherwise(F.concat(F.lit("CHECK "), name, F.lit("."), body("CHECK")))
    return F.substring(text, 1, 500)


def document_signature(machine_id: Column, hours: Column, work_order: Column, generated_at: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", machine_id, hours.cast("string"), work_order, generated_at), 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sanitize_filename(name: Column) -> Column:
    s = F.translate(F.regexp_replace(name, r"[^\p{L}\p{N}\-_. ]", ""), " ", "_")
    return F.coalesce(F.nullif(F.substring(s, 1, 200), F.lit("")), F.lit("file"))


def json_chapters(text: Column) -> Column:
    return F.from_json(text, "array<int>")


def json_task_count(text: Column) -> Column:
    return F.coalesce(F.json_array_length(F.coalesce(text, F.lit("[]"))), F.lit(0))


def json_detail(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")
