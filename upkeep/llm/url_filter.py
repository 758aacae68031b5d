"""URL rules by a sort-merge range join, in DataFrame functions alone.

A host's labels are reversed, so a rule's host is a prefix of the keys of all its
subdomains, and a rule's path is a prefix of the paths it fits: both are intervals of keys, and intervals
of prefixes either nest or don't meet. Intervals and keys are sorted together and swept: a start pushes its rule on
a stack, an end pops it, and a key sees the rules that are open. Hosts are swept first; then, for each open host
of a URL's stack, the paths.

A sweep is spread by ranges of keys. What is open where a range begins (the depth and the last start of each
depth) comes from one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from upkeep.llm import scratch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END, START, POINT = 0, 1, 2

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a byte that sorts before all others of a name."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")).cast("binary")


def _binary(hexadecimal: str) -> Column:
    return F.expr(f"X'{hexadecimal}'")


def sweep(points: DataFrame, spans: DataFrame, salt: str) -> DataFrame:
    """``points`` with ``stack``, the ``item`` of each span whose prefix ``lo`` their ``key`` starts with, shortest prefix first.

    ``lo`` must be distinct; ``salt`` is a column of the points that tells those with one key apart, so that ranges can
    split them. A prefix ends before its own bytes followed by 0xFF, which UTF-8 doesn't hold.
    """
    item = spans.schema["item"].dataType
    own = F.struct(*points.columns)
    kind = points.select(own.alias("p")).schema["p"].dataType
    no_point = F.lit(None).cast(kind)
    events = (
        points.select("key", F.lit(POINT).alias("kind"), F.col(salt).cast("string").alias("salt"), own.alias("point"), F.lit(None).cast(item).alias("item"))
        .unionByName(spans.select(F.col("lo").alias("key"), F.lit(START).alias("kind"), F.lit("").alias("salt"), no_point.alias("point"), "item"))
        .unionByName(spans.select(F.concat("lo", _binary("FF")).alias("key"), F.lit(END).alias("kind"), F.lit("").alias("salt"), no_point.alias("point"), F.lit(None).cast(item).alias("item")))
    )
    # the ranges are drawn once; later jobs must see the same
    rows = scratch.table(events.repartitionByRange("key", "kind", "salt").withColumn("part", F.spark_partition_id()), "sweep")
    upto = W.partitionBy("part").orderBy("key", "kind", "salt").rowsBetween(W.unboundedPreceding, 0)
    move = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range
    bounds = rows.where(F.col("kind") < POINT).select("key", "kind", "salt", "item", "part")
    per = bounds.groupBy("part").agg(F.sum(move).alias("moved"))
    into = per.select("part", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("open"))
    starts = bounds.withColumn("local", F.sum(move).over(upto)).where(F.col("kind") == START).join(F.broadcast(into), "part")
    starts = scratch.table(starts.select("part", "key", "item", (F.col("local") + F.col("open")).alias("depth")), "starts")
    deepest = starts.agg(F.max("depth")).first()[0] or 0
    depths = range(1, deepest + 1)
    at = lambda d, value: F.when(F.col("depth") == d, F.col(value))
    last = starts.groupBy("part").agg(F.lit(1).alias("any"), *[F.max_by(at(d, "item"), at(d, "key")).alias(f"last{d}") for d in depths])
    carry = rows.select("part").distinct().join(F.broadcast(per), "part", "left").join(F.broadcast(last), "part", "left")
    carry = carry.select("part", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("open"), *[F.last(f"last{d}", ignorenulls=True).over(before).alias(f"from{d}") for d in depths])
    rows = rows.join(F.broadcast(carry), "part").withColumn("depth", F.col("open") + F.sum(move).over(upto))
    opened = lambda d: F.last(F.when((F.col("kind") == START) & (F.col("depth") == d), F.col("item")), ignorenulls=True).over(upto)
    rows = rows.withColumns({f"top{d}": F.coalesce(opened(d), F.col(f"from{d}")) for d in depths}).where(F.col("kind") == POINT)
    stack = F.slice(F.array(*[F.col(f"top{d}") for d in depths]), F.lit(1), F.col("depth").cast("int")) if deepest else F.array()
    return rows.select("point.*", stack.cast(f"array<{item.simpleString()}>").alias("stack"))


def _rules(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Distinct rules with their keys; of rules with one host and path, one that blocks wins."""
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rows = rows.groupBy("host", "path").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
    return scratch.table(rows.withColumn("zone", host_key(F.col("host"))), "rules")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` have ``host, path, verdict`` (allow or block). A rule fits the URLs of its host and of all subdomains whose path starts
    with the rule's; the longest (of equal ones that with the longer host) gives the verdict and is shown as host and path
    together. URLs that no rule fits get ``default`` and a null ``rule``. Null URLs and those without ``://`` have an empty
    host and path, which no rule fits. Rules without a host are ignored; hosts are lower-cased in A-Z only. Rows that repeat an id, null ones
    included, come out as often as they went in, and a URL is judged once however many pages have it. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    known = _rules(pages.sparkSession, rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = scratch.table(rows.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one"), "urls")
    hosts = urls.groupBy("host").agg(F.lit(1).alias("one")).select("host", host_key(F.col("host")).alias("key"))
    zones = known.groupBy(F.col("zone").alias("lo")).agg(F.struct(F.min("zone").alias("zone")).alias("item"))
    open_ = sweep(hosts, zones, "host").select("host", F.explode("stack.zone").alias("zone"))
    key = lambda zone, path: F.concat(F.col(zone), _binary("00"), F.col(path).cast("binary"))
    points = urls.join(open_, "host").select("host", "path", key("zone", "path").alias("key"))
    spans = known.select(key("zone", "path").alias("lo"), F.struct(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").alias("item"))
    fits = lambda r: ((F.col("host") == r["r_host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["r_host"]))) & F.startswith(F.col("path"), r["r_path"])
    rank = lambda r: F.struct((F.length(r["r_host"]) + F.length(r["r_path"])).alias("n"), F.length(r["r_host"]).alias("h"), F.concat(r["r_host"], r["r_path"]).alias("rule"), r["verdict"].alias("verdict"))
    found = sweep(points, spans, "host").select("host", "path", F.array_max(F.transform(F.filter("stack", fits), rank)).alias("r"))
    judged = found.where("r is not null").groupBy("host", "path").agg(F.max("r").alias("r"))
    return rows.join(judged, ["host", "path"], "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, r.rule, coalesce(r.v, 'allow') AS verdict
FROM split LEFT JOIN (SELECT u.host, u.path, arg_max(concat(h, p), length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
    FROM (SELECT DISTINCT host, path FROM split) u JOIN rules ON (u.host = h OR ends_with(u.host, concat('.', h))) AND starts_with(u.path, p) GROUP BY ALL) r USING (host, path)
"""
