"""Running values and numbers over long groups, spread by ranges of their order.

A running value over a group (pages of a manual, say) needs no task that sees the whole group: each range of the
order is summed up in one row, the rows of a group's ranges are scanned, and what comes into a range is added to
the running values inside it. Only the rows of the ranges meet by group, one for a thousand rows or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Steps of the order that one range takes.
RANGE = 1024
#: Rows of keys up to which a table is sent to all executors (some tens of MB).
BROADCAST_ROWS = 1_000_000


def bounded(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, to be broadcast if it has at most ``most`` rows; it should be a written table of keys, which is counted without being made."""
    return F.broadcast(table) if table.count() <= most else table


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` of a table in fewer files than there are cores are dealt out, as a file may be a single task; other tables are read where they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *by) if len(rows.inputFiles()) < cores else rows


def carried(rows: DataFrame, group: list[str], order: str, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, size: int = RANGE) -> DataFrame:
    """``rows`` with running values over the rows of their group that come before: sums (0 at first) and last values that aren't null.

    ``sums`` and ``lasts`` name a new column and the column it runs over. ``order`` is an integer that tells the rows
    of a group apart. ``rows`` are read twice and should be a written table. Rows without an order come first and
    have no range of their own.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = rows.withColumn("range_", F.floor(F.col(order) / size))
    here = W.partitionBy(*group, "range_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy(*group, "range_").agg(
        *[F.sum(c).alias(f"{n}_in") for n, c in sums.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{n}_in") for n, c in lasts.items()],
    )
    before = W.partitionBy(*group).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    into = per.select(
        *group, "range_",
        *[F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).alias(f"{n}_in") for n in sums],
        *[F.last(f"{n}_in", ignorenulls=True).over(before).alias(f"{n}_in") for n in lasts],
    )
    local = {n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()}
    out = rows.withColumns(local).join(into, [*group, "range_"])
    whole = {n: F.col(n) + F.col(f"{n}_in") for n in sums} | {n: F.coalesce(n, f"{n}_in") for n in lasts}
    return out.withColumns(whole).drop("range_", *[f"{n}_in" for n in whole])


def numbered(rows: DataFrame, group: list[str], coarse: list[Column], fine: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 within the group, in order of ``coarse``, then ``fine``.

    Rows are counted by ``coarse``, the counts of a group are summed up in order, and rows are numbered within
    each ``coarse`` alone. ``coarse`` must not contradict ``fine``. Nulls come first. ``rows`` are read twice and should be a written table.
    """
    # nulls are made comparable, so that plain columns are the key of grouping, numbering and join alike
    whole = {f"c{i}_": c for i, c in enumerate(coarse)}
    flat = {f"{n}k": F.coalesce(c.cast("string"), F.lit("")) for n, c in whole.items()} | {f"{n}n": c.isNull() for n, c in whole.items()}
    rows, key = rows.withColumns(whole | flat), [*group, *flat]
    per = rows.groupBy(*key, *whole).agg(F.count("*").alias("n_"))
    before = W.partitionBy(*group).orderBy(*whole).rowsBetween(W.unboundedPreceding, -1)
    into = per.select(*key, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(W.partitionBy(*key).orderBy(*fine))
    rows = rows.withColumn("own_", own).join(into, key).withColumn(name, F.col("before_") + F.col("own_"))
    return rows.drop("own_", "before_", *whole, *flat)
