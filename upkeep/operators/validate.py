"""Row-level constraints: which rules a row breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _split(df: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break; a null breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    rows = df.withColumn("broken", broken)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)


def validate_task_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    length = lambda c: F.length(c).between(1, 64)
    return _split(df, [
        ("task_no", F.col("task_no") >= 10), ("area", length("area")), ("action", length("action")), ("description", F.length("description") >= 1),
        ("machine_state", F.col("machine_state").isin("RUNNING", "STOPPED", "POWERED_OFF")),
    ])


def validate_machine_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, [
        ("machine_id", F.rlike("machine_id", F.lit(r"^[A-Z0-9][A-Z0-9\-]{0,63}$"))), ("name", F.length("name").between(1, 128)),
        ("manufacturer", F.length("manufacturer").between(1, 64)), ("machine_type", F.col("machine_type").isin("KRONES", "THIRD_PARTY")),
    ])


def validate_hours_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, [("current_hours", F.col("current_hours") >= 0)])
