"""Levels as expressions: names, priorities, predicates, custom levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import LEVELS, PRIORITY


def _case(on: Column, table: Mapping[object, object]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(on == F.lit(k), F.lit(v)) if out is None else out.when(on == F.lit(k), F.lit(v))
    return out


def priority_of(level: Column, custom: Mapping[str, int] | None = None) -> Column:
    """The priority of a level's name (exact, upper case); null for unknown names."""
    return _case(level, PRIORITY | dict(custom or {}))


def level_of(priority: Column) -> Column:
    """The name of a priority; an exact match, else null."""
    return _case(priority, {p: n for n, p, _ in LEVELS})


def color_of(level: Column) -> Column:
    return _case(level, {n: c for n, _, c in LEVELS})


def index_of(level: Column) -> Column:
    """The place of a level in reports, 0 to 9."""
    return _case(level, {n: i for i, (n, _, _) in enumerate(LEVELS)})


def at_least(priority: Column, level: str) -> Column:
    return priority >= PRIORITY[level]


def more_severe(priority: Column, level: str) -> Column:
    return priority > PRIORITY[level]


def is_error(priority: Column) -> Column:
    return priority >= PRIORITY["ERROR"]


def is_warning(priority: Column) -> Column:
    return priority == PRIORITY["WARNING"]


def is_debug(priority: Column) -> Column:
    return priority.isin(PRIORITY["DEBUG"], PRIORITY["TRACE"])


def nearest_priority(priority: int, fallback: str) -> int:
    """A standard priority as it is; any other becomes that of the fallback level."""
    return priority if priority in PRIORITY.values() else PRIORITY[fallback]


def display_name(custom: Column, level: Column) -> Column:
    return F.coalesce(custom, level)


def display_color(custom: Column, level: Column) -> Column:
    return F.coalesce(custom, color_of(level))


def level_table(spark: SparkSession, custom: Mapping[str, tuple[int, str]] | None = None) -> DataFrame:
    """The level dimension (level, level_priority, level_color) with custom levels; a few rows, by construction."""
    rows = [*LEVELS, *((n, p, c) for n, (p, c) in (custom or {}).items())]
    return spark.createDataFrame(rows, "level string, level_priority int, level_color string")


def resolve_custom(df: DataFrame, name: str, custom: Mapping[str, tuple[int, str]]) -> DataFrame:
    """Look custom level names up; a name that is not registered is an error, as when logging at it."""
    known = df.sparkSession.createDataFrame([(n, p, c) for n, (p, c) in custom.items()], "custom_level_name string, custom_priority int, custom_level_color string")
    looked_up = df.withColumn("custom_level_name", F.col(name)).join(F.broadcast(known), "custom_level_name", "left")
    checked = F.when(F.col("custom_level_name").isNotNull() & F.col("custom_priority").isNull(), F.raise_error(F.concat(F.lit("unknown level "), F.col("custom_level_name")))).otherwise(F.col("custom_priority"))
    return looked_up.withColumn("custom_priority", checked.cast("int"))
