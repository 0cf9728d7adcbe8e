"""Records from a program's own calls, as rows of the log schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import LOG_SCHEMA, PRIORITY

#: Other names of the level calls.
CALLS = {"warn": "WARNING", "error": "ERROR", "err": "ERROR", "crit": "CRITICAL", "note": "NOTICE", "panic": "FATAL", "failure": "FAIL"} | {n.lower(): n for n in PRIORITY}


class InvalidLevel(ValueError):
    """No level of that name."""


def record(call: str, message: str, custom: Mapping[str, tuple[int, str]] | None = None, at: datetime | None = None, **fields: object) -> dict[str, object]:
    """One record: ``call`` is a level's call (``info``, ``warn`` ..) or the name of a custom level."""
    at = at or datetime.now(timezone.utc)
    out: dict[str, object] = {n: None for n in LOG_SCHEMA.names} | {"ts": at, "ts_ms": int(at.timestamp() * 1000), "message": message} | fields
    if custom and call in custom:
        priority, color = custom[call]
        return out | {"level": next((n for n, p in PRIORITY.items() if p == priority), "INFO"), "priority": priority, "custom_level_name": call, "custom_level_color": color}
    level = CALLS.get(call)
    if level is None:
        raise InvalidLevel(call)
    return out | {"level": level, "priority": PRIORITY[level]}


def called(df: DataFrame, call: Column, custom: Mapping[str, tuple[int, str]] | None = None) -> DataFrame:
    """Levels by the name of a call, a row each: as ``record`` for a table of calls. ``valid`` is false, and level and priority
    are null, where no level has that name."""
    of = {c: (n, PRIORITY[n], None, None) for c, n in CALLS.items()}
    of |= {c: (next((n for n, q in PRIORITY.items() if q == p), "INFO"), p, c, color) for c, (p, color) in (custom or {}).items()}
    kinds = ("string", "int", "string", "string")
    known = F.create_map(*[x for c, made in of.items() for x in (F.lit(c), F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(made, kinds, _LEVEL_FIELDS, strict=True)]))])
    found = F.try_element_at(known, F.coalesce(call, F.lit("")))
    return df.withColumn("_level", found).withColumns({n: F.col(f"_level.{n}") for n in _LEVEL_FIELDS} | {"valid": F.col("_level").isNotNull()}).drop("_level")


_LEVEL_FIELDS = ("level", "priority", "custom_level_name", "custom_level_color")


def records(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(n) for n in LOG_SCHEMA.names) for r in rows], LOG_SCHEMA)


def logged(df: DataFrame, level: str, fmt: str, *columns: str) -> DataFrame:
    """A record of ``level`` for each row, with a printf-style message."""
    return df.withColumns({"level": F.lit(level), "priority": F.lit(PRIORITY[level]), "message": F.format_string(fmt, *columns)})


def errors(df: DataFrame, message: Column, name: Column) -> DataFrame:
    """Records of caught errors; they bypass gate, sampler, redaction, filter and rules."""
    from tidelog.operators.enrich import with_error

    rows = df.withColumns({"level": F.lit("ERROR"), "priority": F.lit(PRIORITY["ERROR"]), "message": message})
    return with_error(rows, name, message)


def timed(df: DataFrame, level: str, message: Column, start_ns: Column, end_ns: Column) -> DataFrame:
    from tidelog.operators.enrich import with_duration

    return with_duration(df.withColumns({"level": F.lit(level), "priority": F.lit(PRIORITY[level]), "message": message}), start_ns, end_ns)


def diagnostics(spark: SparkSession) -> DataFrame:
    """One INFO record about the driver's machine - system, processor, memory, drives - with ``diag.*`` context."""
    import os
    import platform
    import shutil

    facts = {"diag.os": platform.system(), "diag.arch": platform.machine(), "diag.cpu": platform.processor() or platform.machine(), "diag.cores": str(os.cpu_count())}
    if hasattr(os, "sysconf") and "SC_PHYS_PAGES" in os.sysconf_names:
        page = os.sysconf("SC_PAGE_SIZE")
        facts |= {"diag.ram_total_mb": str(page * os.sysconf("SC_PHYS_PAGES") >> 20), "diag.ram_avail_mb": str(page * os.sysconf("SC_AVPHYS_PAGES") >> 20)}
    for k, drive in enumerate(os.listdrives() if hasattr(os, "listdrives") else ["/"]):
        used = shutil.disk_usage(drive)
        facts |= {f"diag.drive.{k}.name": drive, f"diag.drive.{k}.total_bytes": str(used.total), f"diag.drive.{k}.free_bytes": str(used.free)}
    return records(spark, [record("info", "system diagnostics", context=facts)])
