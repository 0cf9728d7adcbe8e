"""Metrics of records: volumes, levels, errors, throughput, latency, histograms, thresholds and exports.

All are plain aggregates: Spark combines them within tasks and shuffles one row for each group and task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import rate
from tidelog.schema import LEVELS

#: Inclusive upper bounds of the latency histogram in ns; the last bucket is unbounded.
BOUNDS = [n * 10**e for e in (3, 4, 5, 6, 7, 8) for n in (1, 2, 5)] + [10**9]


def _bytes() -> Column:
    return F.octet_length("message").cast("long")


def totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_records"), F.coalesce(F.sum(_bytes()), F.lit(0)).alias("total_bytes"))


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("records"), F.sum(_bytes()).alias("bytes"))


def level_array(df: DataFrame) -> DataFrame:
    """One row: the counts of the ten levels, in order of priority."""
    return df.agg(F.array(*[F.count_if(F.col("level") == name) for name, _, _ in LEVELS]).alias("level_counts"))


def rates(df: DataFrame, error: Column, dropped: Column) -> DataFrame:
    """Dropped records are not part of the total."""
    kept = ~dropped
    n, errors, drops = F.count_if(kept), F.count_if(kept & error), F.count_if(dropped)
    n_bytes = F.coalesce(F.sum(F.when(kept, _bytes())), F.lit(0))
    uptime = F.coalesce(F.max("ts_ms") - F.min("ts_ms"), F.lit(0))
    return df.agg(
        n.alias("total_records"),
        n_bytes.alias("total_bytes"),
        errors.alias("errors"),
        drops.alias("dropped"),
        uptime.alias("uptime_ms"),
        rate(n, uptime / 1000.0).alias("records_per_second"),
        rate(n_bytes, uptime / 1000.0).alias("bytes_per_second"),
        rate(errors, n).alias("error_rate"),
        rate(drops, n).alias("drop_rate"),
    )


def latency(df: DataFrame, ns: str, by: Sequence[str] = ()) -> DataFrame:
    """The average is an integer over all records, timed or not, divided as integers. Under ANSI mode, Spark's default, a sum
    beyond 2**63 ns is an error."""
    total, n = F.coalesce(F.sum(ns), F.lit(0)), F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("records"), total.alias("latency_sum_ns"), F.coalesce(F.min(ns), F.lit(0)).alias("latency_min_ns"), F.coalesce(F.max(ns), F.lit(0)).alias("latency_max_ns"), F.coalesce(F.call_function("div", total, F.nullif(n, F.lit(0))), F.lit(0)).alias("latency_avg_ns"))


def bucket(ns: Column) -> Column:
    """The number, 0 to 19, of the bucket of a latency."""
    out = None
    for k, bound in enumerate(BOUNDS):
        out = F.when(ns <= bound, F.lit(k)) if out is None else out.when(ns <= bound, F.lit(k))
    return out.otherwise(F.lit(len(BOUNDS)))


def histogram(df: DataFrame, ns: str) -> DataFrame:
    """All buckets, also the empty ones."""
    counted = df.where(F.col(ns).isNotNull()).groupBy(bucket(F.col(ns)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(k, b) for k, b in enumerate([*BOUNDS, None])], "bucket int, upper_ns long")
    return every.join(counted, "bucket", "left").select("bucket", "upper_ns", F.coalesce("n", F.lit(0)).alias("n"))


def per_sink(df: DataFrame, sink: str = "sink") -> DataFrame:
    n, errors = F.count(F.lit(1)), F.count_if(F.col("write_failed"))
    return df.groupBy(sink).agg(n.alias("records_written"), F.sum(_bytes()).alias("bytes_written"), errors.alias("write_errors"), rate(errors, n).alias("error_rate"), rate(F.sum(_bytes()), n).alias("avg_bytes"))


def throughput(df: DataFrame, sink: str = "sink") -> DataFrame:
    """Bytes and records a second of each sink, over the time from its first record to its last."""
    seconds = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    return df.groupBy(sink).agg(rate(F.count(F.lit(1)), seconds).alias("records_per_second"), rate(F.sum(_bytes()), seconds).alias("bytes_per_second"))


def line_sizes(df: DataFrame, line: Column) -> DataFrame:
    """One row: how many lines were rendered, their bytes, and their average size."""
    n, size = F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(line).cast("long")), F.lit(0))
    return df.agg(n.alias("lines"), size.alias("bytes"), rate(size, n).alias("avg_bytes"))


def over_thresholds(snapshot: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """A flag for each limit that its column is strictly above."""
    return snapshot.withColumns({f"{c}_exceeded": F.col(c) > F.lit(v) for c, v in limits.items()})


def history(df: DataFrame, period: Column, last: int) -> DataFrame:
    """Snapshots by period; the last so many stay."""
    shots = df.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("records"), F.sum(_bytes()).alias("bytes"))
    return shots.orderBy(F.desc("period")).limit(last)


def summary(df: DataFrame) -> DataFrame:
    """Sizes and rates of a logger's output, one row."""
    n, n_bytes = F.count(F.lit(1)), F.coalesce(F.sum(_bytes()), F.lit(0))
    seconds = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    return df.agg(n.alias("records"), rate(n, seconds).alias("records_per_second"), rate(n_bytes, n).alias("avg_bytes_per_record"))


def extremes(df: DataFrame, name: str, value: str) -> DataFrame:
    """One row: which ``name`` has the most and the least ``value``, and these; ties by name. Folded within tasks first."""
    pair = F.struct(value, name)
    return df.agg(F.max(pair).alias("most"), F.min(pair).alias("least")).select(
        F.col(f"most.{name}").alias("most"), F.col(f"most.{value}").alias("most_value"), F.col(f"least.{name}").alias("least"), F.col(f"least.{value}").alias("least_value")
    )


def queue_depth(df: DataFrame, order: Sequence[str], delta: Column, by: Sequence[str] = ()) -> DataFrame:
    """The greatest depth of a queue per group, from its entries (+1) and exits (-1) in order."""
    depth = F.sum("_d").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_d", delta).withColumn("_depth", depth).groupBy(*by).agg(F.max("_depth").alias("max_depth"))


def async_stats(df: DataFrame, dropped: Column, latency: Column, by: Sequence[str] = ()) -> DataFrame:
    """A queue's figures: average latency of what was written, and drops as a share of what was queued."""
    n, drops = F.count(F.lit(1)), F.count_if(dropped)
    written = n - drops
    return df.groupBy(*by).agg(n.alias("queued"), drops.alias("dropped"), rate(drops, n).alias("drop_rate"), rate(F.sum(F.when(~dropped, latency)), written).alias("avg_latency"))


def pool_stats(df: DataFrame, wait_ns: Column, exec_ns: Column, failed: Column, threads: int, by: Sequence[str] = ()) -> DataFrame:
    """A pool's figures: average wait and run time, tasks a second of run time, use of the threads, share of successes
    (1 without tasks)."""
    n, ran = F.count(F.lit(1)), F.coalesce(F.sum(exec_ns), F.lit(0))
    success = F.when(n == 0, F.lit(1.0)).otherwise(1 - rate(F.count_if(failed), n))
    return df.groupBy(*by).agg(
        n.alias("tasks"), rate(F.sum(wait_ns), n).alias("avg_wait_ns"), rate(ran, n).alias("avg_exec_ns"), rate(n, ran / F.lit(1e9)).alias("throughput"),
        rate(ran, (ran + F.coalesce(F.sum(wait_ns), F.lit(0))) * threads).alias("utilization"), success.alias("success_rate"),
    )


def level_breakdown(df: DataFrame) -> DataFrame:
    """One line: the levels that occur, with their counts."""
    parts = F.array(*[F.struct(F.lit(name).alias("name"), F.count_if(F.col("level") == name).alias("n")) for name, _, _ in LEVELS])
    shown = F.transform(F.filter(parts, lambda p: p["n"] > 0), lambda p: F.concat(F.lit(" "), p["name"], F.lit(":"), p["n"].cast("string")))
    return df.agg(shown.alias("p")).select(F.concat(F.lit("Level Breakdown:"), F.when(F.size("p") > 0, F.array_join("p", ",")).otherwise(F.lit(" (none)"))).alias("breakdown"))


def export(snapshot: DataFrame, kind: str, prefix: str = "tidelog") -> DataFrame:
    """A snapshot of ``rates`` as one text: text, json, prometheus or statsd."""
    c = {n: F.col(n) for n in ("total_records", "total_bytes", "dropped", "errors", "uptime_ms", "records_per_second", "bytes_per_second")}
    two = lambda n: F.format_string("%.2f", c[n])
    text = lambda n: c[n].cast("string")
    if kind == "json":
        parts = [F.lit('{"total_records":'), text("total_records"), F.lit(',"total_bytes":'), text("total_bytes"), F.lit(',"dropped":'), text("dropped"), F.lit(',"errors":'), text("errors")]
        parts += [F.lit(',"uptime_ms":'), text("uptime_ms"), F.lit(',"rps":'), two("records_per_second"), F.lit(',"bps":'), two("bytes_per_second"), F.lit("}")]
        return snapshot.select(F.concat(*parts).alias("line"))
    if kind == "prometheus":
        lines = []
        for name, kind_, shown, help_ in (
            ("records_total", "counter", text("total_records"), "Total log records"),
            ("bytes_total", "counter", text("total_bytes"), "Total bytes logged"),
            ("dropped_total", "counter", text("dropped"), "Dropped records"),
            ("errors_total", "counter", text("errors"), "Error count"),
            ("records_per_second", "gauge", two("records_per_second"), "Records per second"),
        ):
            lines += [F.lit(f"# HELP {prefix}_{name} {help_}"), F.lit(f"# TYPE {prefix}_{name} {kind_}"), F.concat(F.lit(f"{prefix}_{name} "), shown)]
        return snapshot.select(F.explode(F.array(*lines)).alias("line"))
    if kind == "statsd":
        lines = [F.concat(F.lit(f"{prefix}.{n}:"), v, F.lit(f"|{k}")) for n, v, k in (("records.total", text("total_records"), "c"), ("bytes.total", text("total_bytes"), "c"), ("dropped.total", text("dropped"), "c"), ("errors.total", text("errors"), "c"), ("rps", two("records_per_second"), "g"))]
        return snapshot.select(F.explode(F.array(*lines)).alias("line"))
    if kind == "text":
        shown = [("Total Records: ", text("total_records"), ""), ("Total Bytes: ", text("total_bytes"), ""), ("Dropped: ", text("dropped"), ""), ("Errors: ", text("errors"), ""), ("Uptime: ", text("uptime_ms"), "ms"), ("Rate: ", two("records_per_second"), " records/sec"), ("Throughput: ", two("bytes_per_second"), " bytes/sec")]
        return snapshot.select(F.explode(F.array(F.lit("Metrics"), *[F.concat(F.lit(f"  {a}"), v, F.lit(b)) for a, v, b in shown])).alias("line"))
    raise ValueError(f"unknown export {kind!r}")
