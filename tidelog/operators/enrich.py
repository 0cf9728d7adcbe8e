"""Enrichment: bound context, trace identifiers, spans, source locations, errors and durations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import ERROR_INFO


def merge_context(*maps: Column) -> Column:
    """Later maps win. Independent of the session's policy for duplicate keys."""
    out = maps[0]
    for late in maps[1:]:
        out = _merge_two(out, late)
    return out


def _merge_two(early: Column, late: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    early, late = F.coalesce(early, none), F.coalesce(late, none)
    return F.map_concat(F.map_filter(early, lambda k, _: ~F.map_contains_key(late, k)), late)


def literal_map(values: Mapping[str, object]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])


def bind(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Bound values are the logger's context: a record's own context wins over them."""
    return df.withColumn("context", merge_context(literal_map(values), F.col("context")))


def with_fields(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """A call's context: wins over what is there."""
    return df.withColumn("context", merge_context(F.col("context"), literal_map(values)))


def unbind(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumn("context", F.map_filter("context", lambda k, _: ~k.isin(*names)))


def clear_bindings(df: DataFrame) -> DataFrame:
    return df.withColumn("context", literal_map({}))


def scoped(df: DataFrame, module: str) -> DataFrame:
    return df.withColumn("module", F.lit(module))


def with_trace(df: DataFrame, trace_id: str | None = None, span_id: str | None = None, correlation_id: str | None = None) -> DataFrame:
    """Set (None: clear) the trace columns."""
    return df.withColumns({n: F.lit(v).cast("string") for n, v in (("trace_id", trace_id), ("span_id", span_id), ("correlation_id", correlation_id))})


def trace_id(key: Column) -> Column:
    """16 bytes in hex, from the key: the same in every run."""
    return F.md5(F.concat(F.lit("trace-"), key.cast("string")).cast("binary"))


def span_id(key: Column) -> Column:
    """8 bytes in hex."""
    return F.substring(F.md5(F.concat(F.lit("span-"), key.cast("string")).cast("binary")), 1, 16)


def with_spans(df: DataFrame, trace: str, order: str) -> DataFrame:
    """Each record of a trace is a span whose parent is the record before it."""
    name = F.concat_ws("-", F.col(trace).cast("string"), F.col(order).cast("string"))
    own = Window.partitionBy(trace).orderBy(order)
    spans = df.withColumns({"trace_id": trace_id(F.col(trace)), "span_id": span_id(name)})
    return spans.withColumn("parent_span_id", F.lag("span_id").over(own))


def span_durations(df: DataFrame, trace: str, time_ms: str, order: str) -> DataFrame:
    """Add duration_ns: up to the next record of the trace; null for the last."""
    later = F.lead(time_ms).over(Window.partitionBy(trace).orderBy(time_ms, order))
    return df.withColumn("duration_ns", F.when(later.isNotNull(), F.greatest(later - F.col(time_ms), F.lit(0)) * 1_000_000))


def with_duration(df: DataFrame, start_ns: Column, end_ns: Column) -> DataFrame:
    return df.withColumn("duration_ns", F.greatest(end_ns - start_ns, F.lit(0)))


def with_error(df: DataFrame, name: Column, message: Column, stack_trace: Column | None = None, code: Column | None = None) -> DataFrame:
    none = F.lit(None)
    made = F.struct(name.alias("name"), message.alias("message"), (stack_trace if stack_trace is not None else none).cast("string").alias("stack_trace"), (code if code is not None else none).cast("int").alias("code"))
    return df.withColumn("error_info", F.when(name.isNotNull(), made).cast(ERROR_INFO))


def source_location(df: DataFrame, filename: bool = True, line: bool = True, function: bool = True) -> DataFrame:
    """Clear what isn't to be shown."""
    off = {n: F.lit(None).cast(df.schema[n].dataType) for n, on in (("filename", filename), ("line", line), ("function", function)) if not on and n in df.columns}
    return df.withColumns(off) if off else df


def keep_stack_traces(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Only records of ERROR and CRITICAL keep theirs."""
    return df.withColumn("stack_trace", F.when(F.col("level").isin("ERROR", "CRITICAL") & F.lit(enabled), F.col("stack_trace")))


def describe(df: DataFrame) -> DataFrame:
    """Predicates about what a record has."""
    return df.withColumns(
        {
            "has_custom_level": F.col("custom_level_name").isNotNull(),
            "has_context": F.coalesce(F.size("context"), F.lit(0)) > 0,
            "context_count": F.greatest(F.coalesce(F.size("context"), F.lit(0)), F.lit(0)),
            "has_stack_trace": F.col("stack_trace").isNotNull(),
            "has_error": F.col("error_info").isNotNull(),
            "has_tracing": F.col("trace_id").isNotNull() | F.col("span_id").isNotNull(),
        }
    )

