"""Spans that start and end, nested: which span is open at a record, what its parent is, and how long it took.

A record may start a span, end the innermost open one of its trace, or neither. Starting puts the span inside the one that is
open; ending restores the span that was open before. An end without an open span changes nothing, and a span without an end stays
open. Order in a trace is (time, unique id).

This is bracket matching, in windows and without one task for a long trace. Rows are dealt into ordered blocks; a block of a
trace is summed up by two numbers, its starts less its ends and the lowest depth it reaches, and these compose: a running sum and a
running minimum over a trace's blocks give the depth that each block begins at. Then every record knows its depth, and the
span it is in is the last one that started one level up. That start is in the record's own block, or it is the last one of that level in
an earlier block: only traces that go on from block to block, at most two for each block, need this second step, with a row for a
block and level.

Defined cases. Records without a trace are one trace. A null time comes first, and gives no duration. Depth counts from 0. Times that run
backwards can't be: they are the order. Empty tables give empty tables. Ids must be unique in a trace: of equal ones, any may come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocks import in_blocks

ADDED = ("is_start", "is_end", "span", "parent_span", "span_depth", "span_start_ms", "duration_ns")


def open_spans(df: DataFrame, starts: Column, ends: Column, trace: Sequence[str], time_ms: str, id_column: str, keep: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """A row for each record: trace, time, id, the columns ``keep``, and

    ``is_start``, ``is_end``; ``span``: for a start its own (its id), for an end the one it ends, else the one that is open (null: none);
    ``parent_span``: of a start; ``span_depth``: the span's depth, null without one; ``span_start_ms``; ``duration_ns``: of an end.
    """
    names = list(dict.fromkeys([*trace, time_ms, id_column, *keep]))
    started = F.coalesce(starts, F.lit(False))
    rows = df.select(
        F.struct(*trace).alias("_trace") if trace else F.struct(F.lit(0).alias("all")).alias("_trace"),
        F.col(time_ms).cast("long").alias("_at"),
        F.col(id_column).alias("_id"),
        F.when(started, 1).when(F.coalesce(ends, F.lit(False)), -1).otherwise(0).alias("_step"),
        F.struct(*names).alias("_row"),
    )
    placed = in_blocks(rows, ["_trace", "_at", "_id"], blocks)
    walked = _depths(placed)
    # every record asks for the last start one level up, and a start gives itself to its own level
    none = F.lit(None).cast("struct<at:bigint,id:" + rows.schema["_id"].dataType.simpleString() + ">")
    ask = F.struct((F.col("_depth") - 1).alias("level"), none.alias("given"))
    give = F.struct(F.col("_depth").alias("level"), F.struct(F.col("_at").alias("at"), F.col("_id").alias("id")).alias("given"))
    told = walked.withColumn("_told", F.explode(F.when(F.col("_step") == 1, F.array(ask, give)).otherwise(F.array(ask)))).withColumns({"_level": F.col("_told.level"), "_given": F.col("_told.given")}).drop("_told")
    here = Window.partitionBy("_trace", "_block", "_level").orderBy("_at", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = told.withColumn("_found", F.last("_given", ignorenulls=True).over(here))
    asked = local.where("_given IS NULL").join(_earlier(told), ["_trace", "_block", "_level"], "left")
    found = F.when(F.col("_level") >= 0, F.coalesce("_found", "_earlier"))
    out = asked.withColumn("_in", found)
    is_start, is_end = F.col("_step") == 1, F.col("_step") == -1
    return out.select(
        *[F.col("_row")[n].alias(n) for n in names],
        is_start.alias("is_start"),
        is_end.alias("is_end"),
        F.when(is_start, F.col("_id")).otherwise(F.col("_in.id")).alias("span"),
        F.when(is_start, F.col("_in.id")).alias("parent_span"),
        F.when(is_start, F.col("_depth")).when(F.col("_in").isNotNull(), F.col("_level")).alias("span_depth"),
        F.when(is_start, F.col("_at")).otherwise(F.col("_in.at")).alias("span_start_ms"),
        F.when(is_end, (F.col("_at") - F.col("_in.at")) * 1_000_000).alias("duration_ns"),
    )


def _depths(placed: DataFrame) -> DataFrame:
    """Add ``_depth``, the number of spans that are open before each record, and ``_goes_on``, whether the trace has several blocks."""
    own = Window.partitionBy("_trace", "_block").orderBy("_at", "_id")
    stepped = placed.withColumn("_sum", F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stepped = stepped.withColumn("_low", F.coalesce(F.min("_sum").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = stepped.groupBy("_trace", "_block").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_lowest"))
    before = Window.partitionBy("_trace").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumns({"_before": F.coalesce(F.sum("_total").over(before), F.lit(0)), "_goes_on": F.count(F.lit(1)).over(Window.partitionBy("_trace")) > 1})
    lowest = F.coalesce(F.min(F.col("_before") + F.col("_lowest")).over(before), F.lit(0))
    begun = summed.select("_trace", "_block", (F.col("_before") - F.least(F.lit(0), lowest)).alias("_begin"), "_goes_on")
    # ends without an open span are those that would lead below 0: what they take away is given back
    lost = F.greatest(F.lit(0), -(F.col("_begin") + F.col("_low")))
    depth = F.col("_begin") + F.col("_sum") - F.col("_step") + lost
    return stepped.join(begun, ["_trace", "_block"]).withColumn("_depth", depth).drop("_sum", "_low", "_begin")


def _earlier(told: DataFrame) -> DataFrame:
    """For blocks of traces that go on, by level: the last start in an earlier block."""
    last = told.where("_goes_on").groupBy("_trace", "_block", "_level").agg(F.max("_given").alias("_last"))
    before = Window.partitionBy("_trace", "_level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("_trace", "_block", "_level", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))


def spans(df: DataFrame, starts: Column, ends: Column, trace: Sequence[str], time_ms: str, id_column: str, blocks: int | None = None) -> DataFrame:
    """A row for each span: trace, ``span`` (the id of its start), ``parent_span``, ``span_depth``, ``start_ms``, ``end_ms``, ``duration_ns``
    and ``unended``; end and duration are null for a span that didn't end."""
    rows = open_spans(df, starts, ends, trace, time_ms, id_column, blocks=blocks).where("is_start OR (is_end AND span IS NOT NULL)")
    of_start = lambda c: F.max(F.when(F.col("is_start"), F.col(c)))
    return rows.groupBy(*trace, "span").agg(
        of_start("parent_span").alias("parent_span"),
        of_start("span_depth").alias("span_depth"),
        of_start("span_start_ms").alias("start_ms"),
        F.max(F.when(F.col("is_end"), F.col(time_ms))).alias("end_ms"),
        F.max("duration_ns").alias("duration_ns"),
        (F.count_if(F.col("is_end")) == 0).alias("unended"),
    )


def span_totals(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of ``spans``: how many there are, how many didn't end, how deep they nest, and their time, by ``by``."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("unended")).alias("unended"), F.max("span_depth").alias("deepest"), F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("total_ns"))
