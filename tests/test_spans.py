"""Spans against a stack of each trace."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.blocks import in_blocks, ranked
from tidelog.operators.spans import open_spans, span_totals, spans

SCHEMA = "trace string, at long, id long, kind string, extra string"


def brute(rows):
    """({id: (span, parent, depth, duration)}, {span: (parent, depth, end, unended)})"""
    records, found = {}, {}
    traces = {}
    for trace, at, i, kind, _ in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2])):
        stack = traces.setdefault(trace, [])
        inner = stack[-1] if stack else None
        took = lambda s: None if at is None or s[1] is None else (at - s[1]) * 1_000_000  # noqa: B023, E731
        if kind == "start":
            records[i] = (i, inner and inner[0], len(stack), None)
            found[i] = (inner and inner[0], len(stack), None, True)
            stack.append((i, at))
        elif kind == "end" and stack:
            s = stack.pop()
            records[i] = (s[0], None, len(stack), took(s))
            found[s[0]] = (*found[s[0]][:2], at, False)
        else:
            records[i] = (inner and inner[0], None, len(stack) - 1 if stack and kind != "end" else None, None)
    return records, found


def check(spark, rows, blocks):
    df = spark.createDataFrame(rows, SCHEMA)
    starts, ends = F.col("kind") == "start", F.col("kind") == "end"
    records, found = brute(rows)
    got = open_spans(df, starts, ends, ["trace"], "at", "id", ["extra"], blocks=blocks).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.span, r.parent_span, r.span_depth, r.duration_ns) for r in got} == records
    assert {r.extra for r in got} <= {"x"}
    table = spans(df, starts, ends, ["trace"], "at", "id", blocks=blocks).collect()
    assert {r.span: (r.parent_span, r.span_depth, r.end_ms, r.unended) for r in table} == found and len(table) == len(found)


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_spans_of_random_traces(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"t{k % 50}"]), rng.randrange(200), k, rng.choice(["start", "start", "end", "end", "log", None]), "x") for k in range(900)]
    check(spark, rows, blocks)


@pytest.mark.parametrize("shape", ["up and down", "side by side", "down only", "up only", "saw"])
def test_one_long_trace_in_many_blocks(spark, shape):
    n = 400
    kinds = {
        "up and down": ["start"] * n + ["end"] * n,
        "side by side": ["start", "end"] * n,
        "down only": ["end"] * n + ["start"] + ["log"] * n,
        "up only": ["start"] * (2 * n),
        "saw": (["start"] * 7 + ["end"] * 9 + ["log"]) * 40,
    }[shape]
    check(spark, [("t", k, k, kind, "x") for k, kind in enumerate(kinds)], 16)


def test_a_long_trace_is_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("trace"), F.lit(5).alias("at"), "id")  # all at one time, too
    sizes = [r["n"] for r in in_blocks(rows, ["trace", "at", "id"], 10).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 4000


def test_odd_spans(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert open_spans(empty, F.col("kind") == "start", F.col("kind") == "end", ["trace"], "at", "id").collect() == []
    check(spark, [("t", None, 1, "start", "x"), ("t", 3, 2, "end", "x"), ("t", 3, 3, "end", "x"), ("t", 3, 4, "log", "x")], 2)
    df = spark.createDataFrame([(None, 1, 1, "start", "x"), (None, 2, 2, "start", "x"), ("b", 2, 3, "end", "x")], SCHEMA)
    whole = spans(df, F.col("kind") == "start", F.col("kind") == "end", [], "at", "id").orderBy("span").collect()  # without traces, all is one
    assert [(r.span, r.parent_span, r.end_ms) for r in whole] == [(1, None, None), (2, 1, 2)]
    assert [tuple(r) for r in span_totals(spans(df, F.col("kind") == "start", F.col("kind") == "end", [], "at", "id"), []).collect()] == [(2, 1, 1, 0)]


def test_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("at"), F.xxhash64("id").alias("id"))
    got = [(r["at"], r["id"], r["n"]) for r in ranked(df, ["at", "id"], "n", 7).collect()]
    assert [x[2] for x in sorted(got)] == list(range(1, 5001))
