"""Rules in tables against a loop over all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import rules as rule_tables
from tidelog.operators.rules import Rule, Rules, match_table, message, pieces

RECORDS = "event_id long, priority int, module string, function string, message string"
RULES = "id int, enabled boolean, level_min int, level_max int, module string, function string, message_contains string"


def brute(records, book):
    out = []
    for i, priority, module, function, text in records:
        for k, enabled, low, high, m, f, contains in book:
            if (
                enabled
                and (low is None or priority is not None and priority >= low)
                and (high is None or priority is not None and priority <= high)
                and (m is None or m == module)
                and (f is None or f == function)
                and (contains is None or text is not None and contains in text)
            ):
                out.append((i, k))
    return sorted(out)


def some(seed):
    rng = random.Random(seed)
    words = ["", "a", "ab", "abc", "abcd", "é漢字", "😀😀x", "order 12", "order 1", " ", "%_", "zzz"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(words) for _ in range(rng.randrange(6)))])
    name = lambda: rng.choice([None, None, "m1", "m2", ""])
    level = lambda: rng.choice([None, None, 5, 20, 30, 55])
    records = [(k, level(), name(), name(), text()) for k in range(150)]
    book = [(k, rng.random() < 0.9, level(), level(), name(), name(), rng.choice([None, *words])) for k in range(120)]
    return records, book


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_any_kind(spark, seed):
    records, book = some(seed)
    df, r = spark.createDataFrame(records, RECORDS), spark.createDataFrame(book, RULES)
    want = brute(records, book)
    assert sorted(map(tuple, match_table(df, r).collect())) == want and len(want) > 100
    no_function = sorted(map(tuple, match_table(df.drop("function"), r).collect()))
    assert no_function == brute([(i, p, m, None, t) for i, p, m, _, t in records], book)


def test_odd_tables(spark):
    records, book = some(3)
    df, r = spark.createDataFrame(records, RECORDS), spark.createDataFrame(book, RULES)
    assert match_table(df.limit(0), r).collect() == [] == match_table(df, r.limit(0)).collect()
    long = "x" * 200_000 + "needle" + "y" * 100_000
    one = spark.createDataFrame([(1, 20, "m", "f", long)], RECORDS)
    asked = spark.createDataFrame([(1, True, None, None, None, None, "xneedley"), (2, True, None, None, None, None, "needles")], RULES)
    assert [tuple(x) for x in match_table(one, asked).collect()] == [(1, 1)]


def test_ten_thousand_rules_without_a_nested_loop(spark):
    from tidelog.sources import adapters

    rows = adapters.lineitem(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    text = lambda k: None if k % 100 == 0 else f"order {k} " if k % 2 else f"{k} quantity={k % 50}"
    book = [(k, True, 30 if k % 3 == 0 else None, None, "ship.O" if k % 5 == 0 else None, None, text(k)) for k in range(10_000)]
    pairs = match_table(rows, spark.createDataFrame(book, RULES))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted(map(tuple, pairs.collect()))
    records = [(r.event_id, r.priority, r.module, None, r.message) for r in rows.collect()]
    sample = [b for b in book if b[0] % 97 == 0]
    ids = {b[0] for b in sample}
    assert [p for p in got if p[1] in ids] == brute(records, sample) and len(got) > 1000


def test_few_rules_are_broadcast_and_never_the_records(spark):
    records, book = some(4)
    pairs = match_table(spark.createDataFrame(records, RECORDS), spark.createDataFrame(book, RULES))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, pairs.collect())) == brute(records, book)


@pytest.mark.parametrize("seed", [5, 6])
def test_many_rules_are_shuffled_and_records_not_broadcast(spark, monkeypatch, seed):
    monkeypatch.setattr(rule_tables, "FEW_RULES", 5 if seed == 5 else 0)
    records, book = some(seed)
    book += book[:20]  # rules that are there twice
    pairs = match_table(spark.createDataFrame(records, RECORDS), spark.createDataFrame(book, RULES))
    assert sorted(map(tuple, pairs.collect())) == brute(records, book)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not any("BroadcastHashJoin" in line and "Inner" in line for line in plan.splitlines() if seed == 6)


@pytest.mark.parametrize("most", [0, 20_000])
def test_records_meet_few_rules_besides_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(rule_tables, "FEW_RULES", most)
    met = []
    monkeypatch.setattr(rule_tables, "_met_by_text", lambda *a, real=rule_tables._met_by_text: met.append(real(*a)) or met[-1])
    n = 5000
    df = spark.range(n).selectExpr("id AS event_id", "20 AS priority", "'m' AS module", "'f' AS function", "concat('order ', id + 10000, ' quantity=', id % 50) AS message")
    book = spark.range(n).selectExpr("CAST(id AS INT) AS id", "true AS enabled", "CAST(NULL AS INT) AS level_min", "CAST(NULL AS INT) AS level_max", "CAST(NULL AS STRING) AS module", "CAST(NULL AS STRING) AS function", "concat('order ', id + 10000, ' ') AS message_contains")
    assert sorted(map(tuple, match_table(df, book).collect())) == [(k, k) for k in range(n)]
    assert sum(m.count() for m in met) <= 2 * n  # by three characters, some hundred rules a record


def test_pieces(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("é漢😀x",)], "t string")
    assert [r.p for r in df.select(pieces(F.col("t")).alias("p")).collect()] == [["abc", "bca", "cab"], [], [], [], ["é漢😀", "漢😀x"]]


def test_a_registry_that_is_off(spark):
    book = Rules([Rule(1, (message("note", "x"),)), Rule(2, (message("fix", "y"),), once=True)], enabled=False)
    df = spark.createDataFrame([(1, 20, "m", "f", "t")], RECORDS).withColumn("ts_ms", F.lit(1))
    row = book.evaluate(df).first()
    assert row.rule_ids == [] and row.rule_messages is None
    assert tuple(book.stats(df).first()) == (0, 0, 0, 1, 0.0)
    assert Rules().enabled
