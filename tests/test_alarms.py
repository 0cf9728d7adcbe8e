"""Alarms of streams, states that end, and ranks where all records have one time."""

from __future__ import annotations

import os
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidelog.operators import retention, sampling
from tidelog.operators.filters import Filter
from tidelog.operators.rules import Rule, Rules, message
from tidelog.operators.sampling import Sampler, rate_limit_step
from tidelog.plans.pipeline import LogPipeline
from tidelog.sources import adapters
from tidelog.streaming import stateful, windows
from tidelog.streaming.alarms import Alarm, Alarms, alarm_table, measured, readings


def test_alarms_of_a_stream(spark, tmp_path):
    batch = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    rows = adapters.events(windows.read_stream(spark, "/root/testdata/sf0.001/events.parquet"))
    flow = LogPipeline("INFO", filter=Filter().message("value=4", allow=False))
    called: list[Alarm] = []
    limits = {"latency_ms": 0.0, "error_rate": 0.01, "drop_rate": 0.99, "records_per_second": 0.5}
    with Alarms(spark, limits, called.append, f"file://{tmp_path}/alarms"):
        windows.start(measured(rows, flow), f"{tmp_path}/out", f"{tmp_path}/check", "drain").awaitTermination()
        for _ in range(100):
            if len(called) >= 3:
                break
            time.sleep(0.1)
    left = flow.apply(batch)
    by = {a.metric: a for a in called}
    assert set(by) == {"latency_ms", "error_rate", "records_per_second"}  # the drop rate is below its limit
    assert by["error_rate"].value == left.where("priority >= 40").count() / left.count() and by["error_rate"].most == 0.01
    kept = alarm_table(spark, f"file://{tmp_path}/alarms").collect()
    assert sorted((r.metric, r.value) for r in kept) == sorted((a.metric, a.value) for a in called)


def test_readings_and_bad_callbacks(spark):
    progress = SimpleNamespace(name="q", id="i", batchId=3, timestamp="t", numInputRows=10, durationMs={"triggerExecution": 500}, observedMetrics={"tidelog_in": {"records": 10}, "tidelog_out": {"records": 4, "errors": 1}}, stateOperators=[])
    assert readings(progress) == {"latency_ms": 500.0, "records_per_second": 20.0, "error_rate": 0.25, "drop_rate": 0.6}
    empty = SimpleNamespace(**{**progress.__dict__, "numInputRows": 0, "durationMs": {}, "observedMetrics": {"tidelog_in": {"records": 0}, "tidelog_out": {"records": 0, "errors": 0}}})
    assert set(readings(empty).values()) == {0.0}

    def wrong(_):
        raise RuntimeError("no")

    assert [a.metric for a in Alarms(spark, {"drop_rate": 0.5, "error_rate": 0.25}, wrong).hear(progress)] == ["drop_rate"]
    assert Alarms(spark, {"drop_rate": 0.5}, query="other").hear(progress) == []
    with pytest.raises(ValueError, match="loudness"):
        Alarms(spark, {"loudness": 1})


def test_late_rows_and_matches(spark, tmp_path):
    """Three files, the last two days behind but for one record; a watermark drops rows from the batch on that follows the one which moves it."""
    day = 86_400_000
    for n, times in enumerate(([10 * day, 10 * day + 1], [10 * day + 3], [8 * day, 8 * day + 7_200_000, 10 * day + 2])):
        part = spark.createDataFrame([(f"value={t % 7}", t) for t in times], "message string, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms"))
        part.coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        (file,) = (tmp_path / f"p{n}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    rows = spark.readStream.schema("message string, ts_ms long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = rows.withColumns({"level": F.lit("INFO"), "priority": F.lit(20)})
    called: list[Alarm] = []
    with Alarms(spark, {"late_rows": 1}, called.append):
        windows.start(windows.level_counts(rows, "1 hour", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check", "drain").awaitTermination()
        for _ in range(100):
            if called:
                break
            time.sleep(0.1)
    assert [(a.metric, a.value, a.most) for a in called] == [("late_rows", 2.0, 1)]

    book = Rules()
    book.add(Rule(7, (message("note", "five"),), message_contains="value=5"))
    book.add(Rule(9, (message("note", "never"),), message_contains="value=x"))
    heard: list[tuple] = []
    events = adapters.events(windows.read_stream(spark, "/root/testdata/sf0.001/events.parquet"))
    with Alarms(spark, {}, matches=lambda *told: heard.append(told)):
        windows.start(measured(events, LogPipeline("TRACE", rules=book)), f"{tmp_path}/out2", f"{tmp_path}/check2", "drain").awaitTermination()
        for _ in range(100):
            if heard:
                break
            time.sleep(0.1)
    batch = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    want = batch.where("message LIKE '%value=5%'").count()
    assert want and [(b, c) for _, b, c in heard] == [(0, {7: want, 9: 0})]


def test_states_of_a_stream_end(spark, tmp_path):
    """Keys come and go: a thousand in all, about a tenth of them with an open window."""
    for n in range(10):
        part = spark.range(n * 100, (n + 1) * 100).select(F.col("id").alias("event_id"), (F.col("id") * 100 + 1_000_000).alias("ts_ms"), F.concat(F.lit("k"), F.floor(F.col("id") / 2)).alias("k"))
        part.coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        (file,) = (tmp_path / f"p{n}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    rows = spark.readStream.schema("event_id long, ts_ms long, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    flagged = stateful.rate_limit(rows, 1, 500, ["k"], ["event_id", "ts_ms", "k"], late="0 seconds")
    query = windows.start(flagged, f"{tmp_path}/out", f"{tmp_path}/check", "drain")
    query.awaitTermination()
    most = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert query.recentProgress and most < 500
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    states: dict[str, list] = {}
    want = {r.event_id: rate_limit_step(1, 500)(states.setdefault(r.k, [0, 0]), r.ts_ms)[0] for r in sorted(got, key=lambda r: r.event_id)}
    assert len(got) == 1000 and {r.event_id: r.accepted for r in got} == want and sum(want.values()) == 500


def test_all_records_at_one_time(spark):
    """Ranks, sums and clean-ups of a table that was written within one minute, dealt to many tasks."""
    rng = random.Random(4)
    rows = [(k, 1_000_000, rng.randrange(1, 50), f"f{k:04d}") for k in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, ts_ms long, size long, name string")
    ranked = {r.event_id: r.n for r in sampling.overall_rank(df, "ts_ms", "event_id", "n", 8).collect()}
    assert ranked == {k: k + 1 for k in range(1000)}
    files = df.select("name", F.col("ts_ms").alias("mtime"), "size", F.lit(5).alias("age"))
    gone = {r.name: r.deleted for r in retention.clean_up(files, max_files=400, max_total_size=6000, blocks=8).collect()}
    total, want = 0, {}
    for n, (_, _, size, name) in enumerate(sorted(rows, key=lambda r: r[3], reverse=True), 1):
        total += size
        want[name] = "max_files" if n > 400 else "max_total_size" if total > 6000 else None
    assert gone == want
    sizes = {r.event_id: r.file_index for r in retention.size_index(df, "size", 300, ["ts_ms", "event_id"]).collect()}
    index, held = 0, 0
    for k, _, size, _ in rows:
        if held >= 300:
            index, held = index + 1, 0
        assert sizes[k] == index
        held += size


def test_a_sampler_with_hot_keys(spark, monkeypatch):
    events = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    for strategy, options in (("rate_limit", (("most", 3), ("window_ms", 3_600_000))), ("adaptive", (("target", 0.0001), ("interval_ms", 86_400_000)))):
        shown = [sorted(r.event_id for r in Sampler(strategy, options, ("event_type",), hot).apply(events).collect()) for hot in (False, True, None)]
        monkeypatch.setattr(sampling, "HOT_ROWS", 195)  # some types have more
        shown.append(sorted(r.event_id for r in Sampler(strategy, options, ("event_type",)).apply(events).collect()))
        monkeypatch.undo()
        assert shown[0] == shown[1] == shown[2] == shown[3] and shown[0]
