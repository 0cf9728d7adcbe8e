"""Streams that carry tables: against the batch operators, over cut batches, hot keys and kills."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import metrics, sampling
from tidelog.operators.rules import LevelMatch, Rule, Rules, message
from tidelog.operators.sampling import Sampler, adaptive_step, rate_limit_step
from tidelog.plans.pipeline import LogPipeline
from tidelog.sources import adapters
from tidelog.streaming import carried

SCHEMA = "k string, ts_ms long, event_id long"


def rows_of(seed, n=300, keys=("a", "a", "a", "b", None)):
    rng = random.Random(seed)
    at = 0
    out = []
    for k in range(n):
        at += rng.choice([0, 0, 1, 3, 40, 170])
        out.append((rng.choice(keys), at, k))
    return out


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def run(spark, step, parts, tmp_path):
    for n, part in enumerate(parts):
        assert carried.run_batch(spark.createDataFrame(part, SCHEMA), n, f"file://{tmp_path}/s", step)
    return carried.results(spark, f"file://{tmp_path}/s").collect()


def folded(parts, start, step, keyed):
    """Each batch in its own order, a state for each key."""
    states, out = {}, {}
    for part in parts:
        for k, at, i in sorted(part, key=lambda r: r[1:]):
            out[i] = step(states.setdefault(k if keyed else 0, start()), at)[0]
    return out


@pytest.mark.parametrize(("keyed", "late", "parts"), [(True, True, 3), (True, False, 1), (False, True, 2)])
def test_rate_limit_over_batches(spark, tmp_path, keyed, late, parts):
    batches = cut(rows_of(parts), parts)
    if late:  # some come batches later than their time
        batches = [[(k, max(0, at - (150 if i % 9 == 0 else 0)), i) for k, at, i in b] for b in batches]
    got = run(spark, carried.rate_limit(3, 100, ["k"] if keyed else [], ["event_id"]), batches, tmp_path)
    assert {r.event_id: r.accepted for r in got} == folded(batches, lambda: [0, 0], rate_limit_step(3, 100), keyed)


@pytest.mark.parametrize(("keyed", "parts"), [(True, 3), (False, 2)])
def test_adaptive_over_batches(spark, tmp_path, keyed, parts):
    batches = cut(rows_of(10 + parts), parts)
    got = run(spark, carried.adaptive(20.0, ["k"] if keyed else [], ["event_id"], interval_ms=100, min_rate=0.05), batches, tmp_path)
    want = folded(batches, lambda: [0, 0, 1.0], adaptive_step(20.0, 100, 0.05, 1.0), keyed)
    assert {r.event_id: r.rate for r in got} == want and len(set(want.values())) > 3


def test_state_of_windows_is_bounded(spark, tmp_path):
    """Of ten thousand keys, those whose window is over aren't kept."""
    path = f"file://{tmp_path}/s"
    step = carried.rate_limit(1, 1000, ["k"], ["event_id"])
    for n in range(3):
        batch = spark.range(n * 4000, (n + 1) * 4000).select(F.concat(F.lit("key"), "id").alias("k"), (F.col("id") * 10).alias("ts_ms"), F.col("id").alias("event_id"))
        carried.run_batch(batch, n, path, step)
        assert carried.table(spark, path, "windows").count() == 100
    assert carried.results(spark, path).where("accepted").count() == 12_000
    assert sorted(p.name for p in (tmp_path / "s" / "windows").iterdir()) == ["1", "2"] or len(list((tmp_path / "s" / "windows").iterdir())) <= carried.KEPT + 1


def test_no_task_has_a_hot_keys_rows(spark, tmp_path, monkeypatch):
    """One key has all rows: no exchange of its plans deals records by the key alone."""
    from tidelog.operators import chains

    monkeypatch.setattr(chains, "BLOCK_VALUES", 500)
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("ts_ms"), F.col("id").alias("event_id"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    flagged, state = sampling.rate_limit_batch(rows, 5, 100, "ts_ms", "event_id", ["k"])
    values = rows.select(F.struct("k").alias("_key"), F.col("ts_ms").alias("_at"))
    starts = chains.window_starts(values, "_at", 100)
    assert starts.count() == 588
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in flagged.where("accepted").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and sum(sizes) == flagged.where("accepted").count() == 5 * 589
    assert [tuple(r["_key"]) for r in state.collect()] == [("hot",)]


RULES = Rules([Rule(1, (message("cause", "first error"),), LevelMatch.at_least(40), once=True), Rule(2, (message("fix", "a click"),), module="app.click"), Rule(3, (message("note", "first view"),), module="app.view", once=True), Rule(4, (message("note", "never"),), module="none", once=True)])


@pytest.mark.parametrize("sampler", [Sampler(), Sampler("rate_limit", (("most", 3), ("window_ms", 86_400_000)), ("event_type",))])
def test_pipeline_over_a_stream_that_is_killed(spark, tmp_path, sampler):
    """In order of time, one file a batch; after three batches the query is killed within the fourth."""
    events = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    flow = LogPipeline("DEBUG", sampler=sampler, rules=RULES, context={"env": "x"})
    days = [r["d"] for r in events.select(F.floor(F.col("ts_ms") / (86_400_000 * 5)).alias("d")).distinct().orderBy("d").collect()]
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "in"
    for n, d in enumerate(days):
        part = raw.where(F.floor(F.expr("unix_millis(cast(ts as timestamp))") / (86_400_000 * 5)) == d).coalesce(1)
        part.write.parquet(f"{tmp_path}/day{n}")
        (file,) = (tmp_path / f"day{n}").glob("*.parquet")
        source.mkdir(exist_ok=True)
        file.rename(source / f"{n:03d}.parquet")
        import os

        os.utime(source / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    rows = adapters.events(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    path, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    step = carried.pipeline(flow)
    calls = []

    def dying(batch, tables):
        calls.append(1)
        made = step(batch, tables)
        if len(calls) == 4:
            made[0].write.mode("overwrite").parquet(f"{path}/rows/3")  # it had begun to write
            raise RuntimeError("killed")
        return made

    with pytest.raises(Exception, match="killed"):
        carried.start(rows, path, check, dying, "drain").awaitTermination()
    assert len(carried.Marks(path).all()) == 3
    carried.start(rows, path, check, step, "drain").awaitTermination()
    assert carried.Marks(path).all() == list(range(len(days))) and len(days) > 4
    got = carried.results(spark, path)
    want = flow.apply(events)
    shown = lambda df: sorted((r.event_id, tuple(r.rule_ids)) for r in df.select("event_id", "rule_ids").collect())
    assert shown(got) == shown(want)
    assert {r.rule_id for r in carried.table(spark, path, "fired").collect()} == {1, 3}
    assert not carried.run_batch(events, 2, path, step)  # it was done


def test_history_over_batches(spark, tmp_path):
    events = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    step = carried.history(F.to_date("ts"), 7)
    for n in range(4):
        carried.run_batch(events.where(F.col("event_id") % 4 == n), n, f"file://{tmp_path}/s", step)
    want = sorted(map(tuple, metrics.history(events, F.to_date("ts"), 7).collect()))
    assert sorted(map(tuple, carried.table(spark, f"file://{tmp_path}/s", "snapshots").select("period", "records", "bytes").collect())) == want


def test_odd_batches(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert carried.results(spark, path) is None and carried.table(spark, path, "windows") is None
    empty = spark.createDataFrame([], SCHEMA)
    step = carried.rate_limit(1, 10, ["k"], ["event_id"])
    assert carried.run_batch(empty, 0, path, step)
    assert carried.run_batch(spark.createDataFrame([(None, None, 1), (None, 5, 2), ("a", -3, 3)], SCHEMA), 1, path, step)
    assert carried.run_batch(empty, 2, path, step)
    assert {r.event_id: r.accepted for r in carried.results(spark, path).collect()} == {1: True, 2: False, 3: True}
    with pytest.raises(ValueError, match="every_n"):
        carried.pipeline(LogPipeline(sampler=Sampler("every_n", (("n", 2),))))


