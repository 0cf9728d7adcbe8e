"""Files that rotate over a stream: the batch planner's files, however the stream is cut or killed."""

from __future__ import annotations

import gzip
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.operators import retention
from tidelog.streaming import rotating
from tidelog.streaming.rotating import Hooks, Rotation

SCHEMA = "event_id long, ts_ms long, message string"
DAY = 86_400_000


def records(n=400):
    return [(k, 1_700_000_000_000 + k * 1_300_000 + (k % 7) * 10, f"message {k} " + "x" * (k * 7 % 60)) for k in range(n)]


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def planned(rows, limit, interval):
    """{(bucket, index): lines}, by a plain fold over all records."""
    out, bucket, index, size = defaultdict(list), None, 0, 0
    for i, at, text in sorted(rows, key=lambda r: (r[1], r[0])):
        own = at // 1000 // retention.INTERVALS[interval] if interval else 0
        if bucket is not None and own > bucket or bucket is None:
            bucket, index, size = own, 0, 0
        elif limit and size >= limit:
            index, size = index + 1, 0
        out[bucket, index].append(text)
        size += len(text) + 1
    return list(out.values())


def run(spark, rotation, batches, first=0):
    for n, b in enumerate(batches, first):
        assert rotating.run_batch(spark.createDataFrame(b, SCHEMA), n, rotation, F.col("message"))


def found(spark, rotation):
    lines = defaultdict(list)
    for f in rotating.file_table(spark, rotation).orderBy("file").collect():
        if not f.open:
            text = open(f.path, "rb").read()
            lines[f.name] = (gzip.decompress(text) if rotation.packed else text).decode().splitlines()
            assert f.size == sum(len(x) + 1 for x in lines[f.name]) and f.records == len(lines[f.name])
    for r in rotating.read_lines(spark, rotation).where(F.col("name") == rotation.base).collect():
        lines[rotation.base].append(r.value)
    return lines


@pytest.mark.parametrize(("limit", "interval", "parts"), [(2000, None, 3), (3000, "daily", 2), (None, "daily", 3)])
def test_files_are_the_batch_planners(spark, tmp_path, limit, interval, parts):
    rotation = Rotation(f"{tmp_path}/logs", limit=limit, interval=interval, packed=interval is None)
    rows = records()
    run(spark, rotation, cut(rows, parts))
    got = found(spark, rotation)
    want = planned(rows, limit, interval)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and len(want) > 4
    closed = [v for n, v in got.items() if n != rotation.base]
    assert closed == want[:-1]  # in order, line by line
    if limit and not interval:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.octet_length("message") + 1)
        by_planner = defaultdict(list)
        for r in retention.size_index(df, "size", limit, ["ts_ms", "event_id"]).orderBy("ts_ms", "event_id").collect():
            by_planner[r.file_index].append(r.message)
        assert list(by_planner.values()) == want
    assert rotating.stats(rotation)["rotations"] == len(want) - 1
    if interval == "daily" and not limit:
        assert all(n.startswith("app.log.2023-11-") for n in got if n != "app.log")
    assert {r.value for r in rotating.read_lines(spark, rotation).collect()} == {r[2] for r in rows}


@pytest.mark.parametrize("at", ["before the mark", "after the mark", "while putting together", "while removing"])
def test_killed_in_a_batch(spark, tmp_path, monkeypatch, at):
    archive = f"{tmp_path}/old"
    rotation = Rotation(f"{tmp_path}/logs", limit=1500, naming="index", keep=2, archive=archive)
    whole = Rotation(f"{tmp_path}/whole", limit=1500, naming="index", keep=2, archive=f"{tmp_path}/whole-old")
    rows = records(300)
    batches = cut(rows, 3)
    run(spark, whole, batches)
    run(spark, rotation, batches[:1])

    def dies(*_):
        raise RuntimeError("killed")

    broken = Rotation(**{**rotation.__dict__, "hooks": Hooks(on_start=dies if at == "after the mark" else lambda *_: None, on_cleanup=dies if at == "while removing" else lambda *_: None)})
    with monkeypatch.context() as m:
        if at == "before the mark":
            m.setattr(rotating, "_named", dies)
        if at == "while putting together":
            m.setattr(rotating, "_build", lambda spark, wanted, packed, real=rotating._build: real(spark, wanted[:1], packed) or dies())
        with pytest.raises(RuntimeError, match="killed"):
            rotating.run_batch(spark.createDataFrame(batches[1], SCHEMA), 1, broken, F.col("message"))
    rotating.run_batch(spark.createDataFrame(batches[1], SCHEMA), 1, rotation, F.col("message"))
    run(spark, rotation, batches[2:], 2)
    got, want = found(spark, rotation), found(spark, whole)
    assert dict(got) == dict(want) and sorted(got) == ["app.log", "app.log.1", "app.log.2"]
    assert sorted(p.name for p in (tmp_path / "old").iterdir()) == ["app.log.1", "app.log.2"]
    assert not rotating.run_batch(spark.createDataFrame(batches[2], SCHEMA), 2, rotation, F.col("message"))


def test_hooks_names_and_ages(spark, tmp_path):
    called = defaultdict(list)
    note = lambda name: lambda *a: called[name].append(a)
    hooks = Hooks(note("start"), note("complete"), note("error"), note("archived"), note("cleanup"))
    rotation = Rotation(f"{tmp_path}/logs", "a.log", limit=1, naming_format="{base}-{date}{ext}", max_age_s=200, archive=f"{tmp_path}/old", hooks=hooks, packed=True)
    at = 1_700_000_000_000
    rows = [(k, at + k * 100_000, f"m{k}") for k in range(6)]  # a file each, by size
    run(spark, rotation, [rows[:3], [], rows[3:]])
    files = [r.name for r in rotating.file_table(spark, rotation).orderBy("file").collect()]
    assert files == ["a-2023-11-14.log.2.gz", "a-2023-11-14.log.3.gz", "a-2023-11-14.log.4.gz", "a.log"]
    assert len(called["start"]) == len(called["complete"]) == len(called["archived"]) == 5 and not called["error"]
    assert [a[0].rsplit("/", 1)[1] for a in called["cleanup"]] == ["a-2023-11-14.log.gz", "a-2023-11-14.log.1.gz"]
    assert rotating.stats(rotation) == {"rotations": 5, "packed": 5, "deleted": 2}
    assert all(old == f"{tmp_path}/logs/a.log" and new.startswith(f"{tmp_path}/old/") and ms >= 0 for old, new, ms in called["complete"])


def test_odd_records(spark, tmp_path):
    rotation = Rotation(f"{tmp_path}/logs", limit=100, interval="daily")
    at = 1_700_000_000_000
    batches = [[(1, None, None), (2, at, "a")], [(3, at - 5 * DAY, "late"), (4, None, "no time")], [], [(5, at + DAY, "b")]]
    run(spark, rotation, batches)
    got = found(spark, rotation)
    assert sorted(map(sorted, got.values())) == [[""], ["a", "late", "no time"], ["b"]]


def test_a_stream_of_files(spark, tmp_path):
    from tidelog.functions import formatting
    from tidelog.sources import adapters
    from tidelog.streaming import windows

    batch = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).drop("context")
    rows = adapters.events(windows.read_stream(spark, "/root/testdata/sf0.001/events.parquet")).drop("context")
    rotation = Rotation(f"file://{tmp_path}/logs", limit=20_000, interval="weekly", packed=True)
    rotating.start(rows, rotation, formatting.default_line(batch.columns), f"file://{tmp_path}/check", "drain").awaitTermination()
    want = sorted(r.line for r in batch.select(formatting.default_line(batch.columns).alias("line")).collect())
    assert sorted(r.value for r in rotating.read_lines(spark, rotation).collect()) == want


def test_records_are_told_their_files_by_a_table(spark, tmp_path, monkeypatch):
    """A map of all files in an expression is searched from its beginning for each record: files times records."""
    def grows(*_):
        raise AssertionError("an expression that holds every file")

    monkeypatch.setattr(rotating.F, "create_map", grows)
    rotation, rows = Rotation(f"{tmp_path}/logs", limit=300, interval="daily"), records(120)
    run(spark, rotation, cut(rows, 2))
    assert sorted(map(sorted, found(spark, rotation).values())) == sorted(map(sorted, planned(rows, 300, "daily")))
