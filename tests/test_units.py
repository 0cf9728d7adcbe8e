"""Exact cases of single operators."""

from __future__ import annotations

import re
import socket
import threading
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions import formatting, levels, redaction, scalars
from tidelog.operators import metrics, retention, rules, sampling, sinks
from tidelog.operators.filters import Filter, SinkFilter, level_gate
from tidelog.plans import catalog
from tidelog.plans.pipeline import LogPipeline
from tidelog.schema import LEVELS, PRIORITY
from tidelog.sources import adapters, parsers, records
from tidelog.streaming import windows


def log_rows(spark, rows):
    """(level, module, message) rows."""
    return spark.createDataFrame([(k, k, lv, PRIORITY[lv], m, t) for k, (lv, m, t) in enumerate(rows)], "event_id long, ts_ms long, level string, priority int, module string, message string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("rule", "row", "allowed"),
    [
        (Filter().min_level("WARNING"), ("INFO", None, "x"), False),
        (Filter().min_level("WARNING"), ("ERROR", None, "x"), True),
        (Filter().min_level("INFO").max_level("WARNING"), ("DEBUG", None, "x"), False),
        (Filter().min_level("INFO").max_level("WARNING"), ("WARNING", None, "x"), True),
        (Filter().min_level("INFO").max_level("WARNING"), ("ERROR", None, "x"), False),
        (Filter().module_prefix("database"), ("INFO", None, "x"), False),
        (Filter().module_prefix("database"), ("INFO", "database.query", "x"), True),
        (Filter().module_prefix("database"), ("INFO", "http.server", "x"), False),
        (Filter().message("heartbeat", allow=False), ("INFO", None, "User logged in"), True),
        (Filter().message("heartbeat", allow=False), ("INFO", None, "heartbeat check"), False),
        (Filter().module_prefix("a", allow=False), ("INFO", None, "x"), True),
        (Filter(strict=True).module_prefix("a", allow=False), ("INFO", "a.b", "x"), True),
        (Filter(), ("TRACE", None, ""), True),
        (Filter().min_level("FATAL").disable(), ("TRACE", None, ""), True),
        (Filter().min_level("FATAL").clear(), ("TRACE", None, ""), True),
    ],
)
def test_filters(spark, rule, row, allowed):
    assert rule.flag(log_rows(spark, [row])).first()["allowed"] is allowed


def test_sink_filter(spark):
    rows = log_rows(spark, [("INFO", "auth.service", "user logged in"), ("INFO", "database", "user logged in"), ("INFO", "auth", "inputted password was wrong"), ("INFO", None, "x")])
    takes = SinkFilter(include_modules=("auth",), exclude_messages=("password",))
    assert [r.event_id for r in rows.where(takes.predicate()).collect()] == [0]
    assert {r.event_id for r in rows.where(SinkFilter(exclude_modules=("auth",)).predicate()).collect()} == {1, 3}


def test_gate(spark):
    rows = log_rows(spark, [("DEBUG", "a", "x"), ("INFO", "a", "x"), ("INFO", "b", "x"), ("WARNING", "b", "x"), ("INFO", None, "x")])
    assert {r.event_id for r in level_gate(rows, "INFO", {"a": "DEBUG", "b": "WARNING"}).collect()} == {0, 1, 3, 4}
    assert level_gate(rows, "TRACE", enabled=False).count() == 0


def test_samplers(spark):
    rows = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") * 10).alias("ts_ms"))
    assert sampling.flag_rate_limit(rows, 10, 1000, "ts_ms", "event_id").where("accepted").count() == 10
    flags = [r.accepted for r in sampling.flag_every_n(rows.where("event_id < 6"), 3, "ts_ms", "event_id").orderBy("event_id").collect()]
    assert flags == [False, False, True, False, False, True]
    assert 0.3 < sampling.sample_probability(spark.range(1000).withColumnRenamed("id", "event_id"), 0.5, "event_id").count() / 1000 < 0.7
    burst = spark.range(201).select(F.col("id").alias("event_id"), F.when(F.col("id") < 200, F.col("id") % 10).otherwise(70).alias("ts_ms")).withColumn("ts_ms", F.col("ts_ms") + 1_000_000)
    rates = [r.rate for r in sampling.with_adaptive_rate(burst, 100, "ts_ms", "event_id", interval_ms=50).orderBy("event_id").collect()]
    assert rates[0] == 1.0 and rates[-1] < 1.0
    assert sampling.sample_stats(sampling.Sampler().flag(rows)).first().accept_rate == 1.0
    assert sampling.Sampler.preset("every_10").current_rate() == 0.1
    assert sampling.flag_rate_limit(rows.limit(0), 10, 1000, "ts_ms", "event_id").count() == 0


def test_redaction(spark):
    v = lambda c: one(spark, c)
    assert v(redaction.partial_end(F.lit("secret123456"))) == "secr********"
    assert v(redaction.partial_start(F.lit("abc"))) == "****"
    assert v(redaction.mask_middle(F.lit("abcdefgh"))) == "abc**fgh"
    assert v(redaction.mask_middle(F.lit("abcdef"))) == "***"
    done = v(redaction.contains(F.lit("user login password=secret123 success"), "password=secret123", "[REDACTED]"))
    assert "secret" not in done and "[REDACTED]" in done
    assert v(redaction.regex(F.lit("id=42 id=7"), r"id=\d+ ", r"$1\x")) == r"$1\xid=7"
    assert v(redaction.full(F.lit(None).cast("string"))) is None
    for bad in ("", "*"):
        with pytest.raises(ValueError):
            redaction.translate(bad)
    assert v(redaction.redact_field("PASSWORD", F.lit("x"), redaction.PRESETS["common"])) == "[REDACTED]"
    assert v(redaction.redact_field("PASSWORD", F.lit("x"), redaction.PRESETS["common"], ignore_case=False)) == "x"


def dialect(pattern: str, text: str) -> list[str]:
    """The pattern dialect by plain search, for the translator."""

    def match(p: int, t: int) -> int | None:
        if p == len(pattern):
            return t
        c, step = pattern[p], 1
        if c == "*":
            return len(text) if p + 1 == len(pattern) else next((e for k in range(t, len(text) + 1) if (e := match(p + 1, k)) is not None), None)
        if c == "+":
            if p + 1 == len(pattern):
                return t + 1 if t < len(text) else None
            return next((e for k in range(t + 1, len(text) + 1) if (e := match(p + 1, k)) is not None), None)
        if t == len(text):
            return None
        x = text[t]
        if c == "\\" and p + 1 < len(pattern):
            step, k = 2, pattern[p + 1]
            tests = {"d": x.isdigit(), "w": x.isalnum() or x == "_", "s": x in " \t\n\r\x0b\x0c"}
            ok = tests[k.lower()] != k.isupper() if k.lower() in tests else x == k
        else:
            ok = c == "." or x == c
        return match(p + step, t + 1) if ok else None

    out, at = [], 0
    while at < len(text):
        end = match(0, at)
        if end is not None and end > at:
            out.append(text[at:end])
            at = end
        else:
            at += 1
    return out


@pytest.mark.parametrize("pattern", [r"a*b", r"\d+x", r"k=\w", r"a.c", r"x?y", r"\s\S", r"(a)", r"ab*", r"q+"])
def test_pattern_dialect(pattern):
    for text in ("aab axb a\nb", "12x 3x9x", "k=1 k=_", "abc a.c", "x?y xy", "a b", "(a)a", "abab", "qqq", ""):
        assert [m.group() for m in re.finditer(redaction.translate(pattern), text)] == dialect(pattern, text)


@pytest.mark.parametrize(("text", "size"), [("1024", 1024), ("100B", 100), ("1KB", 1024), ("1K", 1024), ("10KB", 10240), ("1MB", 1 << 20), ("1G", 1 << 30), ("10 MB", 10 << 20), ("5G", 5 << 30), ("", None), ("invalid", None)])
def test_sizes(spark, text, size):
    assert one(spark, scalars.parse_size(F.lit(text))) == size


@pytest.mark.parametrize(("text", "ms"), [("1000ms", 1000), ("30s", 30_000), ("5m", 300_000), ("2h", 7_200_000), ("1d", 86_400_000)])
def test_durations(spark, text, ms):
    assert one(spark, scalars.parse_duration(F.lit(text))) == ms


def test_scalars(spark):
    v = lambda c: one(spark, c)
    assert v(scalars.from_epoch_ms(F.lit(1735689600000))) == datetime(2025, 1, 1)
    assert v(scalars.from_epoch_ms(F.lit(-5))) == datetime(1970, 1, 1)
    assert v(scalars.same_day(F.lit(1735689600), F.lit(1735689600 + 3600))) is True
    assert v(scalars.same_day(F.lit(1735689600), F.lit(1735689600 + 86400))) is False
    assert [v(scalars.clamp(F.lit(x), F.lit(5), F.lit(10))) for x in (3, 15, 7)] == [5, 10, 7]
    assert v(formatting.date_pattern(F.lit(datetime(2025, 12, 25, 14, 30, 45, 123000)).cast("timestamp_ntz"), "YYYY-MM-DD | HH:mm:ss.SSS")) == "2025-12-25 | 14:30:45.123"
    assert v(scalars.escape_json(F.lit('Hello"World\n\t'))) == 'Hello\\"World\\n\\t'
    assert v(scalars.rate(F.lit(0), F.lit(0))) == 0 and v(scalars.percentage(F.lit(50), F.lit(100))) == 50
    assert v(scalars.throughput(F.lit(100), F.lit(10**9))) == 100 and v(scalars.throughput(F.lit(100), F.lit(0))) == 0
    assert v(levels.level_of(F.lit(99))) is None and v(levels.priority_of(F.lit("INVALID"))) is None
    assert [v(levels.priority_of(F.lit(n))) for n, _, _ in LEVELS] == [p for _, p, _ in LEVELS]
    assert v(retention.glob(F.lit("app.log"), "*.log")) and not v(retention.glob(F.lit("app.txt"), "*.log"))


def test_crc(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.crc == zlib.crc32(texts[r.doc_id].encode()) for r in catalog.crc32_text(spark, sf_dir).collect())


def test_rules(spark):
    book = rules.Rules()
    book.add(rules.Rule(1, (rules.message("cause", "a"), rules.message("fix", "b")), rules.LevelMatch.exact("ERROR")))
    book.add(rules.Rule(2, (rules.message("note", "c"),), rules.LevelMatch.exact("INFO"), once=True))
    with pytest.raises(rules.RuleIdExists):
        book.add(rules.Rule(1))
    rows = log_rows(spark, [("ERROR", None, "Test error"), ("INFO", None, "x"), ("INFO", None, "y"), ("DEBUG", None, "z")])
    found = {r.event_id: [m.message for m in r.rule_messages or []] for r in book.evaluate(rows).collect()}
    assert found == {0: ["a", "b"], 1: ["c"], 2: [], 3: []}
    assert book.stats(rows).first().asDict() == {"evaluated": 4, "matched": 2, "messages_emitted": 3, "skipped": 0, "match_rate": 0.5}
    book.add_or_update(rules.Rule(1, (rules.message("docs", "d"),)))
    assert len(book) == 2 and book.get(1).messages[0].message == "d"
    assert book.remove(2) and not book.remove(999) and len(book) == 1
    assert book.enable(1, False) and book.evaluate(rows).where("rule_messages IS NOT NULL").count() == 0
    full = rules.Rules(most=1)
    full.add(rules.Rule(1))
    with pytest.raises(rules.TooManyRules):
        full.add(rules.Rule(2))
    assert rules.Rules().evaluate(rows).count() == 4


def test_metrics(spark):
    rows = log_rows(spark, [("INFO", None, "x" * 50), ("INFO", None, "é" * 25), ("ERROR", None, "x" * 100)])
    assert metrics.totals(rows).first().asDict() == {"total_records": 3, "total_bytes": 200}
    counts = metrics.level_array(rows).first().level_counts
    assert counts[2] == 2 and counts[6] == 1 and sum(counts) == 3
    empty = rows.limit(0)
    assert metrics.totals(empty).first().asDict() == {"total_records": 0, "total_bytes": 0}
    assert metrics.level_breakdown(empty).first().breakdown == "Level Breakdown: (none)"
    assert metrics.rates(empty, F.lit(False), F.lit(False)).first().error_rate == 0
    assert [one(spark, metrics.bucket(F.lit(n))) for n in (1, 1000, 1001, 10**9, 10**9 + 1)] == [0, 0, 1, 18, 19]


def test_retention(spark):
    files = spark.createDataFrame([(f"f{k:02}.log", k, 10, 0) for k in range(15)], "name string, mtime long, size long, age long")
    assert retention.clean_up(files, "*.log", max_files=5).where("deleted IS NOT NULL").count() == 10
    more = files.where("mtime >= 10").union(spark.createDataFrame([("new.log", 99, 1024, 0)], files.schema))
    assert retention.clean_up(more, max_total_size=500).where("deleted IS NOT NULL").count() >= 1
    assert retention.default_naming("daily") == "date" and retention.default_naming("hourly") == "timestamp"


def test_formats(spark):
    rows = spark.createDataFrame([("ERROR", 40, "Error occurred", "api", 1700000000000)], "level string, priority int, message string, module string, ts_ms long").withColumn("ts", scalars.from_epoch_ms(F.col("ts_ms")))
    js = rows.select(formatting.json_line(rows.columns).alias("v")).first().v
    assert '"level":"ERROR"' in js and '"message":"Error occurred"' in js and '"module":"api"' in js
    line = rows.select(formatting.syslog_line("user", "localhost", "test-app").alias("v")).first().v
    assert line.startswith("<11>1 ") and "localhost test-app - - - Error occurred" in line
    back = parsers.text_lines(rows.select(formatting.default_line(rows.columns).alias("value"))).first()
    assert (back.level, back.module, back.message, back.priority) == ("ERROR", "api", "Error occurred", 40)
    assert parsers.json_lines(rows.select(F.lit(js).alias("value"))).first().message == "Error occurred"


def test_records(spark):
    made = records.records(spark, [records.record("warn", "careful"), records.record("AUDIT", "seen", {"AUDIT": (35, "35")}, module="m")])
    assert [(r.level, r.custom_level_name, r.priority) for r in made.collect()] == [("WARNING", None, 30), ("INFO", "AUDIT", 35)]
    with pytest.raises(records.InvalidLevel):
        records.record("loud", "x")
    facts = records.diagnostics(spark).first().context
    assert facts["diag.cores"] and int(facts["diag.ram_total_mb"]) > 0 and int(facts["diag.drive.0.total_bytes"]) > 0


def test_sinks(spark, tmp_path):
    rows = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    every = [
        sinks.Sink("text", "text", f"{tmp_path}/text"),
        sinks.Sink("json", "json", f"{tmp_path}/json", takes=SinkFilter(level="ERROR"), compression="gzip"),
        sinks.Sink("daily", "text", f"{tmp_path}/daily/{{date}}"),
        sinks.Sink("table", "parquet", f"{tmp_path}/table", overwrite=True),
        sinks.Sink("broken", "text", "nowhere://x/y"),
        sinks.Sink("off", "text", f"{tmp_path}/off", enabled=False),
    ]
    done = sinks.write_all(rows, every, on_error="silent")
    assert [n for n, e in done.items() if e] == ["broken"] and "off" not in done
    assert spark.read.text(f"{tmp_path}/text").count() == rows.count() == spark.read.parquet(f"{tmp_path}/table").count()
    assert spark.read.text(f"{tmp_path}/json").count() == rows.where("priority >= 40").count()
    assert spark.read.text(f"{tmp_path}/daily").select("date").distinct().count() == rows.select(F.to_date("ts")).distinct().count()
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_all(rows, every[4:5], on_error="fail_fast")


def test_udp(spark, tmp_path):
    from tidelog.sources.network import register

    register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(20)
        got: list[str] = []

        def receive():
            for _ in range(3):
                got.append(s.recv(65_535).decode())

        t = threading.Thread(target=receive)
        t.start()
        rows = log_rows(spark, [("INFO", None, "a"), ("INFO", None, "b"), ("INFO", None, "c")])
        sinks.write(rows, sinks.Sink("net", "udp", port=s.getsockname()[1]))
        t.join(20)
    assert len(got) == 3


def test_pipeline_is_narrow(spark, sf_dir):
    """Gate, redaction, filter, rules and context share one stage, and the gate reaches the scan's columns."""
    rows = adapters.events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    flow = LogPipeline("INFO", patterns=(("contains", "value", "v"),), filter=Filter().message("x", allow=False), context={"a": 1})
    plan = flow.apply(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_windowed_stream(spark, sf_dir):
    batch = {(r.day, r.level): (r.records, r.bytes) for r in catalog.windowed_levels(spark, sf_dir).collect()}
    closed = {(r.day, r.level): (r.records, r.bytes) for r in catalog.stream_windowed_levels(spark, sf_dir).collect()}
    assert closed and closed.items() <= batch.items() and len(batch) - len(closed) <= 10


@pytest.mark.parametrize("fields", [{}, {"minute": 15}, {"hour": 4}, {"minute": 15, "hour": 4, "weekday": 1}, {"hour": 23, "day": 31}, {"minute": 0, "month": 3}, {"minute": 59, "hour": 23, "weekday": 0}, {"day": 30, "month": 2}, {"hour": 24}, {"minute": 60}])
def test_cron_by_brute_force(spark, fields):
    from datetime import UTC, timedelta

    starts = [0, 59_999, 60_000, 1704067200000, 1704067200000 + 86_340_000, 1709164799999, 1706659140001, 1735689599999, -1, -86_400_000, 1705292040000, 1705292100000, None]

    def brute(now):
        for k in range(1, 30 * 24 * 60):
            t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=now + k * 60_000)
            have = {"minute": t.minute, "hour": t.hour, "day": t.day, "month": t.month, "weekday": t.isoweekday() % 7}
            if all(have[f] == v for f, v in fields.items()):
                return now + k * 60_000
        return now + 60_000

    rows = spark.createDataFrame([(s,) for s in starts], "now long").select("now", retention.next_cron(F.col("now"), **fields).alias("cron")).collect()
    assert [r.cron for r in rows] == [None if r.now is None else brute(r.now) for r in rows]


def test_cron_over_whole_table(spark, sf_dir):
    out = catalog.QUERIES["schedule_cron"](spark, sf_dir)
    assert out.count() == catalog.table(spark, sf_dir, "customer").count() > 60
    assert "43199" not in out._jdf.queryExecution().toString()


def test_clean_up_in_many_tasks(spark):
    """Against brute force, with ties, null times and ages, in sixteen blocks; no group of files is one task."""
    rows = [(f"f{k:04}.log", None if k % 97 == 0 else k * 7919 % 900 * 40_000, None if k % 89 == 0 else k % 50, None if k % 83 == 0 else k % 45) for k in range(2000)]
    files = spark.createDataFrame(rows, "name string, mtime long, size long, age long")
    want: dict[str, str | None] = {}
    for group in (True, False, None):
        n = total = 0
        mine = [r for r in rows if (None if r[3] is None else r[3] > 30) is group]
        for name, _, size, _ in sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True):
            n, total = n + 1, total + (size or 0)
            want[name] = "age" if group else "max_files" if n > 700 else "max_total_size" if total > 9_000 else None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = retention.clean_up(files, "*.log", 30, 700, 9_000, blocks=16).select("name", "deleted", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.name: r.deleted for r in got} == want and len(got) == len(rows)
    assert {"max_files", "max_total_size", "age", None} == set(want.values())
    assert len({r.task for r in got if r.deleted != "age"}) > 2


def chain_rows(seed, n=3_000):
    """Records of a hot key, of some others, of a null key; ties and gaps in time."""
    import random

    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", None]
    return [(k, rng.choice(keys), rng.choice([0, 5_000, 10**6, 10**9]) + rng.randrange(rng.choice([50, 20_000, 3_000_000])), rng.choice([0, 1, 7, 90, None])) for k in range(n)]


def in_order(rows):
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    return by_key


@pytest.mark.parametrize(("width", "block", "key_by"), [(1_000, 10, ["k"]), (40, 100_000, ["k"]), (500_000, 1, ["k"]), (1_000, 100, [])])
@pytest.mark.parametrize("hot_keys", [False, True])
def test_chains_of_windows_by_brute_force(spark, monkeypatch, width, block, key_by, hot_keys):
    from tidelog.operators import chains

    monkeypatch.setattr(chains, "BLOCK_VALUES", block)
    rows = chain_rows(1)
    df = spark.createDataFrame(rows, "id long, k string, at long, size long").repartition(5)
    groups = in_order(rows) if key_by else in_order([(r[0], None, *r[2:]) for r in rows])
    limited, rated, numbered = {}, {}, {}
    for own in groups.values():
        state, adaptive, held, number = [0, 0], [0, 0, 1.0], 0, 0
        limit, adapt = sampling.rate_limit_step(3, width), sampling.adaptive_step(20.0, width, 0.01, 1.0)
        for i, _, at, size in own:
            limited[i], rated[i] = limit(state, at)[0], adapt(adaptive, at)[0]
            if held >= width:
                held, number = 0, number + 1
            held += size or 0
            numbered[i] = number
    got = {r.id: r.accepted for r in sampling.flag_rate_limit(df, 3, width, "at", "id", key_by, hot_keys=hot_keys).collect()}
    assert got == limited
    got = {r.id: r.rate for r in sampling.with_adaptive_rate(df, 20.0, "at", "id", key_by, interval_ms=width, hot_keys=hot_keys).collect()}
    assert got == rated
    got = {r.id: r.file_index for r in retention.size_index(df, "size", width, ["at", "id"], key_by, hot_keys).collect()}
    assert got == numbered
    assert sampling.flag_rate_limit(df.limit(0), 3, width, "at", "id", key_by, hot_keys=hot_keys).count() == 0


def test_a_hot_key_is_dealt_to_many_tasks(spark, monkeypatch):
    """What goes through one task a key is a row for each block, not its records."""
    from tidelog.operators import chains

    monkeypatch.setattr(chains, "BLOCK_VALUES", 10_000)
    df = spark.range(200_000).select("id", F.lit("hot").alias("k"), (F.col("id") * 3).alias("at"), F.concat(F.lit("m"), "id").alias("message"))
    starts = chains.window_starts(df.select(chains.key_of(["k"]).alias("_key"), "at"), "at", 1_000)
    assert starts.count() == len(range(0, 600_000, 1_002)) - 1
    flagged = sampling.flag_rate_limit(df, 2, 1_000, "at", "id", ["k"], hot_keys=True)
    assert flagged.where("accepted").count() == 2 * len(range(0, 600_000, 1_002)) and flagged.columns == [*df.columns, "accepted"]
    with pytest.raises(ValueError):
        chains.window_starts(df, "at", 0)


def test_null_messages_and_empty_patterns(spark):
    rows = log_rows(spark, [("INFO", "m", "text"), ("ERROR", None, "other")]).withColumn("message", F.when(F.col("message") == "text", F.col("message")))
    count = lambda f: f.apply(rows).count()
    assert count(Filter().message("text")) == 1 and count(Filter().message("text", allow=False)) == 1
    assert count(Filter().add("message_regex", "t.x")) == 1 and count(Filter().add("message_regex", "t.x", allow=False)) == 1
    assert {r.allowed for r in Filter().message("text").flag(rows).collect()} == {True, False}
    lines = [r.line for r in rows.select(formatting.default_line(rows.columns, show=()).alias("line")).collect()]
    assert lines == ["[INFO] text", "[ERROR] "]
    for f in (redaction.prefix, redaction.suffix, redaction.contains):
        with pytest.raises(ValueError):
            f(F.lit("x"), "", "y")


def test_latency_average_is_exact(spark):
    rows = spark.createDataFrame([(2**62,), (2**61 + 1,), (3,), (None,)], "ns long")
    r = metrics.latency(rows, "ns").first()
    assert r.latency_avg_ns == (2**62 + 2**61 + 4) // 4 and r.records == 4
    assert metrics.latency(rows.limit(0), "ns").first().latency_avg_ns == 0


def test_sink_paths_by_time_and_pattern(spark, tmp_path):
    rows = adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    sinks.write(rows, sinks.Sink("m", "text", f"{tmp_path}/by/{{YYYY-MM}}/{{level}}"))
    back = spark.read.text(f"{tmp_path}/by")
    assert set(back.columns) == {"value", "part_YYYY_MM", "part_level"} and back.count() == rows.count()
    assert back.select("part_YYYY_MM").distinct().count() == rows.select(F.date_format("ts", "yyyy-MM")).distinct().count()


def test_once_rules_over_a_stream(spark, tmp_path):
    """Two rules that share their first record; over two batches each fires once."""
    from tidelog.operators import rules

    schema = "event_id long, ts_ms long, priority int, module string, message string"
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, k * 10 + i, 40 if i else 20, "m", "text") for i in range(5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    book = rules.Rules([rules.Rule(1, level=rules.LevelMatch.at_least(40), once=True), rules.Rule(2, module="m", once=True), rules.Rule(3, level=rules.LevelMatch.at_least(40))])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = windows.drain(book.matched(stream), f"{tmp_path}/c", f"{tmp_path}/o").collect()
    fired = [i for r in out for i in r.rule_ids]
    assert len(out) == 10 and fired.count(1) == 1 and fired.count(2) == 1 and fired.count(3) == 8


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


@pytest.mark.parametrize("kind", ["tcp", "udp"])
def test_socket_batches_end_under_steady_traffic(kind):
    import time

    from tidelog.sources.network import _SocketReader

    tcp = kind == "tcp"
    number = socket.SOCK_STREAM if tcp else socket.SOCK_DGRAM
    port = free_port(number)
    reader = _SocketReader({"port": str(port), "wait_ms": "300", "max_bytes": "100000"}, number)
    reader._open()
    stop = threading.Event()

    def send():
        with socket.socket(socket.AF_INET, number) as s:
            s.connect(("127.0.0.1", port))
            while not stop.is_set():
                s.sendall("é".encode() * 50 + b"\n")
                time.sleep(0.002)

    senders = [threading.Thread(target=send) for _ in range(2)]
    for t in senders:
        t.start()
    at, texts = reader.initialOffset(), []
    for _ in range(3):
        began = time.monotonic()
        rows, after = reader.read(at)
        assert time.monotonic() - began < 3
        rows = list(rows)
        assert [r for r in reader.readBetweenOffsets(at, after)] == rows
        texts += [r[0] for r in rows]
        reader.commit(after)
        assert not reader.kept
        at = after
    stop.set()
    for t in senders:
        t.join(10)
    assert texts and "\ufffd" not in "".join(texts)


def test_tcp_characters_over_chunk_borders():
    from tidelog.sources.network import _SocketReader

    port = free_port(socket.SOCK_STREAM)
    reader = _SocketReader({"port": str(port), "wait_ms": "500"}, socket.SOCK_STREAM)
    reader._open()
    text = "x" + "é漢" * 5_000
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(text.encode())
    rows, _ = reader.read(reader.initialOffset())
    assert "".join(r[0] for r in rows) == text


def test_tcp_source_and_sink(spark, tmp_path):
    from tidelog.sources.network import register

    register(spark)
    with socket.create_server(("127.0.0.1", 0)) as server:
        got: list[bytes] = []

        def receive():
            client, _ = server.accept()
            with client:
                while data := client.recv(4096):
                    got.append(data)

        t = threading.Thread(target=receive)
        t.start()
        rows = log_rows(spark, [("INFO", None, "a"), ("ERROR", None, "b")]).coalesce(1)
        sinks.write(rows, sinks.Sink("net", "tcp", port=server.getsockname()[1]))
        t.join(20)
    assert b"".join(got).decode().count("\n") == 2
    port = free_port(socket.SOCK_STREAM)
    stream = spark.readStream.format("tidelog_tcp").option("port", port).option("wait_ms", 100).load()
    running = windows.start(stream, f"{tmp_path}/out", f"{tmp_path}/check", "low_latency")
    try:
        import time

        sent = False
        for _ in range(300):
            if not sent:
                try:
                    with socket.create_connection(("127.0.0.1", port), timeout=1) as s:
                        s.sendall(b"one line\n")
                    sent = True
                except OSError:
                    pass
            time.sleep(0.2)
            if sent and spark.read.schema("value string").parquet(f"{tmp_path}/out").count():
                break
        assert "".join(r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()) == "one line\n"
    finally:
        running.stop()


@pytest.mark.parametrize("coding", ["", "gzip", "deflate"])
def test_http_source(spark, coding):
    import gzip
    import http.server
    import json
    import zlib

    from tidelog.sources.network import register

    register(spark)
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers.get("X-Key"))
            body = json.dumps([{"a": 1}, {"a": 2}]).encode()
            body = gzip.compress(body) if coding == "gzip" else zlib.compress(body) if coding == "deflate" else body
            self.send_response(200)
            if coding:
                self.send_header("Content-Encoding", coding)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_address[1]}/logs"
        rows = spark.read.format("tidelog_http").option("url", url).option("header.X-Key", "k").load().collect()
        server.shutdown()
    assert [json.loads(r.value)["a"] for r in rows] == [1, 2] and "k" in seen


def test_callback_for_each_batch(spark, tmp_path):
    schema = "event_id long, message string"
    for k in range(3):
        spark.createDataFrame([(k, "m")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.each_batch(stream, lambda rows, n: seen.append((n, rows.count())), f"{tmp_path}/c", "drain").awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and sum(c for _, c in seen) == 3
