"""The registered queries of the log operators, each with its equal in DuckDB's SQL.

A query runs over whole tables. An entry is ``@query("SQL")`` over a function (spark, sf_dir) -> DataFrame of the same name.
"""

from __future__ import annotations

import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import formatting, levels, redaction, scalars
from tidelog.operators import enrich, metrics, retention, rules, sampling, sinks
from tidelog.operators import spans as span_ops
from tidelog.operators.filters import Filter, SinkFilter, level_gate
from tidelog.plans.pipeline import LogPipeline
from tidelog.sources import adapters, network, receivers, records
from tidelog.streaming import carried, rotating, stateful, windows
from tidelog.streaming.workspace import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.orders(table(spark, sf_dir, "orders"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents(table(spark, sf_dir, "documents"))


def _case(column: str, mapping: dict[str, object], default: str) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {shown(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


_PRIORITIES = {n: p for n, p, _ in levels.LEVELS}
EV = f"""logs AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS ts_ms, {_case("event_type", adapters.EVENT_LEVELS, "'INFO'")} AS level,
  CAST({_case("event_type", {k: _PRIORITIES[v] for k, v in adapters.EVENT_LEVELS.items()}, "20")} AS INTEGER) AS priority, 'app.' || event_type AS module,
  printf('user=%d %s value=%.2f', user_id, event_type, value) AS message, user_id, event_type, value, props FROM events)"""
ORD = f"""logs AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, epoch_us(o_orderdate) // 1000 AS ts_ms, {_case("o_orderpriority", adapters.ORDER_LEVELS, "'INFO'")} AS level,
  CAST({_case("o_orderpriority", {k: _PRIORITIES[v] for k, v in adapters.ORDER_LEVELS.items()}, "20")} AS INTEGER) AS priority, 'orders.' || o_orderstatus AS module,
  printf('order %d total=%.2f', o_orderkey, o_totalprice) AS message, o_custkey AS user_id FROM orders)"""
DOC = "logs AS (SELECT doc_id AS event_id, 'INFO' AS level, 20 AS priority, source AS module, text AS message FROM documents)"


def _ev(rest: str) -> str:
    return f"WITH {EV} {rest}"


def _ord(rest: str) -> str:
    return f"WITH {ORD} {rest}"


def _doc(rest: str) -> str:
    return f"WITH {DOC} {rest}"


# --- gates and filters


@query(_ev("SELECT level, COUNT(*) AS records, CAST(SUM(strlen(message)) AS BIGINT) AS bytes FROM logs WHERE priority >= 20 AND NOT contains(message, 'value=4') GROUP BY level"))
def flagship(spark, sf_dir):
    """Gate, message denial, and volume by level."""
    return metrics.level_counts(Filter().message("value=4", allow=False).apply(level_gate(events(spark, sf_dir), "INFO")))


@query(_ev("SELECT event_id, level FROM logs WHERE priority >= 22"))
def level_gate_notice(spark, sf_dir):
    return level_gate(events(spark, sf_dir), "NOTICE").select("event_id", "level")


@query(_ord("SELECT event_id, level FROM logs WHERE priority >= 20 AND priority <= 30"))
def level_band(spark, sf_dir):
    return Filter().min_level("INFO").max_level("WARNING").apply(orders(spark, sf_dir)).select("event_id", "level")


@query(_ev("SELECT event_id FROM logs WHERE priority = 40"))
def level_exact(spark, sf_dir):
    return Filter().add("level_exact", 40).apply(events(spark, sf_dir)).select("event_id")


@query(_ord("SELECT event_id, priority >= 30 AS at_least_warning, priority > 30 AS above_warning, priority >= 40 AS is_error, priority = 30 AS is_warning, priority IN (10, 5) AS is_debug FROM logs"))
def level_predicates(spark, sf_dir):
    p = F.col("priority")
    return orders(spark, sf_dir).select("event_id", levels.at_least(p, "WARNING").alias("at_least_warning"), levels.more_severe(p, "WARNING").alias("above_warning"), levels.is_error(p).alias("is_error"), levels.is_warning(p).alias("is_warning"), levels.is_debug(p).alias("is_debug"))


@query(
    _ev(
        ", m(module, least) AS (VALUES ('app.view', 5), ('app.click', 30)) SELECT event_id, logs.module FROM logs LEFT JOIN m ON logs.module = m.module WHERE priority >= coalesce(least, 22)"
    )
)
def module_level_override(spark, sf_dir):
    return level_gate(events(spark, sf_dir), "NOTICE", {"app.view": "TRACE", "app.click": "WARNING"}).select("event_id", "module")


@query(_ev("SELECT event_id FROM logs WHERE starts_with(module, 'app.p')"))
def module_prefix_allow(spark, sf_dir):
    return Filter().module_prefix("app.p").apply(events(spark, sf_dir)).select("event_id")


@query(_ev("SELECT event_id FROM logs WHERE NOT starts_with(module, 'app.p')"))
def module_prefix_deny(spark, sf_dir):
    return Filter().module_prefix("app.p", allow=False).apply(events(spark, sf_dir)).select("event_id")


@query(_ev("SELECT event_id FROM logs"))
def module_prefix_deny_strict(spark, sf_dir):
    """Under ``strict`` the denial has no effect."""
    return Filter(strict=True).module_prefix("app.p", allow=False).apply(events(spark, sf_dir)).select("event_id")


@query(_doc("SELECT event_id FROM logs WHERE module = 'src3'"))
def module_match(spark, sf_dir):
    return Filter().add("module_match", "src3").apply(documents(spark, sf_dir)).select("event_id")


@query(_doc("SELECT event_id FROM logs WHERE contains(message, 'token')"))
def message_contains_allow(spark, sf_dir):
    return Filter().message("token").apply(documents(spark, sf_dir)).select("event_id")


@query(_doc("SELECT event_id FROM logs WHERE NOT contains(message, 'the')"))
def message_contains_deny(spark, sf_dir):
    return Filter().message("the", allow=False).apply(documents(spark, sf_dir)).select("event_id")


@query(_doc("SELECT event_id FROM logs WHERE regexp_matches(message, '[a-z]+\\.[0-9]+@')"))
def message_regex(spark, sf_dir):
    return Filter().add("message_regex", r"[a-z]+\.[0-9]+@").apply(documents(spark, sf_dir)).select("event_id")


@query(_ev("SELECT event_id FROM logs WHERE value > 250 AND priority >= 20"))
def filter_custom(spark, sf_dir):
    return Filter().add("custom", F.col("value") > 250).min_level("INFO").apply(events(spark, sf_dir)).select("event_id")


@query(_ev("SELECT event_id, priority >= 20 AND contains(message, 'value=1') AS allowed FROM logs"))
def filter_flags(spark, sf_dir):
    return Filter().min_level("INFO").message("value=1").flag(events(spark, sf_dir)).select("event_id", "allowed")


@query(_ev("SELECT COUNT(*) AS total, COUNT(*) FILTER (priority >= 20) AS allowed, COUNT(*) FILTER (priority < 20) AS filtered, COUNT(*) FILTER (priority >= 20) / COUNT(*)::DOUBLE AS allow_rate, COUNT(*) FILTER (priority < 20) / COUNT(*)::DOUBLE AS filter_rate FROM logs"))
def filter_stats(spark, sf_dir):
    return Filter.production().stats(events(spark, sf_dir))


@query(_ev("SELECT 'errors' AS preset, COUNT(*) FILTER (priority >= 40) AS n FROM logs UNION ALL SELECT 'production', COUNT(*) FILTER (priority >= 20) FROM logs UNION ALL SELECT 'module', COUNT(*) FILTER (starts_with(module, 'app.s')) FROM logs"))
def filter_presets(spark, sf_dir):
    e = events(spark, sf_dir)
    named = {"errors": Filter.errors_only(), "production": Filter.production(), "module": Filter.module_only("app.s")}
    counted = e.agg(*[F.count_if(f.predicate()).alias(n) for n, f in named.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in named])))


@query(_ord("SELECT event_id FROM logs WHERE priority >= 20 AND priority <= 50"))
def priority_range_fallback(spark, sf_dir):
    """33 and 77 are no standard priorities."""
    return Filter().priority_range(33, 77).apply(orders(spark, sf_dir)).select("event_id")


_SINKS = [
    sinks.Sink("console", "console", takes=SinkFilter(level="NOTICE")),
    sinks.Sink("app", "json", "x", takes=SinkFilter(include_modules=("app.c", "app.s"), exclude_messages=("value=9",))),
    sinks.Sink("quiet", "text", "x", takes=SinkFilter(max_level="INFO", exclude_modules=("app.v",), include_messages=("user=1", "user=2"))),
    sinks.Sink("off", "text", "x", enabled=False),
]
_TAKES = {
    "console": "priority >= 22",
    "app": "(starts_with(module, 'app.c') OR starts_with(module, 'app.s')) AND NOT contains(message, 'value=9')",
    "quiet": "priority <= 20 AND NOT starts_with(module, 'app.v') AND (contains(message, 'user=1') OR contains(message, 'user=2'))",
}


@query(_ev(f"SELECT event_id FROM logs WHERE {_TAKES['app']}"))
def sink_include_exclude(spark, sf_dir):
    return events(spark, sf_dir).where(_SINKS[1].takes.predicate()).select("event_id")


@query(_ev(" UNION ALL ".join(f"SELECT '{s}' AS sink, event_id FROM logs WHERE {w}" for s, w in _TAKES.items())))
def sink_fanout(spark, sf_dir):
    return sinks.fan_out(events(spark, sf_dir), _SINKS).select("sink", "event_id")


# --- levels


@query(_ord("SELECT event_id, level, level_priority, level_color FROM logs JOIN (VALUES " + ", ".join(f"('{n}', CAST({p} AS INTEGER), '{c}')" for n, p, c in [*levels.LEVELS, ("AUDIT", 35, "35;1")]) + ") t(level, level_priority, level_color) USING (level)"))
def level_dimension(spark, sf_dir):
    """Each order's record with what the dimension of levels says about its level."""
    return orders(spark, sf_dir).select("event_id", "level").join(levels.level_table(spark, {"AUDIT": (35, "35;1")}), "level").select("event_id", "level", "level_priority", "level_color")


@query(
    "SELECT o_orderkey, c.n AS custom_level_name, CAST(c.p AS INTEGER) AS custom_priority, c.c AS custom_level_color, coalesce(c.n, 'INFO') AS shown FROM orders LEFT JOIN (VALUES ('AUDIT', 35, '35;1'), ('TRADE', 26, '36')) c(n, p, c) ON c.n = CASE o_orderstatus WHEN 'F' THEN 'AUDIT' WHEN 'O' THEN 'TRADE' END"
)
def custom_level_lookup(spark, sf_dir):
    named = table(spark, sf_dir, "orders").withColumn("custom", F.when(F.col("o_orderstatus") == "F", "AUDIT").when(F.col("o_orderstatus") == "O", "TRADE"))
    found = levels.resolve_custom(named, "custom", {"AUDIT": (35, "35;1"), "TRADE": (26, "36")})
    return found.select("o_orderkey", "custom_level_name", "custom_priority", "custom_level_color", levels.display_name(F.col("custom_level_name"), F.lit("INFO")).alias("shown"))


@query(_ord("SELECT event_id, " + _case("level", {n: i for i, (n, _, _) in enumerate(levels.LEVELS)}, "NULL") + " AS idx, " + _case("level", {n: c for n, _, c in levels.LEVELS}, "NULL") + " AS color, level AS back FROM logs"))
def level_functions(spark, sf_dir):
    return orders(spark, sf_dir).select("event_id", levels.index_of(F.col("level")).alias("idx"), levels.color_of(F.col("level")).alias("color"), levels.level_of(F.col("priority")).alias("back"))


# --- samplers

_DRAW = "('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT"
DAY = 86_400_000


@query(_ev(f"SELECT event_id FROM logs WHERE {_DRAW} < 1073741824"))
def sample_probability(spark, sf_dir):
    return sampling.sample_probability(events(spark, sf_dir), 0.25, "event_id").select("event_id")


@query(_ev("SELECT event_id, row_number() OVER (ORDER BY ts_ms, event_id) % 10 = 0 AS accepted FROM logs"))
def sample_every_n(spark, sf_dir):
    """One order for all records, ranked in many tasks."""
    return sampling.flag_every_n(events(spark, sf_dir), 10, "ts_ms", "event_id").select("event_id", "accepted")


@query(_ev("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) % 3 = 0 AS accepted FROM logs"))
def sample_every_n_user(spark, sf_dir):
    return sampling.flag_every_n(events(spark, sf_dir), 3, "ts_ms", "event_id", ["user_id"]).select("event_id", "accepted")


def _rate_limit_sql(key: str, most: int, window: int) -> str:
    return f"""WITH RECURSIVE {EV}, o AS (SELECT {key} AS k, event_id, ts_ms, row_number() OVER (PARTITION BY {key} ORDER BY ts_ms, event_id) AS rn FROM logs),
    r AS (SELECT k, rn, event_id, ts_ms AS s0, 1 AS n, TRUE AS accepted FROM o WHERE rn = 1
      UNION ALL SELECT o.k, o.rn, o.event_id, CASE WHEN o.ts_ms - r.s0 >= {window} THEN o.ts_ms ELSE r.s0 END,
        CASE WHEN o.ts_ms - r.s0 >= {window} THEN 1 WHEN r.n < {most} THEN r.n + 1 ELSE r.n END, o.ts_ms - r.s0 >= {window} OR r.n < {most} FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
    SELECT event_id, accepted FROM r"""


@query(_rate_limit_sql("user_id", 2, DAY))
def sample_rate_limit_user(spark, sf_dir):
    return sampling.flag_rate_limit(events(spark, sf_dir), 2, DAY, "ts_ms", "event_id", ["user_id"]).select("event_id", "accepted")


@query(_rate_limit_sql("event_type", 5, 3_600_000))
def sample_rate_limit_type(spark, sf_dir):
    return sampling.flag_rate_limit(events(spark, sf_dir), 5, 3_600_000, "ts_ms", "event_id", ["event_type"], hot_keys=True).select("event_id", "accepted")


_ADAPTIVE = f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM logs),
    r AS (SELECT user_id, rn, event_id, ts_ms AS s0, 1 AS n, 1.0::DOUBLE AS rate FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.ts_ms - r.s0 >= {DAY} THEN o.ts_ms ELSE r.s0 END, CASE WHEN o.ts_ms - r.s0 >= {DAY} THEN 1 ELSE r.n + 1 END,
        CASE WHEN o.ts_ms - r.s0 < {DAY} THEN r.rate WHEN r.n / {DAY / 1000}::DOUBLE > 0.00003::DOUBLE THEN greatest(0.01::DOUBLE, r.rate * 0.9::DOUBLE) ELSE least(1.0::DOUBLE, r.rate * 1.1::DOUBLE) END
        FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, rate, {_DRAW} < floor(rate * 4294967296) AS accepted FROM r"""


@query(_ADAPTIVE)
def sample_adaptive_user(spark, sf_dir):
    return sampling.with_adaptive_rate(events(spark, sf_dir), 0.00003, "ts_ms", "event_id", ["user_id"], interval_ms=DAY).select("event_id", "rate", "accepted")


@query(_ev(f"SELECT COUNT(*) AS total, COUNT(*) FILTER (a) AS accepted, COUNT(*) FILTER (NOT a) AS rejected, COUNT(*) FILTER (a) / COUNT(*)::DOUBLE AS accept_rate FROM (SELECT {_DRAW} < 429496729 AS a FROM logs)"))
def sample_stats(spark, sf_dir):
    return sampling.sample_stats(sampling.Sampler.preset("ten_percent").flag(events(spark, sf_dir)))


@query(_ev(f"SELECT CASE WHEN {_DRAW} < 2147483648 THEN 'accepted' ELSE 'probability_filter' END AS outcome, COUNT(*) AS n FROM logs GROUP BY 1"))
def sample_reasons(spark, sf_dir):
    flagged = sampling.Sampler.preset("fifty_percent").flag(events(spark, sf_dir))
    return flagged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- redaction


@query("SELECT c_custkey, '[REDACTED]' AS v FROM customer")
def redact_full(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.full(F.col("c_name")).alias("v"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS v FROM customer")
def redact_partial_start(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.partial_start(F.col("c_name")).alias("v"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS v FROM customer")
def redact_partial_end(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.partial_end(F.col("c_name")).alias("v"))


@query("SELECT c_custkey, CASE WHEN length(c_mktsegment) <= 6 THEN '***' ELSE left(c_mktsegment, 3) || repeat('*', length(c_mktsegment) - 6) || right(c_mktsegment, 3) END AS v FROM customer")
def redact_mask_middle(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.mask_middle(F.col("c_mktsegment")).alias("v"))


@query("SELECT c_custkey, '[HASH:' || substr(sha256(c_name), 1, 16) || ']' AS v FROM customer")
def redact_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.hashed(F.col("c_name")).alias("v"))


@query("SELECT doc_id, md5(replace(text, 'token', '[TOKEN]')) AS v FROM documents")
def redact_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.contains(F.col("text"), "token", "[TOKEN]")).alias("v"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN '[KIND]' || substr(p_type, 9) ELSE p_type END AS a, CASE WHEN ends_with(p_name, '1') THEN left(p_name, length(p_name) - 1) || '[ONE]' ELSE p_name END AS b, CASE WHEN p_brand = 'Brand#13' THEN '[BRAND]' ELSE p_brand END AS c FROM part")
def redact_prefix_suffix_exact(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", redaction.prefix(F.col("p_type"), "STANDARD", "[KIND]").alias("a"), redaction.suffix(F.col("p_name"), "1", "[ONE]").alias("b"), redaction.exact(F.col("p_brand"), "Brand#13", "[BRAND]").alias("c"))


_MAIL = r"\w.\d\d@\w+.com"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT doc_id, md5(regexp_replace(text, {_sql_text(redaction.translate(_MAIL))}, '[MAIL]', 'g')) AS v FROM documents")
def redact_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.regex(F.col("text"), _MAIL, "[MAIL]")).alias("v"))


_CHAIN = (("contains", "token", "[T]"), ("regex", _MAIL, "[MAIL]"), ("contains", "[T]", "[TT]"))
_CHAIN_SQL = f"replace(regexp_replace(replace(text, 'token', '[T]'), {_sql_text(redaction.translate(_MAIL))}, '[MAIL]', 'g'), '[T]', '[TT]')"


@query(f"SELECT doc_id, md5({_CHAIN_SQL}) AS v FROM documents")
def redact_chain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.redact_message(F.col("text"), _CHAIN)).alias("v"))


@query(f"SELECT source, COUNT(*) AS processed, COUNT(*) FILTER ({_CHAIN_SQL} <> text) AS redacted, COUNT(*) FILTER ({_CHAIN_SQL} <> text) / COUNT(*)::DOUBLE AS redaction_rate FROM documents GROUP BY source")
def redact_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("changed", redaction.redact_message(F.col("text"), _CHAIN) != F.col("text"))
    n, hit = F.count(F.lit(1)), F.count_if("changed")
    return d.groupBy("source").agg(n.alias("processed"), hit.alias("redacted"), scalars.rate(hit, n).alias("redaction_rate"))


_AUDITED = (("contains", "token", "[T]"), ("prefix", "a", "[A]"), ("regex", r"\d", "#"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'token') THEN '0' END, CASE WHEN starts_with(replace(text, 'token', '[T]'), 'a') THEN '1' END, CASE WHEN regexp_matches(text, '[0-9]') THEN '2' END) AS patterns FROM documents")
def redact_audit(spark, sf_dir):
    """Which patterns changed each message."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(redaction.audit(F.col("text"), _AUDITED), ",").alias("patterns"))


@query(_ev("SELECT event_type, CAST(SUM(1 + CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS fields_redacted FROM logs GROUP BY event_type"))
def redact_field_counts(spark, sf_dir):
    """Fields that are redacted by name, in all contexts."""
    e = enrich.bind(events(spark, sf_dir), {"Token": "x", "env": "prod"})
    return e.groupBy("event_type").agg(F.sum(redaction.fields_redacted(F.col("context"), {"token": "full", "K": "hash"})).alias("fields_redacted"))


@query(
    "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS name, '[REDACTED]' AS address, '[HASH:' || substr(sha256(c_custkey::VARCHAR), 1, 16) || ']' AS user_id, c_mktsegment AS segment FROM customer"
)
def redact_preset_fields(spark, sf_dir):
    fields = redaction.PRESETS["gdpr"]
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", redaction.redact_field("Name", F.col("c_name"), fields).alias("name"), redaction.redact_field("ADDRESS", F.col("c_mktsegment"), fields).alias("address"), redaction.redact_field("user_id", F.col("c_custkey").cast("string"), fields).alias("user_id"), redaction.redact_field("segment", F.col("c_mktsegment"), fields).alias("segment"))


@query("SELECT event_id, CASE WHEN length(user_id::VARCHAR) <= 4 THEN '****' ELSE left(user_id::VARCHAR, 4) || repeat('*', length(user_id::VARCHAR) - 4) END AS token, json_extract_string(props, '$.k') AS k FROM events")
def redact_context(spark, sf_dir):
    e = enrich.with_fields(events(spark, sf_dir), {}).withColumn("context", enrich.merge_context(F.col("context"), F.create_map(F.lit("Token"), F.col("user_id").cast("string"))))
    hidden = e.withColumn("context", redaction.redact_context(F.col("context"), redaction.PRESETS["common"]))
    return hidden.select("event_id", F.try_element_at("context", F.lit("Token")).alias("token"), F.try_element_at("context", F.lit("k")).alias("k"))


# --- rules

RULES = rules.Rules()
RULES.add(rules.Rule(1, (rules.message("cause", "The call failed", title="Cause"), rules.message("fix", "Try again", url="https://docs.example/retry")), rules.LevelMatch.exact("ERROR")))
RULES.add(rules.Rule(2, (rules.message("note", "Large value"),), rules.LevelMatch.between(20, 25), message_contains="value=4"))
RULES.add(rules.Rule(3, (rules.message("perf", "Slow module", title="Speed"),), rules.LevelMatch.at_least(22), module="app.purchase"))
RULES.add(rules.Rule(4, (rules.message("security", "Never"),), enabled=False))
RULES.add(rules.Rule(5, (rules.message("docs", "First signup"),), rules.LevelMatch.at_most(25), module="app.signup", once=True))
_RULE_SQL = {1: "priority = 40", 2: "priority BETWEEN 20 AND 25 AND contains(message, 'value=4')", 3: "priority >= 22 AND module = 'app.purchase'", 5: "event_id = (SELECT arg_min(event_id, (ts_ms, event_id)) FROM logs WHERE module = 'app.signup')"}
_MATCHES = ", matches AS (" + " UNION ALL ".join(f"SELECT event_id, {n} AS rule_id FROM logs WHERE {w}" for n, w in _RULE_SQL.items()) + ")"
_MESSAGES = _MATCHES + """, msgs AS (SELECT event_id, pos, text, js FROM matches JOIN (VALUES
  (1, 1, chr(10) || '    -> [cause] Cause: The call failed', '{"category":"error_analysis","title":"Cause","message":"The call failed"}'),
  (1, 2, chr(10) || '    -> [fix] Try again (https://docs.example/retry)', '{"category":"solution_suggestion","message":"Try again","url":"https://docs.example/retry"}'),
  (2, 3, chr(10) || '    -> [note] Large value', '{"category":"general_information","message":"Large value"}'),
  (3, 4, chr(10) || '    -> [perf] Speed: Slow module', '{"category":"performance_tip","title":"Speed","message":"Slow module"}'),
  (5, 5, chr(10) || '    -> [docs] First signup', '{"category":"documentation_link","message":"First signup"}')) m(rule, pos, text, js) ON rule = rule_id)"""


@query(_ev(_MATCHES + " SELECT event_id, CAST(rule_id AS INTEGER) AS rule_id FROM matches"))
def rules_match(spark, sf_dir):
    return RULES.matched(events(spark, sf_dir)).select("event_id", F.explode("rule_ids").alias("rule_id"))


@query(_ev(_MATCHES + " SELECT event_id, CAST(rule_id AS INTEGER) AS rule_id FROM matches WHERE rule_id = 5"))
def rules_once(spark, sf_dir):
    return RULES.matched(events(spark, sf_dir)).select("event_id", F.explode("rule_ids").alias("rule_id")).where("rule_id = 5")


@query(_ev(_MESSAGES + " SELECT event_id, string_agg(text, '' ORDER BY pos) AS lines FROM msgs GROUP BY event_id"))
def rules_text(spark, sf_dir):
    return RULES.evaluate(events(spark, sf_dir)).where("rule_messages IS NOT NULL").select("event_id", rules.render_text(F.col("rule_messages")).alias("lines"))


@query(_ev(_MESSAGES + " SELECT event_id, '[' || string_agg(js, ',' ORDER BY pos) || ']' AS js FROM msgs GROUP BY event_id"))
def rules_json(spark, sf_dir):
    return RULES.evaluate(events(spark, sf_dir)).where("rule_messages IS NOT NULL").select("event_id", rules.render_json(F.col("rule_messages")).alias("js"))


@query(_ev("SELECT CAST(0 AS BIGINT) AS evaluated, CAST(0 AS BIGINT) AS matched, CAST(0 AS BIGINT) AS messages_emitted, COUNT(*) AS skipped, CAST(0 AS DOUBLE) AS match_rate FROM logs"))
def rules_stats_off(spark, sf_dir):
    """A registry that is switched off."""
    return rules.Rules(list(RULES.rules), enabled=False).stats(events(spark, sf_dir))


#: A rule for each order: its number in the text, and by its priority a least level or a module.
_ORDER_RULES = """r AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 40 END AS level_min, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'ship.' || o_orderstatus END AS module FROM orders)"""


@query(
    f"WITH {_ORDER_RULES}, logs AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_orderkey, CASE l_returnflag WHEN 'R' THEN 30 WHEN 'A' THEN 40 ELSE 20 END AS priority, 'ship.' || l_linestatus AS module FROM lineitem)"
    " SELECT event_id, r.id AS rule_id FROM logs JOIN r ON r.id = logs.l_orderkey WHERE priority >= coalesce(level_min, 0) AND logs.module = coalesce(r.module, logs.module)"
)
def rules_match_orders(spark, sf_dir):
    """As many rules as there are orders over all line items; a message begins with ``order <number> ``."""
    p = F.col("o_orderpriority")
    known = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(True).alias("enabled"), F.when(p == "1-URGENT", 30).when(p == "2-HIGH", 40).alias("level_min"), F.lit(None).cast("int").alias("level_max"),
        F.when(p == "3-MEDIUM", F.concat(F.lit("ship."), "o_orderstatus")).alias("module"), F.lit(None).cast("string").alias("function"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("message_contains"),
    )
    return rules.match_table(adapters.lineitem(table(spark, sf_dir, "lineitem")), known)


@query(_ev(_MESSAGES + " SELECT (SELECT COUNT(*) FROM logs) AS evaluated, (SELECT COUNT(*) FROM matches) AS matched, (SELECT COUNT(*) FROM msgs) AS messages_emitted, CAST(0 AS BIGINT) AS skipped, (SELECT COUNT(*) FROM matches) / (SELECT COUNT(*) FROM logs)::DOUBLE AS match_rate"))
def rules_stats(spark, sf_dir):
    return RULES.stats(events(spark, sf_dir))


@query(
    _ord("SELECT event_id, CAST(id AS INTEGER) AS rule_id FROM logs JOIN (VALUES (1, 40, NULL, NULL, NULL), (2, NULL, 22, 'orders.O', NULL), (3, 20, 30, NULL, 'total=1')) r(id, lo, hi, m, t) ON (lo IS NULL OR priority >= lo) AND (hi IS NULL OR priority <= hi) AND (m IS NULL OR module = m) AND (t IS NULL OR contains(message, t))")
)
def rules_match_table(spark, sf_dir):
    known = spark.createDataFrame([(1, True, 40, None, None, None, None), (2, True, None, 22, "orders.O", None, None), (3, True, 20, 30, None, None, "total=1"), (4, False, None, None, None, None, None)], "id int, enabled boolean, level_min int, level_max int, module string, function string, message_contains string")
    return rules.match_table(orders(spark, sf_dir), known)


@query(
    _ev(
        _MESSAGES
        + ", c(category, display_name, prefix, prefix_ascii, color) AS (VALUES " + ", ".join(f"('{c}', '{n}', '    -> [{t}]', '    |-- [{t}]', '{k}')" for c, (n, t, k) in rules.CATEGORIES.items())
        + ") SELECT event_id, CAST(pos AS INTEGER) AS pos, c.category, display_name, prefix, prefix_ascii, color FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS pos, json_extract_string(js, '$.category') AS category FROM msgs) m JOIN c USING (category)"
    )
)
def rule_categories(spark, sf_dir):
    """Each message that rules emit, with what its category says."""
    emitted = RULES.evaluate(events(spark, sf_dir)).select("event_id", F.posexplode("rule_messages").alias("pos", "m")).select("event_id", "pos", F.col("m.category").alias("category"))
    return emitted.join(rules.category_table(spark), "category").select("event_id", "pos", "category", "display_name", "prefix", "prefix_ascii", "color")


# --- metrics


@query(_ev("SELECT COUNT(*) AS total_records, CAST(SUM(strlen(message)) AS BIGINT) AS total_bytes FROM logs"))
def metrics_totals(spark, sf_dir):
    return metrics.totals(events(spark, sf_dir))


@query("SELECT " + _case("o_orderpriority", adapters.ORDER_LEVELS, "'INFO'") + " AS level, COUNT(*) AS records, CAST(SUM(strlen(printf('order %d total=%.2f', o_orderkey, o_totalprice))) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def metrics_levels(spark, sf_dir):
    return metrics.level_counts(orders(spark, sf_dir))


_RATES = """, s AS (SELECT COUNT(*) FILTER (priority >= 20) AS total_records, CAST(coalesce(SUM(strlen(message)) FILTER (priority >= 20), 0) AS BIGINT) AS total_bytes, COUNT(*) FILTER (priority >= 40) AS errors,
  COUNT(*) FILTER (priority < 20) AS dropped, max(ts_ms) - min(ts_ms) AS uptime_ms FROM logs), x AS (SELECT *, total_records / (uptime_ms / 1000.0::DOUBLE) AS records_per_second, total_bytes / (uptime_ms / 1000.0::DOUBLE) AS bytes_per_second FROM s)"""


def _snapshot(spark, sf_dir):
    return metrics.rates(events(spark, sf_dir), F.col("priority") >= 40, F.col("priority") < 20)


@query(_ev(_RATES + " SELECT *, errors / total_records::DOUBLE AS error_rate, dropped / total_records::DOUBLE AS drop_rate FROM x"))
def metrics_rates(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query(_ev(_RATES + " SELECT errors / total_records::DOUBLE > 0.2 AS error_rate_exceeded, dropped / total_records::DOUBLE > 0.5 AS drop_rate_exceeded, records_per_second > 0.001 AS records_per_second_exceeded FROM x"))
def metrics_thresholds(spark, sf_dir):
    flags = metrics.over_thresholds(_snapshot(spark, sf_dir), {"error_rate": 0.2, "drop_rate": 0.5, "records_per_second": 0.001})
    return flags.select("error_rate_exceeded", "drop_rate_exceeded", "records_per_second_exceeded")


def _latencies(spark, sf_dir):
    return events(spark, sf_dir).withColumn("ns", F.round(F.col("value") * 1_000_000).cast("long"))


_NS = "CAST(round(value * 1000000) AS BIGINT)"


@query(_ev(f"SELECT module, COUNT(*) AS records, CAST(SUM({_NS}) AS BIGINT) AS latency_sum_ns, MIN({_NS}) AS latency_min_ns, MAX({_NS}) AS latency_max_ns, CAST(SUM({_NS}) // COUNT(*) AS BIGINT) AS latency_avg_ns FROM logs GROUP BY module"))
def metrics_latency(spark, sf_dir):
    return metrics.latency(_latencies(spark, sf_dir), "ns", ["module"])


@query(
    _ev(", b AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {b if b else 'NULL'}, {lo})" for k, (b, lo) in enumerate(zip([*metrics.BOUNDS, None], [-1, *metrics.BOUNDS], strict=True))) + f") t(bucket, upper_ns, lo)) SELECT CAST(bucket AS INTEGER) AS bucket, CAST(upper_ns AS BIGINT) AS upper_ns, COUNT(event_id) AS n FROM b LEFT JOIN logs ON {_NS} > lo AND (upper_ns IS NULL OR {_NS} <= upper_ns) GROUP BY 1, 2")
)
def metrics_histogram(spark, sf_dir):
    return metrics.histogram(_latencies(spark, sf_dir), "ns")


@query(_ev(", f AS (" + " UNION ALL ".join(f"SELECT '{s}' AS sink, * FROM logs WHERE {w}" for s, w in _TAKES.items()) + ") SELECT sink, COUNT(*) AS records_written, CAST(SUM(strlen(message)) AS BIGINT) AS bytes_written, COUNT(*) FILTER (event_id % 97 = 0) AS write_errors, COUNT(*) FILTER (event_id % 97 = 0) / COUNT(*)::DOUBLE AS error_rate, SUM(strlen(message)) / COUNT(*)::DOUBLE AS avg_bytes FROM f GROUP BY sink"))
def metrics_per_sink(spark, sf_dir):
    return metrics.per_sink(sinks.fan_out(events(spark, sf_dir), _SINKS).withColumn("write_failed", F.col("event_id") % 97 == 0))


@query(_ev("SELECT period, records, bytes FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS period, COUNT(*) AS records, CAST(SUM(strlen(message)) AS BIGINT) AS bytes FROM logs GROUP BY 1 ORDER BY 1 DESC LIMIT 7)"))
def metrics_history(spark, sf_dir):
    """The last seven daily snapshots."""
    return metrics.history(events(spark, sf_dir), F.to_date("ts"), 7)


@query(_ev("SELECT COUNT(*) AS records, COUNT(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE) AS records_per_second, SUM(strlen(message)) / COUNT(*)::DOUBLE AS avg_bytes_per_record FROM logs"))
def logger_stats(spark, sf_dir):
    return metrics.summary(events(spark, sf_dir))


@query(_ev("SELECT user_id, max(d) AS max_depth FROM (SELECT user_id, CAST(sum(CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS BIGINT) AS d FROM logs) GROUP BY user_id"))
def queue_depth(spark, sf_dir):
    return metrics.queue_depth(events(spark, sf_dir), ["ts_ms", "event_id"], F.when(F.col("event_type").isin("click", "signup"), 1).otherwise(-1), ["user_id"])


@query(_ev("SELECT 'Level Breakdown:' || string_agg(' ' || level || ':' || n, ',' ORDER BY priority) AS breakdown FROM (SELECT level, priority, COUNT(*) AS n FROM logs GROUP BY 1, 2)"))
def level_breakdown(spark, sf_dir):
    return metrics.level_breakdown(events(spark, sf_dir))


@query(_ev(_RATES + """ SELECT '{"total_records":' || total_records || ',"total_bytes":' || total_bytes || ',"dropped":' || dropped || ',"errors":' || errors || ',"uptime_ms":' || uptime_ms || ',"rps":' || printf('%.2f', records_per_second) || ',"bps":' || printf('%.2f', bytes_per_second) || '}' AS line FROM x"""))
def export_json(spark, sf_dir):
    return metrics.export(_snapshot(spark, sf_dir), "json")


@query(_ev(_RATES + " SELECT unnest(['tidelog.records.total:' || total_records || '|c', 'tidelog.bytes.total:' || total_bytes || '|c', 'tidelog.dropped.total:' || dropped || '|c', 'tidelog.errors.total:' || errors || '|c', 'tidelog.rps:' || printf('%.2f', records_per_second) || '|g']) AS line FROM x"))
def export_statsd(spark, sf_dir):
    return metrics.export(_snapshot(spark, sf_dir), "statsd")


@query(
    _ev(_RATES + " SELECT unnest([" + ", ".join(f"'# HELP tidelog_{n} {h}', '# TYPE tidelog_{n} {k}', 'tidelog_{n} ' || {v}" for n, h, k, v in (("records_total", "Total log records", "counter", "total_records"), ("bytes_total", "Total bytes logged", "counter", "total_bytes"), ("dropped_total", "Dropped records", "counter", "dropped"), ("errors_total", "Error count", "counter", "errors"), ("records_per_second", "Records per second", "gauge", "printf('%.2f', records_per_second)"))) + "]) AS line FROM x")
)
def export_prometheus(spark, sf_dir):
    return metrics.export(_snapshot(spark, sf_dir), "prometheus")


@query(_ev(_RATES + " SELECT unnest(['Metrics', '  Total Records: ' || total_records, '  Total Bytes: ' || total_bytes, '  Dropped: ' || dropped, '  Errors: ' || errors, '  Uptime: ' || uptime_ms || 'ms', '  Rate: ' || printf('%.2f', records_per_second) || ' records/sec', '  Throughput: ' || printf('%.2f', bytes_per_second) || ' bytes/sec']) AS line FROM x"))
def export_text(spark, sf_dir):
    return metrics.export(_snapshot(spark, sf_dir), "text")


# --- formats

_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad((ts_ms % 1000)::VARCHAR, 3, '0')"


@query(_ev(f"SELECT event_id, '[' || {_TIME} || '] [' || level || '] [' || module || '] ' || message AS line FROM logs"))
def format_text(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", formatting.default_line(e.columns).alias("line"))


@query(_ev(f"SELECT event_id, {_TIME} || ' / ' || level || ' / ' || message || ' {{what}} <> {{open' AS line FROM logs"))
def format_template(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", formatting.template("{time} / {level} / {message} {what} <{function}> {open", e.columns).alias("line"))


@query(_ev(f"""SELECT event_id, '{{"timestamp":"' || {_TIME} || '","level":"' || level || '","message":"' || message || '","module":"' || module || '"}}' AS line FROM logs"""))
def format_json(spark, sf_dir):
    e = events(spark, sf_dir).drop("context")
    return e.select("event_id", formatting.json_line(e.columns).alias("line"))


@query(_ev("SELECT event_id, '<' || (8 + " + _case("level", formatting.SEVERITY, "NULL") + ") || '>1 ' || ts_ms // 1000 || ' host1 app1 - - - ' || message AS line FROM logs"))
def format_syslog(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", formatting.syslog_line("user", "host1", "app1").alias("line"))


@query(_ord("SELECT event_id, " + _case("level", formatting.SEVERITY, "NULL") + " AS severity, " + _case("level", formatting.EVENT_TYPE, "'INFO'") + " AS kind FROM logs"))
def syslog_severity(spark, sf_dir):
    return orders(spark, sf_dir).select("event_id", formatting.severity(F.col("level")).alias("severity"), formatting.event_type(F.col("level")).alias("kind"))


@query(_ev("SELECT event_id, chr(27) || '[' || CASE level WHEN 'ERROR' THEN '1;31' ELSE " + _case("level", {n: c for n, _, c in levels.LEVELS}, "NULL") + " END || 'm' || message || chr(27) || '[0m' AS line FROM logs"))
def format_color(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", formatting.colored(F.col("message"), formatting.line_color(e.columns, {"ERROR": "1;31"})).alias("line"))


@query(_ev("SELECT event_id, (ts_ms // 1000)::VARCHAR AS unix, ts_ms::VARCHAR AS unix_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((ts_ms % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc FROM logs"))
def time_formats(spark, sf_dir):
    t = lambda f: formatting.time_text(F.col("ts"), F.col("ts_ms"), f)
    return events(spark, sf_dir).select("event_id", t("unix").alias("unix"), t("unix_ms").alias("unix_ms"), t("ISO8601").alias("iso"), t("RFC3339").alias("rfc"))


@query(_ev("SELECT event_id, strftime(ts, '%d/%m/%Y at %H:%M:%S') AS a, strftime(ts, '%y|%-m|%-d|%-H|%I|%-S') AS b FROM logs"))
def date_pattern(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", formatting.date_pattern(F.col("ts"), "DD/MM/YYYY at HH:mm:ss").alias("a"), formatting.date_pattern(F.col("ts"), "YY|M|D|H|hh|s").alias("b"))


# --- scalars

#: What comes behind the size of a part, by its number; the last ones stand alone.
_SIZES = ["", "B", "KB", "K", " MB", "M", "GB", "g", " tb", "T", " parsecs", "7K"]
_TIMES = ["ms", "s", "m", "h", "d", "", " weeks", " S", "5m"]
_ALONE = ["", "invalid", "x1"]


def _texts(spark, sf_dir, units):
    """A text for each part: its size and a unit, or one without digits at its beginning."""
    n = F.pmod("p_partkey", F.lit(len(units) + len(_ALONE)))
    made = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, units)), F.least(n + 1, F.lit(len(units))).cast("int")))
    alone = F.element_at(F.array(*map(F.lit, _ALONE)), F.greatest(n - len(units) + 1, F.lit(1)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n < len(units), made).otherwise(alone).alias("t"))


def _texts_sql(units):
    k = f"p_partkey % {len(units) + len(_ALONE)}"
    told = " ".join(f"WHEN {i} THEN p_size || '{u}'" for i, u in enumerate(units)) + " " + " ".join(f"WHEN {len(units) + i} THEN '{t}'" for i, t in enumerate(_ALONE))
    return f"(SELECT p_partkey, CASE {k} {told} END AS t FROM part)"


@query("SELECT p_partkey, t, CASE WHEN regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 1) <> '' THEN CAST(regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 1) AS BIGINT) * CASE upper(regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 2)) WHEN 'K' THEN 1024 WHEN 'KB' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'MB' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'GB' THEN 1073741824 WHEN 'T' THEN 1099511627776 WHEN 'TB' THEN 1099511627776 ELSE 1 END END AS v FROM " + _texts_sql(_SIZES))
def parse_size(spark, sf_dir):
    return _texts(spark, sf_dir, _SIZES).select("p_partkey", "t", scalars.parse_size(F.col("t")).alias("v"))


@query("SELECT p_partkey, t, CASE WHEN regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 1) <> '' THEN CAST(regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 1) AS BIGINT) * CASE regexp_extract(t, '^(\\d+)\\s*([A-Za-z]*)', 2) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 ELSE 1 END END AS v FROM " + _texts_sql(_TIMES))
def parse_duration(spark, sf_dir):
    return _texts(spark, sf_dir, _TIMES).select("p_partkey", "t", scalars.parse_duration(F.col("t")).alias("v"))


def _rounded(x: str, unit: int, suffix: str) -> str:
    """x / unit with two digits, halves up."""
    return f"printf('%d.%02d{suffix}', ({x} * 200 + {unit}) // {2 * unit} // 100, ({x} * 200 + {unit}) // {2 * unit} % 100)"


_SHOWN_SIZE = " ".join(f"WHEN n_chars * 1000 >= {u} THEN {_rounded('n_chars * 1000', u, s)}" for u, s in ((1 << 30, " GB"), (1 << 20, " MB"), (1 << 10, " KB")))
_SHOWN_TIME = " ".join(f"WHEN n_chars * 50 >= {u} THEN {_rounded('n_chars * 50', u, s)}" for u, s in ((3_600_000, "h"), (60_000, "m"), (1_000, "s")))


@query(f"SELECT doc_id, CASE {_SHOWN_SIZE} ELSE (n_chars * 1000) || ' B' END AS size, CASE {_SHOWN_TIME} ELSE (n_chars * 50) || 'ms' END AS took FROM documents")
def format_size_duration(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.format_size(n * 1000).alias("size"), scalars.format_duration(n * 50).alias("took"))


@query(_ev(", s AS (SELECT event_id, ts, ts_ms, ts_ms // 1000 AS s FROM logs) SELECT event_id, CAST(s // 86400 * 86400 AS BIGINT) AS day, CAST(s // 3600 * 3600 AS BIGINT) AS hour, s // 86400 = (s + 50000) // 86400 AS same_day, s // 3600 = (s + 1000) // 3600 AS same_hour, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d FROM s"))
def calendar_buckets(spark, sf_dir):
    s = F.floor(F.col("ts_ms") / 1000).cast("long")
    ts = scalars.from_epoch_ms(F.col("ts_ms"))
    return events(spark, sf_dir).select("event_id", scalars.start_of_day(s).alias("day"), scalars.start_of_hour(s).alias("hour"), scalars.same_day(s, s + 50_000).alias("same_day"), scalars.same_hour(s, s + 1_000).alias("same_hour"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"))


@query("SELECT c_custkey, CAST(least(greatest(c_acctbal, 0), 5000) AS DOUBLE) AS clamped, greatest(c_custkey - 700, 0) AS unsigned, CASE WHEN length(c_custkey::VARCHAR) >= 6 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS padded, CAST(100 * 2.0 ** (c_custkey % 5) AS DOUBLE) AS delay FROM customer")
def number_functions(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.clamp(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("clamped"), scalars.to_unsigned(k - 700).alias("unsigned"), scalars.pad_digits(k, 6).alias("padded"), scalars.retry_delay(F.lit(100), F.lit(2.0), k % 5).alias("delay"))


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 0.0 ELSE n_chars / (n_chars % 7)::DOUBLE END AS rate, CASE WHEN n_chars % 7 = 0 THEN 0.0 ELSE n_chars / (n_chars % 7)::DOUBLE * 100 END AS pct, CASE WHEN n_chars = 0 THEN 0.0 ELSE (1 - (n_chars // 3) / n_chars::DOUBLE) * 100 END AS saved FROM documents")
def rates(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.rate(n, n % 7).alias("rate"), scalars.percentage(n, n % 7).alias("pct"), scalars.savings_percent(n, F.floor(n / 3)).alias("saved"))


@query(None)
def crc32_text(spark, sf_dir):
    """No crc32 in the oracle's SQL; the tests compare with zlib."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), scalars.compression_ratio(F.octet_length("text"), F.length("text")).alias("ratio"))


@query(
    "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')) AS v FROM documents"
)
def escape_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.escape_json(F.col("text"))).alias("v"))


# --- enrichment


@query("SELECT event_id, 'prod' AS env, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'bound' ELSE json_extract_string(props, '$.k') END AS k, 'x' AS call, CAST(3 AS INTEGER) AS n FROM events")
def context_merge(spark, sf_dir):
    """The bound context, then the record's, then the call's: later ones win."""
    e = enrich.with_fields(enrich.bind(events(spark, sf_dir), {"env": "prod", "k": "bound", "call": "no"}), {"call": "x"})
    at = lambda k: F.try_element_at("context", F.lit(k))
    return e.select("event_id", at("env").alias("env"), at("k").alias("k"), at("call").alias("call"), F.size("context").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(1 AS INTEGER) AS n FROM events")
def context_unbind(spark, sf_dir):
    e = enrich.unbind(enrich.bind(events(spark, sf_dir), {"env": "prod"}), "env")
    return e.select("event_id", F.try_element_at("context", F.lit("k")).alias("k"), F.size("context").alias("n"))


_SPANS = """SELECT conv_id, turn, md5('trace-' || conv_id) AS trace_id, substr(md5('span-' || conv_id || '-' || turn), 1, 16) AS span_id,
  lag(substr(md5('span-' || conv_id || '-' || turn), 1, 16)) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_span_id FROM conversations"""


@query(_SPANS)
def trace_spans(spark, sf_dir):
    return enrich.with_spans(adapters.conversations(table(spark, sf_dir, "conversations")), "conv_id", "turn").select("conv_id", "turn", "trace_id", "span_id", "parent_span_id")


@query(f"WITH s AS ({_SPANS}) SELECT a.conv_id, a.turn, b.turn AS parent_turn, b.role AS parent_role FROM s a LEFT JOIN (SELECT s.*, c.role FROM s JOIN conversations c USING (conv_id, turn)) b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id")
def span_parents(spark, sf_dir):
    """Each span joined to its parent."""
    s = enrich.with_spans(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    parents = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"))
    return s.join(parents, ["trace_id", "parent_span_id"], "left").select("conv_id", "turn", "parent_turn", "parent_role")


@query(_ev("SELECT event_id, CASE WHEN n IS NULL THEN NULL ELSE greatest(n - ts_ms, 0) * 1000000 END AS duration_ns FROM (SELECT event_id, ts_ms, lead(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS n FROM logs)"))
def span_durations(spark, sf_dir):
    return enrich.span_durations(events(spark, sf_dir), "user_id", "ts_ms", "event_id").select("event_id", "duration_ns")


#: Clicks and views start a span, purchases and errors end one.
_STEP = "CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END"
#: Each user's records one after the other, with the stack of open spans.
_STACKS = f""", seq AS (SELECT user_id, event_id, ts_ms, {_STEP} AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS n FROM logs),
  walk AS (SELECT user_id, n, event_id, ts_ms, step, CASE WHEN step = 1 THEN [event_id] ELSE CAST([] AS BIGINT[]) END AS open, CAST([] AS BIGINT[]) AS was FROM seq WHERE n = 1
    UNION ALL SELECT s.user_id, s.n, s.event_id, s.ts_ms, s.step, CASE s.step WHEN 1 THEN list_append(w.open, s.event_id) WHEN -1 THEN w.open[1:len(w.open) - 1] ELSE w.open END, w.open
    FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.n = w.n + 1)"""


def _steps():
    kind = F.col("event_type")
    return kind.isin("click", "view"), kind.isin("purchase", "error")


@query(
    f"WITH RECURSIVE {EV} {_STACKS}, ended AS (SELECT user_id, was[len(was)] AS span, ts_ms AS end_ms FROM walk WHERE step = -1 AND len(was) > 0)"
    " SELECT w.user_id, w.event_id AS span, w.was[len(w.was)] AS parent_span, CAST(len(w.was) AS BIGINT) AS span_depth, w.ts_ms AS start_ms, e.end_ms, (e.end_ms - w.ts_ms) * 1000000 AS duration_ns, e.span IS NULL AS unended FROM walk w LEFT JOIN ended e ON e.user_id = w.user_id AND e.span = w.event_id WHERE w.step = 1"
)
def spans(spark, sf_dir):
    """The spans of each user's records: parent, depth, duration, and whether they ended."""
    return span_ops.spans(events(spark, sf_dir), *_steps(), ["user_id"], "ts_ms", "event_id")


@query(
    f"WITH RECURSIVE {EV} {_STACKS} SELECT w.user_id, w.event_id, CASE WHEN w.step = 1 THEN w.event_id ELSE w.was[len(w.was)] END AS span, CASE WHEN w.step = 1 THEN w.was[len(w.was)] END AS parent_span,"
    " CASE WHEN w.step = 1 THEN CAST(len(w.was) AS BIGINT) WHEN len(w.was) > 0 THEN CAST(len(w.was) - 1 AS BIGINT) END AS span_depth, CASE WHEN w.step = -1 AND len(w.was) > 0 THEN (w.ts_ms - s.ts_ms) * 1000000 END AS duration_ns FROM walk w LEFT JOIN seq s ON s.event_id = w.was[len(w.was)]"
)
def span_records(spark, sf_dir):
    """Each record with the span that is open: what a logger stamps on it."""
    return span_ops.open_spans(events(spark, sf_dir), *_steps(), ["user_id"], "ts_ms", "event_id").select("user_id", "event_id", "span", "parent_span", "span_depth", "duration_ns")


@query(
    f"""WITH {EV}, s AS (SELECT event_id, ts_ms, {_STEP} AS step, SUM({_STEP}) OVER (ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS total FROM logs),
  d AS (SELECT *, total - step - least(0, coalesce(MIN(total) OVER (ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS depth FROM s),
  m AS (SELECT event_id, ts_ms, step, depth, lead(ts_ms) OVER l AS next_ms, lead(step) OVER l AS next_step FROM d WHERE step = 1 OR (step = -1 AND depth > 0) WINDOW l AS (PARTITION BY CASE step WHEN 1 THEN depth ELSE depth - 1 END ORDER BY ts_ms, event_id))
  SELECT event_id AS span, CAST(depth AS BIGINT) AS span_depth, ts_ms AS start_ms, CASE WHEN next_step = -1 THEN next_ms END AS end_ms, CASE WHEN next_step = -1 THEN (next_ms - ts_ms) * 1000000 END AS duration_ns, next_step IS NULL AS unended FROM m WHERE step = 1"""
)
def spans_one_trace(spark, sf_dir):
    """All records as one trace: a hot key, in many tasks."""
    return span_ops.spans(events(spark, sf_dir), *_steps(), [], "ts_ms", "event_id").drop("parent_span")


@query(
    f"WITH RECURSIVE {EV} {_STACKS}, ended AS (SELECT was[len(was)] AS span, ts_ms AS end_ms FROM walk WHERE step = -1 AND len(was) > 0)"
    " SELECT w.user_id, COUNT(*) AS spans, COUNT(*) FILTER (WHERE e.span IS NULL) AS unended, CAST(MAX(len(w.was)) AS BIGINT) AS deepest, CAST(coalesce(SUM((e.end_ms - w.ts_ms) * 1000000), 0) AS BIGINT) AS total_ns FROM walk w LEFT JOIN ended e ON e.span = w.event_id WHERE w.step = 1 GROUP BY w.user_id"
)
def span_totals(spark, sf_dir):
    return span_ops.span_totals(spans(spark, sf_dir), ["user_id"])


@query(_ev("SELECT event_id, 'http' AS module, priority >= 40 AS has_error, CASE WHEN priority >= 40 THEN 'app.error' END AS error_name, 'corr-1' AS correlation_id, TRUE AS has_context FROM logs"))
def record_predicates(spark, sf_dir):
    e = enrich.with_trace(enrich.scoped(events(spark, sf_dir), "http"), correlation_id="corr-1")
    e = enrich.with_error(e, F.when(F.col("priority") >= 40, F.concat(F.lit("app."), "event_type")), F.col("message"))
    e = enrich.describe(e.withColumns({"custom_level_name": F.lit(None).cast("string"), "stack_trace": F.lit(None).cast("array<string>")}))
    return e.select("event_id", "module", "has_error", F.col("error_info.name").alias("error_name"), "correlation_id", "has_context")


# --- rotation, retention, queues


@query("SELECT l_linestatus, CAST((epoch_us(l_shipdate) // 1000000) // 86400 AS BIGINT) AS day, CAST(floor((epoch_us(l_shipdate) // 1000000) / 2592000.0) AS BIGINT) AS month, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def rotation_buckets(spark, sf_dir):
    s = F.floor(scalars.epoch_ms(F.col("l_shipdate")) / 1000)
    bucketed = table(spark, sf_dir, "lineitem").select("l_linestatus", retention.time_bucket(s, "daily").alias("day"), retention.time_bucket(s, "monthly").alias("month"))
    return bucketed.groupBy("l_linestatus", "day", "month").agg(F.count(F.lit(1)).alias("n"))


_SIZE_FOLD = """WITH RECURSIVE o AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS event_id, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem),
  r AS (SELECT k, rn, event_id, size AS held, 0::BIGINT AS file_index FROM o WHERE rn = 1
    UNION ALL SELECT o.k, o.rn, o.event_id, CASE WHEN r.held >= 500 THEN o.size ELSE r.held + o.size END, CASE WHEN r.held >= 500 THEN r.file_index + 1 ELSE r.file_index END FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
  SELECT event_id, file_index FROM r"""


@query(_SIZE_FOLD)
def rotation_size_index(spark, sf_dir):
    rows = adapters.lineitem(table(spark, sf_dir, "lineitem")).select("event_id", "ts_ms", "size", "supplier")
    return retention.size_index(rows, "size", 500, ["ts_ms", "event_id"], ["supplier"]).select("event_id", "file_index")


@query("SELECT o_orderkey, 'app.log.' || (epoch_us(o_orderdate) // 1000000) AS a, 'app.log.' || strftime(o_orderdate, '%Y-%m-%d') AS b, 'app-' || strftime(o_orderdate, '%Y-%m-%d') || '_' || strftime(o_orderdate, '%H') || '.log' AS c FROM orders")
def rotation_names(spark, sf_dir):
    s = F.floor(scalars.epoch_ms(F.col("o_orderdate")) / 1000).cast("long")
    name = lambda kind, custom=None: retention.rotated_name("app.log", s, kind, custom)
    return table(spark, sf_dir, "orders").select("o_orderkey", name("timestamp").alias("a"), name("date").alias("b"), name("custom", "{base}-{date}_{HH}{ext}").alias("c"))


def _files(spark, sf_dir):
    """Order rows as files of a log folder."""
    f = table(spark, sf_dir, "orders")
    return f.select(F.format_string("app-%d.log", "o_orderkey").alias("name"), scalars.epoch_ms(F.col("o_orderdate")).alias("mtime"), F.col("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 40).alias("age"), "o_orderkey")


_FILES = "f AS (SELECT printf('app-%d.log', o_orderkey) AS name, epoch_us(o_orderdate) // 1000 AS mtime, CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderkey % 40 AS age FROM orders)"


@query(f"WITH {_FILES} SELECT name FROM (SELECT name, row_number() OVER (ORDER BY mtime DESC, name DESC) AS n FROM f WHERE age <= 30) WHERE n <= 100")
def retention_age_count(spark, sf_dir):
    return retention.retain(_files(spark, sf_dir), 30, 100).select("name")


@query(f"WITH {_FILES} SELECT name, CASE WHEN old THEN 'age' WHEN n > 800 THEN 'max_files' WHEN s > 100000000 THEN 'max_total_size' END AS deleted FROM (SELECT name, age > 30 AS old, row_number() OVER (PARTITION BY age > 30 ORDER BY mtime DESC, name DESC) AS n, sum(size) OVER (PARTITION BY age > 30 ORDER BY mtime DESC, name DESC ROWS UNBOUNDED PRECEDING) AS s FROM f WHERE ends_with(name, '.log'))")
def cleanup(spark, sf_dir):
    return retention.clean_up(_files(spark, sf_dir), "*.log", 30, 800, 100_000_000).select("name", "deleted")


@query(f"WITH {_FILES} SELECT name FROM f WHERE age >= 10 AND ends_with(name, '7.log')")
def compression_candidates(spark, sf_dir):
    return retention.to_compress(_files(spark, sf_dir), "*7.log", 10).select("name")


@query(
    """SELECT event_id, ts_ms + 5000 AS once, CAST(ts_ms + CASE WHEN s < 9000 THEN 9000 - s ELSE 86400 - s + 9000 END * 1000 AS BIGINT) AS daily FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, (epoch_us(ts) // 1000000) % 86400 AS s FROM events)"""
)
def schedule_next_run(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", retention.next_once(F.col("ts_ms"), 5_000).alias("once"), retention.next_daily(F.col("ts_ms"), 2, 30).alias("daily"))


@query(
    """WITH d AS (SELECT c_custkey, 1704067200000 + c_custkey * 3777777 AS now FROM customer), c AS (SELECT c_custkey, now, now + (((now // 60000 + 1) // 1440 + k) * 1440 + 255 - now // 60000) * 60000 AS ms FROM d, range(0, 31) r(k))
  SELECT c_custkey, CAST(coalesce(min(ms) FILTER (ms > now AND ms < now + 2592000000 AND dayofweek(make_timestamp(ms * 1000)) = 1), min(now) + 60000) AS BIGINT) AS cron FROM c GROUP BY c_custkey"""
)
def schedule_cron(spark, sf_dir):
    """Mondays at 04:15, from a starting time of each customer."""
    return table(spark, sf_dir, "customer").select("c_custkey", retention.next_cron(F.lit(1704067200000) + F.col("c_custkey") * 3777777, minute=15, hour=4, weekday=1).alias("cron"))


@query(_ev("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms DESC, event_id DESC) AS n FROM logs) WHERE n <= 64"))
def ring_drop_oldest(spark, sf_dir):
    return retention.ring(events(spark, sf_dir), 64, "drop_oldest", ["ts_ms", "event_id"], ["event_type"]).select("event_id")


@query(_ev("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, event_id) AS n FROM logs) WHERE n <= 64"))
def ring_drop_newest(spark, sf_dir):
    return retention.ring(events(spark, sf_dir), 64, "drop_newest", ["ts_ms", "event_id"], ["event_type"]).select("event_id")


@query(_ord("SELECT event_id, priority FROM logs ORDER BY priority DESC, ts_ms, event_id LIMIT 64"))
def priority_pop(spark, sf_dir):
    """A batch of a priority queue: the limit is the feature."""
    return retention.by_priority(orders(spark, sf_dir), "priority", ["ts_ms", "event_id"], 64).select("event_id", "priority")


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS p_size, CAST(CASE WHEN p_size + 1 <= 10 THEN p_size + 1 END AS INTEGER) AS new_index FROM part")
def rotation_index_shift(spark, sf_dir):
    return retention.shift_indices(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 10)


@query("SELECT p_partkey, NOT ends_with(p_name, '7') AND p_size >= 20 AS packed FROM part")
def compression_decision(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", retention.should_compress(F.col("p_name"), F.col("p_size"), "size", "7", 20).alias("packed"))


@query(_ord("SELECT level, COUNT(*) AS queued, COUNT(*) FILTER (event_id % 10 = 0) AS dropped, COUNT(*) FILTER (event_id % 10 = 0) / COUNT(*)::DOUBLE AS drop_rate, SUM(event_id % 1000) FILTER (event_id % 10 <> 0) / (COUNT(*) FILTER (event_id % 10 <> 0))::DOUBLE AS avg_latency FROM logs GROUP BY level"))
def async_stats(spark, sf_dir):
    return metrics.async_stats(orders(spark, sf_dir), F.col("event_id") % 10 == 0, F.col("event_id") % 1000, ["level"])


@query(
    _ord(
        ", t AS (SELECT level, event_id % 1000 AS w, event_id % 777 + 1 AS x, event_id % 13 = 0 AS f FROM logs) SELECT level, COUNT(*) AS tasks, SUM(w) / COUNT(*)::DOUBLE AS avg_wait_ns, SUM(x) / COUNT(*)::DOUBLE AS avg_exec_ns, COUNT(*) / (SUM(x) / 1e9::DOUBLE) AS throughput, SUM(x) / ((SUM(x) + SUM(w)) * 4)::DOUBLE AS utilization, 1 - COUNT(*) FILTER (f) / COUNT(*)::DOUBLE AS success_rate FROM t GROUP BY level"
    )
)
def pool_stats(spark, sf_dir):
    e = F.col("event_id")
    return metrics.pool_stats(orders(spark, sf_dir), e % 1000, e % 777 + 1, e % 13 == 0, 4, ["level"])


# --- records from calls, and summaries over them


@query("SELECT o_orderkey AS event_id, 'NOTICE' AS level, CAST(22 AS INTEGER) AS priority, printf('order %d of customer %d: %s', o_orderkey, o_custkey, o_orderstatus) AS message FROM orders")
def logged_printf(spark, sf_dir):
    rows = records.logged(table(spark, sf_dir, "orders"), "NOTICE", "order %d of customer %d: %s", "o_orderkey", "o_custkey", "o_orderstatus")
    return rows.select(F.col("o_orderkey").alias("event_id"), "level", "priority", "message")


@query("SELECT event_id, 'ERROR' AS level, CAST(40 AS INTEGER) AS priority, props AS message, 'E' || user_id AS error_name FROM events WHERE event_type = 'error'")
def logged_errors(spark, sf_dir):
    """Records of caught errors pass neither gate nor filter."""
    rows = records.errors(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("props"), F.concat(F.lit("E"), F.col("user_id")))
    return rows.select("event_id", "level", "priority", "message", F.col("error_info.name").alias("error_name"))


@query("SELECT l_orderkey, l_linenumber, 'INFO' AS level, 'shipped' AS message, greatest(0, l_suppkey * 1000 - l_partkey) AS duration_ns FROM lineitem")
def logged_timed(spark, sf_dir):
    rows = records.timed(table(spark, sf_dir, "lineitem"), "INFO", F.lit("shipped"), F.col("l_partkey"), F.col("l_suppkey") * 1000)
    return rows.select("l_orderkey", "l_linenumber", "level", "message", "duration_ns")


@query(_ev(", c AS (SELECT level, COUNT(*) AS records FROM logs GROUP BY level) SELECT arg_max(level, (records, level)) AS most, MAX(records) AS most_value, arg_min(level, (records, level)) AS least, MIN(records) AS least_value FROM c"))
def level_extremes(spark, sf_dir):
    return metrics.extremes(events(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("records")), "level", "records")


@query(
    _ev(
        ", d AS (SELECT date_trunc('day', ts) AS day, level, strlen(message) AS n FROM logs), w AS (SELECT day AS began, level, n FROM d UNION ALL SELECT day - INTERVAL 1 DAY, level, n FROM d) SELECT strftime(began, '%Y-%m-%d') AS began, level, COUNT(*) AS records, CAST(SUM(n) AS BIGINT) AS bytes FROM w GROUP BY ALL"
    )
)
def sliding_levels(spark, sf_dir):
    """Windows of two days that begin each day."""
    w = windows.level_counts(events(spark, sf_dir), "2 days", slide="1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("began"), "level", "records", "bytes")


_CALL = "CASE event_type WHEN 'error' THEN 'err' WHEN 'view' THEN 'note' WHEN 'click' THEN 'AUDIT' WHEN 'purchase' THEN 'warn' ELSE 'shout' END"


@query(
    _ev(
        f", c AS (SELECT event_id, {_CALL} AS call FROM logs) SELECT event_id, CASE call WHEN 'err' THEN 'ERROR' WHEN 'note' THEN 'NOTICE' WHEN 'AUDIT' THEN 'INFO' WHEN 'warn' THEN 'WARNING' END AS level, CAST(CASE call WHEN 'err' THEN 40 WHEN 'note' THEN 22 WHEN 'AUDIT' THEN 35 WHEN 'warn' THEN 30 END AS INTEGER) AS priority, CASE WHEN call = 'AUDIT' THEN call END AS custom_level_name, CASE WHEN call = 'AUDIT' THEN '35;1' END AS custom_level_color, call <> 'shout' AS valid FROM c"
    )
)
def logged_calls(spark, sf_dir):
    """Levels by the names of calls, a custom one and an unknown one among them."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    call = F.when(kind == "error", "err").when(kind == "view", "note").when(kind == "click", "AUDIT").when(kind == "purchase", "warn").otherwise("shout")
    return records.called(e, call, {"AUDIT": (35, "35;1")}).select("event_id", "level", "priority", "custom_level_name", "custom_level_color", "valid")


def _placed(spark, sf_dir):
    """Records with a source location and a stack trace."""
    e = events(spark, sf_dir)
    n = F.col("user_id")
    return e.withColumns({"filename": F.concat(F.lit("src/u"), (n % 7).cast("string"), F.lit(".py")), "line": (n * 3).cast("long"), "function": F.concat(F.lit("on_"), "event_type"), "stack_trace": F.array(F.lit("a"), F.col("event_type"))})


@query(_ev(f"SELECT event_id, 'src/u' || (user_id % 7) || '.py' AS filename, CAST(NULL AS BIGINT) AS line, 'on_' || event_type AS function, '[' || {_TIME} || '] [' || level || '] [' || module || '] [on_' || event_type || '] src/u' || (user_id % 7) || '.py:' || user_id * 3 || ':0: ' || message AS shown FROM logs"))
def source_locations(spark, sf_dir):
    """Records carry file, line and function; a logger may leave the line out."""
    e = _placed(spark, sf_dir).drop("stack_trace")
    e = e.withColumn("shown", formatting.default_line(e.columns, show=("time", "module", "function", "file", "line")))
    return enrich.source_location(e, line=False).select("event_id", "filename", "line", "function", "shown")


@query(_ev("SELECT event_id, CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 'a,' || event_type END AS stack FROM logs"))
def stack_traces(spark, sf_dir):
    return enrich.keep_stack_traces(_placed(spark, sf_dir)).select("event_id", F.array_join("stack_trace", ",").alias("stack"))


@query(_ev("SELECT event_id, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reject_reason FROM logs"))
def sample_none(spark, sf_dir):
    return sampling.Sampler().flag(events(spark, sf_dir)).select("event_id", "accepted", F.col("reject_reason").cast("string").alias("reject_reason"))


@query(_ev("SELECT event_id FROM logs WHERE FALSE"))
def logger_disabled(spark, sf_dir):
    return level_gate(events(spark, sf_dir), "TRACE", enabled=False).select("event_id")


@query(_ev("SELECT event_id, CAST(2 AS INTEGER) AS rule_id FROM logs WHERE priority >= 30 UNION ALL SELECT event_id, 4 FROM logs WHERE module = 'app.view'"))
def rules_registry(spark, sf_dir):
    """Rules added, replaced, taken out and switched off."""
    book = rules.Rules()
    book.add(rules.Rule(1, level=rules.LevelMatch.at_least(5)))
    book.add(rules.Rule(2, level=rules.LevelMatch.at_least(55)))
    book.add(rules.Rule(3))
    book.add_or_update(rules.Rule(2, level=rules.LevelMatch.at_least(30)))
    book.add_or_update(rules.Rule(4, module="app.view"))
    book.remove(1)
    book.enable(3, False)
    return book.matched(events(spark, sf_dir)).select("event_id", F.explode("rule_ids").alias("rule_id"))


@query(_ev("SELECT event_id, '/logs/' || strftime(ts, '%Y-%m-%d') || '/' || level || '/app_' || strftime(ts, '%H-%M-%S') || '.' || module || '.log' AS a, strftime(ts, '%Y/%m') || '/x' AS b FROM logs"))
def sink_paths(spark, sf_dir):
    """Paths with tags, and with a date pattern of one's own."""
    return events(spark, sf_dir).select("event_id", sinks.path_of("/logs/{date}/{level}/app_{time}.{module}.log").alias("a"), sinks.path_of("{YYYY/MM}/x").alias("b"))


@query(_ev(f"SELECT 'files' AS on, 'console' AS sink, 0 AS n FROM logs WHERE FALSE UNION ALL SELECT 'files', 'app', COUNT(*) FROM logs WHERE {_TAKES['app']} UNION ALL SELECT 'files', 'quiet', COUNT(*) FROM logs WHERE {_TAKES['quiet']} UNION ALL SELECT 'console', 'console', COUNT(*) FROM logs WHERE {_TAKES['console']}").replace(" AS on,", ' AS "on",'))
def sink_switches(spark, sf_dir):
    """Console and file sinks as switched off for all."""
    e = events(spark, sf_dir)
    some = lambda on, **kw: sinks.fan_out(e, sinks.active(_SINKS, **kw)).groupBy("sink").agg(F.count(F.lit(1)).alias("n")).select(F.lit(on).alias("on"), "sink", "n")
    return some("files", console=False).union(some("console", files=False))


@query("SELECT p_partkey, CAST(p_size * pow(2.0, p_partkey % 5) AS DOUBLE) AS delay FROM part")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.retry_delay(F.col("p_size").cast("double"), F.lit(2.0), F.col("p_partkey") % 5).alias("delay"))


@query(_ev("""SELECT event_id, '{"timestamp":' || ts_ms // 1000 || ',"level":"' || level || '","message":"' || message || '","module":"' || module || '"}' AS line, '[' || ts_ms // 1000 || '] [' || level || '] [' || module || '] ' || message AS text FROM logs"""))
def format_unix(spark, sf_dir):
    e = events(spark, sf_dir).drop("context")
    return e.select("event_id", formatting.json_line(e.columns, "unix").alias("line"), formatting.default_line(e.columns, "unix").alias("text"))


@query(
    _ev(
        f"""SELECT event_id, '{{"timestamp":"' || {_TIME} || '","level":"' || level || '","message":"' || message || '","module":"' || module || '","function":"on_' || event_type || '","filename":"src/u' || (user_id % 7) || '.py","line":' || user_id * 3 || ',"hostname":"host1","pid":7' || CASE WHEN level IN ('ERROR', 'CRITICAL') THEN ',"stack_trace":["a","' || event_type || '"]' ELSE '' END || ',"context":{{"env":"prod"}}' || CASE WHEN priority >= 30 THEN ',"rules":[{{"category":"error_analysis","title":"T","message":"Look \\"here\\"","url":"u"}},{{"category":"performance_tip","message":"Slow"}}]' ELSE '' END || '}}' AS line FROM logs"""
    )
)
def format_json_full(spark, sf_dir):
    """Every field that a JSON line may have: location, host and process, stack trace, context and rules."""
    book = rules.Rules([rules.Rule(1, (rules.message("cause", 'Look "here"', title="T", url="u"), rules.message("perf", "Slow")), rules.LevelMatch.at_least(30))])
    e = book.evaluate(enrich.keep_stack_traces(_placed(spark, sf_dir)).withColumn("context", enrich.literal_map({"env": "prod"})))
    return e.select("event_id", formatting.json_line(e.columns, hostname="host1", pid=7).alias("line"))


@query(_ev("SELECT COUNT(*) AS lines, CAST(SUM(strlen(message) + strlen(level) + 3) AS BIGINT) AS bytes, SUM(strlen(message) + strlen(level) + 3) / COUNT(*)::DOUBLE AS avg_bytes FROM logs"))
def format_sizes(spark, sf_dir):
    e = events(spark, sf_dir)
    return metrics.line_sizes(e, formatting.template("{level} | {message}", e.columns))


@query(_ev(" SELECT sink, COUNT(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE) AS records_per_second, SUM(strlen(message)) / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE) AS bytes_per_second FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS sink, * FROM logs WHERE {w}" for s, w in _TAKES.items()) + ") GROUP BY sink"))
def sink_throughput(spark, sf_dir):
    return metrics.throughput(sinks.fan_out(events(spark, sf_dir), _SINKS))


@query("SELECT COUNT(*) AS files, CAST(SUM(p_size - p_size // 3) AS BIGINT) AS bytes_saved, (1 - SUM(p_size // 3) / SUM(p_size)::DOUBLE) * 100 AS percent FROM part WHERE NOT ends_with(p_name, '7') AND p_size >= 20")
def compression_savings(spark, sf_dir):
    """Bytes that a compression run saves, where files shrink to a third."""
    p = table(spark, sf_dir, "part")
    packed = p.where(retention.should_compress(F.col("p_name"), F.col("p_size"), "size", "7", 20))
    return retention.savings(packed.withColumn("packed", F.floor(F.col("p_size") / 3)), "p_size", "packed")


@query("SELECT o_orderkey, '/old/app-' || o_orderkey || '.log.gz' AS moved FROM orders")
def archive_paths(spark, sf_dir):
    """Where rotated and packed files go."""
    path = F.format_string("/var/log/%s/app-%d.log.gz", "o_orderstatus", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", retention.archived_column(path, "/old/").alias("moved"))


# --- the whole pipeline

PIPELINE = LogPipeline(
    "INFO",
    {"app.view": "DEBUG", "app.click": "NOTICE"},
    sampling.Sampler("probability", (("p", 0.5),)),
    (("contains", "value=", "v="), ("regex", r"user=\d", "user=#")),
    filter=Filter().message("v=3", allow=False),
    rules=RULES,
    context={"env": "prod"},
)
_FULL = f""", g AS (SELECT * FROM logs WHERE priority >= CASE module WHEN 'app.view' THEN 10 WHEN 'app.click' THEN 22 ELSE 20 END AND {_DRAW} < 2147483648),
  x AS (SELECT * REPLACE (regexp_replace(replace(message, 'value=', 'v='), 'user=[0-9]', 'user=#', 'g') AS message) FROM g), f AS (SELECT * FROM x WHERE NOT contains(message, 'v=3')),
  m AS (SELECT event_id, 2 AS n FROM f WHERE priority = 40 UNION ALL SELECT event_id, 1 FROM f WHERE priority >= 22 AND module = 'app.purchase'
    UNION ALL SELECT event_id, 1 FROM f WHERE event_id = (SELECT arg_min(event_id, (ts_ms, event_id)) FROM f WHERE module = 'app.signup'))"""


@query(_ev(_FULL + " SELECT f.event_id, level, message, 'prod' AS env, json_extract_string(props, '$.k') AS k, CAST(coalesce((SELECT SUM(n) FROM m WHERE m.event_id = f.event_id), 0) AS INTEGER) AS n_messages FROM f"))
def full_pipeline(spark, sf_dir):
    out = PIPELINE.apply(events(spark, sf_dir))
    at = lambda k: F.try_element_at("context", F.lit(k))
    return out.select("event_id", "level", "message", at("env").alias("env"), at("k").alias("k"), F.greatest(F.coalesce(F.size("rule_messages"), F.lit(0)), F.lit(0)).alias("n_messages"))


# --- streams: bounded ones, run to their end; each must equal its batch twin


def _stream(spark, sf_dir):
    return adapters.events(windows.read_stream(spark, f"{sf_dir}/events.parquet"))


def _drained(spark, df, mode="append"):
    base = shared_folder(spark).rstrip("/")
    return windows.drain(df, f"{base}/stream-checkpoints", f"{base}/stream-results", mode)


@query(ORACLES["full_pipeline"].split(" SELECT f.event_id")[0].replace("UNION ALL SELECT event_id, 1 FROM f WHERE event_id = (SELECT arg_min(event_id, (ts_ms, event_id)) FROM f WHERE module = 'app.signup')", "") + " SELECT event_id, level, message FROM f")
def stream_pipeline(spark, sf_dir):
    """The stateless part of the pipeline over a stream."""
    flow = LogPipeline(PIPELINE.level, PIPELINE.module_levels, PIPELINE.sampler, PIPELINE.patterns, filter=PIPELINE.filter, context=PIPELINE.context)
    return _drained(spark, flow.apply(_stream(spark, sf_dir)).select("event_id", "level", "message"))


@query(ORACLES["full_pipeline"])
def stream_full_pipeline(spark, sf_dir):
    """The whole pipeline over a stream, rules that fire once included."""
    out = PIPELINE.apply(_stream(spark, sf_dir))
    at = lambda k: F.try_element_at("context", F.lit(k))
    return _drained(spark, out.select("event_id", "level", "message", at("env").alias("env"), at("k").alias("k"), F.greatest(F.coalesce(F.size("rule_messages"), F.lit(0)), F.lit(0)).alias("n_messages")))


@query(ORACLES["sample_every_n_user"])
def stream_every_n(spark, sf_dir):
    return _drained(spark, stateful.every_n(_stream(spark, sf_dir).select("event_id", "ts_ms", "user_id"), 3, ["user_id"], ["event_id"]))


@query(ORACLES["sample_rate_limit_user"])
def stream_rate_limit(spark, sf_dir):
    return _drained(spark, stateful.rate_limit(_stream(spark, sf_dir).select("event_id", "ts_ms", "user_id"), 2, DAY, ["user_id"], ["event_id"]))


@query(ORACLES["sample_adaptive_user"])
def stream_adaptive(spark, sf_dir):
    return _drained(spark, stateful.adaptive(_stream(spark, sf_dir).select("event_id", "ts_ms", "user_id"), 0.00003, ["user_id"], ["event_id"], interval_ms=DAY))


@query(_ev("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, event_id) = 1 AS fired FROM logs"))
def stream_once(spark, sf_dir):
    return _drained(spark, stateful.once(_stream(spark, sf_dir).select("event_id", "ts_ms", "event_type"), ["event_type"], ["event_id"]))


# --- streams that carry tables, and what sinks and sockets have written


def _fresh(spark, label):
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _carried(spark, df, step):
    base = _fresh(spark, "carried")
    carried.start(df, f"{base}/out", f"{base}/check", step, "drain").awaitTermination()
    return f"{base}/out"


@query(ORACLES["sample_rate_limit_type"])
def stream_rate_limit_type(spark, sf_dir):
    """Hot keys: windows are chains in many tasks, and a few numbers a key go from batch to batch."""
    rows = _stream(spark, sf_dir).select("event_id", "ts_ms", "event_type")
    return carried.results(spark, _carried(spark, rows, carried.rate_limit(5, 3_600_000, ["event_type"], ["event_id"])))


@query(_ADAPTIVE.replace("user_id", "event_type").replace(EV.replace("user_id", "event_type"), EV))
def stream_adaptive_type(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("event_id", "ts_ms", "event_type")
    return carried.results(spark, _carried(spark, rows, carried.adaptive(0.00003, ["event_type"], ["event_id"], interval_ms=DAY)))


@query(ORACLES["full_pipeline"])
def stream_carried_pipeline(spark, sf_dir):
    """The whole pipeline; of a rule that fires once, one row a batch gets to what the batches carry."""
    out = carried.results(spark, _carried(spark, _stream(spark, sf_dir), carried.pipeline(PIPELINE)))
    at = lambda k: F.try_element_at("context", F.lit(k))
    return out.select("event_id", "level", "message", at("env").alias("env"), at("k").alias("k"), F.greatest(F.coalesce(F.size("rule_messages"), F.lit(0)), F.lit(0)).alias("n_messages"))


@query(ORACLES["metrics_history"])
def stream_history(spark, sf_dir):
    return carried.table(spark, _carried(spark, _stream(spark, sf_dir), carried.history(F.to_date("ts"), 7)), "snapshots").select("period", "records", "bytes")


_LINE = f"'[' || {_TIME} || '] [' || level || '] [' || module || '] ' || message"
_PAIRS = f"""'"timestamp" : "' || {_TIME} || '",' || chr(10) || '  "level" : "' || level || '",' || chr(10) || '  "message" : "' || message || '",' || chr(10) || '  "module" : "' || module || '"'"""


@query(
    f"WITH RECURSIVE {EV}, o AS (SELECT event_id || ' ' || message AS line, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts_ms, event_id) AS rn FROM logs),"
    " w AS (SELECT day, rn, line, strlen(line) + 1 AS size, 0 AS n FROM o WHERE rn = 1 UNION ALL SELECT o.day, o.rn, o.line, CASE WHEN w.size >= 5000 THEN 0 ELSE w.size END + strlen(o.line) + 1, w.n + CAST(w.size >= 5000 AS INTEGER) FROM w JOIN o ON o.day = w.day AND o.rn = w.rn + 1),"
    " f AS (SELECT line, dense_rank() OVER (ORDER BY day DESC, n DESC) - 1 AS back FROM w) SELECT CASE WHEN back = 0 THEN 'app.log' ELSE 'app.log.' || back || '.gz' END AS name, line AS value FROM f"
)
def stream_rotation(spark, sf_dir):
    """Every line of the files that a stream has written: daily ones of 5,000 bytes, numbered from the newest, packed."""
    base = _fresh(spark, "rotation")
    rotation = rotating.Rotation(f"{base}/logs", limit=5_000, interval="daily", naming="index", archive=f"{base}/old", packed=True)
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "message")
    rotating.start(_stream(spark, sf_dir), rotation, line, f"{base}/check", "drain").awaitTermination()
    return rotating.read_lines(spark, rotation)


@query(
    _ev(
        f"""SELECT 'text' AS sink, {_LINE} AS value FROM logs WHERE priority >= 20 UNION ALL SELECT 'json', '{{"timestamp":"' || {_TIME} || '","level":"' || level || '","message":"' || message || '","module":"' || module || '"}}' FROM logs
    UNION ALL SELECT 'pretty', '{{' || chr(10) || '  ' || {_PAIRS} || chr(10) || '}}' FROM logs UNION ALL SELECT 'raw', message FROM logs UNION ALL SELECT 'table', message FROM logs UNION ALL SELECT 'daily', strftime(ts, '%Y-%m-%d') || {_LINE} FROM logs"""
    )
)
def sink_files(spark, sf_dir):
    """What file sinks have written, read back: text, packed JSON lines, pretty JSON, raw messages, a table, and folders by day under a root."""
    e = events(spark, sf_dir).drop("context")
    base = _fresh(spark, "sinks")
    made = [
        sinks.Sink("text", "text", f"{base}/text", takes=SinkFilter(level="INFO")),
        sinks.Sink("json", "json", f"{base}/json", compression="gzip"),
        sinks.Sink("pretty", "pretty_json", f"{base}/pretty", overwrite=True),
        sinks.Sink("raw", "raw", "elsewhere/raw"),
        sinks.Sink("table", "parquet", f"{base}/table"),
        sinks.Sink("daily", "text", f"{base}/daily/{{date}}", most_records_per_file=1000),
    ]
    book = sinks.SinkSet([s for s in made if s.name != "raw"])
    book.enable(book.add(sinks.Sink("off", "text", f"{base}/off")), False)
    sinks.write_all(e, book.sinks, on_error="fail_fast")
    sinks.write(e, made[3], root=base)  # of its path, the root takes the last part
    out = None
    for s in made:
        back = sinks.read_back(spark, s, base if s.name == "raw" else None)
        value = F.col("message") if s.name == "table" else F.concat("date", "value") if s.name == "daily" else F.col("value")
        shown = back.select(F.lit(s.name).alias("sink"), value.alias("value"))
        out = shown if out is None else out.union(shown)
    return out


def _through_tcp(spark, sf_dir):
    """Events sent to a TCP receiver that runs on an executor: (the receiver's spool, the sender's counts)."""
    base = _fresh(spark, "network")
    with socket.socket() as s:
        s.bind(("", 0))
        port = s.getsockname()[1]
    e = events(spark, sf_dir).drop("context")
    with receivers.Receivers(spark, f"{base}/spool", [receivers.Port("tcp", port)]) as running:
        host = running.addresses()[port].rpartition(":")[0]
        sinks.write(e, sinks.Sink("net", "tcp", host=host, port=port, stats=f"{base}/stats"))
        sent = network.sent_stats(spark, f"{base}/stats").agg(F.sum("lines")).first()[0]
        until = time.monotonic() + 60
        while time.monotonic() < until and (receivers.network_stats(spark, f"{base}/spool").agg(F.sum("messages_received")).first()[0] or 0) < sent:
            time.sleep(0.2)
    return f"{base}/spool", f"{base}/stats"


@query(_ev(f"SELECT {_LINE} AS value FROM logs"))
def network_round_trip(spark, sf_dir):
    """Lines that a TCP sink sends, a receiver spools, and a stream reads."""
    spool, _ = _through_tcp(spark, sf_dir)
    return _drained(spark, receivers.stream(spark, spool, "drain").select("value"))


@query(_ev(f"SELECT COUNT(*) AS lines, CAST(SUM(strlen({_LINE}) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS errors, COUNT(*) AS messages_received, CAST(SUM(strlen({_LINE}) + 1) AS BIGINT) AS bytes_received, CAST(0 AS BIGINT) AS receive_errors FROM logs"))
def network_counts(spark, sf_dir):
    """What the sender has counted, beside what the receiver has."""
    spool, stats = _through_tcp(spark, sf_dir)
    sent = network.sent_stats(spark, stats).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors")).withColumn("one", F.lit(1))
    got = receivers.network_stats(spark, spool).agg(F.sum("messages_received").alias("messages_received"), F.sum("bytes_received").alias("bytes_received"), F.sum("errors").alias("receive_errors")).withColumn("one", F.lit(1))
    return sent.join(got, "one").drop("one")


@query(_ev("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, level, COUNT(*) AS records, CAST(SUM(strlen(message)) AS BIGINT) AS bytes FROM logs GROUP BY ALL"))
def windowed_levels(spark, sf_dir):
    """Tumbling windows over a batch; the stream below leaves out what its last watermark hasn't closed."""
    w = windows.level_counts(events(spark, sf_dir), "1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "level", "records", "bytes")


@query(_ev("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, level, COUNT(*) AS records, CAST(SUM(strlen(message)) AS BIGINT) AS bytes FROM logs WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM logs) GROUP BY ALL"))
def stream_windowed_levels(spark, sf_dir):
    """Append mode gives the windows that the watermark, ten minutes behind the latest record, has closed."""
    w = _drained(spark, windows.level_counts(_stream(spark, sf_dir), "1 day"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "level", "records", "bytes")


@query(
    _ev(
        ", g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM logs WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, COUNT(*) AS records FROM s GROUP BY user_id, n"
    )
)
def user_sessions(spark, sf_dir):
    s = windows.sessions(events(spark, sf_dir), "12 hours")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("began"), "records")
