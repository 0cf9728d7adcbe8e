"""The one typed record schema that all operators work on, and the level dimension."""

from __future__ import annotations

from pyspark.sql import types as T

#: Name, priority, ANSI colour of the standard levels, by priority.
LEVELS = [
    ("TRACE", 5, "36"),
    ("DEBUG", 10, "34"),
    ("INFO", 20, "37"),
    ("NOTICE", 22, "96"),
    ("SUCCESS", 25, "32"),
    ("WARNING", 30, "33"),
    ("ERROR", 40, "31"),
    ("FAIL", 45, "35"),
    ("CRITICAL", 50, "91"),
    ("FATAL", 55, "97;41"),
]
PRIORITY = {name: priority for name, priority, _ in LEVELS}

RULE_MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("category", "title", "message", "url", "custom_color", "custom_prefix")]
    + [T.StructField("use_background", T.BooleanType()), T.StructField("background_color", T.StringType())]
)

ERROR_INFO = T.StructType([T.StructField("name", T.StringType()), T.StructField("message", T.StringType()), T.StructField("stack_trace", T.StringType()), T.StructField("code", T.IntegerType())])

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("custom_level_name", T.StringType()),
        T.StructField("custom_level_color", T.StringType()),
        T.StructField("message", T.StringType(), False),
        *[T.StructField(n, T.StringType()) for n in ("module", "function", "filename")],
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
        T.StructField("thread_id", T.DecimalType(20, 0)),
        *[T.StructField(n, T.StringType()) for n in ("trace_id", "span_id", "parent_span_id", "correlation_id", "request_id", "session_id", "user_id")],
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("error_info", ERROR_INFO),
        T.StructField("duration_ns", T.LongType()),
        T.StructField("stack_trace", T.ArrayType(T.StringType())),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("rule_messages", T.ArrayType(RULE_MESSAGE)),
    ]
)
