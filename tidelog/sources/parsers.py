"""Readers for what the sinks write: text lines in the default format, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.levels import priority_of

_LINE = r"^(?:\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] )?\[([^\]]+)\] (?:\[([^\]]+)\] )?(.*)$"


def text_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """ts, level, priority, module and message; lines of another form get nulls but for the message."""
    part = lambda n: F.nullif(F.regexp_extract(value, _LINE, n), F.lit(""))
    rows = df.select(F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("level"), part(3).alias("module"), F.coalesce(part(4), F.when(part(2).isNull(), F.col(value)), F.lit("")).alias("message"))
    return rows.withColumn("priority", priority_of(F.col("level")))


def json_lines(df: DataFrame, value: str = "value") -> DataFrame:
    fields = "timestamp string, level string, message string, module string, function string, filename string, line bigint, context map<string,string>"
    rows = df.select(F.from_json(value, fields).alias("r")).select("r.*")
    return rows.withColumn("priority", priority_of(F.col("level")))
