"""Adapters from tables to log rows: the columns of ``schema.LOG_SCHEMA`` that a table fills, and its unique key.

Times stay TIMESTAMP_NTZ (UTC wall clock); ``ts_ms`` does not depend on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.levels import priority_of
from tidelog.functions.scalars import epoch_ms

EVENT_LEVELS = {"view": "DEBUG", "click": "INFO", "signup": "SUCCESS", "purchase": "NOTICE", "error": "ERROR"}
ORDER_LEVELS = {"1-URGENT": "CRITICAL", "2-HIGH": "ERROR", "3-MEDIUM": "WARNING", "4-NOT SPECIFIED": "INFO", "5-LOW": "DEBUG"}
ROLE_LEVELS = {"system": "NOTICE", "user": "INFO", "assistant": "DEBUG"}
FLAG_LEVELS = {"R": "WARNING", "A": "ERROR", "N": "INFO"}


def mapped(column: Column, table: Mapping[str, str], default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _leveled(df: DataFrame, level: Column) -> DataFrame:
    return df.withColumn("level", level).withColumn("priority", priority_of(F.col("level")))


def events(df: DataFrame) -> DataFrame:
    message = F.format_string("user=%d %s value=%.2f", "user_id", "event_type", "value")
    rows = _leveled(df, mapped(F.col("event_type"), EVENT_LEVELS, "INFO"))
    return rows.select(
        "event_id", "ts", epoch_ms(F.col("ts")).alias("ts_ms"), "level", "priority", F.concat(F.lit("app."), "event_type").alias("module"), message.alias("message"),
        F.from_json("props", "map<string,string>").alias("context"), F.col("user_id"), "event_type", "value",
    )


def orders(df: DataFrame) -> DataFrame:
    rows = _leveled(df, mapped(F.col("o_orderpriority"), ORDER_LEVELS, "INFO"))
    message = F.format_string("order %d total=%.2f", "o_orderkey", "o_totalprice")
    return rows.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), epoch_ms(F.col("o_orderdate")).alias("ts_ms"), "level", "priority", F.concat(F.lit("orders."), "o_orderstatus").alias("module"), message.alias("message"), F.col("o_custkey").alias("user_id"))


def conversations(df: DataFrame) -> DataFrame:
    rows = _leveled(df, mapped(F.col("role"), ROLE_LEVELS, "INFO"))
    return rows.select("conv_id", "turn", "level", "priority", F.concat(F.lit("chat."), "role").alias("module"), F.col("text").alias("message"))


def documents(df: DataFrame) -> DataFrame:
    rows = df.withColumns({"level": F.lit("INFO"), "priority": F.lit(20)})
    return rows.select(F.col("doc_id").alias("event_id"), "level", "priority", F.col("source").alias("module"), F.col("text").alias("message"), "lang", "n_chars")


def lineitem(df: DataFrame) -> DataFrame:
    rows = _leveled(df, mapped(F.col("l_returnflag"), FLAG_LEVELS, "INFO"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_shipdate").alias("ts"), epoch_ms(F.col("l_shipdate")).alias("ts_ms"), "level", "priority",
        F.concat(F.lit("ship."), "l_linestatus").alias("module"), F.format_string("order %d quantity=%.0f", "l_orderkey", "l_quantity").alias("message"), F.col("l_quantity").cast("long").alias("size"), F.col("l_suppkey").alias("supplier"),
    )
