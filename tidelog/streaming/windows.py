"""Event-time metrics over streams, and running a bounded stream to its end.

Windows and watermarks are an extension: the record-at-a-time library works in processing time only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Presets as Spark settings. What a micro-batch takes is bounded by files or by bytes, so that also a key with
#: most of the rows has a bounded number of them in a batch; the trigger is the flush interval.
PRESETS = {
    "low_latency": {"trigger": {"processingTime": "100 milliseconds"}, "batch": {"maxFilesPerTrigger": 1}},
    "balanced": {"trigger": {"processingTime": "1 second"}, "batch": {"maxFilesPerTrigger": 16}},
    "high_throughput": {"trigger": {"processingTime": "10 seconds"}, "batch": {"maxBytesPerTrigger": 1 << 30}},
    "drain": {"trigger": {"availableNow": True}, "batch": {"maxBytesPerTrigger": 256 << 20}},
}


def _event_time(df: DataFrame, late: str) -> DataFrame:
    """A watermark needs TIMESTAMP; the wall clock of TIMESTAMP_NTZ is read in the session's zone (set it to UTC)."""
    return df.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)


def level_counts(df: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Records and bytes by tumbling (or sliding) window and level."""
    w = F.window("_at", width, slide) if slide else F.window("_at", width)
    out = _event_time(df, late).groupBy(w.alias("w"), "level").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("message")).cast("long").alias("bytes"))
    return out.select(F.col("w.start").alias("window_start"), "level", "records", "bytes")


def sessions(df: DataFrame, gap: str, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    out = _event_time(df, late).groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("records"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "records")


def read_stream(spark: SparkSession, path: str, preset: str = "drain") -> DataFrame:
    """A table's files as a stream; ``path`` may be one file (then its folder is watched for that name)."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).options(**PRESETS[preset]["batch"])
    return stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else stream.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def start(df: DataFrame, path: str, checkpoint: str, preset: str = "balanced", mode: str = "append"):
    """Write a stream as Parquet with a preset's trigger; the running query."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(**PRESETS[preset]["trigger"]).start()


def each_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, preset: str = "balanced"):
    """Call ``callback`` (rows, batch number) on the driver for each micro-batch; the running query. A batch may come again after
    a failure, under its number."""
    writer = df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return writer.trigger(**PRESETS[preset]["trigger"]).start()


def drain(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into Parquet under ``out``, and read that."""
    name = uuid.uuid4().hex
    path = f"{out.rstrip('/')}/{name}"
    start(df, path, f"{checkpoint.rstrip('/')}/{name}", "drain", mode).awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path)
