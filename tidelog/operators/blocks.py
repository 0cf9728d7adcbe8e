"""Ordered blocks: rows dealt by ranges of keys and order, so that neither a long key nor a dense time is one task.

Spark samples the order to find the ranges (``repartitionByRange``), each range is sorted and written, and what is read back knows
its range (``_block``, growing along the order) and its place there (``_place``, from 0). Ranges follow the density of the data,
and ties are parted by what comes later in the order: end it with a unique column. A lost executor can't deal rows anew, as
the blocks are files in the shared folder.

Nulls come first. A block is about as large as any shuffle partition of the session. Equal rows may come in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.streaming.workspace import shared_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, and read it again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidelog-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """The rows with ``_block`` and ``_place``, long: both along ``order``."""
    ranges = rows.repartitionByRange(blocks, *order) if blocks else rows.repartitionByRange(*order)
    sorted_rows = ranges.sortWithinPartitions(*order).withColumn("_block", F.spark_partition_id().cast("long"))
    # a task writes one file, in order, so a row's place in the block is its place in the file
    return written(sorted_rows, "blocks").withColumn("_place", F.col("_metadata.row_index"))


def ranked(rows: DataFrame, order: Sequence[str], out: str, blocks: int | None = None) -> DataFrame:
    """Number all rows from 1 along ``order`` in column ``out``: one exchange, and a sum over the blocks' counts."""
    placed = in_blocks(rows, order, blocks)
    counts = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_block", before.alias("_before"))
    return placed.join(starts, "_block").withColumn(out, F.col("_before") + F.col("_place") + 1).select(*rows.columns, out)
