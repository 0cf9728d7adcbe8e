"""Chains of windows along an order, without one task for all of a key's records.

A window starts at the first value that lies at least ``width`` beyond the last window's start; before the first such value
there is a window that starts at 0. Values are times (rate limits, adaptive rates) or bytes written before (files by size).

A start depends on the one before it, but little has to go from task to task:

1. Values are cut into blocks of a fixed length by key. A block finds, for every place where its first window may start,
   where its last one then does: a step function of few steps, as chains from different places soon meet.
2. The step functions of a key's blocks are applied one after the other; only these go through one task a key.
3. With what enters it, each block lists its starts. Of all stretches of ``width`` a value has at most one start in its own,
   and else the last one is in the stretch before: one join by key and stretch gives each record its window.

A block's length follows from the densest stretch of the data, which a first pass finds: a block holds ``BLOCK_VALUES`` values,
or one stretch's distinct ones if these are more. Null keys are a key; a null value counts as 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocks import in_blocks

#: The values of a block, at most, unless one stretch has more; values up to which a block is worked out without arrays.
BLOCK_VALUES, SMALL_BLOCK = 100_000, 64


def key_of(key_by: Sequence[str]) -> Column:
    """A key's columns as one; without keys all records have one."""
    return F.struct(*key_by) if key_by else F.struct(F.lit(0).alias("all"))


def _list_array(lists: list) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int64()))


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column, one after the other, as views of its buffer."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[low:high]


def starts_from(values: np.ndarray, entry: int, width: int) -> list[int]:
    """The windows' starts among sorted ``values``, from ``entry`` on."""
    if len(values) <= SMALL_BLOCK:
        values, find = values.tolist(), lambda x, low: bisect_left(values, x, low)
    else:
        find = lambda x, low: low + int(np.searchsorted(values[low:], x))
    starts, at = [], find(entry, 0)
    while at < len(values):
        starts.append(int(values[at]))
        at = find(starts[-1] + width, at)
    return starts


def steps(values: np.ndarray, begin: int, width: int) -> tuple[list[int], list[int]]:
    """(upto, exit) of a block that begins at ``begin``: if the next window may start from x on, and x is at most ``upto``,
    the block's last window starts at ``exit``."""
    n = len(values)
    if n <= SMALL_BLOCK:  # most blocks of keys with few records
        return _few_steps(np.asarray(values).tolist(), begin, width)
    values = np.asarray(values)
    following = np.searchsorted(values, values + width)
    last = np.arange(n)
    jump = np.append(np.where(following < n, following, n), n)
    while (jump[:-1] < n).any():  # doubling: last holds the end of 1, 2, 4 .. windows
        on = jump[:-1] < n
        last = np.where(on, last[np.minimum(jump[:-1], n - 1)], last)
        jump = jump[jump]
    first = min(n, int(np.searchsorted(values, begin + width)) + 1)
    exits = values[last[:first]]
    ends = np.append(np.flatnonzero(exits[1:] != exits[:-1]), first - 1)
    return values[ends].tolist(), exits[ends].tolist()


def _few_steps(values: list[int], begin: int, width: int) -> tuple[list[int], list[int]]:
    n = len(values)
    exits = list(values)
    for k in range(n - 2, -1, -1):
        following = bisect_left(values, values[k] + width, k)
        if following < n:
            exits[k] = exits[following]
    first = min(n, bisect_left(values, begin + width) + 1)
    ends = [k for k in range(first) if k == first - 1 or exits[k] != exits[k + 1]]
    return [values[k] for k in ends], [exits[k] for k in ends]


def window_starts(values: DataFrame, value: str, width: int) -> DataFrame:
    """(_key, start) of all windows but those that start at 0. ``values``: _key, and a long."""
    if width < 1:
        raise ValueError("a window needs a width")
    stretches = values.groupBy("_key", F.floor(F.col(value) / width)).agg(F.count(F.lit(1)).alias("n"))
    densest = stretches.agg(F.max("n").alias("n")).first()["n"] or 1
    length = width * max(1, BLOCK_VALUES // densest)
    blocks = values.select("_key", F.floor(F.col(value) / length).cast("long").alias("_block"), value).groupBy("_key", "_block").agg(F.sort_array(F.collect_set(value)).alias("values"))
    key = values.schema["_key"].dataType.simpleString()

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [steps(v, b * length, width) for v, b in zip(_arrays(batch.column(2)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _list_array([u for u, _ in made]), _list_array([e for _, e in made])], ["_key", "_block", "upto", "exit"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            out = []
            for new, upto, exits in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if new:
                    start = 0
                out.append(start + width)
                at = bisect_left(upto, start + width)
                if at < len(upto):
                    start = exits[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["_key", "_block", "entry"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [starts_from(v, entry, width) for v, entry in zip(_arrays(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(out)], ["_key", "starts"])

    functions = blocks.mapInArrow(stepped, f"_key {key}, _block long, upto array<long>, exit array<long>")
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_block")) == 1  # deals blocks by key, and sorts them
    entries = functions.withColumn("_new", first).mapInArrow(entered, f"_key {key}, _block long, entry long")
    known = blocks.join(entries, ["_key", "_block"]).select("_key", "values", "entry")
    return known.mapInArrow(listed, f"_key {key}, starts array<long>").select("_key", F.explode("starts").alias("start"))


def windows_of(records: DataFrame, value: str, starts: DataFrame, width: int, *payload: str) -> DataFrame:
    """Add to ``records`` (_key, a long, others) the ``start`` of their windows, and the columns ``payload`` of ``starts``. The
    window that starts at 0 need not be among ``starts``; then its payload is null."""
    at = F.struct("start", *payload)
    stretch = F.floor(F.col("start") / width).cast("long")
    sides = starts.select("_key", F.inline(F.array(F.struct(stretch.alias("_stretch"), at.alias("own"), F.lit(None).cast(_kind(starts, payload)).alias("before")), F.struct((stretch + 1).alias("_stretch"), F.lit(None).cast(_kind(starts, payload)).alias("own"), at.alias("before")))))
    table = sides.groupBy("_key", "_stretch").agg(F.max("own").alias("_in_own"), F.max("before").alias("_in_last"))
    placed = records.withColumn("_stretch", F.floor(F.col(value) / width).cast("long")).join(table, ["_key", "_stretch"], "left")
    found = F.when(F.col("_in_own.start") <= F.col(value), F.col("_in_own")).otherwise(F.col("_in_last"))
    return placed.withColumn("_found", found).select(*records.columns, F.coalesce("_found.start", F.lit(0)).alias("start"), *[F.col(f"_found.{c}").alias(c) for c in payload])


def _kind(starts: DataFrame, payload: Sequence[str]) -> str:
    return starts.select(F.struct("start", *payload).alias("s")).schema["s"].dataType.simpleString()


def sums_before(records: DataFrame, amount: str, order: Sequence[str], out: str, blocks: int | None = None) -> DataFrame:
    """Add the sum of a key's amounts before each record (0 for the first). ``records``: _key, and what is named.

    Records are summed inside ordered blocks (see ``blocks``); each block starts where the earlier ones' sums end.
    """
    placed = in_blocks(records, ["_key", *order], blocks)
    totals = placed.groupBy("_key", "_block").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select("_key", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_begun"))
    inside = Window.partitionBy("_key", "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(begun, ["_key", "_block"]).withColumn(out, (F.col("_begun") + F.col("_inside")).cast("long")).select(*records.columns, out)
