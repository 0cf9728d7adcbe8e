"""Rotation, retention, schedules and queues, planned over tables of files or records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocks import in_blocks
from tidelog.operators.chains import key_of, sums_before, window_starts, windows_of

#: Rotation intervals in seconds; a month has 30 days and a year 365.
INTERVALS = {"minutely": 60, "hourly": 3_600, "daily": 86_400, "weekly": 604_800, "monthly": 2_592_000, "yearly": 31_536_000}

def default_naming(interval: str | None) -> str:
    return "date" if interval in ("daily", "weekly", "monthly", "yearly") else "timestamp"


def time_bucket(seconds: Column, interval: str, start: int = 0) -> Column:
    """The number of the file that a record falls into, with files that change every interval from ``start`` on."""
    return F.floor((seconds - start) / INTERVALS[interval]).cast("long")


def rotated_name(base: str, seconds: Column, naming: str, custom: str | None = None) -> Column:
    """The name that the file gets when it rotates at ``seconds``."""
    from tidelog.functions.formatting import date_pattern
    from tidelog.functions.scalars import from_epoch_ms

    ts = from_epoch_ms(seconds * 1000)
    stem, dot, ext = base.rpartition(".")
    stem, ext = (stem, "." + ext) if dot and stem else (base, "")
    if naming == "timestamp":
        return F.concat(F.lit(f"{base}."), seconds.cast("string"))
    if naming == "date":
        return F.concat(F.lit(f"{base}."), date_pattern(ts, "YYYY-MM-DD"))
    if naming == "iso_datetime":
        return F.concat(F.lit(f"{base}."), date_pattern(ts, "YYYY-MM-DD_HH-mm-ss"))
    if naming == "index":
        return F.lit(f"{base}.1")
    if naming == "custom" and custom:
        parts, rest = [], custom
        while rest:
            before, brace, after = rest.partition("{")
            tag, closed, after_tag = after.partition("}")
            if before:
                parts.append(F.lit(before))
            if not brace:
                break
            if not closed:
                parts.append(F.lit("{"))
                rest = after
                continue
            known = {"base": F.lit(stem), "ext": F.lit(ext), "timestamp": seconds.cast("string"), "date": date_pattern(ts, "YYYY-MM-DD"), "time": date_pattern(ts, "HH:mm:ss"), "iso": date_pattern(ts, "YYYY-MM-DDTHH:mm:ssZ")}
            parts.append(known.get(tag) if tag in known else date_pattern(ts, tag))
            rest = after_tag
        return F.concat(*parts)
    raise ValueError(f"unknown naming {naming!r}")


def archived(path: str, archive: str | None) -> str:
    """Where a rotated file goes: the archive folder, or its own."""
    return f"{archive.rstrip('/')}/{path.rsplit('/', 1)[-1]}" if archive else path


def shift_indices(files: DataFrame, index: str, most: int = 10) -> DataFrame:
    """Rotation by numbers: each file moves up by one; add ``new_index``, null for a file that falls off the end."""
    return files.withColumn("new_index", F.when(F.col(index) + 1 <= most, F.col(index) + 1))


def should_compress(path: Column, size: Column, mode: str, extension: str = ".gz", threshold: int = 0) -> Column:
    """Whether a file is to be packed: never, always, or from a size on; packed files never are."""
    if mode == "never":
        return F.lit(False)
    fresh = ~F.endswith(path, F.lit(extension))
    return fresh if mode == "always" else fresh & (size >= threshold)


def size_index(df: DataFrame, size: str, limit: int, order: Sequence[str], key_by: Sequence[str] = (), hot_keys: bool = False, held: Column | None = None) -> DataFrame:
    """Add ``file_index``: a record starts a new file if the current one has reached ``limit`` before it is written. ``held``: the bytes
    that a key's current file has already (chains only).

    ``key_by``: each key has its own files. With keys that all have moderately many records, one fold. Without keys, or with
    ``hot_keys``, a file starts where the bytes written before are at least ``limit`` beyond the last one's: a chain of windows
    over these sums, in many tasks.
    """
    if key_by and not hot_keys:
        from tidelog.operators.sampling import fold

        def step(state: list, n: float) -> tuple[int]:
            if state[0] >= limit:
                state[0], state[1] = 0, state[1] + 1
            state[0] += n
            return (state[1],)

        return fold(df, size, key_by, order, "file_index long", lambda: [0, 0], step)
    rows = df.withColumns({"_key": key_of(key_by), "_amount": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    summed = sums_before(rows, "_amount", order, "_written")
    if held is not None:
        summed = summed.withColumn("_written", F.col("_written") + held)
    starts = window_starts(summed.select("_key", "_written"), "_written", limit)
    numbered = starts.withColumn("_number", F.row_number().over(Window.partitionBy("_key").orderBy("start")).cast("long"))
    placed = windows_of(summed, "_written", numbered, limit, "_number")
    return placed.withColumn("file_index", F.coalesce("_number", F.lit(0))).select(*df.columns, "file_index")


def retain(files: DataFrame, max_age: int | None, keep: int | None) -> DataFrame:
    """Files (name, mtime, size, age) that stay: not older than ``max_age``, then the newest ``keep``."""
    out = files.where(F.col("age") <= max_age) if max_age is not None else files
    if keep is not None:
        out = out.orderBy(F.desc("mtime"), F.desc("name")).limit(keep)
    return out


def clean_up(files: DataFrame, pattern: str | None = None, max_age: int | None = None, max_files: int | None = None, max_total_size: int | None = None, blocks: int | None = None) -> DataFrame:
    """Add ``deleted`` (null: stays) to the files that match: age, max_files or max_total_size, in this order, oldest first.

    Files are ranked and summed inside ordered blocks (see ``blocks``); each block starts where the newer ones' counts and sizes end. Only
    the table of blocks is summed up in one task.
    """
    out = files.where(glob(F.col("name"), pattern)) if pattern else files
    columns = out.columns
    old = F.col("age") > max_age if max_age is not None else F.lit(False)
    out = in_blocks(out.withColumn("_old", old), ["_old", "mtime", "name"], blocks).withColumnRenamed("_block", "_bucket")
    buckets = out.groupBy("_old", "_bucket").agg(F.count(F.lit(1)).alias("_files"), F.sum("size").alias("_size"))
    newer = Window.partitionBy("_old").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("_old").alias("_of_old"), F.col("_bucket").alias("_of"), F.sum("_files").over(newer).alias("_files"), F.sum("_size").over(newer).alias("_size"))
    newest = Window.partitionBy("_old", "_bucket").orderBy(F.desc("mtime"), F.desc("name"))
    out = out.withColumns({"_n": F.row_number().over(newest), "_sum": F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    out = out.join(starts, F.col("_old").eqNullSafe(F.col("_of_old")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    n = F.col("_n") + F.coalesce("_files", F.lit(0))
    total = F.coalesce(F.col("_sum") + F.col("_size"), "_sum", "_size")
    many = n > max_files if max_files is not None else F.lit(False)
    large = total > max_total_size if max_total_size is not None else F.lit(False)
    reason = F.when(F.col("_old"), F.lit("age")).when(many, F.lit("max_files")).when(large, F.lit("max_total_size"))
    return out.withColumn("deleted", reason).select(*columns, "deleted")


def to_compress(files: DataFrame, pattern: str | None, min_age: int) -> DataFrame:
    """Files that a compression run takes."""
    packed = F.col("name").rlike(r"\.(gz|lgz|zst)$")
    return files.where(~packed & (F.col("age") >= min_age) & (glob(F.col("name"), pattern) if pattern else F.lit(True)))


def savings(packed: DataFrame, before: str, after: str) -> DataFrame:
    """One row about a compression run: files, bytes saved, and the share that is saved in percent."""
    from tidelog.functions.scalars import savings_percent

    was, now = F.coalesce(F.sum(before), F.lit(0)), F.coalesce(F.sum(after), F.lit(0))
    return packed.agg(F.count(F.lit(1)).alias("files"), (was - now).cast("long").alias("bytes_saved"), savings_percent(was, now).alias("percent"))


def archived_column(path: Column, archive: str) -> Column:
    """``archived`` for a column of paths."""
    return F.concat(F.lit(archive.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -1))


def glob(name: Column, pattern: str) -> Column:
    """``*.ext``, or an exact name."""
    return F.endswith(name, F.lit(pattern[1:])) if pattern.startswith("*") else name == pattern


def next_once(now_ms: Column, delay_ms: int) -> Column:
    return now_ms + delay_ms


next_interval = next_once


def next_daily(now_ms: Column, hour: int, minute: int) -> Column:
    """The next time of day, strictly later, to whole seconds from now."""
    current = F.floor(now_ms / 1000) % 86_400
    target = hour * 3_600 + minute * 60
    wait = F.when(current < target, target - current).otherwise(86_400 - current + target)
    return (now_ms + wait * 1000).cast("long")


def next_cron(now_ms: Column, minute: int | None = None, hour: int | None = None, day: int | None = None, month: int | None = None, weekday: int | None = None) -> Column:
    """The first minute step from now, within 30 days, whose UTC fields fit (weekday: Sunday 0); else in a minute."""
    now = F.floor(now_ms / 60_000)
    # days first, as a step's minute of the day follows from its fields; 30 days touch 31 dates
    first = F.floor((now + 1) / 1440)
    hours = hour is None or 0 <= hour < 24
    minutes = minute is None or 0 <= minute < 60

    def step(k: Column) -> Column:
        """The first minute of the k-th date, as minutes from now, that fits hour and minute; null if none does."""
        date = F.date_add(F.lit("1970-01-01").cast("date"), (first + k).cast("int"))
        fits = F.lit(hours and minutes)
        for value, have in ((month, F.month(date)), (day, F.dayofmonth(date)), (weekday, F.dayofweek(date) - 1)):
            if value is not None:
                fits = fits & (have == value)
        low = F.when(k == 0, now + 1 - first * 1440).otherwise(0)
        if hour is not None:
            low = F.greatest(low, F.lit(hour * 60))
        at = low if minute is None else low + F.pmod(minute - low, F.lit(60))
        steps = (first + k) * 1440 + at - now
        return F.when(fits & (at < (1440 if hour is None else hour * 60 + 60)) & (steps < 30 * 24 * 60), steps)

    found = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(30)), step))
    return (now_ms + F.coalesce(found, F.lit(1)).cast("long") * 60_000).cast("long")


def ring(df: DataFrame, capacity: int, policy: str, order: Sequence[str], key_by: Sequence[str] = ()) -> DataFrame:
    """What is left of a burst in a ring buffer: drop_oldest keeps the last, drop_newest (and block) the first."""
    direction = [F.desc(c) for c in order] if policy == "drop_oldest" else list(order)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key_by).orderBy(*direction))).where(F.col("_n") <= capacity).drop("_n")


def by_priority(df: DataFrame, priority: str, submitted: Sequence[str], most: int) -> DataFrame:
    """What a priority queue hands out first; equal priorities in order of submission."""
    return df.orderBy(F.desc(priority), *submitted).limit(most)
