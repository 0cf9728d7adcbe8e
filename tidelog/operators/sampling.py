"""Samplers over records in arrival order. Order is always (time, unique id), time is the records' own.

``key_by`` names the columns that a sampler has a state for. The record-at-a-time library has one state; here that is an
empty ``key_by``. Probability sampling is a filter, and every-N ranks records in many tasks. The rate limit and the adaptive
rate are folds of each key's records; without keys, or with ``hot_keys``, they are chains of windows (see ``chains``), which
many tasks share, at several times the cost a record. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import rate
from tidelog.operators.blocks import ranked, written
from tidelog.operators.chains import key_of, window_starts, windows_of

TWO32 = 4_294_967_296

DEFAULT_ADAPTIVE = {"min_rate": 0.01, "max_rate": 1.0, "interval_ms": 1000}

#: The named samplers.
PRESETS = {
    "one_percent": ("probability", {"p": 0.01}),
    "ten_percent": ("probability", {"p": 0.1}),
    "fifty_percent": ("probability", {"p": 0.5}),
    "ten_per_second": ("rate_limit", {"most": 10, "window_ms": 1000}),
    "hundred_per_second": ("rate_limit", {"most": 100, "window_ms": 1000}),
    "thousand_per_second": ("rate_limit", {"most": 1000, "window_ms": 1000}),
    "every_5": ("every_n", {"n": 5}),
    "every_10": ("every_n", {"n": 10}),
    "every_100": ("every_n", {"n": 100}),
    "adaptive_100": ("adaptive", {"target": 100}),
    "adaptive_1000": ("adaptive", {"target": 1000}),
}


def draw(id_column: Column) -> Column:
    """A uniform number below 2**32 from a record's id: the same in every run and partitioning."""
    return F.conv(F.substring(F.md5(id_column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def keep_probability(p: float, id_column: Column) -> Column:
    return draw(id_column) < F.lit(int(p * TWO32))


def sample_probability(df: DataFrame, p: float, id_column: str) -> DataFrame:
    """Narrow: a filter next to the scan."""
    return df.where(keep_probability(p, F.col(id_column)))


def _order(time: str, id_column: str) -> list[str]:
    return [time, id_column]


def overall_rank(df: DataFrame, time: str, id_column: str, out: str, blocks: int | None = None) -> DataFrame:
    """Number all records from 1 by (time, id), in ordered blocks that follow the density of the data: also where all have one time."""
    return ranked(df, _order(time, id_column), out, blocks)


def flag_every_n(df: DataFrame, n: int, time: str, id_column: str, key_by: Sequence[str] = ()) -> DataFrame:
    """Accept each n-th record, not the first."""
    if not key_by:
        return overall_rank(df, time, id_column, "_place").withColumn("accepted", F.col("_place") % n == 0).drop("_place")
    place = F.row_number().over(Window.partitionBy(*key_by).orderBy(*_order(time, id_column)))
    return df.withColumn("accepted", place % n == 0)


#: Rows of a key from which on ``hot_keys=None`` makes it a chain.
HOT_ROWS = 1_000_000


def by_heat(df: DataFrame, key_by: Sequence[str], make: Callable[[DataFrame, bool], DataFrame], rows: int | None = None) -> DataFrame:
    """``make(records, hot)`` over the keys with at most ``rows`` records and over the others, in one result. One aggregate finds the hot
    keys; without any, records go one way only."""
    columns = [f"_key_{k}" for k in range(len(key_by))]
    counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(key_by, columns, strict=True)]).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(counts.where(F.col("_n") > (HOT_ROWS if rows is None else rows)).select(*columns), "hot-keys")
    if hot.isEmpty():
        return make(df, False)
    same = F.lit(True)
    for c, n in zip(key_by, columns, strict=True):
        same = same & df[c].eqNullSafe(hot[n])
    return make(df.join(hot, same, "left_anti"), False).unionByName(make(df.join(hot, same, "left_semi"), True))


def fold(df: DataFrame, value: str, key_by: Sequence[str], order: Sequence[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Run a state machine over each key's records in order; ``step(state, value)`` gives the added columns of a record.

    Rows are dealt by key and sorted; a partition's keys follow one another, so state is a few numbers, not a group. A null
    value counts as 0. One shuffle, but all of a key's records go through one task.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    out = StructType([*df.schema.fields, *added.fields])
    keyed = df.withColumn("_key", F.struct(*key_by))
    keyed = keyed.repartition(*key_by).sortWithinPartitions(*key_by, *order)
    columns = df.columns
    at = columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        last, state = None, None
        for batch in batches:
            keys = batch.column(len(columns)).to_pylist()
            made: list[tuple] = []
            for key, x in zip(keys, batch.column(at).to_pylist(), strict=True):
                if key != last or state is None:
                    last, state = key, start()
                made.append(step(state, x or 0))
            arrays = [batch.column(k).cast(arrow.field(k).type) for k in range(len(columns))]
            arrays += [pa.array([m[i] for m in made], type=arrow.field(len(columns) + i).type) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return keyed.mapInArrow(run, out)


def rate_limit_step(most: int, window_ms: int) -> Callable:
    """A window starts with the first record after the last one's end; up to ``most`` of its records are accepted."""

    def step(state: list, ms: int) -> tuple[bool]:
        if ms - state[0] >= window_ms:
            state[0], state[1] = ms, 0
        if state[1] < most:
            state[1] += 1
            return (True,)
        return (False,)

    return step


def _keyed(df: DataFrame, time: str, id_column: str, key_by: Sequence[str]) -> DataFrame:
    """With the columns that windows need; times before 1970, and null ones, count as 0."""
    return df.withColumns({"_key": key_of(key_by), "_at": F.greatest(F.coalesce(F.col(time).cast("long"), F.lit(0)), F.lit(0)), "_id": F.col(id_column)})


def flag_rate_limit(df: DataFrame, most: int, window_ms: int, time: str, id_column: str, key_by: Sequence[str] = (), hot_keys: bool | None = False) -> DataFrame:
    """Add ``accepted``: the first ``most`` records of each window. ``hot_keys=None``: each key the way that its number of records asks for.

    With keys that all have moderately many records, one fold. Without keys, or with ``hot_keys``, key, time and id go through the windows and give each one's last accepted record; whole records meet these in one join.
    """
    if key_by and hot_keys is None:
        return by_heat(df, key_by, lambda rows, hot: flag_rate_limit(rows, most, window_ms, time, id_column, key_by, hot))
    if key_by and not hot_keys:
        return fold(df, time, key_by, _order(time, id_column), "accepted boolean", lambda: [0, 0], rate_limit_step(most, window_ms))
    rows = _keyed(df, time, id_column, key_by)
    records = rows.select("_key", "_at", "_id")
    placed = windows_of(records, "_at", window_starts(records, "_at", window_ms), window_ms)
    nth = F.row_number().over(Window.partitionBy("_key", "start").orderBy("_at", "_id"))  # Spark keeps the first of each before it shuffles
    last = placed.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("_key", "start").agg(F.max(F.struct("_at", "_id")).alias("_last"))
    found = windows_of(rows, "_at", last, window_ms, "_last")
    return found.withColumn("accepted", F.coalesce(F.struct("_at", "_id") <= F.col("_last"), F.lit(False))).select(*df.columns, "accepted")


def adaptive_step(target: float, interval_ms: int, min_rate: float, max_rate: float) -> Callable:
    """The rate in force for a record: down by a tenth after an interval above the target, else up by a tenth."""

    def step(state: list, ms: int) -> tuple[float]:
        if ms - state[0] >= interval_ms:
            actual = state[1] / (interval_ms / 1000.0)
            state[2] = max(min_rate, state[2] * 0.9) if actual > target else min(max_rate, state[2] * 1.1)
            state[0], state[1] = ms, 0
        state[1] += 1
        return (state[2],)

    return step


def with_adaptive_rate(df: DataFrame, target: float, time: str, id_column: str, key_by: Sequence[str] = (), interval_ms: int = 1000, min_rate: float = 0.01, max_rate: float = 1.0, hot_keys: bool | None = False) -> DataFrame:
    """Add ``rate`` and ``accepted`` (the record's draw is below the rate). ``hot_keys=None``: each key the way that its number of records asks
    for.

    With keys that all have moderately many records, one fold. Without keys, or with ``hot_keys``, intervals are windows, and
    only their counts, a row for each key and interval, go through one task a key.
    """
    if key_by and hot_keys is None:
        return by_heat(df, key_by, lambda rows, hot: with_adaptive_rate(rows, target, time, id_column, key_by, interval_ms, min_rate, max_rate, hot))
    if key_by and not hot_keys:
        rated = fold(df, time, key_by, _order(time, id_column), "rate double", lambda: [0, 0, 1.0], adaptive_step(target, interval_ms, min_rate, max_rate))
        return rated.withColumn("accepted", draw(F.col(id_column)) < F.floor(F.col("rate") * TWO32))
    rows = _keyed(df, time, id_column, key_by)
    records = rows.select("_key", "_at")
    placed = windows_of(records, "_at", window_starts(records, "_at", interval_ms), interval_ms)
    counts = placed.groupBy("_key", "start").agg(F.count(F.lit(1)).alias("n"))
    key = records.schema["_key"].dataType.simpleString()
    step = adaptive_step(target, interval_ms, min_rate, max_rate)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for own, start, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != last or state is None:
                    last, state = own, [0, 0, 1.0]
                out.append(step(state, start)[0])
                state[1] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["_key", "start", "rate"])

    rates = counts.repartition("_key").sortWithinPartitions("_key", "start").mapInArrow(rated, f"_key {key}, start long, rate double")
    found = windows_of(rows, "_at", rates, interval_ms, "rate").select(*df.columns, "rate")
    return found.withColumn("accepted", draw(F.col(id_column)) < F.floor(F.col("rate") * TWO32))


def _carried(df: DataFrame, time: str, id_column: str, key_by: Sequence[str], state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A batch's records with the window that their key is in already (``_since``, ``_state``), and (_key, _at) of all that windows may start
    from. A record that is earlier than that window is in it, too: ``_in`` is where it counts."""
    rows = _keyed(df, time, id_column, key_by)
    if state is None:
        rows = rows.withColumns({"_since": F.lit(None).cast("long"), "_state": F.lit(None)})
        return rows.withColumn("_in", F.col("_at")), rows.select("_key", "_at")
    known = state.select("_key", F.col("start").alias("_since"), F.struct(*[c for c in state.columns if c != "_key"]).alias("_state"))
    rows = rows.join(known, "_key", "left").withColumn("_in", F.greatest("_at", F.coalesce("_since", F.lit(0))))
    return rows, rows.select("_key", F.col("_in").alias("_at")).union(state.select("_key", "start"))


def rate_limit_batch(df: DataFrame, most: int, window_ms: int, time: str, id_column: str, key_by: Sequence[str] = (), state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``flag_rate_limit`` for one of many batches that follow in time: the records with ``accepted``, and the state for the next batch.

    ``state``: a row for each key - _key, the ``start`` of its window and the ``n`` that it has accepted; None at first. Windows are chains in
    many tasks (see ``chains``). A key whose window is over at the latest time of the batch isn't kept: its next record starts a new one.
    """
    rows, values = _carried(df, time, id_column, key_by, state)
    starts = window_starts(values, "_at", window_ms)
    had = F.when(F.col("_since") == F.col("start"), F.col("_state.n")).otherwise(0) if state is not None else F.lit(0)
    records = rows.select("_key", "_in", "_at", "_id", "_since", *(["_state"] if state is not None else []))
    placed = windows_of(records, "_in", starts, window_ms).withColumn("_had", had)
    nth = F.row_number().over(Window.partitionBy("_key", "start").orderBy("_at", "_id"))
    last = placed.withColumn("_n", nth).where(F.col("_n") <= most).where(F.col("_n") + F.col("_had") <= most).groupBy("_key", "start").agg(F.max(F.struct("_at", "_id")).alias("_last"))
    found = windows_of(rows, "_in", last, window_ms, "_last")
    flagged = found.withColumn("accepted", F.coalesce(F.struct("_at", "_id") <= F.col("_last"), F.lit(False))).select(*df.columns, "accepted")
    used = placed.groupBy("_key", "start").agg(F.least(F.lit(most), F.count(F.lit(1)) + F.max("_had")).cast("long").alias("n"))
    if state is not None:
        used = used.union(state.select("_key", "start", "n"))
    now = used.groupBy("_key").agg(F.max(F.struct("start", "n")).alias("_w")).select("_key", "_w.start", "_w.n")
    latest = rows.agg(F.max("_at").alias("latest")).first()["latest"] or 0
    return flagged, now.where(F.lit(latest) - F.col("start") < window_ms)


def adaptive_batch(df: DataFrame, target: float, time: str, id_column: str, key_by: Sequence[str] = (), interval_ms: int = 1000, min_rate: float = 0.01, max_rate: float = 1.0, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``with_adaptive_rate`` for one of many batches: the records with ``rate`` and ``accepted``, and the state for the next batch.

    ``state``: _key, ``start`` and ``n`` of the key's interval, and its ``rate``. A rate is a key's whole past, so every key stays.
    """
    rows, values = _carried(df, time, id_column, key_by, state)
    starts = window_starts(values, "_at", interval_ms)
    placed = windows_of(rows.select("_key", "_in"), "_in", starts, interval_ms)
    counts = placed.groupBy("_key", "start").agg(F.count(F.lit(1)).alias("n"))
    old = state if state is not None else counts.select("_key", "start", "n", F.lit(1.0).alias("rate")).limit(0)
    begun = old.select("_key", F.col("start").alias("_since"), F.col("n").alias("_had"), F.col("rate").alias("_rate"))
    key = rows.schema["_key"].dataType.simpleString()
    step = adaptive_step(target, interval_ms, min_rate, max_rate)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for batch in batches:
            rates, held = [], []
            for own, start, n, since, had, rate_then in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if own != last or now is None:
                    last, now = own, [since, had, rate_then] if since is not None else [0, 0, 1.0]
                if start == now[0]:  # the interval that the key is in goes on
                    now[1] += n
                else:
                    step(now, start)
                    now[1] = n
                rates.append(now[2])
                held.append(now[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.int64()), pa.array(rates, pa.float64())], ["_key", "start", "n", "rate"])

    along = counts.join(begun, "_key", "left").repartition("_key").sortWithinPartitions("_key", "start").select("_key", "start", "n", "_since", "_had", "_rate")
    rates = along.mapInArrow(rated, f"_key {key}, start long, n long, rate double")
    found = windows_of(rows, "_in", rates, interval_ms, "rate").select(*df.columns, F.coalesce("rate", F.lit(1.0)).alias("rate"))
    now = rates.union(old.select("_key", "start", "n", "rate")).groupBy("_key").agg(F.max(F.struct("start", "n", "rate")).alias("_w")).select("_key", "_w.start", "_w.n", "_w.rate")
    return found.withColumn("accepted", draw(F.col(id_column)) < F.floor(F.col("rate") * TWO32)), now


@dataclass(frozen=True)
class Sampler:
    """``strategy``: none, probability, rate_limit, every_n or adaptive. ``hot_keys``: how rate limits and adaptive rates go about keys
    that may have very many records; None: the records of each key are counted first (see ``flag_rate_limit``)."""

    strategy: str = "none"
    options: tuple[tuple[str, object], ...] = ()
    key_by: tuple[str, ...] = ()
    hot_keys: bool | None = None

    @staticmethod
    def preset(name: str, key_by: Sequence[str] = (), hot_keys: bool | None = None) -> Sampler:
        strategy, options = PRESETS[name]
        return Sampler(strategy, tuple(options.items()), tuple(key_by), hot_keys)

    def flag(self, df: DataFrame, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
        """Add ``accepted`` and ``reject_reason`` (null if accepted)."""
        o = dict(self.options)
        if self.strategy == "none":
            out = df.withColumn("accepted", F.lit(True))
        elif self.strategy == "probability":
            out = df.withColumn("accepted", keep_probability(o["p"], F.col(id_column)))
        elif self.strategy == "every_n":
            out = flag_every_n(df, o["n"], time, id_column, self.key_by)
        elif self.strategy == "rate_limit":
            out = flag_rate_limit(df, o["most"], o["window_ms"], time, id_column, self.key_by, self.hot_keys)
        elif self.strategy == "adaptive":
            out = with_adaptive_rate(df, time=time, id_column=id_column, key_by=self.key_by, hot_keys=self.hot_keys, **o)
        else:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        reason = {"probability": "probability_filter", "rate_limit": "rate_limit_exceeded", "every_n": "every_n_filter", "adaptive": "adaptive_rate_limit"}.get(self.strategy)
        return out.withColumn("reject_reason", F.when(~F.col("accepted"), F.lit(reason)))

    def apply(self, df: DataFrame, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
        return self.flag(df, time, id_column).where("accepted").select(df.columns)

    def current_rate(self) -> float | None:
        """The configured share; None where it depends on the data."""
        o = dict(self.options)
        return {"none": 1.0, "probability": o.get("p"), "every_n": 1.0 / o["n"] if "n" in o else None}.get(self.strategy)


def sample_stats(flagged: DataFrame) -> DataFrame:
    total, accepted = F.count(F.lit(1)), F.count_if(F.col("accepted"))
    return flagged.agg(total.alias("total"), accepted.alias("accepted"), (total - accepted).alias("rejected"), rate(accepted, total).alias("accept_rate"))
