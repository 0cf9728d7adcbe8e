"""Stateful operators for streams: samplers and once-rules with a state for each key.

They take rows in order of (time, id) within each micro-batch, so a stream whose batches follow in time gives what the
batch operators give. State is a few numbers for each key, in RocksDB. A key's rows of one micro-batch are sorted in one
task, so bound micro-batches by bytes, as ``windows.PRESETS`` do; only order, id and kept columns get there. For keys that may have most
of the rows there is ``carried``.

A rate limit's state ends: with ``late``, a watermark, an event-time timer removes a key when its window is over, and its next
record starts a window anyhow, so results stay the same for records that aren't later than that. The states of adaptive rates, every-N and
once are a key's whole past, and stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidelog.operators.sampling import adaptive_step, draw, rate_limit_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """The state machine ``step(state, ms)`` over each key's rows."""

    def __init__(self, fields: str, start: tuple, step: Callable, added: Sequence[str], order: Sequence[str], keep: Sequence[str], lasts_ms: int | None = None):
        self.fields, self.start, self.step, self.added, self.order, self.keep, self.lasts_ms = fields, start, step, list(added), list(order), list(keep), lasts_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = list(held) if held is not None else list(self.start)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        made = [self.step(state, ms) for ms in frame[self.order[0]].tolist()]
        self.state.update(tuple(state))
        if self.lasts_ms is not None:  # the state's first number is when its window began
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(state[0] + self.lasts_ms)
        yield frame[self.keep].assign(**{n: [m[i] for m in made] for i, n in enumerate(self.added)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key_by: Sequence[str], added: str, processor: _Fold, keep: Sequence[str]) -> DataFrame:
    if df.isStreaming:
        df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(added).fields])
    return df.groupBy(*key_by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None" if processor.lasts_ms is None else "EventTime")


def rate_limit(df: DataFrame, most: int, window_ms: int, key_by: Sequence[str], keep: Sequence[str], time: str = "ts_ms", id_column: str = "event_id", late: str | None = None) -> DataFrame:
    """Add ``accepted``; see ``sampling.flag_rate_limit``. ``late``: how late records may be; then a key's state ends with its window. Later
    ones are left out, as behind any watermark."""
    if late is not None:
        df = df.withColumn("at_watermark", F.timestamp_millis(time)).withWatermark("at_watermark", late)
    fold = _Fold("start long, n long", (0, 0), rate_limit_step(most, window_ms), ["accepted"], [time, id_column], keep, window_ms if late is not None else None)
    return _stateful(df, key_by, "accepted boolean", fold, keep)


def adaptive(df: DataFrame, target: float, key_by: Sequence[str], keep: Sequence[str], interval_ms: int = 1000, min_rate: float = 0.01, max_rate: float = 1.0, time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
    """Add ``rate`` and ``accepted``; see ``sampling.with_adaptive_rate``."""
    step = adaptive_step(target, interval_ms, min_rate, max_rate)
    rated = _stateful(df, key_by, "rate double", _Fold("last long, n long, rate double", (0, 0, 1.0), step, ["rate"], [time, id_column], keep), keep)
    return rated.withColumn("accepted", draw(F.col(id_column)) < F.floor(F.col("rate") * 4_294_967_296))


def every_n(df: DataFrame, n: int, key_by: Sequence[str], keep: Sequence[str], time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
    """Add ``accepted``: each n-th of a key."""

    def step(state: list, _: int) -> tuple[bool]:
        state[0] += 1
        return (state[0] % n == 0,)

    return _stateful(df, key_by, "accepted boolean", _Fold("n long", (0,), step, ["accepted"], [time, id_column], keep), keep)


def once(df: DataFrame, key_by: Sequence[str], keep: Sequence[str], time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
    """Add ``fired``: true for the first row of a key."""

    def step(state: list, _: int) -> tuple[bool]:
        state[0] += 1
        return (state[0] == 1,)

    return _stateful(df, key_by, "fired boolean", _Fold("n long", (0,), step, ["fired"], [time, id_column], keep), keep)


class _FirstOnly(StatefulProcessor):
    """Of the boolean columns ``tests``, each is true once in the whole stream: for its first row."""

    def __init__(self, tests: Sequence[str], order: Sequence[str], columns: Sequence[str]):
        self.tests, self.order, self.columns = list(tests), list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"t{k} boolean" for k in range(len(self.tests))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fired = list(self.state.get()) if self.state.exists() else [False] * len(self.tests)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for k, test in enumerate(self.tests):
            hit = frame[test].to_numpy(dtype=bool)
            first = hit & (hit.cumsum() == 1) & (not fired[k])
            fired[k] = bool(fired[k] or hit.any())
            frame[test] = first
        self.state.update(tuple(fired))
        yield frame[self.columns]

    def close(self) -> None:
        pass


def first_only(df: DataFrame, tests: Sequence[str], time: str = "ts_ms", id_column: str = "event_id") -> DataFrame:
    """Let each of the boolean columns ``tests`` be true only for its first row. Rows for which none is true pass by; the others
    share one state, as one row may fire several."""
    some = F.lit(False)
    for t in tests:
        some = some | F.col(t)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # as tuples, rows lose names with a leading underscore
    plain = [f"column_{k}" for k in range(len(df.columns))]
    name = dict(zip(df.columns, plain, strict=True))
    hit = df.where(some).toDF(*plain)
    processor = _FirstOnly([name[t] for t in tests], [name[time], name[id_column]], plain)
    fired = hit.withColumn("all_rows", F.lit(0)).groupBy("all_rows").transformWithStateInPandas(statefulProcessor=processor, outputStructType=hit.schema, outputMode="Append", timeMode="None")
    return df.where(~some).union(fired.toDF(*df.columns))
