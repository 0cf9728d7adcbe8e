"""Alarms of a running stream: latency, error rate, drop rate, throughput and late rows of each micro-batch against limits.

``measured`` runs a pipeline between two observations, which Spark sums up within the batch at no further pass; ``Alarms`` is a
listener that hears of each batch's progress, calls back for each limit that is strictly exceeded, and keeps the alarms in a
folder, one small file a batch, from which ``alarm_table`` reads them. A batch that runs again writes its file again.
Where the pipeline has rules, ``matches`` hears how many records each of them matched in a batch.

Callbacks run on the driver, in the order of batches, and shouldn't take long; an error in one is logged and stops nothing.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidelog.plans.pipeline import LogPipeline
from tidelog.sources import spool as files

#: What limits may be about.
METRICS = ("latency_ms", "error_rate", "drop_rate", "records_per_second", "late_rows")

SCHEMA = "query string, batch long, metric string, value double, most double, at string"

#: From this priority on a record is an error.
ERROR = 40


@dataclass(frozen=True)
class Alarm:
    query: str
    batch: int
    metric: str
    value: float
    most: float
    at: str


def measured(df: DataFrame, flow: LogPipeline, name: str = "tidelog") -> DataFrame:
    """``flow.apply`` between observations of what comes in and what is left."""
    taken = flow.apply(df.observe(f"{name}_in", F.count(F.lit(1)).alias("records")))
    hits = [F.count_if(F.array_contains("rule_ids", r.id)).alias(f"rule_{r.id}") for r in flow.rules.rules] if flow.rules is not None else []
    return taken.observe(f"{name}_out", F.count(F.lit(1)).alias("records"), F.count_if(F.col("priority") >= ERROR).alias("errors"), *hits)


def matched(progress, name: str = "tidelog") -> dict[int, int]:
    """Records that each rule matched in a batch, by the rule's id; empty for a pipeline without rules or observations."""
    seen = (progress.observedMetrics or {}).get(f"{name}_out")
    counts = {} if seen is None else seen if isinstance(seen, Mapping) else seen.asDict()
    return {int(c.removeprefix("rule_")): n for c, n in counts.items() if c.startswith("rule_")}


def readings(progress, name: str = "tidelog") -> dict[str, float]:
    """The metrics of a batch's progress; rates are 0 where nothing came in.

    ``late_rows`` is there if an operator of the query has state: the rows that came behind the watermark and were dropped. An
    aggregate sums up before its shuffle, so there it counts a late group of a task once.
    """
    seen = progress.observedMetrics or {}
    came = seen[f"{name}_in"]["records"] if f"{name}_in" in seen else progress.numInputRows
    out = {"latency_ms": float((progress.durationMs or {}).get("triggerExecution", 0))}
    seconds = out["latency_ms"] / 1000
    out["records_per_second"] = came / seconds if seconds else 0.0
    if f"{name}_out" in seen:
        left, errors = seen[f"{name}_out"]["records"], seen[f"{name}_out"]["errors"]
        out["error_rate"] = errors / left if left else 0.0
        out["drop_rate"] = (came - left) / came if came else 0.0
    if progress.stateOperators:
        out["late_rows"] = float(sum(op.numRowsDroppedByWatermark for op in progress.stateOperators))
    return out


class Alarms(StreamingQueryListener):
    """``limits``: the most of each of ``METRICS`` that is fine. ``with Alarms(spark, limits, ..):`` listens to all queries of the session, or
    to the one called ``query``. ``matches`` (query, batch number, records by rule id) is called for each batch in which a rule matched."""

    def __init__(
        self,
        spark: SparkSession,
        limits: Mapping[str, float],
        callback: Callable[[Alarm], None] | None = None,
        folder: str | None = None,
        query: str | None = None,
        name: str = "tidelog",
        matches: Callable[[str, int, dict[int, int]], None] | None = None,
    ):
        if wrong := set(limits) - set(METRICS):
            raise ValueError(f"no limits are known for {sorted(wrong)}")
        self.spark, self.limits, self.callback, self.folder, self.query, self.name, self.matches = spark, dict(limits), callback, folder, query, name, matches

    def hear(self, progress) -> list[Alarm]:
        """The alarms of a batch, called back and kept."""
        if self.query is not None and progress.name != self.query:
            return []
        counts = matched(progress, self.name)
        if self.matches and any(counts.values()):
            try:
                self.matches(str(progress.name or progress.id), progress.batchId, counts)
            except Exception as e:
                logging.getLogger(__name__).warning("rules of batch %s: %s", progress.batchId, e)
        found = readings(progress, self.name)
        raised = [Alarm(str(progress.name or progress.id), progress.batchId, m, found[m], most, progress.timestamp) for m, most in self.limits.items() if found.get(m, 0.0) > most]
        for alarm in raised:
            if self.callback:
                try:
                    self.callback(alarm)
                except Exception as e:
                    logging.getLogger(__name__).warning("alarm %s: %s", alarm.metric, e)
        if raised and self.folder:
            store, folder = files.opened(self.folder)
            body = "".join(json.dumps({"query": a.query, "batch": a.batch, "metric": a.metric, "value": a.value, "most": float(a.most), "at": a.at}) + "\n" for a in raised)
            files.put(store, f"{folder}/{progress.id}-{progress.batchId:012d}.json", body.encode())
        return raised

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.hear(event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def __enter__(self) -> Alarms:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)


def alarm_table(spark: SparkSession, folder: str) -> DataFrame:
    store, path = files.opened(folder)
    store.create_dir(path)
    return spark.read.schema(SCHEMA).json(folder)
