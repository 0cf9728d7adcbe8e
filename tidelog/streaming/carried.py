"""Streams as batch queries that carry tables from one micro-batch to the next.

A keyed state of Structured Streaming puts all of a key's rows of a micro-batch into one task. Here a micro-batch is an ordinary
DataFrame: windows are chains in many tasks, a rule's first record is an aggregate, and what the next batch has to know - a few
numbers for each key or rule - is a small table. So a hot key, or a stream without keys, is spread over the cluster.

Each batch writes its rows and its tables under its own number, and at last a *mark* that names them. A batch that has a mark isn't
run again; one that was cut off has none, and runs anew from the tables of the mark before it. Readers take what has a mark. So every
record is in the results once, whatever dies.

    <path>/rows/<batch>   <path>/<table>/<batch>   <path>/_marks/<batch>.json
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import sampling
from tidelog.operators.filters import level_gate
from tidelog.plans.pipeline import LogPipeline
from tidelog.sources import spool as files
from tidelog.streaming.windows import PRESETS

Tables = Mapping[str, DataFrame]
Step = Callable[[DataFrame, Tables], tuple[DataFrame, dict[str, DataFrame]]]

#: Batches whose tables stay besides the last one's.
KEPT = 2


class Marks:
    """The marks of a folder: what each finished batch has written."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.store, folder = files.opened(self.path)
        self.folder = f"{folder.rstrip('/')}/_marks"

    def all(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.store, self.folder) if n.endswith(".json")]

    def has(self, batch: int) -> bool:
        return files.exists(self.store, f"{self.folder}/{batch:012d}.json")

    def before(self, batch: int) -> tuple[int, dict] | None:
        """The last batch before this one, and its mark."""
        older = [b for b in self.all() if b < batch]
        return (max(older), self.get(max(older))) if older else None

    def get(self, batch: int) -> dict:
        return json.loads(files.get(self.store, f"{self.folder}/{batch:012d}.json"))

    def put(self, batch: int, mark: dict) -> None:
        files.put(self.store, f"{self.folder}/{batch:012d}.json", json.dumps(mark).encode())

    def drop(self, path: str) -> None:
        """Remove a folder that this sink has written."""
        store, folder = files.opened(path)
        if files.exists(store, folder):
            store.delete_dir(folder)


def run_batch(batch: DataFrame, number: int, path: str, step: Step) -> bool:
    """One micro-batch: rows, tables, mark. False if it was done before."""
    spark, marks = batch.sparkSession, Marks(path)
    if marks.has(number):
        return False
    before = marks.before(number)
    names = before[1]["tables"] if before else []
    tables = {n: spark.read.parquet(f"{marks.path}/{n}/{before[0]}") for n in names}
    held = batch.persist(StorageLevel.MEMORY_AND_DISK)  # a step may look at its rows several times
    try:
        rows, following = step(held, tables)
        rows.write.mode("overwrite").parquet(f"{marks.path}/rows/{number}")
        for name, table in following.items():
            table.write.mode("overwrite").parquet(f"{marks.path}/{name}/{number}")
    finally:
        held.unpersist()
    marks.put(number, {"tables": sorted(following)})
    for old in sorted(b for b in marks.all() if b < number)[: -KEPT or None]:
        for name in marks.get(old)["tables"]:
            marks.drop(f"{marks.path}/{name}/{old}")
    return True


def start(stream: DataFrame, path: str, checkpoint: str, step: Step, preset: str = "balanced") -> StreamingQuery:
    """Run ``step`` (rows of a batch, tables) -> (rows of the result, tables for the next batch) over a stream; the running query."""
    out = stream.writeStream.foreachBatch(lambda batch, number: run_batch(batch, number, path, step) and None)
    return out.option("checkpointLocation", checkpoint).trigger(**PRESETS[preset]["trigger"]).start()


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches that are done; None if there are none."""
    marks = Marks(path)
    done = marks.all()
    return spark.read.parquet(*[f"{marks.path}/rows/{b}" for b in done]) if done else None


def table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table as the last batch left it."""
    marks = Marks(path)
    done = marks.all()
    return spark.read.parquet(f"{marks.path}/{name}/{max(done)}") if done and name in marks.get(max(done))["tables"] else None


# --- steps


def rate_limit(most: int, window_ms: int, key_by: Sequence[str] = (), keep: Sequence[str] | None = None, time: str = "ts_ms", id_column: str = "event_id") -> Step:
    """Rows with ``accepted``; see ``sampling.rate_limit_batch``."""

    def step(batch: DataFrame, tables: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
        rows, state = sampling.rate_limit_batch(batch, most, window_ms, time, id_column, key_by, tables.get("windows"))
        return rows.select(*(keep or batch.columns), "accepted"), {"windows": state}

    return step


def adaptive(target: float, key_by: Sequence[str] = (), keep: Sequence[str] | None = None, interval_ms: int = 1000, min_rate: float = 0.01, max_rate: float = 1.0, time: str = "ts_ms", id_column: str = "event_id") -> Step:
    """Rows with ``rate`` and ``accepted``; see ``sampling.adaptive_batch``."""

    def step(batch: DataFrame, tables: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
        rows, state = sampling.adaptive_batch(batch, target, time, id_column, key_by, interval_ms, min_rate, max_rate, tables.get("rates"))
        return rows.select(*(keep or batch.columns), "rate", "accepted"), {"rates": state}

    return step


def pipeline(flow: LogPipeline) -> Step:
    """A whole ``LogPipeline``: rate limits and adaptive rates carry their windows, rules that fire once the ids of those that have.

    Of such a rule one row a batch gets here: its first record, by an aggregate. Records that every-N takes are numbered within a batch, so
    that sampler isn't for streams of several batches: use ``stateful.every_n``.
    """
    if flow.sampler.strategy == "every_n":
        raise ValueError("every_n ranks all records; over streams use stateful.every_n")

    def step(batch: DataFrame, tables: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
        spark, out, following = batch.sparkSession, flow, {}
        rows = batch
        if flow.sampler.strategy in ("rate_limit", "adaptive"):
            o = dict(flow.sampler.options)
            gated = level_gate(rows, flow.level, flow.module_levels, flow.enabled)
            if flow.sampler.strategy == "rate_limit":
                taken, following["windows"] = sampling.rate_limit_batch(gated, o["most"], o["window_ms"], flow.time, flow.id_column, flow.sampler.key_by, tables.get("windows"))
            else:
                taken, following["rates"] = sampling.adaptive_batch(gated, time=flow.time, id_column=flow.id_column, key_by=flow.sampler.key_by, state=tables.get("rates"), **o)
            rows, out = taken.where("accepted").select(batch.columns), replace(flow, sampler=sampling.Sampler())
        once = [r.id for r in flow.rules.rules if r.once] if flow.rules else []
        if not once:
            return out.apply(rows), following
        fired = {r["rule_id"] for r in tables["fired"].collect()} if "fired" in tables else set()  # ids of rules of the registry
        rules = replace(flow.rules, rules=[replace(r, enabled=r.enabled and r.id not in fired) if r.once else r for r in flow.rules.rules])
        made = replace(out, rules=rules).apply(rows)
        now = made.select(F.explode("rule_ids").alias("rule_id")).where(F.col("rule_id").isin(once)).distinct()
        known = spark.createDataFrame([(f,) for f in sorted(fired)], "rule_id int")
        return made, {**following, "fired": now.union(known).distinct()}

    return step


def history(period: Column, last: int) -> Step:
    """Snapshots of volumes by ``period``: the rows pass by, and the table ``snapshots`` has the last so many periods of the stream."""
    from tidelog.operators.metrics import history as snapshots

    def step(batch: DataFrame, tables: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
        new = snapshots(batch, period, last)
        both = new.union(tables["snapshots"].select(new.columns)) if "snapshots" in tables else new
        merged = both.groupBy("period").agg(F.sum("records").alias("records"), F.sum("bytes").cast("long").alias("bytes"))
        return batch, {"snapshots": merged.orderBy(F.desc("period")).limit(last)}

    return step
