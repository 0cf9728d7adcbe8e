"""A stream into log files that rotate by size and time, are packed, archived and removed.

Files are those that the batch planner gives the whole stream (``retention.time_bucket`` and ``retention.size_index``): an interval of
record time begins a new file, and so does a record before which the file has reached its limit. A micro-batch's records are told
their files by chains of windows in many tasks, from the bytes that the open file has already; they are dealt and sorted by
file, time and id, and written as parts. A file that is full is then put together from its parts by a task, packed if wanted, under
its rotated name, in the archive folder if there is one.

Two phases. A batch writes parts under its own number, then its *mark*: the open file, what has rotated, and what is to be
done about it. Only then files are put together, shifted and removed, each step such that it can be done again; a second mark says that all
is done. A batch that was cut off before its mark runs anew from the mark before it; one that was cut off after is finished first.

Defined cases. A record that is earlier than the open file's interval, or has no time, goes into the open file. A null line is an empty
line. A name that is taken gets a number behind it, but by ``index`` the newest is ``.1`` and the others move up. Files are counted to
stay by ``keep``, or by ``max_age_s`` before the latest record. An empty batch changes nothing. Hooks run on the driver; an error in putting
a file together calls ``on_error`` and stops the query, which then begins again there.
"""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import retention
from tidelog.sources import spool as files
from tidelog.streaming.carried import Marks
from tidelog.streaming.windows import PRESETS

#: Bytes that are copied at once.
COPY_BYTES = 1 << 20


@dataclass(frozen=True)
class Hooks:
    """Called with (old, new), (old, new, milliseconds), (path, error), (original, archived) and (path)."""

    on_start: Callable[[str, str], None] = lambda *_: None
    on_complete: Callable[[str, str, int], None] = lambda *_: None
    on_error: Callable[[str, Exception], None] = lambda *_: None
    on_archived: Callable[[str, str], None] = lambda *_: None
    on_cleanup: Callable[[str], None] = lambda *_: None


@dataclass(frozen=True)
class Rotation:
    """Files ``<folder>/<base>..``. ``limit``: bytes; ``interval``: one of ``retention.INTERVALS``; ``naming``: see ``retention.rotated_name``."""

    folder: str
    base: str = "app.log"
    limit: int | None = None
    interval: str | None = None
    naming: str | None = None
    naming_format: str | None = None
    keep: int | None = None
    max_age_s: int | None = None
    archive: str | None = None
    packed: bool = False
    clean_empty: bool = False
    hooks: Hooks = field(default_factory=Hooks)

    def target(self) -> str:
        return (self.archive or self.folder).rstrip("/")

    def name_by(self) -> str:
        return "custom" if self.naming_format else self.naming or retention.default_naming(self.interval)


EMPTY = {"open": 0, "bucket": None, "written": 0, "records": 0, "parts": [], "rotated": [], "stats": {"rotations": 0, "packed": 0, "deleted": 0}}


def _file_of(rows: DataFrame, rotation: Rotation, state: dict) -> DataFrame:
    """Add ``period`` and ``_index``: a record's file."""
    own = retention.time_bucket(F.floor(F.col("_at") / 1000), rotation.interval) if rotation.interval else F.lit(0).cast("long")
    now = F.lit(state["bucket"]).cast("long")
    rows = rows.withColumn("period", F.greatest(own, now))  # leaves nulls aside
    if rotation.interval:  # records without a time, at the very beginning
        rows = rows.withColumn("period", F.coalesce("period", F.lit(0)))
    if rotation.limit is None:
        return rows.withColumn("_index", F.lit(0).cast("long"))
    held = F.when(F.col("period") == now, F.lit(state["written"])).otherwise(0) if state["bucket"] is not None else F.lit(0)
    return retention.size_index(rows, "_size", rotation.limit, ["_at", "_id"], ["period"], hot_keys=True, held=held).withColumnRenamed("file_index", "_index")


def _plan(batch: DataFrame, number: int, rotation: Rotation, line: Column, state: dict, time_ms: str, id_column: str) -> dict | None:
    """Write the batch's parts, and say what follows from it; None without records."""
    value = F.coalesce(line, F.lit(""))
    rows = batch.select(value.alias("value"), (F.octet_length(value) + 1).cast("long").alias("_size"), F.col(time_ms).cast("long").alias("_at"), F.col(id_column).alias("_id"))
    told = _file_of(rows, rotation, state).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = told.groupBy("period", "_index").agg(F.count(F.lit(1)).alias("records"), F.sum("_size").alias("size"), F.min("_at").alias("first"), F.max("_at").alias("last")).orderBy("period", "_index").collect()  # a row a file
        if not found:
            return None
        begun = state["bucket"] is not None
        goes_on = begun and (found[0]["period"], found[0]["_index"]) == (state["bucket"], 0)
        first = state["open"] if goes_on or not begun else state["open"] + 1
        ordinal = {(f["period"], f["_index"]): first + k for k, f in enumerate(found)}
        # a table, not a map in an expression, which each record would search from its beginning
        files_ = batch.sparkSession.createDataFrame([(*key, n) for key, n in ordinal.items()], "period long, _index long, file long")
        numbered = told.join(F.broadcast(files_), ["period", "_index"])
        ranges = numbered.repartitionByRange("file", "_at", "_id").sortWithinPartitions("file", "_at", "_id")
        parts = f"{rotation.folder.rstrip('/')}/_parts/{number}"
        ranges.select("value", "file").write.mode("overwrite").partitionBy("file").text(parts)
    finally:
        told.unpersist()
    store, folder = files.opened(parts)
    made = {n: [f"{parts}/file={n}/{x}" for x in files.names(store, f"{folder}/file={n}") if not x.startswith((".", "_"))] for n in ordinal.values()}
    open_ = {"open": first, "written": state["written"] if goes_on else 0, "records": state["records"] if goes_on else 0, "parts": list(state["parts"]) if goes_on else []}
    closed = [] if goes_on or not begun else [_closing(state, found[0]["first"])]
    for k, f in enumerate(found):
        n = ordinal[f["period"], f["_index"]]
        if k:
            closed.append(_closing(open_, f["first"]))
            open_ = {"open": n, "written": 0, "records": 0, "parts": []}
        open_ = {"open": n, "written": open_["written"] + f["size"], "records": open_["records"] + f["records"], "parts": open_["parts"] + made[n], "bucket": f["period"]}
    latest = max((f["last"] for f in found if f["last"] is not None), default=0)
    return open_ | {"closed": closed, "latest": max(latest, state.get("latest") or 0)}


def _closing(file: dict, at_ms: int | None) -> dict:
    return {"file": file["open"], "size": file["written"], "records": file["records"], "parts": file["parts"], "at_ms": at_ms or 0}


def _named(spark: SparkSession, rotation: Rotation, closed: list[dict], rotated: list[dict]) -> list[dict]:
    """The rotated files, old and new, with the names they are to have."""
    naming, end = rotation.name_by(), ".gz" if rotation.packed else ""
    if naming == "index":
        every = [*rotated, *closed]
        return [f | {"was": f.get("name"), "name": f"{rotation.base}.{len(every) - k}{end}"} for k, f in enumerate(every)]
    taken = {f["name"] for f in rotated}
    seconds = spark.createDataFrame([(k, f["at_ms"] // 1000) for k, f in enumerate(closed)], "k int, s long")
    names = {r["k"]: r["name"] for r in seconds.select("k", retention.rotated_name(rotation.base, F.col("s"), naming, rotation.naming_format).alias("name")).collect()} if closed else {}
    out = [f | {"was": f["name"]} for f in rotated]
    for k, f in enumerate(closed):
        name, n = names[k] + end, 0
        while name in taken:
            n += 1
            name = f"{names[k]}.{n}{end}"
        taken.add(name)
        out.append(f | {"was": None, "name": name})
    return out


def run_batch(batch: DataFrame, number: int, rotation: Rotation, line: Column, time_ms: str = "ts_ms", id_column: str = "event_id") -> bool:
    """One micro-batch; False if it was done before."""
    marks = Marks(rotation.folder)
    last = marks.before(number + 1)
    if last and not files.exists(marks.store, f"{marks.folder}/{last[0]:012d}.done"):
        _finish(batch.sparkSession, rotation, marks, *last)
    if marks.has(number):
        return False
    state = last[1]["state"] if last else EMPTY
    plan = _plan(batch, number, rotation, line, state, time_ms, id_column)
    if plan is None:
        return True
    rotated = _named(batch.sparkSession, rotation, plan["closed"], state["rotated"])
    kept = rotated[-rotation.keep :] if rotation.keep else rotated if rotation.keep is None else []
    if rotation.max_age_s is not None:
        kept = [f for f in kept if plan["latest"] - f["at_ms"] <= rotation.max_age_s * 1000]
    stats = dict(state["stats"])
    stats["rotations"] += len(plan["closed"])
    stats["packed"] += len(plan["closed"]) if rotation.packed else 0
    stats["deleted"] += len(rotated) - len(kept)
    light = lambda f: {n: f[n] for n in ("file", "size", "records", "at_ms", "name")}
    now = {n: plan[n] for n in ("open", "bucket", "written", "records", "parts", "latest")} | {"rotated": [light(f) for f in kept], "stats": stats}
    stay = {f["file"] for f in kept}
    todo = {
        "build": [{"file": f["file"], "name": f["name"], "parts": f["parts"]} for f in rotated if "parts" in f],
        "moves": [[f["was"], f["name"]] for f in rotated if f["was"] and f["was"] != f["name"]],
        "remove": [f["name"] for f in rotated if f["file"] not in stay],
    }
    marks.put(number, {"state": now, "todo": todo})
    _finish(batch.sparkSession, rotation, marks, number, {"todo": todo})
    for old in [b for b in marks.all() if b < number]:
        for name in (f"{old:012d}.json", f"{old:012d}.done"):
            if files.exists(marks.store, f"{marks.folder}/{name}"):
                marks.store.delete_file(f"{marks.folder}/{name}")
    return True


def _finish(spark: SparkSession, rotation: Rotation, marks: Marks, number: int, mark: dict) -> None:
    """Do what a mark says; may be done again at any point."""
    todo, target, hooks = mark["todo"], rotation.target(), rotation.hooks
    store, folder = files.opened(target)
    current = f"{rotation.folder.rstrip('/')}/{rotation.base}"
    if todo["moves"]:  # by index: all under hidden names first, as a name may be another's old one
        aside = f"{marks.folder}/{number:012d}.aside"
        if not files.exists(marks.store, aside):
            for was, _ in todo["moves"]:
                if files.exists(store, f"{folder}/{was}"):
                    store.move(f"{folder}/{was}", f"{folder}/.{was}.{number}")
            files.put(marks.store, aside, b"")
        for was, name in todo["moves"]:
            if files.exists(store, f"{folder}/.{was}.{number}"):
                store.move(f"{folder}/.{was}.{number}", f"{folder}/{name}")
    for f in todo["build"]:
        hooks.on_start(current, f"{target}/{f['name']}")
    began = time.monotonic()
    try:
        _build(spark, [(f["parts"], f"{target}/{f['name']}") for f in todo["build"]], rotation.packed)
    except Exception as e:
        hooks.on_error(current, e)
        raise
    for f in todo["build"]:
        hooks.on_complete(current, f"{target}/{f['name']}", int((time.monotonic() - began) * 1000))
        if rotation.archive:
            hooks.on_archived(current, f"{target}/{f['name']}")
    for name in todo["remove"]:
        if files.exists(store, f"{folder}/{name}"):
            store.delete_file(f"{folder}/{name}")
            hooks.on_cleanup(f"{target}/{name}")
    for f in todo["build"]:
        for part in f["parts"]:
            own, path = files.opened(part)
            if files.exists(own, path):
                own.delete_file(path)
    if rotation.clean_empty and rotation.archive and files.exists(store, folder) and not store.get_file_info(files.fs.FileSelector(folder)):
        store.delete_dir(folder)
    files.put(marks.store, f"{marks.folder}/{number:012d}.done", b"")
    if todo["moves"]:
        marks.store.delete_file(f"{marks.folder}/{number:012d}.aside")


def _build(spark: SparkSession, wanted: list[tuple[list[str], str]], packed: bool) -> None:
    """Put files together from their parts, a task each; a file that is there was put there whole."""
    if not wanted:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts, target = json.loads(text)
                store, path = files.opened(target)
                if files.exists(store, path):
                    continue
                folder, _, name = path.rpartition("/")
                store.create_dir(folder)
                hidden = f"{folder}/.{name}.new"
                with store.open_output_stream(hidden, compression=None) as plain, gzip.GzipFile(fileobj=plain, mode="wb", mtime=0) if packed else plain as out:
                    for part in parts:
                        own, at = files.opened(part)
                        with own.open_input_stream(at, compression=None) as f:
                            while chunk := f.read(COPY_BYTES):
                                out.write(chunk)
                store.move(hidden, path)
                yield pa.RecordBatch.from_pydict({"target": [target]})

    made = spark.createDataFrame([(json.dumps(w),) for w in wanted], "w string").repartition(min(len(wanted), 1000)).mapInArrow(run, "target string")
    made.collect()  # a row a file


def start(stream: DataFrame, rotation: Rotation, line: Column, checkpoint: str, preset: str = "balanced", time_ms: str = "ts_ms", id_column: str = "event_id") -> StreamingQuery:
    """Write ``line`` of each record of a stream; the running query."""
    out = stream.writeStream.foreachBatch(lambda batch, number: run_batch(batch, number, rotation, line, time_ms, id_column) and None)
    return out.option("checkpointLocation", checkpoint).trigger(**PRESETS[preset]["trigger"]).start()


def file_table(spark: SparkSession, rotation: Rotation) -> DataFrame:
    """The files that there are: ordinal, name (the open one's is the base), size, records, path, open."""
    last = Marks(rotation.folder).before(1 << 40)
    state = last[1]["state"] if last else EMPTY
    rows = [(f["file"], f["name"], f["size"], f["records"], f"{rotation.target()}/{f['name']}", False) for f in state["rotated"]]
    if state["parts"]:
        rows.append((state["open"], rotation.base, state["written"], state["records"], None, True))
    return spark.createDataFrame(rows, "file long, name string, size long, records long, path string, open boolean")


def stats(rotation: Rotation) -> dict[str, int]:
    """Rotations, files packed and files removed so far."""
    last = Marks(rotation.folder).before(1 << 40)
    return (last[1]["state"] if last else EMPTY)["stats"]


def read_lines(spark: SparkSession, rotation: Rotation) -> DataFrame:
    """The lines of all files that there are, with their ``name``."""
    last = Marks(rotation.folder).before(1 << 40)
    state = last[1]["state"] if last else EMPTY
    out = spark.createDataFrame([], "name string, value string")
    if state["rotated"]:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        out = out.union(spark.read.text([f"{rotation.target()}/{f['name']}" for f in state["rotated"]]).select(F.url_decode(name).alias("name"), "value"))
    if state["parts"]:
        out = out.union(spark.read.text(state["parts"]).select(F.lit(rotation.base).alias("name"), "value"))
    return out
