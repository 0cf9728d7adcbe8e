"""Sinks: what they take, how they render it, and where Spark writes it."""

from __future__ import annotations

import logging
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import TextIO

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions import formatting
from tidelog.operators.filters import SinkFilter


@dataclass(frozen=True)
class Sink:
    """``kind``: console, text, json, pretty_json, raw, parquet, tcp, udp or syslog. ``path`` may hold ``{date}``, ``{time}``,
    ``{hour}``, ``{level}``, ``{module}`` or a date pattern such as ``{YYYY-MM}``: records go to a folder for each value of theirs.

    The console is the driver's standard output; it gets every record, or the first ``most_shown``. A pretty JSON record takes several
    lines, and an empty one parts it from the next. ``stats``: a folder for the counts of what a tcp or udp sink sent. ``compression``
    of these is ``deflate``, of files one of Spark's codecs."""

    name: str
    kind: str = "text"
    path: str | None = None
    takes: SinkFilter = SinkFilter()
    enabled: bool = True
    overwrite: bool = False
    compression: str | None = None
    most_records_per_file: int = 0
    color: bool = False
    facility: str = "user"
    hostname: str = "localhost"
    app: str = "app"
    host: str = "127.0.0.1"
    port: int = 0
    stats: str | None = None
    most_shown: int | None = None

    def line(self, columns: list[str]) -> Column:
        if self.kind == "json":
            return formatting.json_line(columns)
        if self.kind == "pretty_json":
            return formatting.json_line(columns, pretty=True)
        if self.kind == "raw":
            return F.col("message")
        if self.kind == "syslog":
            return formatting.syslog_line(self.facility, self.hostname, self.app)
        line = formatting.default_line(columns)
        return formatting.colored(line, formatting.line_color(columns)) if self.color else line


_TAG = re.compile(r"\{([^{}]+)\}")


def _tag(name: str) -> Column:
    """What a tag of a path stands for, at the record's own time; a name that isn't known is a date pattern."""
    if name in ("level", "module"):
        return F.col(name)
    return formatting.date_pattern(F.col("ts"), {"date": "YYYY-MM-DD", "time": "HH-mm-ss", "hour": "HH"}.get(name, name))


def path_of(pattern: str) -> Column:
    """The path of a record's file by a pattern with tags."""
    parts = [F.lit(t) if k % 2 == 0 else F.coalesce(_tag(t), F.lit("")) for k, t in enumerate(_TAG.split(pattern)) if t]
    return F.concat(*parts)


def under_root(root: str | None, path: str) -> str:
    """A root folder takes the path's last part."""
    return f"{root.rstrip('/')}/{path.rsplit('/', 1)[-1]}" if root else path


def active(sinks: Sequence[Sink], console: bool = True, files: bool = True) -> list[Sink]:
    """The enabled sinks, without console or file sinks where these are switched off."""
    return [s for s in sinks if s.enabled and (console or s.kind != "console") and (files or s.kind in ("console", "tcp", "udp", "syslog"))]


def fan_out(df: DataFrame, sinks: Sequence[Sink]) -> DataFrame:
    """A row for each record and sink that takes it, in one pass: column ``sink``."""
    taking = F.filter(F.array(*[F.when(s.takes.predicate(), F.lit(s.name)) for s in active(sinks)]), lambda x: x.isNotNull())
    return df.withColumn("sink", F.explode(taking))


#: What is between two records of a pretty JSON file; a record has no empty line.
BETWEEN = "\n\n"


def show(lines: DataFrame, most: int | None = None, out: TextIO | None = None) -> int:
    """Print the first column of every row, or of the first ``most``; how many. The driver holds one partition at a time."""
    out = out or sys.stdout
    n = 0
    for row in (lines if most is None else lines.limit(most)).toLocalIterator():
        out.write(f"{row[0]}\n")
        n += 1
    out.flush()
    return n


def _network_options(sink: Sink) -> dict[str, object]:
    return {"host": sink.host, "port": sink.port} | ({"stats": sink.stats} if sink.stats else {}) | ({"compression": sink.compression} if sink.compression else {})


def _parts(sink: Sink, root: str | None) -> tuple[str, dict[str, Column]]:
    """The folder of a file sink, and the columns by which it parts its records."""
    path = under_root(root, sink.path) if "{" not in sink.path else sink.path
    tags = list(dict.fromkeys(_TAG.findall(path)))
    return _TAG.sub("", path).rstrip("/"), {t if t in ("date", "time", "hour") else f"part_{re.sub('[^A-Za-z0-9]', '_', t)}": _tag(t) for t in tags}


def _shown(rows: DataFrame, sink: Sink, parts: dict[str, Column]) -> DataFrame:
    if sink.kind == "parquet":
        return rows.drop("rule_ids").withColumns(parts) if parts else rows.drop("rule_ids")
    return rows.select(sink.line(rows.columns).alias("value"), *[c.alias(n) for n, c in parts.items()])


def _file_options(sink: Sink) -> dict[str, object]:
    return ({"compression": sink.compression} if sink.compression else {}) | ({"maxRecordsPerFile": sink.most_records_per_file} if sink.most_records_per_file else {}) | ({"lineSep": BETWEEN} if sink.kind == "pretty_json" else {})


def write(df: DataFrame, sink: Sink, root: str | None = None) -> None:
    rows = df.where(sink.takes.predicate())
    if sink.kind == "console":
        show(rows.select(sink.line(df.columns).alias("value")), sink.most_shown)
        return
    if sink.kind in ("tcp", "udp"):
        from tidelog.sources.network import register

        register(df.sparkSession)
        rows.select(sink.line(df.columns).alias("value")).write.format(f"tidelog_{sink.kind}").options(**_network_options(sink)).mode("append").save()
        return
    path, parts = _parts(sink, root)
    out = _shown(rows, sink, parts).write.mode("overwrite" if sink.overwrite else "append").options(**_file_options(sink))
    out = out.partitionBy(*parts) if parts else out
    out.format("parquet" if sink.kind == "parquet" else "text").save(path)


def start(df: DataFrame, sink: Sink, checkpoint: str, preset: str = "balanced", root: str | None = None) -> StreamingQuery:
    """Write a stream to a sink; the running query. Files get each record once, network and console sinks at least once."""
    from tidelog.streaming.windows import PRESETS

    rows = df.where(sink.takes.predicate())
    if sink.kind == "console":
        lines = rows.select(sink.line(df.columns).alias("value"))
        out = lines.writeStream.foreachBatch(lambda batch, _: show(batch, sink.most_shown) and None)
    elif sink.kind in ("tcp", "udp"):
        from tidelog.sources.network import register

        register(df.sparkSession)
        out = rows.select(sink.line(df.columns).alias("value")).writeStream.format(f"tidelog_{sink.kind}").options(**_network_options(sink))
    else:
        path, parts = _parts(sink, root)
        out = _shown(rows, sink, parts).writeStream.format("parquet" if sink.kind == "parquet" else "text").options(**_file_options(sink)).option("path", path)
        out = out.partitionBy(*parts) if parts else out
    return out.option("checkpointLocation", checkpoint).trigger(**PRESETS[preset]["trigger"]).start()


def read_back(spark: SparkSession, sink: Sink, root: str | None = None) -> DataFrame:
    """What a file sink has written: for parquet its columns, else a row for each record, ``value``; with the columns of its folders."""
    path, parts = _parts(sink, root)
    if sink.kind == "parquet":
        return spark.read.parquet(path)
    lines = spark.read.text(path, lineSep=BETWEEN if sink.kind == "pretty_json" else None)
    return lines.select("value", *[F.col(n).cast("string").alias(n) for n in parts])


@contextmanager
def shared(df: DataFrame) -> Iterator[DataFrame]:
    """Computed once for several sinks; spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def write_all(df: DataFrame, sinks: Sequence[Sink], on_error: str = "log_and_continue", callback: Callable[[Sink, Exception], None] | None = None, root: str | None = None, console: bool = True, files: bool = True) -> dict[str, str | None]:
    """Write to every sink; the error of each, or None. ``on_error``: silent, log_and_continue, fail_fast or callback."""
    done: dict[str, str | None] = {}
    with shared(df) as rows:
        for sink in active(sinks, console, files):
            try:
                write(rows, sink, root)
                done[sink.name] = None
            except Exception as e:
                if on_error == "fail_fast":
                    raise
                if on_error == "log_and_continue":
                    logging.getLogger(__name__).warning("sink %s: %s", sink.name, e)
                elif on_error == "callback" and callback:
                    callback(sink, e)
                done[sink.name] = str(e)
    return done


class SinkSet:
    """The sinks of a logger, by place."""

    def __init__(self, sinks: Sequence[Sink] = ()):
        self.sinks = list(sinks)

    def add(self, sink: Sink) -> int:
        self.sinks.append(sink)
        return len(self.sinks) - 1

    def remove(self, at: int) -> None:
        del self.sinks[at]

    def remove_all(self) -> int:
        n = len(self.sinks)
        self.sinks.clear()
        return n

    def enable(self, at: int, enabled: bool = True) -> None:
        self.sinks[at] = replace(self.sinks[at], enabled=enabled)

    def __len__(self) -> int:
        return len(self.sinks)

    def __getitem__(self, at: int) -> Sink:
        return self.sinks[at]
