"""Network ingest on executors: a receiver for each port writes what comes in to a spool, and streams read the spool.

``Receivers`` runs one long task for each port in a Spark job of its own. A task binds its port, announces its address, and
writes records to segments: a segment is flushed after each turn of receiving, and closed (renamed, so that readers see it) when
it is ``roll_ms`` old or has ``roll_bytes``. When an executor is lost, Spark starts its task again elsewhere; it takes over the
segment that its predecessor left open. So what has been flushed is never lost, whatever dies; what the operating system hadn't
handed over is lost with its machine, as these protocols don't say what has arrived.

``stream`` reads the spool with Spark's own file source: the checkpoint knows which segments belong to which batch, so a query
that is killed and started again gives each record once, in as many tasks as there are segments. ``network_stats`` counts over
the same files. Receivers take a core each while they run. Ports are fixed, addresses are where the tasks happen to run: see ``addresses``.

Defined cases. A datagram is a record; a datagram without bytes is none. A TCP client's bytes are parted into lines (the rest when it
closes is a line), or with ``framing="chunks"`` given as they come, of 4096 bytes at most. Bytes that are no UTF-8 become U+FFFD. A
client that breaks off is an error, counted, and its rest is kept. A torn record at the end of an open segment is left out.
"""

from __future__ import annotations

import codecs
import json
import select
import socket
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import spool as files

SCHEMA = "port int, kind string, value string, peer string, received_ms long, bytes long"

#: Bytes of a TCP chunk, and the longest wait between looks at the stop mark.
CHUNK, LOOK_S = 4096, 0.1


@dataclass(frozen=True)
class Port:
    """``kind``: tcp or udp."""

    kind: str
    port: int
    host: str = "0.0.0.0"


class Segments:
    """One port's part of the spool."""

    def __init__(self, uri: str, port: int, roll_ms: int, roll_bytes: int):
        self.store, self.folder = files.opened(uri)
        self.port, self.roll_s, self.roll_bytes = port, roll_ms / 1000, roll_bytes
        self.store.create_dir(self.folder)
        known = files.names(self.store, self.folder)
        mine = f"{port}-"
        self.number = max([int(n.removeprefix(mine).split(".")[0]) for n in known if n.startswith(mine)], default=-1) + 1
        for name in known:
            if name.startswith(f".{mine}"):
                self._take_over(name)
        self.out, self.held, self.since = None, 0, 0.0

    def _take_over(self, name: str) -> None:
        """Close a segment that another task left open: its whole records."""
        body = files.get(self.store, f"{self.folder}/{name}")
        whole = body[: body.rfind(b"\n") + 1]
        if whole:
            files.put(self.store, f"{self.folder}/{self.port}-{self.number:012d}.json", whole)
            self.number += 1
        self.store.delete_file(f"{self.folder}/{name}")

    def add(self, kind: str, value: str | None, peer: str, size: int) -> None:
        if self.out is None:
            self.open = f"{self.folder}/.{self.port}-{self.number:012d}.open"
            self.out, self.held, self.since = self.store.open_output_stream(self.open), 0, time.monotonic()
        line = json.dumps({"port": self.port, "kind": kind, "value": value, "peer": peer, "received_ms": int(time.time() * 1000), "bytes": size}).encode() + b"\n"
        self.out.write(line)
        self.held += len(line)

    def turn(self, last: bool = False) -> None:
        """At the end of a turn of receiving: flush, and close the segment if it is due."""
        if self.out is None:
            return
        self.out.flush()
        if last or self.held >= self.roll_bytes or time.monotonic() - self.since >= self.roll_s:
            self.out.close()
            self.store.move(self.open, f"{self.folder}/{self.port}-{self.number:012d}.json")
            self.out, self.number = None, self.number + 1


class _Client:
    def __init__(self, peer: str, framing: str):
        self.peer, self.lines = peer, framing == "lines"
        self.decoder, self.rest = codecs.getincrementaldecoder("utf-8")("replace"), ""

    def take(self, data: bytes, ended: bool) -> list[str]:
        """The records that these bytes complete."""
        text = self.rest + self.decoder.decode(data, final=ended)
        if not self.lines:
            self.rest = ""
            return [text] if text else []
        *whole, self.rest = text.split("\n")
        if ended and self.rest:
            whole.append(self.rest)
            self.rest = ""
        return [w.removesuffix("\r") for w in whole]


def receive(port: Port, uri: str, framing: str = "lines", roll_ms: int = 500, roll_bytes: int = 8 << 20) -> int:
    """Receive until the spool has a stop mark; the number of records. Runs in a task."""
    segments = Segments(uri, port.port, roll_ms, roll_bytes)
    tcp = port.kind == "tcp"
    records = 0
    with socket.socket(socket.AF_INET, socket.SOCK_STREAM if tcp else socket.SOCK_DGRAM) as sock:
        sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        if not tcp:
            sock.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        sock.bind((port.host, port.port))
        sock.setblocking(False)
        if tcp:
            sock.listen(128)
        files.put(segments.store, f"{segments.folder}/_addresses/{port.port}", f"{_own_address()}:{port.port}".encode())
        clients: dict[socket.socket, _Client] = {}

        def end(s: socket.socket, error: str | None = None) -> None:
            nonlocal records
            c = clients.pop(s)
            for value in c.take(b"", True):
                segments.add("line", value, c.peer, 0)
                records += 1
            if error:
                segments.add("error", error, c.peer, 0)
            s.close()

        looked = 0.0
        while True:
            if time.monotonic() - looked >= LOOK_S:
                looked = time.monotonic()
                if files.exists(segments.store, f"{segments.folder}/_stop"):
                    break
            ready, _, _ = select.select([sock, *clients], [], [], LOOK_S)
            for s in ready:
                if s is sock and tcp:
                    client, address = sock.accept()
                    client.setblocking(False)
                    clients[client] = _Client(f"{address[0]}:{address[1]}", framing)
                    segments.add("connection", None, clients[client].peer, 0)
                elif s is sock:
                    for _ in range(1000):  # what has come in meanwhile
                        try:
                            data, address = sock.recvfrom(65_535)
                        except BlockingIOError:
                            break
                        if data:
                            segments.add("line", data.decode("utf-8", "replace"), f"{address[0]}:{address[1]}", len(data))
                            records += 1
                else:
                    try:
                        data = s.recv(CHUNK)
                    except BlockingIOError:
                        continue
                    except OSError as e:
                        end(s, str(e))
                        continue
                    if not data:
                        end(s)
                        continue
                    c = clients[s]
                    made = c.take(data, False)
                    for k, value in enumerate(made):  # a record's bytes are counted where they end
                        segments.add("line", value, c.peer, len(data) if k == 0 else 0)
                        records += 1
                    if not made:
                        segments.add("part", None, c.peer, len(data))
            segments.turn()
        for s in list(clients):
            end(s)
        segments.turn(last=True)
    return records


def _own_address() -> str:
    try:
        return socket.gethostbyname(socket.gethostname())
    except OSError:
        return "127.0.0.1"


class Receivers:
    """Receivers of several ports, as a Spark job: ``with Receivers(spark, spool, [Port("udp", 9000)]): ..``"""

    def __init__(self, spark: SparkSession, spool: str, ports: Sequence[Port], framing: str = "lines", roll_ms: int = 500, roll_bytes: int = 8 << 20):
        self.spark, self.spool, self.ports = spark, spool, list(ports)
        self.store, self.folder = files.opened(spool)
        self.options = (framing, roll_ms, roll_bytes)
        self.records: dict[int, int] = {}
        self.failed: Exception | None = None

    def start(self) -> Receivers:
        if self.spark.sparkContext.defaultParallelism <= len(self.ports):
            raise ValueError("each receiver takes a core, and there must be one left")
        self.store.create_dir(self.folder)
        if files.exists(self.store, f"{self.folder}/_stop"):
            self.store.delete_file(f"{self.folder}/_stop")
        for p in self.ports:
            if files.exists(self.store, f"{self.folder}/_addresses/{p.port}"):
                self.store.delete_file(f"{self.folder}/_addresses/{p.port}")
        ports, uri, options = self.ports, self.spool, self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    n = receive(ports[k], uri, *options)
                    yield pa.RecordBatch.from_pydict({"port": pa.array([ports[k].port], pa.int32()), "records": pa.array([n], pa.int64())})

        def go() -> None:
            try:
                tasks = self.spark.range(0, len(ports), 1, len(ports)).mapInArrow(run, "port int, records long")
                self.records = {r["port"]: r["records"] for r in tasks.collect()}  # a row for each port
            except Exception as e:
                self.failed = e

        self.thread = InheritableThread(target=go, daemon=True)
        self.thread.start()
        return self

    def addresses(self, wait_s: float = 60.0) -> dict[int, str]:
        """host:port by port, as soon as all receive."""
        end = time.monotonic() + wait_s
        while time.monotonic() < end and self.thread.is_alive():
            found = {p.port: f"{self.folder}/_addresses/{p.port}" for p in self.ports}
            if all(files.exists(self.store, path) for path in found.values()):
                return {port: files.get(self.store, path).decode() for port, path in found.items()}
            time.sleep(0.05)
        raise self.failed or TimeoutError("the receivers have not started")

    def stop(self) -> dict[int, int]:
        """End all receivers; records by port."""
        files.put(self.store, f"{self.folder}/_stop", b"")
        self.thread.join()
        if self.failed:
            raise self.failed
        return self.records

    def __enter__(self) -> Receivers:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()


def stream(spark: SparkSession, spool: str, preset: str = "balanced", clean: str = "off", archive: str | None = None) -> DataFrame:
    """The records of a spool as a stream: port, value, peer, received_ms. ``clean``: what becomes of segments when their batch is
    done - off, delete, or archive to the folder ``archive``."""
    from tidelog.streaming.windows import PRESETS

    store, folder = files.opened(spool)
    store.create_dir(folder)
    options = dict(PRESETS[preset]["batch"]) | {"cleanSource": clean} | ({"sourceArchiveDir": archive} if archive else {})
    return spark.readStream.schema(SCHEMA).options(**options).json(spool).where("kind = 'line'").select("port", "value", "peer", "received_ms")


def network_stats(spark: SparkSession, spool: str) -> DataFrame:
    """By port: messages_received, bytes_received, connections, errors; of what the spool holds."""
    kind = F.col("kind")
    return spark.read.schema(SCHEMA).json(spool).groupBy("port").agg(F.count_if(kind == "line").alias("messages_received"), F.sum("bytes").alias("bytes_received"), F.count_if(kind == "connection").alias("connections"), F.count_if(kind == "error").alias("errors"))
