"""Network sources and sinks as Spark data sources in Python: UDP and TCP ingest, HTTP JSON, TCP and UDP writers for batches and streams.

Register with ``register(spark)``; then ``spark.readStream.format("tidelog_udp").option("port", 9000).load()``.
"""

from __future__ import annotations

import codecs
import gzip
import json
import select
import socket
import time
import urllib.request
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

from tidelog.sources import spool as files


class _SocketReader(SimpleDataSourceStreamReader):
    """Receives on the driver, for sources of a moderate rate; a table or queue that executors read scales further. A batch
    ends ``wait_ms`` after it began, or with ``max_bytes``, however steady the traffic is; all clients get their turn. Batches
    are kept until they are committed, so a batch that is asked for again is the same. They are kept in memory: a query that is
    started again can't have them, and fails unless ``failOnDataLoss`` is false. ``receivers`` keep them in files, on executors."""

    def __init__(self, options: dict[str, str], kind: int):
        self.kind = kind
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])
        self.wait = int(options.get("wait_ms", "200")) / 1000
        self.most = int(options.get("max_bytes", str(8 << 20)))
        self.sock: socket.socket | None = None
        self.clients: dict[socket.socket, codecs.IncrementalDecoder] = {}
        self.kept: dict[int, str] = {}
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _open(self) -> socket.socket:
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, self.kind)
            self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.sock.bind((self.host, self.port))
            self.sock.setblocking(False)
            if self.kind == socket.SOCK_STREAM:
                self.sock.listen()
        return self.sock

    def _receive(self) -> list[str]:
        sock, out, held = self._open(), [], 0
        end = time.monotonic() + self.wait
        while held < self.most and (left := end - time.monotonic()) > 0:
            ready, _, _ = select.select([sock, *self.clients], [], [], left)
            for s in ready:
                if s is sock and self.kind == socket.SOCK_STREAM:
                    client, _ = sock.accept()
                    client.setblocking(False)
                    self.clients[client] = codecs.getincrementaldecoder("utf-8")("replace")
                    continue
                try:
                    data = s.recv(65_535 if s is sock else 4096)
                except (BlockingIOError, ConnectionResetError):
                    continue
                if s is sock:
                    text = data.decode("utf-8", "replace")
                else:  # a character may go on in the next chunk
                    text = self.clients[s].decode(data, final=not data)
                    if not data:
                        del self.clients[s]
                        s.close()
                        if not text:
                            continue
                held += len(data)
                if text or s is sock:
                    out.append(text)
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        got = self._receive()
        self.kept.update((n + k, m) for k, m in enumerate(got))
        return iter([(m,) for m in got]), {"n": n + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        lost = sum(k not in self.kept for k in range(start["n"], end["n"]))
        if lost and self.strict:
            raise RuntimeError(f"{lost} messages of a batch are gone, as the query was started again; set failOnDataLoss to false to go on without them")
        return iter([(self.kept[k],) for k in range(start["n"], end["n"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {k: m for k, m in self.kept.items() if k >= end["n"]}


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent."""

    lines: int = 0
    bytes: int = 0
    errors: int = 0
    connections: int = 0


class _Socket:
    """Sends lines. TCP lines are gathered up to ``buffer_bytes``; a connection that breaks is opened once more for the same buffer. A UDP
    line is a datagram. ``compression=deflate`` sends each buffer or datagram as a raw deflate stream of its own."""

    def __init__(self, options: dict[str, str], kind: int):
        self.kind, self.address = kind, (options.get("host", "127.0.0.1"), int(options["port"]))
        self.buffer = int(options.get("buffer_bytes", str(64 << 10))) if kind == socket.SOCK_STREAM else 0
        self.packed = options.get("compression", "none") == "deflate"
        self.sent = Sent()
        self.sock: socket.socket | None = None
        self.held: list[bytes] = []
        self.size = 0

    def _connect(self) -> None:
        self.close()
        self.sock = socket.socket(socket.AF_INET, self.kind)
        self.sock.connect(self.address)
        self.sent.connections += 1

    def _send(self, data: bytes, lines: int) -> None:
        if self.packed:
            deflate = zlib.compressobj(wbits=-15)
            data = deflate.compress(data) + deflate.flush()
        if self.sock is None:
            self._connect()
        try:
            self.sock.sendall(data)
        except OSError:
            self.sent.errors += 1
            self._connect()
            self.sock.sendall(data)
        self.sent.lines += lines
        self.sent.bytes += len(data)

    def line(self, text: object) -> None:
        line = (str(text) + "\n").encode()
        self.held.append(line)
        self.size += len(line)
        if self.size >= self.buffer:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._send(b"".join(self.held), len(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        if self.sock is not None:
            self.sock.close()
            self.sock = None


#: A batch's counts, as ``stats`` files hold them.
SENT_SCHEMA = "batch string, lines long, bytes long, errors long, connections long, tasks int"


class _SocketWriter(DataSourceWriter, DataSourceStreamWriter):
    """Each task sends its rows' first column. A task that runs again sends again: at least once, and counted as often as it ended well.

    With the option ``stats``, a folder, each batch's counts are written there when all its tasks have ended; a batch that is
    committed again overwrites its own.
    """

    def __init__(self, options: dict[str, str], kind: int):
        self.options, self.kind = dict(options), kind

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        out = _Socket(self.options, self.kind)
        for row in iterator:
            out.line(row[0])
        out.flush()
        out.close()
        return out.sent

    def commit(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803
        where = self.options.get("stats")
        if not where:
            return
        done = [m for m in messages if m is not None]
        name = f"write-{uuid.uuid4().hex}" if batchId is None else f"batch-{batchId:012d}"
        total = {n: sum(getattr(m, n) for m in done) for n in ("lines", "bytes", "errors", "connections")}
        store, folder = files.opened(where)
        files.put(store, f"{folder}/{name}.json", json.dumps({"batch": name, **total, "tasks": len(done)}).encode() + b"\n")

    def abort(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803
        pass


def sent_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each batch that was sent with the option ``stats``: lines, bytes, errors, connections, tasks."""
    return spark.read.schema(SENT_SCHEMA).json(folder)


class UdpSource(DataSource):
    """One datagram is one message."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_udp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema):
        return _SocketReader(self.options, socket.SOCK_DGRAM)

    def writer(self, schema, overwrite):
        return _SocketWriter(self.options, socket.SOCK_DGRAM)

    def streamWriter(self, schema, overwrite):
        return _SocketWriter(self.options, socket.SOCK_DGRAM)


class TcpSource(DataSource):
    """Chunks as they come, of 4096 bytes at most, from any number of clients."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_tcp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema):
        return _SocketReader(self.options, socket.SOCK_STREAM)

    def writer(self, schema, overwrite):
        return _SocketWriter(self.options, socket.SOCK_STREAM)

    def streamWriter(self, schema, overwrite):
        return _SocketWriter(self.options, socket.SOCK_STREAM)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.headers = {k[len("header.") :]: v for k, v in options.items() if k.startswith("header.")}

    def read(self, partition) -> Iterator[tuple]:
        request = urllib.request.Request(self.url, headers={"Accept-Encoding": "gzip, deflate"} | self.headers)
        with urllib.request.urlopen(request, timeout=30) as answer:
            body, coding = answer.read(), (answer.headers.get("Content-Encoding") or "").lower()
        if coding == "gzip":
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
        elif coding == "zstd":
            import zstandard

            body = zstandard.ZstdDecompressor().stream_reader(body).read()
        found = json.loads(body)
        for x in found if isinstance(found, list) else [found]:
            yield (json.dumps(x),)


class HttpJsonSource(DataSource):
    """A row for the document, or for each element of an array."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_http"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _HttpReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (UdpSource, TcpSource, HttpJsonSource):
        spark.dataSource.register(source)
