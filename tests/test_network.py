"""Receivers on executors, and what streams send: counts, restarts, lost tasks."""

from __future__ import annotations

import io
import json
import os
import signal
import socket
import subprocess
import sys
import threading
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog.operators import sinks
from tidelog.sources import receivers, spool
from tidelog.sources.network import sent_stats
from tidelog.sources.receivers import Port, Receivers, Segments, network_stats
from tidelog.streaming import windows

ROOT = Path(__file__).resolve().parent.parent


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def send_tcp(port, lines):
    with socket.create_connection(("127.0.0.1", port), timeout=10) as s:
        s.sendall("".join(f"{x}\n" for x in lines).encode())


def settled(spark, folder, n, wait=40):
    end = time.monotonic() + wait
    while time.monotonic() < end:
        got = spark.read.schema(receivers.SCHEMA).json(folder).where("kind = 'line'").count()
        if got >= n:
            break
        time.sleep(0.2)
    assert got == n


def drained(spark, folder, base):
    """One batch of what is there, then a kill: the query is stopped, with its checkpoint left."""
    rows = receivers.stream(spark, folder, "drain")
    windows.start(rows, f"{base}/out", f"{base}/check", "drain").awaitTermination()


def test_no_line_is_lost_between_kills(spark, tmp_path):
    """A query is killed between batches, and within one before it is committed; the receivers go on meanwhile."""
    folder, base = f"file://{tmp_path}/spool", f"file://{tmp_path}"
    tcp, udp = free_port(socket.SOCK_STREAM), free_port(socket.SOCK_DGRAM)
    running = Receivers(spark, folder, [Port("tcp", tcp), Port("udp", udp)], roll_ms=100).start()
    try:
        assert set(running.addresses()) == {tcp, udp}
        send_tcp(tcp, [f"a{k}é" for k in range(500)])
        settled(spark, folder, 500)
        drained(spark, folder, base)
        send_tcp(tcp, [f"b{k}" for k in range(500)])  # while no query runs
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for k in range(50):
                s.sendto(f"u{k}\nsecond".encode(), ("127.0.0.1", udp))
                time.sleep(0.001)
        settled(spark, folder, 1050)
        drained(spark, folder, base)
        last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()  # as if it had been killed before the commit: the batch comes again, and its files count once
        (tmp_path / "check" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
        send_tcp(tcp, ["c"])
        settled(spark, folder, 1051)
        drained(spark, folder, base)
    finally:
        counted = running.stop()
    want = sorted([f"a{k}é" for k in range(500)] + [f"b{k}" for k in range(500)] + [f"u{k}\nsecond" for k in range(50)] + ["c"])
    assert sorted(r.value for r in spark.read.parquet(f"{base}/out").collect()) == want
    assert counted == {tcp: 1001, udp: 50}
    stats = {r.port: r for r in network_stats(spark, folder).collect()}
    assert (stats[tcp].messages_received, stats[tcp].connections, stats[tcp].errors) == (1001, 3, 0)
    assert stats[tcp].bytes_received == sum(len(f"{x}\n".encode()) for x in want if x[0] != "u")
    assert (stats[udp].messages_received, stats[udp].bytes_received) == (50, sum(len(f"u{k}\nsecond") for k in range(50)))


def test_a_lost_receiver_leaves_its_segment(tmp_path):
    """A receiver is killed with a segment open; the next one on that port takes it over, without a torn record."""
    port = free_port(socket.SOCK_STREAM)
    code = f"from tidelog.sources.receivers import *; receive(Port('tcp', {port}), 'file://{tmp_path}/spool', roll_ms=10**9)"
    child = subprocess.Popen([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)})
    for _ in range(300):
        try:
            send_tcp(port, [f"x{k}" for k in range(300)])
            break
        except OSError:
            time.sleep(0.1)
    open_ = tmp_path / "spool" / f".{port}-000000000000.open"
    for _ in range(200):
        if open_.exists() and open_.read_bytes().count(b'"line"') == 300:
            break
        time.sleep(0.1)
    os.kill(child.pid, signal.SIGKILL)
    child.wait()
    with open_.open("ab") as f:
        f.write(b'{"port": 1, "kind": "li')
    Segments(f"file://{tmp_path}/spool", port, 100, 100)
    assert not open_.exists()
    (whole,) = (tmp_path / "spool").glob(f"{port}-*.json")
    rows = [json.loads(x) for x in whole.read_bytes().splitlines()]
    assert [r["value"] for r in rows if r["kind"] == "line"] == [f"x{k}" for k in range(300)]
    assert Segments(f"file://{tmp_path}/spool", port, 100, 100).number == 1


@pytest.mark.parametrize("framing", ["lines", "chunks"])
def test_framing(framing):
    c = receivers._Client("p", framing)
    text = "é漢\r\n\nlast"
    made = [x for k in range(len(text.encode())) for x in c.take(text.encode()[k : k + 1], False)] + c.take(b"", True)
    assert made == ["é漢", "", "last"] if framing == "lines" else "".join(made) == text


def test_receivers_that_cannot_start(spark, tmp_path):
    with socket.create_server(("127.0.0.1", 0)) as taken:
        running = Receivers(spark, f"file://{tmp_path}/spool", [Port("tcp", taken.getsockname()[1], "127.0.0.1")]).start()
        with pytest.raises(Exception):  # noqa: B017
            running.addresses()
        with pytest.raises(Exception):  # noqa: B017
            running.stop()


class Server:
    """Takes TCP clients and keeps what each sent; hangs up on the first after ``rude`` bytes."""

    def __init__(self, rude=0):
        self.sock = socket.create_server(("127.0.0.1", 0))
        self.port, self.rude, self.got = self.sock.getsockname()[1], rude, []
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self):
        while True:
            try:
                client, _ = self.sock.accept()
            except OSError:
                return
            self.got.append(bytearray())
            threading.Thread(target=self._read, args=(client, self.got[-1]), daemon=True).start()

    def _read(self, client, into):
        with client:
            while data := client.recv(65_536):
                into.extend(data)

    def lines(self, n, wait=30):
        end = time.monotonic() + wait
        while sum(g.count(b"\n") for g in self.got) < n and time.monotonic() < end:
            time.sleep(0.05)
        return sorted(x for g in self.got for x in g.decode().splitlines())


def events_stream(spark):
    from tidelog.sources import adapters

    return adapters.events(windows.read_stream(spark, "/root/testdata/sf0.001/events.parquet")), adapters.events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))


def test_stream_to_tcp_is_counted(spark, tmp_path):
    server = Server()
    rows, batch = events_stream(spark)
    sink = sinks.Sink("net", "tcp", port=server.port, stats=f"file://{tmp_path}/stats")
    sinks.start(rows, sink, f"file://{tmp_path}/check", "drain").awaitTermination()
    want = sorted(r.value for r in batch.select(sink.line(batch.columns).alias("value")).collect())
    assert server.lines(len(want)) == want
    stats = sent_stats(spark, f"file://{tmp_path}/stats")
    got = stats.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors"), F.sum("connections").alias("connections")).first()
    assert (got.lines, got.bytes, got.errors) == (len(want), sum(map(len, server.got)), 0) and got.connections == len(server.got)
    sinks.write(batch, sink)  # a batch is counted, too
    assert stats.sparkSession.read.json(f"{tmp_path}/stats").where("batch LIKE 'write-%'").first().lines == len(want)


def test_broken_connections_and_compression():
    from tidelog.sources.network import _Socket

    server = Server()
    out = _Socket({"host": "127.0.0.1", "port": str(server.port), "buffer_bytes": "10"}, socket.SOCK_STREAM)
    out.line("one two three")
    out.sock.shutdown(socket.SHUT_WR)  # as when the connection broke
    out.line("four five six")
    out.close()
    assert server.lines(2) == ["four five six", "one two three"]
    assert (out.sent.lines, out.sent.errors, out.sent.connections, out.sent.bytes) == (2, 1, 2, 28)
    packed = _Socket({"host": "127.0.0.1", "port": str(server.port), "compression": "deflate"}, socket.SOCK_STREAM)
    for k in range(100):
        packed.line(f"line {k}")
    packed.flush()
    packed.close()
    for _ in range(100):
        if len(server.got) == 3 and len(server.got[2]) == packed.sent.bytes:
            break
        time.sleep(0.05)
    assert zlib.decompress(bytes(server.got[2]), wbits=-15).decode().splitlines() == [f"line {k}" for k in range(100)]


def test_stream_to_udp(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        rows, batch = events_stream(spark)
        errors = sinks.SinkFilter(level="ERROR")
        sink = sinks.Sink("net", "udp", port=s.getsockname()[1], stats=f"{tmp_path}/stats", takes=errors)
        sinks.start(rows, sink, f"file://{tmp_path}/check", "drain").awaitTermination()
        n = sum(r["lines"] for r in sent_stats(spark, f"file://{tmp_path}/stats").collect())
        assert n == batch.where("priority >= 40").count()
        assert len([s.recv(65_535) for _ in range(n)]) == n


def test_console_shows_every_record(spark, capsys, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.lit(20).alias("priority"), F.lit("INFO").alias("level"), F.lit("m").alias("module"), F.concat(F.lit("x" * 60), F.col("id")).alias("message"))
    sinks.write(rows, sinks.Sink("c", "console"))
    assert capsys.readouterr().out.count("\n") == 100
    sinks.write(rows, sinks.Sink("c", "console", most_shown=7))
    assert capsys.readouterr().out.count("\n") == 7
    out = io.StringIO()
    assert sinks.show(rows.select("message"), out=out) == 100 and sorted(out.getvalue().split()) == sorted("x" * 60 + str(k) for k in range(100))
    stream, batch = events_stream(spark)
    sinks.start(stream, sinks.Sink("c", "console"), f"file://{tmp_path}/check", "drain").awaitTermination()
    assert capsys.readouterr().out.count("\n") == batch.count()


def test_streams_to_files(spark, tmp_path):
    rows, batch = events_stream(spark)
    for kind in ("text", "json", "pretty_json", "raw", "parquet"):
        sink = sinks.Sink(kind, kind, f"{tmp_path}/{kind}/{{date}}")
        sinks.start(rows, sink, f"file://{tmp_path}/check-{kind}", "drain").awaitTermination()
        back = sinks.read_back(spark, sink)
        assert back.count() == batch.count()
        assert back.select("date").distinct().count() == batch.select(F.to_date("ts")).distinct().count()


def test_messages_that_a_simple_source_has_lost():
    from tidelog.sources.network import _SocketReader

    again = _SocketReader({"port": "1"}, socket.SOCK_DGRAM)
    with pytest.raises(RuntimeError, match="3 messages"):
        again.readBetweenOffsets({"n": 0}, {"n": 3})
    assert list(_SocketReader({"port": "1", "failOnDataLoss": "false"}, socket.SOCK_DGRAM).readBetweenOffsets({"n": 0}, {"n": 3})) == []


def test_spool_files(tmp_path):
    store, folder = spool.opened(str(tmp_path))
    assert spool.names(store, f"{folder}/none") == [] and not spool.exists(store, f"{folder}/none/x")
    spool.put(store, f"{folder}/a/x", b"1")
    spool.put(store, f"{folder}/a/x", b"2")
    assert spool.get(store, f"{folder}/a/x") == b"2" and spool.names(store, f"{folder}/a") == ["x"]
