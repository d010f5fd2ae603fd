"""TCP and UDP sources, as a Python data source with one reader per listening address.

Framing: ``line`` ends at LF and drops trailing CR, blanks and tabs; ``len`` is RFC 6587's
``<length> <payload>``; ``auto`` prefers a length where one stands and falls back to lines for
frames of no length or of ten megabytes and more.
"""

from __future__ import annotations

import re
import socket
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

LONGEST = 10_000_000
_LENGTH = re.compile(rb"([0-9]{1,8}) ")


def frames(buffer: bytes, framing: str = "auto", final: bool = False) -> tuple[list[bytes], bytes]:
    """(complete frames, what is left)."""
    out, at = [], 0
    while at < len(buffer):
        found = _LENGTH.match(buffer, at) if framing in ("auto", "len") else None
        if found and 0 < int(found[1]) < LONGEST:
            end = found.end() + int(found[1])
            if end > len(buffer):
                break
            out.append(buffer[found.end() : end])
            at = end
            while buffer[at : at + 1] == b"\n":
                at += 1
            continue
        if framing == "len" and not found:
            if len(buffer) - at < 9 and not final:
                break
        end = buffer.find(b"\n", at)
        if end < 0:
            if final and at < len(buffer):
                out.append(buffer[at:].rstrip(b"\r \t"))
                at = len(buffer)
            break
        line = buffer[at:end].rstrip(b"\r \t")
        if line:
            out.append(line)
        at = end + 1
    return out, buffer[at:]


class _Reader(SimpleDataSourceStreamReader):
    """Receives on the driver for ``wait_ms`` per batch; offsets count received events.

    The network does not replay: batches that were handed out are kept until they are committed.  While
    ``kept_bytes`` are held nothing more is received, so that TCP senders wait; UDP datagrams are lost.
    """

    def __init__(self, options: dict):
        self.framing = options.get("framing", "auto")
        self.wait = float(options.get("wait_ms", "200")) / 1000
        self.protocol = options.get("protocol", "tcp")
        self.address = (options.get("addr", "127.0.0.1"), int(options["port"]))
        self.most, self.held = int(options.get("kept_bytes", str(64 << 20))), 0
        self.kept: list[tuple[int, tuple]] = []
        self.next = 0
        self.sock, self.peers = None, {}

    def _listen(self):
        kind = socket.SOCK_DGRAM if self.protocol == "udp" else socket.SOCK_STREAM
        self.sock = socket.socket(socket.AF_INET, kind)
        self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.sock.bind(self.address)
        if kind == socket.SOCK_STREAM:
            self.sock.listen(64)
        self.sock.setblocking(False)

    def _receive(self) -> list[tuple[str, str]]:
        if self.sock is None:
            self._listen()
        out, until = [], time.monotonic() + self.wait
        taken = 0
        while time.monotonic() < until and self.held + taken < self.most:
            idle = True
            try:
                if self.protocol == "udp":
                    data, peer = self.sock.recvfrom(65_535)
                    taken += len(data)
                    out += [(line.decode("utf-8", "replace"), peer[0]) for line in frames(data, "line", final=True)[0]]
                    idle = False
                else:
                    peer, where = self.sock.accept()
                    peer.setblocking(False)
                    self.peers[peer] = (where[0], b"")
                    idle = False
            except BlockingIOError:
                pass
            for peer, (ip, rest) in list(self.peers.items()):
                try:
                    data = peer.recv(1 << 16)
                except BlockingIOError:
                    continue
                idle = False
                taken += len(data)
                found, rest = frames(rest + data, self.framing, final=not data)
                out += [(f.decode("utf-8", "replace"), ip) for f in found]
                if data:
                    self.peers[peer] = (ip, rest)
                else:
                    peer.close()
                    del self.peers[peer]
            if idle:
                time.sleep(0.005)
        return out

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        for row in self._receive():
            self.kept.append((self.next, row))
            self.held += len(row[0])
            self.next += 1
        self.next = max(self.next, start["n"])
        return iter([(i, *row) for i, row in self.kept if i >= start["n"]]), {"n": self.next}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(i, *row) for i, row in self.kept if start["n"] <= i < end["n"]])

    def commit(self, end: dict) -> None:
        self.kept = [x for x in self.kept if x[0] >= end["n"]]
        self.held = sum(len(row[0]) for _, row in self.kept)


class NetworkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltwork_network"

    def schema(self) -> str:
        return "event_id long, raw string, ups_ip string"

    def simpleStreamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def read_network(spark: SparkSession, port: int, *, addr: str = "127.0.0.1", protocol: str = "tcp", framing: str = "auto", kept_bytes: int = 64 << 20):
    spark.dataSource.register(NetworkSource)
    return spark.readStream.format("siltwork_network").options(addr=addr, port=str(port), protocol=protocol, framing=framing, kept_bytes=str(kept_bytes)).load()


def read_kafka(spark: SparkSession, brokers: str, topic: str, **options):
    """Needs Spark's Kafka package on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    for k, v in options.items():
        stream = stream.option(k, v)
    return stream.load().selectExpr("cast(value as string) as raw", "map('topic', topic) as tags")
