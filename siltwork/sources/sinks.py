"""Sinks: text formats, files, and network writers."""

from __future__ import annotations

import socket
import struct
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.types import Field, as_text, kind_of


def _cells(df: DataFrame) -> list[tuple[str, str, Column]]:
    return [(f.name, kind_of(f.dataType), as_text(Field(F.col(f"`{f.name}`"), kind_of(f.dataType)))) for f in df.schema.fields]


def formatted(df: DataFrame, fmt: str = "json") -> DataFrame:
    """One column ``value``: json, csv, kv, show, raw or proto-text of each record; absent fields are left out (csv: empty)."""
    cells = _cells(df)
    if fmt == "json":
        return df.select(F.to_json(F.struct("*")).alias("value"))
    if fmt == "csv":
        quoted = [F.coalesce(F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit("")) for _, _, c in cells]
        return df.select(F.concat_ws(",", *quoted).alias("value"))
    if fmt == "kv":
        pairs = [F.concat(F.lit(f"{n}: "), F.when(F.lit(k in ("digit", "float", "bool")), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')))) for n, k, c in cells]
        return df.select(F.concat_ws(", ", *pairs).alias("value"))
    if fmt == "show":
        return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{n}({k}) = "), c) for n, k, c in cells]).alias("value"))
    if fmt == "raw":
        return df.select(F.concat_ws(" ", *[c for _, _, c in cells]).alias("value"))
    if fmt == "proto-text":
        pairs = [F.concat(F.lit(f"{n}: "), F.when(F.lit(k in ("digit", "float", "bool")), c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))) for n, k, c in cells]
        return df.select(F.concat_ws(" ", *pairs).alias("value"))
    raise ValueError(f"no such format: {fmt}")


def write_file(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    formatted(df, fmt).write.mode(mode).text(path)


def blackhole(df: DataFrame, sleep_ms: int = 0) -> None:
    df.write.format("noop").mode("append").save()
    time.sleep(sleep_ms / 1000)


def write_arrow_files(df: DataFrame, folder: str) -> DataFrame:
    """One Arrow IPC stream file per task in a shared folder: ``[4-byte big-endian length][IPC]`` per batch; gives (file, rows)."""
    import pyarrow as pa

    def run(batches):
        import uuid

        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        name, rows = f"{base}/part-{uuid.uuid4().hex}.arrow", 0
        with filesystem.open_output_stream(name) as out:
            for batch in batches:
                payload = arrow_frame(batch)
                out.write(payload)
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "rows"])

    return df.mapInArrow(run, "file string, rows long")


def read_arrow_files(spark, folder: str, schema: str) -> DataFrame:
    """Records of the Arrow files in a folder; each file is read by one task."""

    def run(batches):
        for whole in batches:
            for content in whole.column(0):
                yield from read_arrow_frames(content.as_buffer())

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("content").mapInArrow(run, schema)


def write_arrow_network(df: DataFrame, host: str, port: int, *, first_wait: float = 1.0, last_wait: float = 30.0) -> DataFrame:
    """Send record batches over TCP as ``[4-byte big-endian length][IPC]``; gives rows (sent, dropped) per task.

    Nothing waits for a receiver: batches are dropped while there is no connection, and a new one is
    tried after doubling waits.
    """
    import pyarrow as pa

    def run(batches):
        connection, wait, after = None, first_wait, 0.0
        sent = dropped = 0
        for batch in batches:
            if connection is None and time.monotonic() >= after:
                try:
                    connection = socket.create_connection((host, port), timeout=10)
                    wait = first_wait
                except OSError:
                    after, wait = time.monotonic() + wait, min(last_wait, wait * 2)
            try:
                if connection is None:
                    raise ConnectionError
                connection.sendall(arrow_frame(batch))
                sent += batch.num_rows
            except OSError:
                connection = None
                dropped += batch.num_rows
        if connection is not None:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64()), pa.array([dropped], pa.int64())], names=["sent", "dropped"])

    return df.mapInArrow(run, "sent long, dropped long")


def arrow_frame(batch) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    data = out.getvalue().to_pybytes()
    return struct.pack(">I", len(data)) + data


def read_arrow_frames(data: bytes):
    import pyarrow as pa

    at = 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield from pa.ipc.open_stream(data[at + 4 : at + 4 + size])
        at += 4 + size


def network_writer(host: str, port: int, *, protocol: str = "tcp", framing: str = "line", attempts: int = 6):
    """A function for foreachPartition over rows with ``value``; reconnects with doubled waits of 1 to 30 s."""

    def send(rows):
        connection, wait = None, 1.0
        for row in rows:
            data = row.value.encode()
            payload = data if protocol == "udp" else f"{len(data)} ".encode() + data if framing == "len" else data + b"\n"
            for attempt in range(attempts):
                try:
                    if connection is None:
                        kind = socket.SOCK_DGRAM if protocol == "udp" else socket.SOCK_STREAM
                        connection = socket.socket(socket.AF_INET, kind)
                        connection.connect((host, port))
                    connection.sendall(payload)
                    wait = 1.0
                    break
                except OSError:
                    connection = None
                    if attempt == attempts - 1:
                        raise
                    time.sleep(wait)
                    wait = min(30.0, wait * 2)
        if connection is not None:
            connection.close()

    return send


def write_network(df: DataFrame, host: str, port: int, fmt: str = "json", **options) -> None:
    formatted(df, fmt).foreachPartition(network_writer(host, port, **options))


def syslog_lines(df: DataFrame, fmt: str = "json", *, facility: int = 1, severity: int = 6, host: str = "siltwork", app: str = "siltwork") -> DataFrame:
    """RFC 3164 lines of records, for a network writer."""
    head = F.concat(F.lit(f"<{facility * 8 + severity}>"), F.date_format(F.localtimestamp(), "MMM d HH:mm:ss"), F.lit(f" {host} {app}: "))
    return formatted(df, fmt).select(F.concat(head, "value").alias("value"))
