"""WARC archives with an embedded Zstandard dictionary, one frame per record.

Layout of a file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then each record
as its own Zstandard frame made with it, so a reader may seek to any record.  A task writes its
partition's records: the first megabytes train the dictionary (raw content where there is too
little to train on, no dictionary where there is none), then all records, the first ones included,
are compressed.  A file appears under its final name only when it is whole, and its name is told in
a manifest table, so files of lost or repeated attempts are never read.

Duplicates: SHA-1 digests are grouped with partial aggregation; the groups, one row per repeated
payload, are joined back under Spark's own skew handling.  The record with the largest page_id is
the response, others revisit it.

Defined cases: null html is an empty payload; a null page_id sorts below all others (a group of
nulls only has responses only); rows that repeat the largest page_id of a group are all responses;
null or odd urls are percent-encoded; an empty table writes no file and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, record, scratch_path

MAGIC = 0x184D2A5D
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string"
_LONGEST_RUN = 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    from urllib.parse import quote

    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of one response or revisit record; a revisit has the HTTP head only."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Has-URI: {int(url is not None)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, and for responses the payload, checked against the digest in the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"payload of page {fields['X-Page-ID']} does not match its digest")
    from urllib.parse import unquote

    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None,
        "url": unquote(fields["WARC-Target-URI"]) if fields["X-Has-URI"] == "1" else None,
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None,
        "payload": payload,
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, the raw end of the samples where training has too little, or nothing."""
    import zstandard

    total = sum(map(len, samples))
    if total == 0:
        return b""
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def dictionary_of(data: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


class ArchiveWriter:
    """Writes records to a binary stream; the dictionary is fixed once enough of them have come."""

    def __init__(self, out, dict_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3):
        self.out, self.dict_bytes, self.sample_bytes, self.level = out, dict_bytes, sample_bytes, level
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.compressor = None
        self.written = 0

    def write(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= self.sample_bytes:
                self._begin()
        else:
            self._frame(data)

    def _frame(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.written += len(frame)

    def _begin(self) -> None:
        import zstandard

        trained = train_dictionary([s[: 64 << 10] for s in self.held], self.dict_bytes)
        self.out.write(struct.pack("<II", MAGIC, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary_of(trained) if trained else None, write_content_size=True)
        for data in self.held:
            self._frame(data)
        self.held = []

    def finish(self) -> None:
        if self.compressor is None:
            self._begin()


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other; memory is one record and one chunk."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    trained = stream.read(size)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary_of(trained) if trained else None)
    rest = b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _open_folder(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame, scratch: Scratch, *, min_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, payload, payload_digest (hex), refers_to."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = base.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    joined = base.join(scratch.save("repeated", repeated), "digest", "left")
    other = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30, dict_bytes: int = 32 << 10) -> DataFrame:
    """Write archives from every partition; the manifest (archive, records, bytes) as a lazy DataFrame.

    Evaluate it once and keep it: only the files it names are complete.
    """
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, base = _open_folder(folder)
        filesystem.create_dir(base, recursive=True)
        task = TaskContext.get()
        now = None

        def start():
            name = f"{base}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
            stream = filesystem.open_output_stream(name + ".open", compression=None)
            return {"name": name, "stream": stream, "writer": ArchiveWriter(stream, dict_bytes), "n": 0}

        def finish(a):
            a["writer"].finish()
            a["stream"].close()
            filesystem.move(a["name"] + ".open", a["name"])
            return record(schema, {"archive": [a["name"].rsplit("/", 1)[1]], "records": [a["n"]], "bytes": [a["writer"].written]})

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5))):
                now = now or start()
                payload = payload.as_py()
                now["writer"].write(build_record(page_id.as_py(), url.as_py(), payload, base64.b32encode(digest.as_py()).decode(), refers.as_py(), date))
                now["n"] += 1
                if now["writer"].written >= archive_bytes:
                    done, now = now, None
                    yield finish(done)
        if now:
            yield finish(now)

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives, digests checked; streams, holding one record at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in read_archive(stream):
                        row = parse_record(data) | {"archive": name}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size >= _LONGEST_RUN:
                            yield record(schema, {k: [r[k] for r in rows] for k in schema.names})
                            rows, size = [], 0
                if rows:
                    yield record(schema, {k: [r[k] for r in rows] for k in schema.names})

    names = manifest.select("archive")
    return names.repartition(max(1, manifest.count()), "archive").mapInArrow(run, READ_SCHEMA)


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages to archives in the shared folder, then read the archives back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or scratch_path(spark, "warc-archives")
    manifest = scratch.save("manifest", write_archives(classify(pages, scratch, min_bytes=min_bytes), folder))
    return read_archives(manifest, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive")
