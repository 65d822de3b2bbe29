"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Each writing task streams its rows into archives. An archive starts with a skippable frame that
holds the dictionary (magic 0x184D2A5D, the length, the dictionary), then one Zstandard frame per
record, each compressed alone with that dictionary, so any record can be read by itself. The
dictionary is trained on the archive's first records (`SAMPLE_BYTES` of them are held in memory);
where they are too few to train on, the archive has an empty dictionary frame and its frames use
none. A new archive starts after `ARCHIVE_BYTES` of records.

Records with equal payloads: the one with the smallest page_id is a `response`, the others are
`revisit` records that carry the digest and name the record they repeat. Digests are counted with
a map-side combine; the rows of a payload that many pages share are spread (see `common.lookup`).

Archives go to the shared folder through pyarrow's file systems (file, hdfs, s3, gs). Their names
hold the partition and the attempt, and the manifest comes from the rows of the tasks that ended
well, so archives of a lost or repeated task are never read.

Edge cases: null html is an empty payload; a null url leaves out the target header, control
characters and spaces in one are percent-encoded; a null page_id is kept and never a first record
unless all copies have none; rows that repeat the smallest page_id and payload are all responses; an empty
table gives no archive; records of any length are held one at a time; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import lookup, saved
from settlekit.session import checkpoint_dir

#: Fixed values of the format: the dictionary frame's magic, and the profile of a repeated payload.
DICTIONARY_MAGIC = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the UUID namespace of URLs


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_id(first)}"]
        head += [f"Refers-To-Page-ID: {first}"] if first is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The row of a record; a response's digest is taken anew from its payload and compared."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload has changed")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("Page-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("Refers-To-Page-ID"))


def _open(folder: str):
    """A pyarrow file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Archive:
    """Writes one archive; the first records wait until there are enough to train on."""

    def __init__(self, system, path: str) -> None:
        self.system, self.path, self.waiting, self.held = system, path, [], 0
        self.out = self.packer = None
        self.records = self.bytes = self.written = 0

    def add(self, data: bytes) -> None:
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.packer:
            self._put(self.packer.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, level=LEVEL)
        except zstandard.ZstdError:  # too few or too small records to train on
            trained = None
        raw = trained.as_bytes() if trained else b""
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        self.out = self.system.open_output_stream(self.path, compression=None)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        for data in self.waiting:
            self._put(self.packer.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if not self.packer:
            self._start()
        self.out.close()
        return self.path, self.records, self.written


def read_archive(system, path: str) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    import zstandard

    with system.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} does not start with a dictionary frame")
        raw = source.read(size)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        frame, parts, data = reader.decompressobj(), [], source.read(1 << 20)
        while data:
            parts.append(frame.decompress(data))
            if frame.eof:
                yield b"".join(parts)
                data = frame.unused_data or source.read(1 << 20)
                frame, parts = reader.decompressobj(), []
            else:
                data = source.read(1 << 20)
        if parts:
            raise ValueError(f"{path} ends inside a record")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha1, first) of each row that repeats a payload of a smaller page_id."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digests = saved(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
        .filter(F.col("size") >= least_bytes)
        .drop("size")
    )
    groups = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lookup(digests, groups, "sha1", digests.count())
    return found.filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of `pages` (page_id, url, html) in `folder`; returns the manifest, which is saved:
    calling an action on it does not write again."""
    known = revisits(pages, least_bytes).select(
        F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first", F.lit(True).alias("revisit")
    )
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1")
    )
    rows = rows.join(
        known, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left"
    ).select("page_id", "url", "payload", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        context, done, archive = TaskContext.get(), [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if archive is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.zst"
                        archive = Archive(system, f"{base}/{name}")
                    archive.add(record(row["page_id"], row["url"], row["payload"], row["first"], bool(row["revisit"])))
                    if archive.bytes >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            kinds = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)

    return saved(rows.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The rows of all records of the archives that `manifest` lists."""
    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for data in read_archive(system, path):
                    rows.append(parse(data))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return manifest.select("path").mapInArrow(run, RECORDS)


def new_folder(pages: DataFrame) -> str:
    """A folder for archives under the cluster's shared folder."""
    return f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
