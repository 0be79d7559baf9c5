"""WARC archives packaged in ZIP files: a writer, and a reader that never extracts.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz`` (each record a gzip
member of its own) and ``indexes/index.cdxj`` (each record's place in it).  The reader works on
byte ranges alone: it finds the end-of-directory record (and its ZIP64 form) in the file's
tail, parses the central directory, locates the stored members behind their local headers,
reads the index, and then reads records in runs of at most ``RUN_BYTES``.  Runs are rows of a
DataFrame, so many tasks can read one archive.

Files are written through ``pyarrow.fs``, so the folder may be in any store that it knows.  A
task writes under names of its own and returns what it wrote; the table of returned names is
what counts, and what a lost executor left behind is never read.  A new archive is begun
after ``ARCHIVE_BYTES`` or ``ARCHIVE_RECORDS``, which bounds an index's size.

Defined cases: a null payload is an empty one.  Of records with equal payloads (of at least
``least_bytes``), those with the smallest page_id are responses and the others revisits of it,
without a payload; rows that repeat the smallest page_id are responses too.  Null page_ids come
after all others, and are responses only if their payload has no other.  A null url is written
as an empty target.  Empty tables write no archives.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import Scratch

ARCHIVE_BYTES, ARCHIVE_RECORDS, RUN_BYTES = 64 << 20, 50_000, 1 << 20
#: Bytes of archives for each reading task.
TASK_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TAIL = 22 + 20 + 65_535  # end-of-directory record, ZIP64 locator, longest comment

RECORD_SCHEMA = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


# Records


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: str | None, url: str, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """A record as one gzip member; a revisit has its HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join(url.splitlines())), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-ID", json.dumps(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", json.dumps(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse_record(raw: bytes) -> tuple:
    """One row of ``RECORD_SCHEMA`` from an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, stated = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    found = stated if revisit else digest(payload)
    intact = revisit or (found == stated and len(payload) == size)
    refers_to = json.loads(fields["x-refers-to-page-id"]) if revisit else None
    return json.loads(fields["x-page-id"]), fields["warc-target-uri"], None if revisit else payload, size if revisit else len(payload), found, fields["warc-type"], refers_to, intact


# ZIP reading by ranges


def central_directory(source, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, compressed size, size, local header's offset) of every member.

    ``source`` has ``seek`` and ``read``; sizes and offsets over 32 bits come from ZIP64 fields.
    """
    tail_at = max(0, size - TAIL)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):  # a comment may hold the mark
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        source.seek(at)
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 directory")
        count, length, offset = struct.unpack_from("<QQQ", wide, 32)
    source.seek(offset)
    directory = source.read(length)
    members, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad ZIP directory entry")
        method, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<10xH8xIIHHH", directory, at)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        members[name] = (method, packed, full, local)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_member(source, members: dict[str, tuple[int, int, int, int]], name: str) -> tuple[int, int]:
    """Offset and length of a stored member's bytes."""
    method, packed, _, local = members[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    source.seek(local)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad ZIP local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra, packed


def archive_runs(source, size: int, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, list[int]]]:
    """(absolute offset, record lengths) of runs of adjacent records, from the archive's index."""
    members = central_directory(source, size)
    data_at, data_n = stored_member(source, members, DATA)
    index_at, index_n = stored_member(source, members, INDEX)
    source.seek(index_at)
    start, lengths, total = None, [], 0
    for line in io.BytesIO(source.read(index_n)):
        entry = json.loads(line)
        at, n = entry["offset"], entry["length"]
        if at < 0 or n < 0 or at + n > data_n:
            raise ValueError("index entry outside the archive member")
        if start is not None and (at != start + total or total + n > run_bytes):
            yield data_at + start, lengths
            start = None
        if start is None:
            start, lengths, total = at, [], 0
        lengths.append(n)
        total += n
    if start is not None:
        yield data_at + start, lengths


# DataFrames


class ArchiveWriter:
    """Writes archives under names of their own in a folder; used within one task."""

    def __init__(self, folder: str, archive_bytes: int, archive_records: int):
        self.folder, self.archive_bytes, self.archive_records = folder, archive_bytes, archive_records
        self.store, self.at = open_store(folder)
        self.store.create_dir(self.at, recursive=True)
        self.zip = None

    def add(self, page_id: str | None, url: str, record: bytes) -> tuple[str, int, int] | None:
        """The finished archive (uri, bytes, records), if this record had to begin another."""
        done = self.close() if self.zip is not None and (self.n + len(record) > self.archive_bytes or len(self.index) >= self.archive_records) else None
        if self.zip is None:
            self.name, self.n, self.index = f"{uuid.uuid4().hex}.wacz", 0, []
            self.out = self.store.open_output_stream(f"{self.at}/{self.name}")
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
            self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index.append(json.dumps({"page_id": page_id, "url": url, "offset": self.n, "length": len(record)}))
        self.member.write(record)
        self.n += len(record)
        return done

    def close(self) -> tuple[str, int, int] | None:
        if self.zip is None:
            return None
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in self.index))
        self.zip.close()
        self.out.close()
        self.zip = None
        name = f"{self.at}/{self.name}"
        return f"{self.folder}/{self.name}", self.store.get_file_info(name).size, len(self.index)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id (text), url, payload (binary), and refers_to and revisit by equal payloads.

    The smallest page_id of each payload is found with partial aggregation; the join back is
    one that adaptive execution splits where a payload has very many rows.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # Payloads are compared by SHA-1 as their digests are, and by length.
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    first = rows.groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= least_bytes)
    out = rows.join(first, ["sha", "n"]).withColumn("revisit", revisit)
    return out.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.when(F.col("revisit"), F.col("first")).cast("string").alias("refers_to"), "revisit")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes rows of ``with_roles`` as archives; (path, bytes, records) of each.  Evaluate once, into a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, archive_bytes, archive_records)
        done = []
        for batch in batches:
            for r in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                page_id, url, payload, refers_to, revisit = (x.as_py() for x in r)
                done.append(writer.add(page_id, url, warc_record(page_id, url, payload, refers_to, revisit)))
        done = [x for x in [*done, writer.close()] if x]
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "bytes", "records"), map(list, zip(*done, strict=True)), strict=True)))

    return rows.mapInArrow(run, "path string, bytes long, records long")


def read_archives(archives: DataFrame, scratch: Scratch, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Every record (``RECORD_SCHEMA``) of the archives in ``archives`` (path and bytes)."""

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                size = store.get_file_info(at).size
                with store.open_input_file(at) as source:
                    runs = list(archive_runs(source, size, run_bytes))
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs)), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["path", "at", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, at = open_store(path)
                with store.open_input_file(at) as source:
                    source.seek(start)
                    run, k, out = source.read(sum(lengths)), 0, []
                for n in lengths:
                    out.append(parse_record(gzip.decompress(run[k : k + n])))
                    k += n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    width = archives.sparkSession.sparkContext.defaultParallelism
    runs = archives.select("path").repartition(width, "path").mapInArrow(list_runs, "path string, at long, lengths array<bigint>")
    # Rows of runs are few and small, what they stand for isn't: a stated number of partitions is kept as it is.
    parts = max(width, math.ceil((archives.agg(F.sum("bytes")).first()[0] or 0) / TASK_BYTES))
    return scratch.table(runs, "runs").repartition(parts, "path", "at").mapInArrow(read, RECORD_SCHEMA)


def op9_warc_zip(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    archives = scratch.table(write_archives(with_roles(pages), scratch.folder("archives")), "manifest")
    kind = pages.schema["page_id"].dataType
    records = read_archives(archives, scratch)
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
