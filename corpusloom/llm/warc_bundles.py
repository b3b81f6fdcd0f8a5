"""WARC archives in seekable Zstandard bundles, written by tasks and read back by ranges.

A task writes the records of its rows into bundles: records are grouped into Zstandard frames that decompress
alone, and a footer (a skippable frame in the public seekable format) lists every frame's sizes, so any Zstandard
reader can read a bundle from start to end and this one can jump. The index table maps a record identifier to
(bundle, frame, offset inside the decompressed frame, length); it is written by Spark next to the bundles.
Bundle names are unique to a task attempt and only rows of attempts that Spark commits reach the index, so a lost
executor or a repeated attempt leaves at most files that nothing refers to.

Records with equal payloads of at least `LEAST_SHARED` bytes are stored once: the record with the smallest page_id
is a `response`, the others are `revisit` records that refer to it and hold the HTTP head alone. Smaller payloads
are all stored. Digests are found by one aggregation of (digest, page_id) that adds up before the shuffle; only
digests that occur more than once are joined back, as a broadcast if their written table is small enough, else
by a join whose hot digests Spark splits.

The bundles lie under a path that executors can open: a shared folder, or a store that ``pyarrow.fs`` knows.

Defined results: a null html is an empty payload; invalid UTF-8 is kept byte for byte. Rows that share the smallest
page_id of a payload are all responses (their identifiers can't be told apart); a null page_id is never the smallest, refers
to it like any other, and is a response where all ids are null. Repeated rows are records of their own. An empty table
gives an empty index and no records. Control characters in URLs are written as %XX, a null URL leaves the header out.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_path, shared_table

LEAST_SHARED = 100      # bytes of a payload from which equal ones are stored once
FRAME = 1 << 20         # bytes of records after which a frame is closed
BUNDLE = 1 << 27        # compressed bytes after which a task begins another bundle
READ = 16 * FRAME       # bytes of records that a reading task takes on average
LEVEL = 3

#: FIXED VALUES of the seekable format: the skippable frame's magic number and the one that ends the footer
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: FIXED VALUE of the WARC standard: the profile of a revisit with an equal payload
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = ("record_id string, page_id long, record_type string, refers_to long, bundle string, frame long, "
         "offset long, length long")
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "intact boolean, bundle string, frame long, offset long")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _header_value(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in text)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
                date: str = DATE) -> bytes:
    """A page's response, or the revisit of the page ``first``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
              *([] if url is None else [("WARC-Target-URI", _header_value(url))]),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is None:
        return record("response", fields, head + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))], head)


def records_in(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield at, fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Appends records to a bundle, closes frames, ends with the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME):
        self.out, self.frame_bytes = out, frame_bytes
        self.pending, self.size = [], 0
        self.sizes: list[tuple[int, int]] = []
        self.written = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset of the record in it."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.sizes), self.size
        self.pending.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.compressor.compress(b"".join(self.pending))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8               # with the optional checksum
        file.seek(size - 9 - n * entry)
        table = file.read(n * entry)
        self.sizes = [struct.unpack_from("<II", table, i * entry) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        self.file.seek(self.starts[number])
        return self.unpacker.decompress(self.file.read(self.sizes[number][0]), max_output_size=self.sizes[number][1])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and ``first``: the page that a revisit refers to, null for a response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = shared_table(
        rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
        .select("digest", "least"), "shared-payloads")
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Write a record for every page (page_id, url, html) into bundles under ``path``; returns the index table."""
    folder = f"{path.rstrip('/')}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        writer, name = None, ""
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                    writer.add(record("warcinfo", [("WARC-Record-ID", f"<urn:bundle:{name}>"), ("WARC-Date", DATE),
                                                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                data = page_record(page_id, url, payload, digest, first)
                frame, offset = writer.add(data)
                rows.append((record_id(page_id), page_id, "response" if first is None else "revisit", first, name,
                             frame, offset, len(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i in (0, 2, 4) else pa.int64()) for i, c in enumerate(zip(*rows))]
                if rows else [pa.array([], pa.string() if i in (0, 2, 4) else pa.int64()) for i in range(8)],
                [f.split()[0] for f in INDEX.split(", ")])
        if writer is not None:
            writer.close()

    where = f"{path.rstrip('/')}/index"
    described(pages).mapInArrow(run, INDEX).write.parquet(where)
    return pages.sparkSession.read.schema(INDEX).parquet(where)


def read_frames(frames: DataFrame, path: str, with_payload: bool = False, parts: int = 1) -> DataFrame:
    """The page records in the frames (bundle, frame) of the bundles under ``path``.

    ``intact`` says whether a response's payload has the digest and length that its headers give; a revisit's
    are those of its headers. Each frame is read by one ranged read and decompressed alone.
    """
    folder = f"{path.rstrip('/')}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        name, reader = None, None
        for batch in batches:
            for bundle, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bundle != name:
                    if reader is not None:
                        reader.file.close()
                    name, reader = bundle, BundleReader(fs.open_input_file(f"{base}/{bundle}"))
                rows = []
                for offset, fields, block in records_in(reader.frame(frame)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
                    digest, intact, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None, None
                    if kind == "response":
                        found = hashlib.sha256(payload).hexdigest()
                        digest, intact = found, found == digest and len(payload) == size
                    else:
                        refers = _page_of(fields["WARC-Refers-To"])
                    rows.append((_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, size,
                                 digest, intact, bundle, frame, offset, payload if with_payload and kind == "response" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if reader is not None:
            reader.file.close()

    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"]
    of = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [of[f.split()[1]] for f in RECORDS.split(", ")] + [pa.binary()]
    # an explicit number of parts: by their few bytes, Spark would put all frame numbers into one task
    dealt = (frames.select("bundle", "frame").distinct().repartition(parts, "bundle", F.floor(F.col("frame") / 16))
             .sortWithinPartitions("bundle", "frame"))
    return dealt.mapInArrow(run, RECORDS + ", payload binary")


def read_bundles(index: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """All page records of the bundles that the index names."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read_frames(index, path, with_payload, parts=1 + total // READ)


def fetch(index: DataFrame, path: str, page_ids: DataFrame) -> DataFrame:
    """(page_id, payload) of the wanted pages: a revisit's payload is that of the page it refers to.

    The index gives frame and offset, so only frames that hold a wanted record are read.
    """
    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi").select(
        "page_id", F.coalesce("refers_to", "page_id").alias("held_by"))
    places = index.where("record_type = 'response'").join(
        wanted.select(F.col("held_by").alias("page_id")).distinct(), "page_id", "left_semi")
    places = shared_table(places.select("page_id", "bundle", "frame", "offset", "length"), "wanted-records")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    read = read_frames(places, path, True, parts=1 + total // READ)
    held = read.join(places, ["page_id", "bundle", "frame", "offset"], "left_semi").select(
        F.col("page_id").alias("held_by"), "payload")
    return wanted.join(held, "held_by").select("page_id", "payload")


def archived_pages(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives, read the archives back: a row for each record."""
    path = path or shared_path(spark, "warc")
    return read_bundles(write_bundles(pages, path), path).select(*[f.split()[0] for f in RECORDS.split(", ")])


def archived_pages_sql() -> str:
    """DuckDB SQL of the contract's columns."""
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
  sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM q"""


__all__ = ["BundleReader", "BundleWriter", "archived_pages", "archived_pages_sql", "described", "fetch",
           "page_record", "read_bundles", "read_frames", "record", "record_id", "records_in", "write_bundles"]
