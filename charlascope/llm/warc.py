"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, followed by a skippable frame with
the seek table: compressed and decompressed size of every frame. An index table maps each record identifier to its bundle,
frame and place inside the decompressed frame, so one record costs one frame. Tasks write bundles to the shared folder under names
of their own attempt; the index, written by Spark, names only bundles of attempts that succeeded, so a lost executor
leaves unreferenced files at worst. Of records with equal payloads one is stored as response, the others as revisits
without payload, which are written second and name the identifier of their response.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.llm.base import batched, rows_of
from charlascope.session import cut_lineage, run_folder

# Payloads below this size are always stored.
LEAST_BYTES = 100
# Decompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 26
LEVEL = 3

# ---- Fixed values: the seekable Zstandard format ----
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record; line ends inside header values become spaces."""
    lines = [f"{k}: {' '.join(v.splitlines())}".encode() for k, v in headers.items()]
    length = f"Content-Length: {len(block)}".encode()
    return _VERSION + b"\r\n".join([*lines, length]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() + b"\r\n" != _VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length")
    return headers, rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable footer frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(footer)) + body + footer


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of every frame of a bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", file.read(8 * n))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2]):
        out.append((at, packed, plain))
        at += packed
    return out


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class BundleWriter:
    """Bundles of one task; ``add`` gives index rows (bundle, frame, offset inside the frame, length)."""

    def __init__(self, folder: str):
        self.files, self.path = _opened(folder)
        self.files.create_dir(self.path, recursive=True)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out, self.frames, self.frame, self.size, self.written, self.name = None, [], [], 0, 0, ""

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.frames, self.written = [], 0
        place = (self.name, len(self.frames), self.size, len(data))
        self.frame.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self._end_frame()
        if self.written >= BUNDLE_BYTES:
            self.close()
        return place

    def _end_frame(self) -> None:
        if self.size:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.frame, self.size = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._end_frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


class BundleReader:
    """Records of bundles by index row; the last frame read is kept."""

    def __init__(self, folder: str):
        self.files, self.path = _opened(folder)
        self.unpacker = zstandard.ZstdDecompressor()
        self.name, self.file, self.frames, self.at, self.plain = None, None, [], -1, b""

    def get(self, name: str, frame: int, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.file = self.files.open_input_file(f"{self.path}/{name}")
            self.frames, self.name, self.at = read_seek_table(self.file, self.file.size()), name, -1
        if frame != self.at:
            start, packed, plain = self.frames[frame]
            self.file.seek(start)
            self.plain, self.at = self.unpacker.decompress(self.file.read(packed), max_output_size=plain), frame
        return self.plain[offset : offset + length]


INDEX_COLUMNS = (
    "record_id string, page_id long, digest string, bundle string, frame int, frame_offset long, record_bytes long"
)
_INDEX = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("digest", pa.string()),
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("frame_offset", pa.int64()),
        ("record_bytes", pa.int64()),
    ]
)


def responses_and_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(page_id, url, html, digest)`` of responses, and ``(page_id, url, size, digest, refers_to)`` of revisits.

    Payloads are grouped by digest without their texts. Every row with the smallest id of its payload is a response; if
    all rows of a payload lack an id, all of them are. A row's part follows from its id and digest, so texts are shuffled
    by both, and a payload that very many pages share is spread over tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    size = F.octet_length("html").cast("long")
    large = cut_lineage(keyed.where(size >= least_bytes).select("page_id", "url", size.alias("size"), "digest"))
    shared = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = shared.where("n > 1 and refers_to is not null").drop("n")
    revisits = large.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    # Rows without an id share the empty key.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key")
    others = revisits.select(key, "digest").distinct()
    responses = keyed.withColumn("_key", key).join(others, ["_key", "digest"], "left_anti")
    return (
        responses.select("page_id", "url", "html", "digest"),
        revisits.select("page_id", "url", "size", "digest", "refers_to"),
    )


def _headers(kind: str, record_id: str, date: str, page_id, url, size: int, digest: str) -> dict[str, str]:
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "text/html; charset=utf-8",
    }
    return headers if page_id is None else headers | {"WARC-Page-ID": str(page_id)}


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """Write one record per page to bundles in ``folder``, a shared one; returns the stored index.

    A null html is an empty payload, a null url an empty one. Repeated rows are records of their own, each with its own
    identifier. ``date`` is the records' WARC-Date (UTC, as in 2025-01-31T12:00:00Z), now by default, as pages have none.
    Other columns are ignored; an empty table gives an empty index and no bundle.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def response(page_id, url, html: bytes, digest: str) -> tuple[str, bytes]:
        record_id = uuid.uuid4().urn
        return record_id, record(_headers("response", record_id, date, page_id, url, len(html), digest), html)

    def revisit(page_id, url, size: int, digest: str, refers_to: int, target: str) -> tuple[str, bytes]:
        record_id = uuid.uuid4().urn
        headers = _headers("revisit", record_id, date, page_id, url, size, digest) | {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": f"<{target}>",
            "WARC-Refers-To-Date": date,
            "WARC-Refers-To-Page": str(refers_to),
        }
        return record_id, record(headers, b"")

    def written(rows: DataFrame, made, *columns: str) -> DataFrame:
        def task(batches):
            writer = BundleWriter(folder)

            def placed() -> Iterator[tuple]:
                for row in rows_of(batches, *columns):
                    record_id, data = made(*row)
                    yield record_id, row[0], row[3], *writer.add(data)

            yield from batched(placed(), _INDEX)
            writer.close()

        return cut_lineage(rows.mapInArrow(task, INDEX_COLUMNS))

    responses, revisits = responses_and_revisits(pages, least_bytes)
    first = written(responses, response, "page_id", "url", "html:raw", "digest")
    targets = first.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min("record_id").alias("target"))
    referring = revisits.join(targets, ["refers_to", "digest"])
    second = written(referring, revisit, "page_id", "url", "size", "digest", "refers_to", "target")
    return first.unionByName(second)


_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)
READ_COLUMNS = (
    "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, payload binary"
)


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of an index, read from their bundles frame by frame; response payloads are checked against their digest.

    ``payload`` is null for revisits, and everywhere without ``payloads``.
    """

    def task(batches):
        reader = BundleReader(folder)

        def found() -> Iterator[tuple]:
            for record_id, *place in rows_of(batches, "record_id", "bundle", "frame", "frame_offset", "record_bytes"):
                headers, block = parse_record(reader.get(*place))
                if headers["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"another record lies at the place of {record_id}")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size, kind = int(headers["WARC-Payload-Length"]), headers["WARC-Type"]
                if kind == "response" and (len(block), hashlib.sha256(block).hexdigest()) != (size, digest):
                    raise ValueError(f"payload of {record_id} is damaged")
                page, target = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page")
                page, target = (None if x is None else int(x) for x in (page, target))
                body = block if payloads and kind == "response" else None
                yield record_id, page, size, digest, kind, target, headers["WARC-Target-URI"], body

        yield from batched(found(), _READ, 512)

    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "frame_offset")
    return dealt.mapInArrow(task, READ_COLUMNS)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages written to bundles in the shared folder and read back, one row per page."""
    folder = f"{run_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_bundles(pages, folder, least_bytes), folder, payloads=False).drop("payload")
