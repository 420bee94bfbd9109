"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records of about ``frame_bytes``, and ends in a
seek table: a skippable frame that lists the frames' sizes, which readers without knowledge of it skip. An index maps
each record's identifier to its bundle, frame and offset in the frame, so one record costs one seek and one frame.

Tasks write bundles under names of their own and name a bundle in the index only when it is closed. The index is
written by Spark, whose commit decides: what a lost or repeated task leaves is a file that no index names.

Of records with equal payloads one is a response and the others revisit it. Which ones is decided on hashes alone; then
each payload meets its decision, by its row number, and goes to disk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import shared_dir
from .common import column, staged, unstage

#: Marks of the skippable frame and of the seek table in it (fixed values of the seekable format).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORDS = "record_id string, page_id bigint, url string, record_type string, refers_to_record string, payload_bytes bigint, payload_digest string"


def place(folder: str):
    """(file system, path) of a folder's URI, for Python in tasks."""
    from pyarrow import fs

    if re.match(r"file:/|/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", folder))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Frames to a stream, then their seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.frames = stream, []
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def frame(self, data: bytes) -> int:
        """Writes data as a frame of its own; its number."""
        packed = self.zstd.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data)))
        return len(self.frames) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.stream.close()


class BundleReader:
    """Any frame of a bundle by its number, found by the seek table at the end."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, flags, mark = struct.unpack("<IBI", source.read(9))
        if mark != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 128 else 8
        source.seek(size - 9 - count * width)
        table = source.read(count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=plain)


def _header(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record. Control characters in values are written %XX, so that no value ends its line."""
    lines = [f"{k}: {re.sub('[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or (``refers_to``) a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>", "WARC-Refers-To-Target-URI": refers_url}
    fields |= {"X-Page-ID": None if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response"}
    return _header(fields, http if refers_to else http + payload)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record; a response whose payload belies its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return fields, payload


@dataclass
class Archive:
    folder: str
    #: One row per record: record_id, page_id, bundle, frame, offset and length in the frame.
    index: DataFrame


def _rows(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, payload, hash) of every page; the numbers are fixed once staged."""
    kinds = {"page_id": "bigint", "url": "string", "html": "string"}
    have = set(pages.columns)
    page = pages.select(*[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])
    page = page.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return staged(page.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("hash")), "pages")


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """(row, first_row, first_page_id, first_url) of the rows that repeat the payload of an earlier one.

    Only hashes and numbers move. A group is reduced to its first before the shuffle, and joined back by a plain
    equi-join, which splits a large group.
    """
    small = rows.filter(F.length("payload") >= least).select("hash", "row", "page_id", "url")
    rank = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("page_id"), F.col("row").alias("row"), F.col("url").alias("url"))
    firsts = small.groupBy("hash").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = small.select("hash", "row").join(firsts, "hash").filter(F.col("row") != F.col("first.row"))
    return staged(found.select("row", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page_id"), F.col("first.url").alias("first_url")), "revisits")


def write(pages: DataFrame, folder: str | None = None, least: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Pages (page_id, url, html) as WARC records in bundles, and their index.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response (rows
    without page_id come last, of equal page_ids one row is taken), the others are revisits of it. Null html is an empty
    payload; a null url is left out of the record. A record of more than ``frame_bytes`` has a frame, and one of more
    than ``bundle_bytes`` a bundle of its own. Repeated rows are records of their own. An empty table makes no bundle;
    other columns are ignored. ``folder`` must be one that all executors share (default: a new one in
    ``spark.checkpoint.dir``).
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = _rows(pages)
    revisits = _revisits(rows, least)  # staged, so that a small one is known to be small and no payload needs shuffling

    def named(hashed: bytes, page_id: int | None, row: int) -> str:
        return uuid.UUID(bytes=hashlib.md5(hashed + f"{page_id}|{row}".encode()).digest(), version=5).urn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = place(folder)
        files.create_dir(path, recursive=True)
        bundle, name, entries, size = None, "", [], 0
        frame, waiting = bytearray(), []

        def flush() -> None:
            number = bundle.frame(bytes(frame))
            entries.extend((i, p, name, number, at, n) for i, p, at, n in waiting)
            frame.clear()
            waiting.clear()

        def ended() -> pa.RecordBatch:
            flush()
            bundle.close()
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*entries, strict=True), kinds, strict=True)], names=names)
            entries.clear()
            return out

        for batch in batches:
            payloads = column(batch, "payload")
            rest = batch.select(["hash", "page_id", "row", "url", "first_row", "first_page_id", "first_url"]).to_pydict()
            for k, (hashed, page_id, row, url, first_row, first_page, first_url) in enumerate(zip(*rest.values(), strict=True)):
                payload = payloads[k].as_py()
                first = named(hashed, first_page, first_row) if first_row is not None else None
                record_id = named(hashed, page_id, row)
                raw = record(record_id, page_id, url, payload, date, first, first_url)
                if bundle and size + len(raw) > bundle_bytes:
                    yield ended()
                    bundle = None
                if not bundle:
                    name, size = f"{uuid.uuid4().hex}.warc.zst", 0
                    bundle = BundleWriter(files.open_output_stream(f"{path}/{name}", compression=None))
                    bundle.frame(_header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                if frame and len(frame) + len(raw) > frame_bytes:
                    flush()
                waiting.append((record_id, page_id, len(frame), len(raw)))
                frame += raw
                size += len(raw)
        if bundle:
            yield ended()

    index = staged(rows.join(revisits, "row", "left").mapInArrow(run, INDEX), "index", f"{folder}/index")
    unstage(rows, revisits)
    return Archive(folder, index)


def _frames(rows: pa.RecordBatch, folder: str, state: dict) -> Iterator[bytes]:
    """Each row's record, from a frame that is read once for neighbouring rows."""
    files, path = place(folder)
    for name, number, at, n in zip(*rows.select(["bundle", "frame", "offset", "length"]).to_pydict().values(), strict=True):
        if state.get("name") != name:
            if "reader" in state:
                state["reader"].source.close()
            state |= {"name": name, "reader": BundleReader(files.open_input_file(f"{path}/{name}")), "number": None}
        if state["number"] != number:
            state |= {"number": number, "frame": state["reader"].frame(number)}
        yield state["frame"][at : at + n]


def read(archive: Archive, wanted: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """Records by their places in the index (all of it, or the rows of it in ``wanted``): record_id, page_id, url,
    record_type, refers_to_record, payload_bytes and payload_digest (of what the record holds; null for a revisit), with
    ``payload`` also the payload.

    Rows meet by frame, in the order of the file: each frame is read and unpacked once. Digests are checked.
    """
    rows = wanted if wanted is not None else archive.index
    folder = archive.folder
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, rows.select("bundle").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for raw in _frames(batch, folder, state):
                f, body = parsed(raw)
                whole = f["warc-type"] == "response"
                page, refers = f.get("x-page-id"), f.get("warc-refers-to")
                row = (f["warc-record-id"][1:-1], int(page) if page else None, f.get("warc-target-uri"), f["warc-type"], refers and refers[1:-1])
                out.append((*row, len(body) if whole else None, digest(body) if whole else None, *([body if whole else None] * payload)))
                held += len(body) if payload else 0
                if held > 8_000_000:
                    yield _records(out)
                    out, held = [], 0
            if out:
                yield _records(out)

    placed = rows.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInArrow(run, RECORDS + (", payload binary" if payload else ""))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [*[x.split()[0] for x in RECORDS.split(", ")], "payload"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])


def lookup(archive: Archive, ids: DataFrame) -> DataFrame:
    """The records whose record_id is in ids (column record_id), with payload: only their frames are read."""
    return read(archive, archive.index.join(ids.select("record_id").distinct(), "record_id", "left_semi"), payload=True)


def resolved(archive: Archive) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload is that of
    the response it names, found by record identifier; refers_to is that response's page_id."""
    records = staged(read(archive), "records")
    whole = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes_"), F.col("payload_digest").alias("digest_"))
    both = records.join(whole, "refers_to_record", "left")
    return both.select("page_id", F.coalesce("payload_bytes", "bytes_").alias("payload_bytes"), F.coalesce("payload_digest", "digest_").alias("payload_digest"), "record_type", "refers_to")
