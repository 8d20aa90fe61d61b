"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends in the seek table
of the seekable format (a skippable frame). The index maps each record to its bundle, frame
and offset within the frame. A task that runs again writes bundles of new names; the index,
committed by Spark, names only those of the attempt that counts.

Defined results: a null payload is empty; of equal payloads of ``LEAST`` bytes or more the
row with the largest page_id is the response and the others revisit it; rows that repeat that
page_id and payload are responses each; a null page_id is never referred to unless there is no
other; an empty table writes no bundle; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.scratch import Scratch

LEAST = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable format: skippable frame, end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


class BundleWriter:
    """One bundle: frames, then the seek table."""

    def __init__(self, path: str):
        self.path = path
        store, inner = _open(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(inner, compression=None)
        self.compress = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        place = len(self.frames), self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.held:
            frame = self.compress.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.held_bytes))
            self.written += len(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, path: str):
        store, inner = _open(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for compressed, plain in struct.iter_unpack("<II", entries):
            self.frames.append((at, compressed, plain))
            at += compressed
        self.decompress = zstandard.ZstdDecompressor()

    def frame(self, n: int) -> bytes:
        at, compressed, plain = self.frames[n]
        return self.decompress.decompress(self.file.read_at(compressed, at), max_output_size=plain)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    else:
        head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(block))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` with digest, size, and the page that a row's payload is kept under (null: no other has it)."""
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    large, small = sized.filter(F.col("size") >= LEAST), sized.filter(F.col("size") < LEAST)
    keepers = large.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # small payloads have no copies to look for, so they aren't shuffled
    return large.join(keepers, ["digest", "size"], "left").unionByName(small.withColumn("keeper", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles under ``folder`` when the index it returns is computed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                revisit = r["keeper"] is not None and r["keeper"] != r["page_id"]
                record = record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], revisit, r["keeper"])
                rows.append((r["page_id"], bundle.path, *bundle.add(record), len(record)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return decide(pages).select("page_id", "url", "html", "digest", "keeper").mapInArrow(write, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """What the records hold, each found through the index; payload digests are computed anew."""

    def read(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["frame"], r["offset"]))
        bundle, number, frame, out = BundleReader(rows[0]["bundle"]), -1, b"", []
        for r in rows:
            if r["frame"] != number:
                number, frame = r["frame"], bundle.frame(r["frame"])
            fields, payload = parse_record(frame[r["offset"] : r["offset"] + r["length"]])
            page = _page_of(fields["WARC-Record-ID"])
            if page != r["page_id"]:
                raise ValueError(f"record {page} stands where {r['page_id']} should")
            told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                if hashlib.sha1(payload).hexdigest() != told:
                    raise ValueError(f"record {page}: its payload has another digest")
                out.append((page, len(payload), told, "response", None))
            else:
                out.append((page, int(fields["X-Payload-Length"]), told, "revisit", _page_of(fields["WARC-Refers-To"])))
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.groupBy("bundle").applyInArrow(read, RECORDS)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes bundles and index under the shared folder; the index table and the bundles' folder."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/bundles"
    return scratch.write(write_archives(pages, folder), "index"), folder
