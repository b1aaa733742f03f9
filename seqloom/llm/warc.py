"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that can be read alone, frames into bundles of bounded size.  After the frames a bundle
has a record index (record id, frame, offset within the frame, length) and a seek table in the published seekable
format (sizes of the frames), each in a frame that a plain Zstandard reader skips, so one record costs one frame.
Bundles are written as rows of a table, which any store that Spark writes to can hold; ``data`` is the archive file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import rows_of, shared_folder

# Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(name: str, date: str, page_id: int | None, url: str | None, payload: bytes, first: dict | None) -> bytes:
    """A WARC 1.1 record: a response with the payload, or a revisit of ``first`` (page_id and url) that keeps only headers.

    The page_id is in a field of its own, since a record's id is unique and a page_id need not be."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    plain = lambda x: "".join(c for c in x or "" if c >= " ")
    number = lambda x: "" if x is None else str(x)
    head = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": plain(url), "Page-ID": number(page_id)}
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": plain(first["url"]), "WARC-Refers-To-Date": date, "Refers-To-Page-ID": number(first["page_id"])}
    head |= {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items())]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload facts of a record; a response's digest and length are taken from its payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    number = lambda name: int(x) if (x := headers[name]) else None
    found = {"page_id": number("Page-ID"), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "payload_bytes": size}
    if found["record_type"] == "response":
        digest = sha1_base32(payload)
        if len(payload) != size or f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        return found | {"payload_digest": digest, "refers_to": None, "payload": payload}
    return found | {"payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("Refers-To-Page-ID"), "payload": None}


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.press = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.sizes, self.index, self.open = bytearray(), [], [], bytearray()

    def add(self, name: int | None, data: bytes) -> None:
        self.index.append((name, len(self.sizes), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.press.compress(bytes(self.open))
            self.sizes.append((len(packed), len(self.open)))
            self.out += packed
            self.open = bytearray()

    def finish(self) -> bytes:
        self.end_frame()
        index = self.press.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table


class BundleReader:
    """Random access to a bundle: the seek table gives each frame's place, the index each record's."""

    def __init__(self, data: bytes):
        frames, descriptor, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC or descriptor != 0:
            raise ValueError("no seek table")
        table = data[-9 - 8 * frames : -9]
        self.data, self.frames, self.places, at = data, [], None, 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        kind, size = struct.unpack_from("<II", data, at)
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no record index")
        self.unpack = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unpack.decompress(data[at + 8 : at + 8 + size]))

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return self.unpack.decompress(self.data[at : at + packed], max_output_size=plain)

    def get(self, name: int | None) -> list[bytes]:
        """The records of this page_id, each for the price of its frame; several only if the page was written several times."""
        if self.places is None:
            self.places = {}
            for i, f, at, n in self.index:
                self.places.setdefault(i, []).append((f, at, n))
        return [self.frame(f)[at : at + n] for f, at, n in self.places.get(name, [])]

    def records(self) -> Iterator[bytes]:
        last, data = None, b""
        for _, f, at, n in self.index:
            if f != last:
                last, data = f, self.frame(f)
            yield data[at : at + n]


def bundle_pages(
    pages: DataFrame, least_revisit: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 4 << 20, level: int = 3, date: str | None = None
) -> DataFrame:
    """Bundles ``n_records, data`` of the pages: of equal payloads of at least ``least_revisit`` bytes, that with the
    smallest page_id is a response and the others are revisits of it.  ``date`` is what records say; now if none is given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)
    payload = F.col("html").cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    keys = pages.select("page_id", "url", "sha1", "n")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = keys.where(F.col("n") >= least_revisit).groupBy("sha1", "n").agg(least.alias("first"))
    others = keys.join(first, ["sha1", "n"]).where("page_id > first.page_id OR page_id IS NULL AND first IS NOT NULL")
    later = others.select(F.col("page_id").alias("_page_id"), F.col("sha1").alias("_sha1"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("sha1") == F.col("_sha1"))
    rows = pages.join(later, same, "left").select("page_id", "url", "html", "first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, part, n = BundleWriter(frame_bytes, level), TaskContext.get().partitionId(), 0
        whole = lambda: pa.record_batch([pa.array([len(writer.index)], pa.int64()), pa.array([writer.finish()], pa.binary())], ["n_records", "data"])
        for batch in rows_of(batches, 64):
            for page_id, url, html, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                data, n = html.encode("utf-8", "surrogatepass"), n + 1
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{date} {part} {n} {page_id} {sha1_base32(data)}")
                writer.add(page_id, record(str(name), date, page_id, url, data, response))
                if len(writer.out) >= bundle_bytes:
                    yield whole()
                    writer = BundleWriter(frame_bytes, level)
        if writer.index:
            yield whole()

    return rows.mapInArrow(pack, "n_records long, data binary")


def store_bundles(bundles: DataFrame, path: str) -> None:
    bundles.write.mode("overwrite").parquet(path)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a ``.warc.zst`` file for other tools; returns ``file, n_records`` when it is run.

    ``folder`` is a URI in a store that pyarrow reaches from all executors.  A file is named by what it holds, so a task
    that runs again writes the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in rows_of(batches, 1):
            data = batch.column("data")[0].as_py()
            name = f"{root}/{hashlib.sha1(data).hexdigest()}.warc.zst"
            with store.open_output_stream(name, compression=None) as out:  # it would compress once more
                out.write(data)
            yield pa.record_batch([pa.array([name]), batch.column("n_records")], ["file", "n_records"])

    return bundles.select("data", "n_records").mapInArrow(write, "file string, n_records long")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of all records, read frame by frame."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
            return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))

        for bundle in rows_of(batches, 1):
            rows, held = [], 0
            for data in BundleReader(bundle.column("data")[0].as_py()).records():
                rows.append(parse_record(data))
                held += len(data)
                if held > 1 << 22:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return bundles.select("data").mapInArrow(unpack, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4()}"


def warc_round_trip(pages: DataFrame, path: str | None = None, least_revisit: int = 0) -> DataFrame:
    """Write the archive of all pages and read back ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload; null page_ids revisit the smallest id of their payload or, without one, are responses;
    equal rows are records of their own with equal types; an empty table gives no rows; columns beyond page_id, url and
    html are not looked at.  The bundles stay in ``path``.
    """
    path = path or archive_folder(pages.sparkSession)
    store_bundles(bundle_pages(pages, least_revisit), path)
    return read_bundles(pages.sparkSession.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
