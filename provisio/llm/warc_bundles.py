r"""WARC records in seekable Zstandard bundles (operator 1).

A bundle is a row of independent Zstandard frames, each holding a group of whole WARC records, and a closing seek table:
a skippable frame (magic 0x184D2A5E) with the compressed and plain size of every frame and the footer (number of frames,
descriptor 0, magic 0x8F92EAB1).  Any Zstandard decoder reads the bundle from start to end as one WARC file; a reader
with the seek table fetches one frame alone.  The index maps each record id to bundle, frame, offset in the plain frame
and length.

Equal payloads of `min_revisit` bytes or more are stored once: the record with the largest id is a `response`, the others
are `revisit` records that refer to it and carry the HTTP headers alone.

Every task writes bundles of its own with fresh names into a shared folder and reports index rows only of finished
bundles.  The index is stored before anything is read back; a task that ran twice leaves a bundle that no index names.

Defined cases: a null payload is empty; a null url is written as about:blank; a null id sorts below every id; rows with
the same id and payload, when that id is the largest, are all responses; an empty table gives an empty index and no
bundle; a payload of any length stands in one frame of its own if it is longer than a frame.  A hot payload is counted
map-side, and its records are spread by AQE's skew join.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAMES_PER_TASK = 32
SAFE = "".join(chr(c) for c in range(0x21, 0x7F))
INDEX = "record_id string, bundle string, frame long, frame_offset long, record_bytes long"
RECORD = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder named as Hadoop does."""
    fs, path = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))
    return fs, path


def warc_record(record_id: str, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: str | None, date: str) -> bytes:
    """One WARC 1.1 record with its two closing line ends; a revisit has no payload."""
    urn = lambda x: f"<urn:page:{urllib.parse.quote(x, safe='')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {urn(record_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(offset, length, fields, HTTP headers, payload) of each record of a plain frame."""
    at = 0
    fields = lambda raw: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = fields(data[at:head_end])
        body = head_end + 4
        end = body + int(head["content-length"])
        http_end = data.index(b"\r\n\r\n", body)
        yield at, end + 4 - at, head, fields(data[body:http_end]), data[http_end + 4:end]
        at = end + 4


class BundleWriter:
    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.fs, self.path = open_folder(folder)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.stream = None

    def add(self, record_id: str, record: bytes) -> list[tuple]:
        """The index rows of a bundle that this record has finished."""
        if self.stream is None:
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.name, self.stream = f"{self.folder}/{name}", self.fs.open_output_stream(f"{self.path}/{name}", compression=None)
            self.frame, self.filled, self.frames, self.rows, self.written = [], 0, [], [], 0
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.flush()
        self.rows.append((record_id, self.name, len(self.frames), self.filled, len(record)))
        self.frame.append(record)
        self.filled += len(record)
        return self.close() if self.written >= self.bundle_bytes else []

    def flush(self) -> None:
        data = self.zstd.compress(b"".join(self.frame))
        self.stream.write(data)
        self.frames.append((len(data), self.filled))
        self.written += len(data)
        self.frame, self.filled = [], 0

    def close(self) -> list[tuple]:
        if self.stream is None:
            return []
        if self.frame:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()
        self.stream = None
        return self.rows


class BundleReader:
    def __init__(self, bundle: str):
        folder, _, name = bundle.rpartition("/")
        fs, path = open_folder(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{bundle} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for c, _ in self.sizes:
            self.starts.append(self.starts[-1] + c)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        compressed, plain = self.sizes[k]
        return self.zstd.decompress(self.file.read_at(compressed, self.starts[k]), max_output_size=plain)


def _arrow(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    of = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in kinds.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def write_archive(pages: DataFrame, folder: str | None = None, record_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row; returns the stored index."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(record_id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest"))
    copies = (rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest")
              .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").select("digest", "last"))
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    told = rows.join(copies, "digest", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")), "url", F.when(refers.isNull(), F.col("payload")), "digest", "n_bytes", refers.cast("string"))
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                rid, to, text, digest, n, ref = (batch.column(k)[i].as_py() for k in range(6))
                done += writer.add(rid, warc_record(rid, to, None if ref is not None else text.encode(), digest, n, ref, date))
            if done:
                yield _arrow(done, INDEX)
        if done := writer.close():
            yield _arrow(done, INDEX)

    return stored(told.mapInArrow(run, INDEX), "warc-index")


def _frames(wanted: DataFrame, only_ids: bool, payloads: bool) -> DataFrame:
    def run(batches):
        name, reader = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for r in sorted(rows, key=lambda r: (r["bundle"], r["frame"])):
                if r["bundle"] != name:
                    name, reader = r["bundle"], BundleReader(r["bundle"])
                data = reader.frame(r["frame"])
                if only_ids:
                    data = data[r["frame_offset"]:r["frame_offset"] + r["record_bytes"]]
                done = []
                for _, _, head, http, body in parse_records(data):
                    urn = lambda x: urllib.parse.unquote(head[x][len("<urn:page:"):-1]) if x in head else None  # noqa: B023, E731
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(http["content-length"])):
                        raise ValueError(f"{name}: the payload of {head['warc-record-id']} doesn't match its digest")
                    done.append((urn("warc-record-id"), head["warc-target-uri"], head["warc-type"], digest, int(http["content-length"]),
                                 urn("warc-refers-to"), body if payloads and head["warc-type"] == "response" else None))
                yield _arrow(done, RECORD)

    return wanted.mapInArrow(run, RECORD)


def read_archive(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles that the index names, frame by frame; each payload is held against its digest."""
    frames = index.select("bundle", "frame").distinct()
    tasks = -(-frames.count() // FRAMES_PER_TASK)  # the rows are tiny, the frames behind them aren't
    return _frames(frames.repartition(max(1, tasks), "bundle", "frame"), False, payloads)


def lookup(index: DataFrame, ids: DataFrame, payloads: bool = True) -> DataFrame:
    """The records with the ids in the first column of `ids`, each fetched from its own frame."""
    keys = ids.select(ids[ids.columns[0]].cast("string").alias("record_id")).distinct()
    return _frames(index.join(keys, "record_id", "left_semi"), True, payloads)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    back = read_archive(write_archive(pages))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url")
