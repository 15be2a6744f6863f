"""Operator 10: WARC archives as seekable Zstandard bundles.

Method: records are grouped into independent Zstandard frames; a bundle ends with a
skippable frame holding the seek table (compressed and decompressed size of each frame, in
the public seekable format); an index maps each record identifier to its bundle, frame and the
offset inside the decompressed frame.  Bundles are binary cells of a Parquet table, so any
store that Spark writes to will do; the index is a table of its own, in ranges of record
identifiers, so that a lookup reads few of its pages and then only the bundles it names.

Among records with equal payloads that of the largest page id is the response; the others
are revisits that refer to it and carry HTTP headers only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path

#: fixed values of the Zstandard seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 4 << 20, 3
ID = "urn:graphloom:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame int, offset int"
ARCHIVE = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:int>>"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle without checksums")
    at, out = 0, []
    for i in range(count):
        c, d = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (count - i))
        out.append((at, c, d))
        at += c
    return out


def _id(page: int | None) -> str:
    return f"{ID}{'' if page is None else page}"


def record(page: int | None, url: str | None, payload: bytes, response: bool, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers, which state the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <{_id(page)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_id(refers)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0, one: bool = False) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Records of a decompressed frame from an offset: (WARC headers, HTTP headers, payload)."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at = end + 4 + size + 4
        if one:
            return


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    records: list[dict] = []
    frame, held, serial = bytearray(), 0, 0

    def close_frame() -> None:
        nonlocal frame, held
        if frame:
            frames.append(packer.compress(bytes(frame)))
            sizes.append((len(frames[-1]), len(frame)))
            held += len(frames[-1])
            frame = bytearray()

    def bundle() -> pa.RecordBatch:
        nonlocal frames, sizes, records, held, serial
        close_frame()
        out = pa.RecordBatch.from_arrays(
            [pa.array([f"graphloom-{part:06d}-{serial:06d}.warc.zst"]), pa.array([b"".join(frames) + seek_table(sizes)], pa.binary()), pa.array([records], pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])))],
            ["bundle", "content", "records"],
        )
        frames, sizes, records, held, serial = [], [], [], 0, serial + 1
        return out

    for b in batches:
        ids, urls, most, alone = (b.column(c).to_pylist() for c in ("page_id", "url", "most", "alone"))
        for i, payload in enumerate(b.column("html").cast(pa.binary())):
            response = alone[i] or ids[i] == most[i]
            data = record(ids[i], urls[i], payload.as_buffer().to_pybytes() if payload.is_valid else b"", response, most[i])
            records.append({"record_id": _id(ids[i]), "frame": len(frames), "offset": len(frame)})
            frame += data
            if len(frame) >= FRAME_BYTES:
                close_frame()
            if held >= BUNDLE_BYTES:
                yield bundle()
    if records:
        yield bundle()


def write(pages: DataFrame, path: str, *, min_bytes: int = 0, indexed: bool = True) -> None:
    """Writes the archive of ``pages`` (page_id, url, html) to ``path``/bundles and, if asked, its index to ``path``/index.

    A null html is empty; a null page id is smaller than any other; rows equal in page id
    and payload are all responses; payloads under ``min_bytes`` are never revisits.  A
    payload of any length is one record in a frame of its own, which a task holds whole.
    Page ids must be integers.  An empty table makes an empty archive; other columns are
    ignored, whatever their names.
    """
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError("page_id must be of an integer type")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(body).alias("digest"))
    most = pages.select(F.sha1(body).alias("digest"), F.col("page_id").cast("long").alias("page_id")).groupBy("digest").agg(F.max("page_id").alias("most"))
    # the largest ids are written before the join, so that the pages of one payload, all empty
    # ones for instance, are a skewed partition that adaptive execution splits
    joined = rows.join(materialize(most, "warc-most"), "digest").select("page_id", "url", "html", "most", (F.octet_length(body) < min_bytes).alias("alone"))
    joined.mapInArrow(_bundles, ARCHIVE).write.option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(f"{path}/bundles")
    if indexed:
        listed = pages.sparkSession.read.schema(ARCHIVE).parquet(f"{path}/bundles").select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset")
        listed.repartitionByRange("record_id").sortWithinPartitions("record_id").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads all bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each record is read at the place that the index has for its identifier, and must have
    that identifier; a frame is unpacked once for all its records.  Every stored payload is checked against its length and digest.  An empty archive has no
    rows; records that repeat have a row each; a null page id comes back null.  A payload of
    any length is held whole by its task, with its frame.
    """

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(ID)
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for content, records in zip(b.column("content"), b.column("records").to_pylist(), strict=True):
                raw = content.as_py()
                got, frames = [], read_seek_table(raw)
                for frame, listed in groupby(records, key=itemgetter("frame")):
                    start, size, length = frames[frame]
                    data = unpack.decompress(raw[start : start + size], max_output_size=length)
                    for place in listed:
                        head, http, payload = next(parse(data, place["offset"], one=True))
                        digest, n, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), head["WARC-Type"]
                        if head["WARC-Record-ID"] != f"<{place['record_id']}>":
                            raise ValueError(f"{place['record_id']} is not where the index has it")
                        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        got.append((number(head["WARC-Record-ID"]), n, digest, kind, number(head.get("WARC-Refers-To"))))
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    archive = spark.read.schema(ARCHIVE).parquet(f"{path}/bundles").select("content", "records")
    return archive.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def fetch(spark: SparkSession, path: str, page_ids: list[int]) -> DataFrame:
    """Random access: by the index to the bundles, and there only the frames that hold the asked records.

    Ids that the archive lacks give no row, repeated records one each; a payload of any
    length comes whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            raws, picks = b.column("content").to_pylist(), b.column("r").to_pylist()
            for raw, pick in zip(raws, picks, strict=True):
                start, size, length = read_seek_table(raw)[pick["frame"]]
                head, _, payload = next(parse(unpack.decompress(raw[start : start + size], max_output_size=length), pick["offset"], one=True))
                yield pa.RecordBatch.from_arrays([pa.array([pick["record_id"]]), pa.array([head["WARC-Type"]]), pa.array([payload], pa.binary())], ["record_id", "record_type", "payload"])

    index = spark.read.schema(INDEX).parquet(f"{path}/index").where(F.col("record_id").isin([_id(p) for p in page_ids]))
    hits = index.collect()  # as many as were asked for, and their repeats
    bundles = spark.read.schema(ARCHIVE).parquet(f"{path}/bundles").select("bundle", "content").where(F.col("bundle").isin(sorted({r["bundle"] for r in hits})))
    picked = F.broadcast(spark.createDataFrame(hits, INDEX)).select("bundle", F.struct("record_id", "frame", "offset").alias("r"))
    return bundles.join(picked, "bundle").select("content", "r").mapInArrow(run, "record_id string, record_type string, payload binary")


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes the archive and its index to the shared folder and reads all records back by their places."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes=min_bytes)
    return read(pages.sparkSession, path)
