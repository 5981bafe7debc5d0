"""WARC archives as seekable Zstandard bundles (operator 4).

Records are grouped into frames that decompress on their own; behind the last
frame a skippable frame holds the seek table of the public Zstandard seekable
format.  An index maps each record to its bundle, frame and place in the
frame's decompressed bytes, so that one record costs one frame.

Bundles are rows of a table: Spark's writers commit them, whatever store the
shared folder is in, and lost executors cost nothing but time.  ``export``
writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
#: A date must be in every record; archives made twice shall be equal.
DATE = "1970-01-01T00:00:00Z"

_INDEX = "array<struct<record_id:string,frame:int,frame_start:bigint,frame_length:bigint,start:bigint,length:bigint>>"
BUNDLES = f"bundle_id string, content binary, records {_INDEX}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that names the record it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Builds one bundle from records given in turn."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level)
        self._frame_bytes = frame_bytes
        self._frames: list[bytes] = []
        self._table: list[tuple[int, int]] = []
        self._open: list[tuple[str, bytes]] = []
        self._open_bytes = 0
        self.written = 0
        self.index: list[dict] = []

    def add(self, record_id: str, data: bytes) -> None:
        self._open.append((record_id, data))
        self._open_bytes += len(data)
        if self._open_bytes >= self._frame_bytes:
            self._close_frame()

    def size(self) -> int:
        return self.written + self._open_bytes

    def _close_frame(self) -> None:
        if not self._open:
            return
        raw = b"".join(d for _, d in self._open)
        frame = self._zstd.compress(raw)
        at = 0
        for record_id, d in self._open:
            self.index.append({"record_id": record_id, "frame": len(self._frames), "frame_start": self.written, "frame_length": len(frame), "start": at, "length": len(d)})
            at += len(d)
        self._frames.append(frame)
        self._table.append((len(frame), len(raw)))
        self.written += len(frame)
        self._open, self._open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self._table)
        footer = struct.pack("<IBI", len(self._table), 0, _SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    begin = len(content) - 9 - n * width
    out, at = [], 0
    for i in range(n):
        packed, raw = struct.unpack_from("<II", content, begin + i * width)
        out.append((at, packed, raw))
        at += packed
    return out


def read_record(content: bytes, frame: int, start: int, length: int) -> bytes:
    """One record; only its frame is decompressed."""
    import zstandard

    at, packed, raw = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=raw)[start : start + length]


def _record_id(page_id, copy: str = "") -> str:
    """The name of a page's record; ``copy`` tells rows of one id apart."""
    own = "urn:null-page" if page_id is None else "urn:page:" + quote(str(page_id), safe="")
    return f"{own}#{copy}" if copy else own


def page_of(record_id: Column) -> Column:
    """The page id, as a string, of a record's name; null for that of a null id."""
    return F.when(record_id.startswith("urn:page:"), F.url_decode(F.regexp_extract(record_id, "^urn:page:([^#]*)", 1)))


def mark_rows(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page, digest, refers_to, again) of the rows that revisit another page,
    or whose id is that of several rows.

    Of the rows with equal payloads of at least ``least_bytes`` bytes those
    with the smallest id are responses (null ids come last); the digests that
    occur once never leave the first aggregation.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    seen = pages.select(F.col(f"`{id_col}`").alias("page"), F.sha1(payload).alias("digest"), F.length(payload).alias("bytes"))
    long = seen.where(F.col("bytes") >= least_bytes)
    first = long.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = long.join(first, "digest").where("not (page <=> first)").select("page", "digest", F.col("first").alias("refers_to"), F.lit(False).alias("again"))
    many = seen.groupBy("page").count().where("count > 1").select(F.col("page").alias("p"))
    again = seen.join(small_side(many), F.col("page").eqNullSafe(F.col("p"))).select("page", "digest", F.lit(None).cast(seen.schema["page"].dataType).alias("refers_to"), F.lit(True).alias("again"))
    return revisits.unionByName(again).groupBy("page", "digest").agg(F.max("refers_to").alias("refers_to"), F.max("again").alias("again"))


def write_bundles(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles: a table (bundle_id, content,
    records) in the shared folder.

    A null payload is empty.  Each record has a name of its own: ``urn:page:``
    and the id, ``urn:null-page`` for a null id, and where several rows have
    one id, the place where the row was written behind that; a revisit names
    the page that it refers to by its id, whatever rows have that.  Rows that
    repeat an id and a payload are all responses, or all revisits.  Other
    columns are not read."""
    marks = mark_rows(pages, least_bytes, id_col, payload_col)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(marks.withColumnRenamed("page", "p").withColumnRenamed("digest", "d"), F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    index = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_length", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(w: BundleWriter) -> pa.RecordBatch:
            content = w.finish()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary()), pa.array([w.index], index)], names=["bundle_id", "content", "records"])

        w, n = BundleWriter(frame_bytes), 0
        for b in batches:
            page, url, body, refers, again = (b.column(i) for i in range(5))
            for i in range(b.num_rows):
                r = refers[i].as_py()
                n += 1
                record_id = _record_id(page[i].as_py(), f"{TaskContext.get().partitionId()}-{n}" if again[i].as_py() else "")
                w.add(record_id, record_bytes(record_id, url[i].as_py(), body[i].as_py(), None if r is None else _record_id(r)))
                if w.size() >= bundle_bytes:
                    yield done(w)
                    w = BundleWriter(frame_bytes)
        if w.size():
            yield done(w)

    return materialize(rows.select("page", "url", "payload", "refers_to", "again").mapInArrow(bundles, BUNDLES), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Read every record back by seek table and index, as (record_id,
    record_type, refers_to, url, payload_bytes, payload_digest, bundle_id,
    frame, start, length).  A response's digest is computed from its payload
    and must equal its header."""
    ddl = "record_id string, record_type string, refers_to string, url string, payload_bytes bigint, payload_digest string, bundle_id string, frame int, start bigint, length bigint"
    types = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ddl.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                bundle_id, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                table = seek_table(content)
                out, frame, raw = [], -1, b""
                for x in b.column(2)[i].as_py():
                    if x["frame"] != frame:
                        frame = x["frame"]
                        at, packed, size = table[frame]
                        raw = zstd.decompress(content[at : at + packed], max_output_size=size)
                    fields, http, payload = parse_record(raw[x["start"] : x["start"] + x["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have the digest of its header")
                    refers = fields.get("WARC-Refers-To")
                    out.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], refers and refers[1:-1], fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, bundle_id, frame, x["start"], x["length"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return bundles.mapInArrow(records, ddl)


def find_records(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, url, payload) of the records that a
    column ``record_id`` names: the index tells their frames, and no other
    frame is decompressed.  A revisit's payload is empty."""
    wanted = record_ids.select("record_id").where("record_id is not null").distinct()
    places = bundles.select("bundle_id", F.inline("records")).join(small_side(wanted), "record_id")
    places = places.groupBy("bundle_id").agg(F.collect_list(F.struct("frame", "start", "length")).alias("places"))  # at most a bundle's records
    found = bundles.select("bundle_id", "content").join(small_side(places), "bundle_id").select("content", "places")
    ddl = "record_id string, record_type string, refers_to string, url string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content, at in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = content.as_py()
                for x in at:
                    fields, _, payload = parse_record(read_record(raw, x["frame"], x["start"], x["length"]))
                    refers = fields.get("WARC-Refers-To")
                    out.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], refers and refers[1:-1], fields.get("WARC-Target-URI"), payload))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["record_id", "record_type", "refers_to", "url", "payload"])

    return found.mapInArrow(read, ddl)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<bundle_id>.warc.zst`` into a folder that all
    executors share, by renaming whole files; (bundle_id, path) of all files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.{os.getpid()}", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["bundle_id", "path"])

    return materialize(bundles.select("bundle_id", "content").mapInArrow(write, "bundle_id string, path string"), "exported")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages into bundles and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    kind = pages.schema["page_id"].dataType
    got = read_bundles(write_bundles(pages, least_bytes))
    return got.select(
        page_of(F.col("record_id")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).cast(kind).alias("refers_to"),
    )
