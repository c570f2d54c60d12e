"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a few WARC records, then a
skippable frame with the place of every record, then the seek table of the public seekable
format: compressed and full size of each frame. To read one record, find its frame
and offset in the index, sum the frame sizes before it and decompress that frame alone.

Records with equal payloads of at least ``MIN_REVISIT`` bytes are kept once: by the page with
the largest id; the others become revisit records that name it. A NULL payload is
empty, a NULL URL is written as an empty target. Among rows with equal id and payload one is
the response if its id is the largest, the others revisit it by that same id. NULL ids are written
without identifier and are never the page that others refer to unless all are NULL.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recapspark.operators.storage import new_folder, stored

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10  # full size after which a frame is closed
BUNDLE_BYTES = 16 << 20  # compressed size after which a bundle is closed
LEVEL = 3
#: Payload hashes shared by at least this many pages are broadcast; at most ``MAX_HOT`` are.
HOT_ROWS = 10_000
MAX_HOT = 10_000

# Fixed values of the seekable Zstandard format.
_SKIP_INDEX = 0x184D2A50
_SKIP_SEEK = 0x184D2A5E
_SEEK_MAGIC = b"\xb1\xea\x92\x8f"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """All columns of ``pages`` and ``_digest, _bytes, _refers, _revisit``.

    Callers pass the columns of a record alone; others could bear a working name.

    Digests are counted before they meet the pages. Pages of very frequent digests get the answer by
    broadcast and are spread by id in the shuffle join that serves the others.
    """
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = pages.select("*", raw.alias("_raw")).select(
        "*", F.sha1("_raw").alias("_digest"), F.octet_length("_raw").cast("long").alias("_bytes")
    ).drop("_raw")
    long_ones = F.col("_bytes") >= MIN_REVISIT
    again = stored(
        pages.filter(long_ones)
        .groupBy(F.col("_digest").alias("_d"))
        .agg(F.max(id_col).alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1),
        "repeats",
    )
    total = again.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_ROWS, -(-total // MAX_HOT))
    hot = again.filter(F.col("_n") >= least).select("_d", F.col("_keep").alias("_hot"))
    rest = again.filter(F.col("_n") < least).select(
        F.col("_d").alias("_c"), F.col("_keep").alias("_cold"), F.lit(0).alias("_zero")
    )
    served = pages.join(F.broadcast(hot), F.col("_digest") == F.col("_d"), "left")
    is_hot = F.col("_d").isNotNull()
    spread = F.when(is_hot, 1 + F.pmod(F.xxhash64(id_col), F.lit(1 << 30))).otherwise(F.lit(0))
    served = served.withColumn("_spread", spread.cast("int"))
    joined = served.join(
        rest, (F.col("_digest") == F.col("_c")) & (F.col("_spread") == F.col("_zero")), "left"
    )
    refers = F.when(is_hot, F.col("_hot")).otherwise(F.col("_cold"))
    shared = is_hot | F.col("_c").isNotNull()
    return joined.select(*pages.columns, refers.alias("_refers"), shared.alias("_shared")).select(
        *pages.columns,
        "_refers",
        (F.col("_shared") & ~F.col(id_col).eqNullSafe(F.col("_refers"))).alias("_revisit"),
    )


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit=False) -> bytes:
    """One WARC record; a revisit carries the size and digest of the payload but not the payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if revisit:
        head.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(url) -> str:
    return " ".join((url or "").split())


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers and body of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


class Bundle:
    """Collects records; :meth:`close` gives the bytes of the file."""

    def __init__(self):
        self.parts, self.sizes, self.index = [], [], []
        self.open: list[bytes] = []
        self.at = self.written = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id, data: bytes) -> None:
        self.index.append((page_id, len(self.sizes), self.at))
        self.open.append(data)
        self.at += len(data)
        if self.at >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.at))
            self.parts.append(frame)
            self.written += len(frame)
            self.open, self.at = [], 0

    def close(self) -> bytes:
        self._frame()
        places = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        self.parts.append(struct.pack("<II", _SKIP_INDEX, len(places)) + places)
        # the skippable index is a frame of no content to the seek table
        sizes = [*self.sizes, (len(self.parts[-1]), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes)
        table += struct.pack("<IB", len(sizes), 0) + _SEEK_MAGIC
        return b"".join(self.parts) + struct.pack("<II", _SKIP_SEEK, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed size, full size)`` of every frame, from the end of the file."""
    if data[-4:] != _SEEK_MAGIC:
        raise ValueError("no seek table")
    n, flags = struct.unpack("<IB", data[-9:-4])
    width = 12 if flags & 0x80 else 8
    start, at, out = 0, len(data) - 9 - n * width, []
    for i in range(n):
        size, full = struct.unpack_from("<II", data, at + i * width)
        out.append((start, size, full))
        start += size
    return out


def index_of(data: bytes) -> list[tuple]:
    """``(record id, frame, offset in the frame)`` of every record, without unpacking frames."""
    start, size, _ = seek_table(data)[-1]
    packed = data[start + 8 : start + size]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(packed))]


def frame_bytes(data: bytes, frame: int) -> bytes:
    """One frame, unpacked alone."""
    start, size, full = seek_table(data)[frame]
    if not full:
        return b""
    return zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=full)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html") -> None:
    """Write ``pages`` as bundles, one file each, to any store that Spark writes to.

    A task fills its bundles one after the other and holds one at a time. Spark's text writer puts
    each bundle into a file of its own: the row is the bundle without its last four
    bytes, and these, the magic number that ends every seek table, are the line end.
    """
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        "_digest",
        "_refers",
        "_revisit",
    )

    def run(batches):
        bundle = Bundle()
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page, url, payload, digest, refers, revisit = (v.as_py() for v in row)
                bundle.add(page, record(page, url, payload, digest, refers, revisit))
                if bundle.written >= BUNDLE_BYTES:
                    yield _row(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield _row(bundle)

    bundles = rows.mapInArrow(run, "value binary")
    bundles.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", _SEEK_MAGIC.decode("latin-1")).text(path)


def _row(bundle: Bundle) -> pa.RecordBatch:
    data = bundle.close()
    return pa.RecordBatch.from_arrays([pa.array([data[:-4]], pa.binary())], names=["value"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the bundles in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, path, frame, start, size, offset)``: where each record is.

    ``start`` and ``size`` are the bytes of the frame in the file, ``offset`` counts in the
    unpacked frame.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                frames = seek_table(data)
                rows = [(p, name.as_py(), f, *frames[f][:2], o) for p, f, o in index_of(data)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(schema.names, r)) for r in rows], schema=schema
                )

    schema = pa.schema(
        [("record_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()),
         ("start", pa.int64()), ("size", pa.int64()), ("offset", pa.int64())]
    )
    return files(spark, path).mapInArrow(
        run, "record_id long, path string, frame int, start long, size long, offset long"
    )


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record of a folder.

    The digest of a response is worked out from what was read and must agree with its
    header. ``payload=True`` adds the stored bytes (NULL for revisits).
    """

    def page(value):
        return int(value[10:-1]) if value else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                for frame in range(len(seek_table(data))):
                    text, at, rows = frame_bytes(data, frame), 0, []
                    while at < len(text):
                        head, body, at = parse(text, at)
                        kind = head["WARC-Type"]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError("a payload doesn't agree with its digest")
                        rows.append(
                            (
                                page(head.get("WARC-Record-ID")),
                                int(head["X-Payload-Length"]),
                                digest,
                                kind,
                                page(head.get("WARC-Refers-To")),
                                body if payload and kind == "response" else None,
                            )
                        )
                    if rows:
                        columns = list(zip(*rows))[: len(schema)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
                        )

    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("payload", pa.binary())] * payload
    )
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files(spark, path).select("content").mapInArrow(
        run, columns + ", payload binary" * payload
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder and read the archives back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path)
    return read(spark, path)
