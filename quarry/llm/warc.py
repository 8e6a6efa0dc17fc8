"""WARC archives: a writer of gzip members, and a reader that splits archives at any byte.

Writing: each task writes the records of its rows to archives of its own, one gzip member a record, and gives back a row per archive
(path, bytes, records). Those rows, once written, are the archives that count: what a task that was lost has left is never
read. Of equal payloads only one is stored; the others are revisit records that name it.

Reading: archives are cut into byte ranges, many to a task. A task looks for gzip magic from the start of its range, takes a place for
a record only if the member decodes (with its checksum), its text begins with a WARC version, and what follows it is the end or
another member, and owns the records that start inside its range; the last one may end beyond it. So every record has one owner,
wherever the cuts fall. Any archive whose members are records can be read, not only those written here.

Scale: the digest of a payload is grouped with partial aggregation and only digests of several rows are kept and written; the join that
tells copies then has them on its small side and plain exchanges, so AQE splits a payload that a third of all pages share. Payloads
shorter than the limit are never joined. Archives are in the folder given (or the shared one); tasks reach it by its URI.

Defined results: a null payload is empty; payloads below `revisit_from` bytes are always stored; of equal ones that with the smallest id is
stored (rows that repeat this id with this payload are stored too) and null ids come last; a null URL has no header, and control
characters and spaces in one are percent-encoded; an empty table gives no archive. Members cut off by the end of a file are no records. A record is held
in memory whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes of a range, and of what is read at a time.
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20
_PIECE = 16 << 10
_WRITTEN = "path string, bytes long, records long"
_RECORDS = "record_type string, record_id string, url string, refers_to string, declared_digest string, payload binary"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _clean(url: str | None) -> str | None:
    """A URL that can stand in a header."""
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_of(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit of the response of page `refers_to`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _urn(refers_to) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _info() -> bytes:
    block = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _header(fields) + block + b"\r\n\r\n"


def _archived(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        task, out, path, size, records = TaskContext.get().partitionId(), None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for at in range(batch.num_rows):
                page, url, payload, digest, refers_to, revisit = (batch.column(c)[at].as_py() for c in range(6))
                if out is None:
                    name = f"part-{task:05d}-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out, path, first = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", _member(_info())
                    size, records = out.write(first), 0
                size, records = size + out.write(_member(record_of(page, url, payload, digest, refers_to, revisit))), records + 1
                if size >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 100, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes a record per row and returns a row per archive: path, bytes, records."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("shared", F.octet_length("payload") >= revisit_from)
    firsts = rows.where("shared").groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("n > 1").select(F.col("digest").alias("key"), "first"), "warc-shared")
    keyed = rows.withColumn("key", F.when(F.col("shared"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit("")))))
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    dealt = keyed.join(firsts, "key", "left").select("page", "url", "payload", "digest", "first", revisit.alias("revisit"))
    return materialize(dealt.mapInArrow(_archived(folder, archive_bytes), _WRITTEN), "warc-archives")


class _Window:
    """Bytes of a file by place, read in blocks."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from `place` on, fewer at the end of the file."""
        n = min(n, self.size - place)
        if n <= 0:
            return b""
        if place < self.base or place + n > self.base + len(self.held):
            self.file.seek(place)
            self.base, self.held = place, self.file.read(max(n, _BLOCK))
        return self.held[place - self.base : place - self.base + n]

    def find_magic(self, place: int, end: int) -> int:
        """The first place from `place` on and before `end` where a member may start, or -1."""
        end = min(end, self.size)
        while place < end:
            held = self.at(place, min(_BLOCK, end - place + len(MAGIC) - 1))
            found = held.find(MAGIC)
            if found >= 0:
                return place + found if place + found < end else -1
            place += max(1, len(held) - len(MAGIC) + 1)
        return -1


def _decoded(window: _Window, place: int) -> tuple[bytes, int] | None:
    """The text of the record that starts at `place`, and the place after it; None if none starts there."""
    unpack, parts, at, begun = zlib.decompressobj(31), [], place, False
    try:
        while not unpack.eof:
            piece = window.at(at, _PIECE)
            if not piece:
                return None
            at += len(piece)
            parts.append(unpack.decompress(piece))
            if not begun and sum(map(len, parts)) >= 5:
                parts, begun = [b"".join(parts)], True
                if not parts[0].startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    at -= len(unpack.unused_data)
    after = window.at(at, len(MAGIC))
    return (b"".join(parts), at) if begun and (at >= window.size or after == MAGIC) else None


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload; the payload of an HTTP message is what follows its own headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {k.strip().lower(): v.strip() for k, _, v in fields}
    length = headers.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    if headers.get("content-type", "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def _owned(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that start within a range of bytes."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        window = _Window(file, file.size())
        place = window.find_magic(start, end)
        while 0 <= place < end:
            found = _decoded(window, place)
            if found is None:
                place = window.find_magic(place + 1, end)
                continue
            yield parsed(found[0])
            place = window.find_magic(found[1], end) if found[1] < end else -1


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())])
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
    rows, held = [], 0
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            for headers, payload in _owned(path, start, end):
                rows.append((*(headers.get(n) for n in names), payload))
                held += len(payload) + 500
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that something else wrote: path, bytes. Their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives (path, bytes): record_type, record_id, url, refers_to, declared_digest, payload."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = archives.where("bytes > 0").select("path", starts.alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + split_bytes).alias("end"))
    return ranges.repartition(parts, "path", "start").mapInArrow(_records, _RECORDS)


def page_of(urn: str) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def index_of(records: DataFrame) -> DataFrame:
    """One row per page of archives written here: page, url, record_type, refers_to, payload_bytes, payload_digest. Those of a revisit are of the response that
    it names; null if no response has both its id and its digest."""
    of_pages = records.where(F.col("record_type").isin("response", "revisit"))
    declared = F.regexp_extract("declared_digest", "^sha256:([0-9a-f]{64})$", 1)
    own = F.col("record_type") == "response"
    digest = F.when(own, F.sha2("payload", 256)).otherwise(declared)
    narrow = of_pages.select(
        page_of("record_id").alias("page"), "url", "record_type", page_of("refers_to").alias("refers_to"), digest.alias("digest"), F.when(own, F.octet_length("payload").cast("long")).alias("bytes")
    )
    narrow = materialize(narrow, "warc-records")
    stored = narrow.where("record_type = 'response'").groupBy(F.col("page").alias("refers_to"), "digest").agg(F.max("bytes").alias("stored_bytes"))
    revisits = narrow.where("record_type = 'revisit'").join(stored, ["refers_to", "digest"], "left")
    revisits = revisits.select("page", "url", "record_type", "refers_to", F.col("stored_bytes").alias("payload_bytes"), F.when(F.col("stored_bytes").isNotNull(), F.col("digest")).alias("payload_digest"))
    responses = narrow.where("record_type = 'response'").select("page", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    return responses.unionByName(revisits)
