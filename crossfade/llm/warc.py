"""WARC archives: segmented records, written and put together again.

The writer turns rows into records of gzipped archives in the shared folder. A
payload that later pages hold as well is not repeated: the row with the largest
id is the ``response``, the others are ``revisit`` records that refer to it.
Response bodies have chunked transfer framing; a block longer than
``segment_bytes`` is cut into a first record and ``continuation`` records.

The reader streams each archive, record by record. Whole records are decoded
where they are read. Segments are grouped by the identifier of their origin,
sorted by segment number, verified against the total length and decoded; only
they are shuffled, and a task holds one payload at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
#: Where archives are cut. No start of it is an end of it: Hadoop's reader of lines
#: misses a delimiter with such a border at the edges of its buffers.
_MARK = _VERSION
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END
_CONTROL = re.compile(rb"[\x00-\x1f\x7f]")
_SIZE = re.compile(rb"[0-9A-Fa-f]+")
#: Bytes within which a record's head has to end.
_HEAD = 1 << 20
#: Bytes a task gathers before it passes them on.
_BATCH = 1 << 22

RECORDS = "origin string, segment int, total bigint, type string, uri string, refers_to string, digest string, intact boolean, block binary"
PAYLOADS = "record_id string, type string, uri string, refers_to string, segments int, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def base32_sha1(payload: bytes) -> str:
    """The digest as archives state it, without its label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes, chunk_bytes: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = (payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken.

    Extensions of a chunk's size and trailing fields are passed over.
    """
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = _SIZE.match(body, at, line) if line >= 0 else None
        if size is None or body[size.end() : line].lstrip()[:1] not in (b"", b";"):
            return None
        n, at = int(size[0], 16), line + 2
        if not n:
            rest = body[at:]
            return b"".join(parts) if rest == b"\r\n" or rest.endswith(_END) else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def decoded(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None if it can't be read."""
    end = block.find(_END)
    if end < 0:
        return None
    fields = dict(_fields(block[:end]))
    body = block[end + 4 :]
    return unframed(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _fields(head: bytes) -> Iterator[tuple[str, str]]:
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            yield name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")


def _record(fields: list[tuple[bytes, bytes | None]], block: bytes) -> bytes:
    head = b"".join(b"%b: %b\r\n" % (name, _CONTROL.sub(lambda c: b"%%%02X" % c[0][0], value)) for name, value in fields if value is not None)
    return b"%b%bContent-Length: %d\r\n\r\n%b" % (_VERSION, head, len(block), block)


def _written(own: bytes, url: bytes | None, payload: bytes, refers_to: bytes | None, date: bytes, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one row."""
    digest = b"sha1:" + base32_sha1(payload).encode()
    named = [(b"WARC-Record-ID", b"<%b>" % own), (b"WARC-Target-URI", url), (b"WARC-Date", date), (b"WARC-Payload-Digest", digest)]
    http = (b"Content-Type", b"application/http;msgtype=response")
    if refers_to is not None:
        refers = [(b"WARC-Refers-To", b"<%b>" % refers_to), (b"WARC-Profile", _PROFILE)]
        yield _record([(b"WARC-Type", b"revisit"), *named, *refers, http], _HTTP)
        return
    block = _HTTP + framed(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [(b"WARC-Segment-Number", b"1")] if len(parts) > 1 else []
    yield _record([(b"WARC-Type", b"response"), *named, *first, http], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = b"%d" % len(block) if number == len(parts) else None
        origin = [(b"WARC-Segment-Origin-ID", b"<%b>" % own), (b"WARC-Segment-Number", b"%d" % number), (b"WARC-Segment-Total-Length", total)]
        yield _record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<%b/%d>" % (own, number)), (b"WARC-Date", date), *origin], part)


def _batches(rows: Iterator[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + len(row[at] or b"")
        if size >= _BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def name_of(id_column: Column) -> Column:
    """The name of the row with this id, which ``refers_to`` holds; a record's own id adds where it was written."""
    return F.concat(F.lit("urn:page:"), id_column.cast("string"))


def id_of(name: Column) -> Column:
    """The row's id out of a name or a record's id; NULL if it had none."""
    found = F.regexp_extract(name, r"^urn:page:(-?[0-9]+)", 1)
    return F.when(found != "", found).cast("bigint")


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    segment_bytes: int = 8192,
    chunk_bytes: int = 4096,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a record per row of ``pages`` into archives below ``path``, one archive for each task.

    NULL payloads are empty, strings are written in UTF-8. Of rows with one
    payload of ``least_bytes`` or more, that with the largest id is a response
    and those with another id (or NULL) revisit it; rows that repeat its id are
    responses as well, and so are all rows of a payload without any id. Control
    characters in URLs are percent-encoded; a NULL URL is left out. Other
    columns aren't read. An empty table writes no record.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").cast("binary").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("mark", F.sha1("payload"))
    # narrow: of payloads that several ids hold, the largest id
    shared = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("mark")
    shared = shared.agg(F.max("id").alias("latest"), (F.count_if(F.col("id").isNull()) > 0).alias("unnamed"), F.min("id").alias("first"))
    shared = shared.filter(F.col("unnamed") | (F.col("first") < F.col("latest"))).filter(F.col("latest").isNotNull())
    shared = _staged(shared.select(F.col("mark").alias("shared"), "latest"), path)
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("latest")), name_of(F.col("latest")).cast("binary"))
    rows = rows.join(shared, F.col("mark") == F.col("shared"), "left").select("id", "url", "payload", refers.alias("refers_to"))
    schema = pa.schema([("value", pa.binary())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()

        def records() -> Iterator[tuple[bytes]]:
            n = 0
            for batch in batches:
                for own, url, body, refers_to in zip(*(batch.column(i) for i in range(4))):
                    if not n:
                        yield (_record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:archive:%d>" % partition), (b"WARC-Date", date.encode())], b""),)
                    label = b"" if own.as_py() is None else b"%d" % own.as_py()
                    name = b"urn:page:%b#%d.%d" % (label, partition, n)
                    n += 1
                    for record in _written(name, url.as_py(), body.as_py(), refers_to.as_py(), date.encode(), segment_bytes, chunk_bytes):
                        yield (record,)

        yield from _batches(records(), schema, 0)

    # the bytes as they are: a string here is no more than what the text writer takes
    found = rows.mapInArrow(compute, "value binary").select(F.col("value").cast("string").alias("value"))
    found.write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def _staged(df: DataFrame, path: str) -> DataFrame:
    """A small table beside the archives, so that its size decides how it is joined."""
    beside = f"{path.rstrip('/')}-shared"
    df.write.parquet(beside)
    return df.sparkSession.read.schema(df.schema).parquet(beside)


_RECORD_TYPES = pa.schema(
    [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string())]
    + [("digest", pa.string()), ("intact", pa.bool_()), ("block", pa.binary())]
)
_PAYLOAD_TYPES = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("segments", pa.int32())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())]
)


def _whole(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """``(record, intact)`` of one archive that was cut at every mark.

    A record may hold the mark itself; pieces are joined until it has its stated
    length. What stands before the first mark counts for nothing.
    """
    held: list[bytes] = []
    size, due = 0, None

    def closed() -> tuple[bytes, bool]:
        record = _MARK.join(held)
        end = len(record) if due is None else due
        return record[:end], due is not None and size >= due and not record[end:].strip(b"\r\n")

    next(pieces, None)
    for piece in pieces:
        if held and (size < due if due is not None else size <= _HEAD):
            held.append(piece)
            size += len(_MARK) + len(piece)
        else:
            if held:
                yield closed()
            held, size, due = [piece], len(piece), None
        if due is None and size <= _HEAD:
            due = _due(_MARK.join(held))
    if held:
        yield closed()


def _due(head: bytes) -> int | None:
    """The bytes that a record has to have, from its head; None if that isn't all there."""
    end = head.find(_END)
    if end < 0:
        return None
    return end + 4 + (_number(dict(_fields(head[:end])).get("content-length")) or 0)


def _bare(name: str | None) -> str | None:
    return name.removeprefix("<").removesuffix(">") if name else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def _parsed(record: bytes, intact: bool) -> tuple:
    """A row of :data:`RECORDS`."""
    end = record.find(_END)
    fields = dict(_fields(record[:end])) if end >= 0 else {}
    kind, segment = fields.get("warc-type"), _number(fields.get("warc-segment-number"))
    origin = _bare(fields.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id"))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    total = _number(fields.get("warc-segment-total-length"))
    block = record[end + 4 :] if end >= 0 else b""
    return origin, segment, total, kind, fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), digest, intact and end >= 0, block


def records(spark: SparkSession, path: str) -> DataFrame:
    """:data:`RECORDS` of the gzipped archives below ``path``, one row per record.

    ``origin`` is the record's own id, or that of its first segment. A record
    that is shorter or longer than it says isn't ``intact``. An archive is
    streamed by one task, a record at a time. No archive gives no rows.
    """
    lines = spark.read.option("lineSep", _MARK.decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), v.as_py()) for b in batches for f, v in zip(b.column(0), b.column(1)))
        found = (_parsed(r, ok) for _, run in groupby(pieces, key=lambda p: p[0]) for r, ok in _whole(v for _, v in run))
        yield from _batches(found, _RECORD_TYPES, 8)

    return lines.mapInArrow(read, RECORDS)


def _assembled(rows: Iterator[tuple]) -> tuple:
    """A row of :data:`PAYLOADS` of the segments of one origin, in order."""
    first, held, number, size, total, intact, after = None, [], 0, 0, None, True, None
    for row in rows:
        origin, segment, stated, kind, _, _, _, whole, block = row
        segment = 1 if segment is None else segment
        if first is None:
            first = row
        if segment == number and block == after:
            continue  # a segment that was stored twice
        intact = intact and whole and segment == number + 1 and (kind == "continuation") == (number > 0)
        number, after, size = segment, block, size + len(block)
        total = stated if stated is not None else total
        held = [*held, block] if number == 1 else held
        if number > 1:
            held.append(block)
        if not intact:
            held = []
    origin, segment, _, kind, uri, refers_to, digest, _, _ = first
    # what says it is segmented has to have its last segment, which knows the length
    intact = intact and (total == size if segment is not None else total is None)
    if kind != "response":
        return origin, kind, uri, refers_to, number, None, digest, intact and kind != "continuation", None
    payload = decoded(b"".join(held)) if intact else None
    if payload is None:
        return origin, kind, uri, refers_to, number, None, digest, False, None
    found = base32_sha1(payload)
    return origin, kind, uri, refers_to, number, len(payload), found, digest in (None, found), payload


def payloads(found: DataFrame, keep: bool = True) -> DataFrame:
    """:data:`PAYLOADS` of rows of :func:`records`: one row per record, its segments put together.

    A response is ``intact`` if its segments are numbered without a gap from its
    first, sum up to the total length that the last one states, hold a body
    whose framing is right, and have the digest they state; a segment stored
    twice counts once. Otherwise ``payload`` is NULL, and the other columns say
    what is known. Records of other types have the stated digest and no
    payload. Continuations without an origin are rows of their own, never
    intact. ``keep`` set to False leaves ``payload`` NULL.
    """
    segmented = F.col("segment").isNotNull() & F.col("origin").isNotNull()
    alone = found.filter(~segmented)
    several = found.filter(segmented).repartition("origin").sortWithinPartitions("origin", "segment", "type", "block")

    def grouped(batches: Iterator[pa.RecordBatch], together: bool) -> Iterator[pa.RecordBatch]:
        rows = (tuple(v.as_py() for v in row) for b in batches for row in zip(*b.columns))
        runs = (run for _, run in groupby(rows, key=lambda r: r[0])) if together else ([row] for row in rows)
        put = (_assembled(run) for run in runs)
        put = put if keep else ((*row[:-1], None) for row in put)
        yield from _batches(put, _PAYLOAD_TYPES, 8)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, False)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, True)

    return alone.mapInArrow(one, PAYLOADS).unionByName(several.mapInArrow(many, PAYLOADS))


def resolved(found: DataFrame) -> DataFrame:
    """Rows of :func:`payloads` in which revisits have the ``payload_bytes`` of what they refer to.

    A revisit whose response isn't there, or has another digest, isn't intact and
    has no size. ``found`` is read twice; payloads aren't carried along.
    """
    found = found.drop("payload")
    revisit = F.col("type") == "revisit"
    there = found.filter((F.col("type") == "response") & F.col("intact"))
    there = there.groupBy(F.substring_index("record_id", "#", 1).alias("name"), F.col("payload_digest").alias("theirs")).agg(F.max("payload_bytes").alias("size"))
    met = (F.col("refers_to") == F.col("name")) & (F.col("payload_digest") == F.col("theirs"))
    again = found.filter(revisit).drop("payload_bytes").join(there, met, "left").withColumnRenamed("size", "payload_bytes")
    again = again.withColumn("intact", F.col("intact") & F.col("payload_bytes").isNotNull())
    return found.filter(~F.coalesce(revisit, F.lit(False))).unionByName(again.select(*found.columns))
