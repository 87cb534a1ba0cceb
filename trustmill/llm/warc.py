"""WARC archives of pages: written by Spark, read back with segments put together again.

A page becomes a response record whose block is an HTTP message with chunked transfer framing, or, where an earlier page
has the same payload, a revisit record without one. A block above `segment_bytes` is cut: the first segment keeps the type
and gets segment number 1, the others are continuation records that name its record as their origin, the last one with the
total length. Segments are records of their own, and may come to lie in other archives.

The reader groups segments by their origin, orders them by number, verifies that none is missing and that the lengths add
up, and decodes the framing as they stream by: only one segment is held, unless whole payloads are asked for.

Archives are text files of Spark's own writer, so half-written ones of lost executors are never seen: a row is a record and
the row separator is the two line ends behind it. Each is one gzip stream and read as one row, of at most 2 GB packed; a
task's input and `records` bound it.

Defined results: a null text is an empty payload; a null id comes last among equal payloads; rows that are equal in id, url
and payload are one record, written as often as they are there; very long texts become more segments; an empty table gives
archives without records; extra columns are ignored. A record whose segments, lengths or framing are wrong is returned with
the fault and without a digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, looked_up, materialize

#: The line end, the version line, and the date of all records, as pages have none.
END = b"\r\n"
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
CHUNK_BYTES = 64 << 10
SEGMENT_BYTES = 1 << 20
#: Records of an archive.
RECORDS = 50_000
#: Payloads below this are never revisits.
REVISIT_BYTES = 100
#: Bytes of records that leave a task at once.
BATCH_BYTES = 4 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HEX = re.compile(rb"[0-9A-Fa-f]+")


class Fault(ValueError):
    """What is wrong with a record."""


# ---------------------------------------------------------------- one record


def header(fields: list[tuple[str, object]]) -> bytes:
    """The head of a record or message; fields without a value are left out."""
    return b"".join(f"{k}: {v}".encode() + END for k, v in fields if v is not None) + END


def framed(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + chunk] for k in range(0, len(payload), chunk))) + b"0\r\n\r\n"


def page_records(page: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page: page_id, url, record_id, digest, refers_to, body."""
    revisit = page["refers_to"] is not None
    head = b"HTTP/1.1 200 OK\r\n" + header([("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", None if revisit else "chunked")])
    block = head if revisit else head + framed(page["body"])
    url = None if page["url"] is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", page["url"])
    pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for k, piece in enumerate(pieces):
        cut = len(pieces) > 1
        yield VERSION + END + header([
            ("WARC-Type", "continuation" if k else "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{page['record_id']}>" if not k else f"<urn:x-segment:{page['record_id']}:{k + 1}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", None if k else page["page_id"]),
            ("WARC-Payload-Digest", None if k else f"sha256:{page['digest']}"),
            ("WARC-Refers-To", f"<urn:uuid:{page['refers_to']}>" if revisit else None),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Segment-Origin-ID", f"<urn:uuid:{page['record_id']}>" if k else None),
            ("WARC-Segment-Number", k + 1 if cut else None), ("WARC-Segment-Total-Length", len(block) if cut and k + 1 == len(pieces) else None),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(piece)),
        ]) + piece


class Stream:
    """Bytes of a gzip or plain archive, some at a time."""

    def __init__(self, data: bytes, step: int = 1 << 20) -> None:
        self.data, self.step, self.at, self.held = data, step, 0, bytearray()
        self.unpack = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.rest = b""

    def more(self) -> bool:
        """Gets the next bytes; false at the end. Members of a gzip file follow each other."""
        while self.at < len(self.data) or self.rest:
            part = self.rest or self.data[self.at : self.at + self.step]
            if not self.rest:
                self.at += len(part)
            self.rest = b""
            if self.unpack is not None:
                if self.unpack.eof:
                    self.unpack = zlib.decompressobj(31)
                out = self.unpack.decompress(part, self.step)
                self.rest = self.unpack.unconsumed_tail or self.unpack.unused_data
                part = out
            if part:
                self.held += part
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before mark, which is taken too; None at the end."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields in lower case; lines that go on are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive."""
    stream = Stream(data)
    while True:
        line = stream.until(END)
        if line is None:
            return
        if not line.startswith(b"WARC/"):  # line ends between records
            continue
        fields = fields_of(stream.until(END + END) or b"")
        yield fields, stream.take(int(fields.get("content-length", 0)))


class Message:
    """Decodes the blocks of one HTTP message as they come, and hashes or keeps its payload."""

    def __init__(self, keep: bool) -> None:
        self.held, self.mode, self.left = bytearray(), "head", 0
        self.size, self.hash, self.kept = 0, hashlib.sha256(), [] if keep else None

    def put(self, data: bytes) -> None:
        self.size += len(data)
        self.hash.update(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, block: bytes) -> None:
        self.held += block
        while True:
            if self.mode == "body":
                self.put(bytes(self.held))
                self.held.clear()
            if self.mode == "chunk" and self.held:
                part = bytes(self.held[: self.left])
                del self.held[: self.left]
                self.put(part)
                self.left -= len(part)
                if not self.left:
                    self.mode = "after"
            mark = END + END if self.mode == "head" else END
            at = self.held.find(mark)
            if self.mode in ("body", "chunk") or at < 0:
                return
            line = bytes(self.held[:at])
            del self.held[: at + len(mark)]
            if self.mode == "head":
                self.mode = "size" if "chunked" in fields_of(line).get("transfer-encoding", "").lower() else "body"
            elif self.mode == "after":
                if line:
                    raise Fault("a chunk is longer than its size")
                self.mode = "size"
            elif self.mode == "size":
                size = _HEX.match(line)
                if not size:
                    raise Fault("a chunk has no size")
                self.left = int(size[0], 16)
                self.mode = "chunk" if self.left else "trailer"
            elif self.mode == "trailer" and not line:
                self.mode = "end"

    def close(self) -> None:
        if self.mode not in ("body", "end"):
            raise Fault("the message ends early")


# ---------------------------------------------------------------- Spark


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records: int = RECORDS) -> None:
    """Writes archives of at most so many records to path: of equal payloads of at least `REVISIT_BYTES` the one with the least id is a response, the others revisit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                page = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                for record in page_records(page, segment_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
            yield pa.record_batch([pa.array(held, pa.binary())], ["record"])
        give_back()

    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    x = x.withColumn("digest", F.sha2("body", 256))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("digest"), F.coalesce(F.concat(F.lit("="), "url"), F.lit("-"))))
    x = x.withColumn("record_id", F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first")
    shared = x.filter(F.length("body") >= REVISIT_BYTES).groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.record_id").alias("to"))
    x = looked_up(x, ["digest"], shared, F.xxhash64("record_id"))
    x = x.select("page_id", "url", "record_id", "digest", F.when(F.col("to") != F.col("record_id"), F.col("to")).alias("refers_to"), F.when(F.coalesce(F.col("to") == F.col("record_id"), F.lit(True)), F.col("body")).alias("body"))
    lines = x.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=records).text(path)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each logical record: record_id, page_id, url, record_type, refers_to (a record), refers_to_page, payload_bytes, payload_digest, fault (null: none), [payload].

    A revisit has the size and digest of the payload that it refers to.
    """
    names = ["record_id", "page_id", "url", "record_type", "refers_to", "stated", "payload_bytes", "payload_digest", "fault", "payload", "segment", "total", "block"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    schema = "record_id string, page_id long, url string, record_type string, refers_to string, stated string, payload_bytes long, payload_digest string, fault string, payload binary, segment long, total long, block binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def decoded(head: tuple, message: Message, fault: str | None) -> tuple:
        if head[3] == "revisit" and fault is None:
            return (*head, None, None, None, None, None, None, None)
        digest = None if fault else message.hash.hexdigest()
        if digest and head[5] and head[5] != f"sha256:{digest}":
            digest, fault = None, "the digest is another one"
        return (*head, message.size, digest, fault, b"".join(message.kept) if message.kept is not None and not fault else None, None, None, None)

    def single(block: bytes, head: tuple) -> tuple:
        message, fault = Message(payloads), None
        try:
            message.feed(block)
            message.close()
        except Fault as e:
            fault = str(e)
        return decoded(head, message, fault)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(content.as_py()):
                    kind, number = fields.get("warc-type"), fields.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page = fields.get("page-id", "")
                    head = (fields.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id"), int(page) if page.lstrip("-").isdigit() else None, fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"), fields.get("warc-payload-digest"))
                    if len(block) != int(fields.get("content-length", 0)):
                        rows.append((*head, None, None, "the record ends early", None, None, None, None))
                    elif number is None:
                        rows.append(single(block, head))
                    else:
                        rows.append((*head, None, None, None, None, int(number), int(fields.get("warc-segment-total-length", -1)), block))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)
            give_back()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a record, in order, equal ones beside each other: as many records leave as its first segment is there."""
        now = head = message = None
        copies = last = length = total = 0
        fault: str | None = None

        def leave() -> pa.RecordBatch:
            problem = fault or ("the last segment is missing" if total < 0 else f"segments add up to {length} bytes of {total}" if length != total else None)
            if problem is None:
                try:
                    message.close()
                except Fault as e:
                    problem = str(e)
            return batch_of([decoded(head, message, problem)] * max(1, copies))

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
                *own, number, size, block = (x.as_py() for x in (*row[:6], *row[10:13]))
                if own[0] != now:
                    if now is not None:
                        yield leave()
                    now, head, message, copies, last, length, total, fault, before = own[0], tuple(own), Message(payloads), 0, 0, 0, -1, None, b""
                copies += number == 1
                if number == last:
                    fault = fault or (None if block == before else f"segment {number} is there twice")
                    continue
                if number != last + 1:
                    fault = fault or f"segment {last + 1} is missing"
                last, length, before = number, length + len(block), block
                total = max(total, size)
                if fault is None:
                    try:
                        message.feed(block)
                    except Fault as e:
                        fault = str(e)
        if now is not None:
            yield leave()
        give_back()

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    found = materialize(archives.mapInArrow(unpack, schema), "records")
    segments = found.filter(F.col("segment").isNotNull()).repartition("record_id").sortWithinPartitions("record_id", "segment")
    whole = found.filter(F.col("segment").isNull()).unionByName(segments.mapInArrow(joined, schema))
    whole = materialize(whole.drop("segment", "total", "block"), "whole")
    first = lambda c: F.first(c).alias(f"of_{c.removeprefix('payload_')}")
    of = whole.filter("record_type = 'response' AND fault IS NULL").groupBy(F.col("record_id").alias("refers_to")).agg(*map(first, ["page_id", "payload_bytes", "payload_digest", *["payload"] * payloads]))
    out = looked_up(whole.filter("record_type = 'revisit'"), ["refers_to"], of, F.xxhash64("record_id"))
    out = out.unionByName(whole.filter("record_type <> 'revisit'"), allowMissingColumns=True)
    lost = (F.col("record_type") == "revisit") & F.col("fault").isNull() & F.col("of_digest").isNull()
    columns = [F.col("of_page_id").alias("refers_to_page"), F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "of_digest").alias("payload_digest")]
    return out.select("record_id", "page_id", "url", "record_type", "refers_to", *columns, F.when(lost, "what it refers to is missing").otherwise(F.col("fault")).alias("fault"), *([F.coalesce("payload", "of_payload").alias("payload")] if payloads else []))

