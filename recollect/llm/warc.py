"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Records longer than a segment are cut into a first segment and continuation records,
which may lie in any archive of the folder. The reader parses archives side by side,
groups the segments of a record by its origin identifier, orders them by number, checks
that none is missing and that the total length is the one stated, and only then decodes
the HTTP message and its chunked framing.

Archives are written and read through Spark alone, so any store that Spark reaches will
do. Each record is a gzip member of its own, so other tools can seek in them; between them
stands an empty member, as the text writer puts something after each row. An archive is at most
``records_per_file`` records of ``segment_bytes`` each and begins with a warcinfo record: a
task holds one archive or one page, never more.

The reader takes archives as they come: header names in any case, with or without a space
after the colon, unknown record types, members or records that are cut or altered. What it
can't read it passes over, to the next record that it finds, and counts (``archive_report``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16_384, 4_096, 2_048
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 100

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_END = b"\r\n\r\n"
_INFO = b"software: recollect\r\nformat: WARC File Format 1.1\r\n"
#: Digits of a length or number in a header.
_MOST_DIGITS = 18


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (4 at least) that keep UTF-8 characters whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in _cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(piece)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message, its chunked framing decoded."""
    head, found, body = block.partition(_END)
    if not found:
        return None
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")[1:]):
        return dechunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    """The data as one gzip member; the same bytes each time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_BETWEEN = member(b"")


def _uri(record: str) -> str:
    return f"<urn:uuid:{record[:8]}-{record[8:12]}-{record[12:16]}-{record[16:20]}-{record[20:32]}>"


def _id(*parts: object) -> str:
    return _uri(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest())


def _records(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page."""
    own = _id(row["page_id"], row["digest"], row["nth"])
    url = row["url"] and row["url"].replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Record-ID", own),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", row["page_id"]),
    ]
    if row["refers_to"] is not None:
        refers = [("WARC-Refers-To", _id(row["refers_to"], row["digest"], 1)), ("WARC-Profile", _PROFILE)]
        yield _record([("WARC-Type", "revisit"), *fields, *refers], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["html"].encode())
    pieces = list(_cuts(block, segment_bytes))
    if len(pieces) == 1:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        of = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", _id(own, number)),
            ("WARC-Date", _DATE),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(pieces) else None),
        ]
        yield _record(of, piece)


def _write(segment_bytes: int, records_per_file: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, made = 0, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in batch.slice(i, 256).to_pylist():
                    for record in _records(row, segment_bytes):
                        data = member(record)
                        if nth % records_per_file == 0:  # the writer begins a file here
                            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("warcinfo", record)), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")]
                            data = member(_record(info, _INFO)) + data
                        made.append(data)
                        nth += 1
                yield batch_of()
                made = []

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
    least_revisit_bytes: int = LEAST_REVISIT_BYTES,
) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzipped archives in ``path``.

    The files are named as Spark's text writer names them; their content is that of .warc.gz files.

    Of equal payloads of at least ``least_revisit_bytes`` bytes the one with the smallest
    page_id (null last) is a response and the others revisit it; of repeated rows with that
    page_id the first is the response. Shorter payloads are all responses. Null html is
    empty; a null url has no header. Other columns are not read. No rows, no records.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("row", F.concat_ws("|", "digest", "page_id"))
    small = rows.where(F.octet_length("html") >= least_revisit_bytes).select("row", "page_id", "digest")
    # digests first, so that a payload of very many pages is met by narrow rows only
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    refers = small.distinct().join(first, "digest").select("row", "first", F.lit(True).alias("shared"))
    # one shuffle of the pages, by the key of both the join and the window
    joined = rows.repartition("row").join(refers, "row", "left")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("digest"))
    own = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("nth") == 1)
    joined = joined.withColumn("nth", nth).withColumn("refers_to", F.when(F.col("shared") & ~own, F.col("first")))
    records = joined.select("page_id", "url", "html", "digest", "nth", "refers_to")
    records = records.mapInArrow(_write(segment_bytes, records_per_file), "value binary").select(F.col("value").cast("string"))
    # bytes pass through the text writer as they are; so does the separator in a one-byte encoding
    (
        records.write.option("encoding", "ISO-8859-1")
        .option("lineSep", _BETWEEN.decode("latin-1"))
        .option("compression", "none")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


RECORD_SCHEMA = (
    "record_id string, kind string, page_id long, url string, refers_to string, origin string, "
    "number long, total long, block binary"
)


_START = re.compile(rb"(?:(?<=\n)|\A)WARC/\d+\.\d+[ \t]*\r?\n")


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() and len(text) <= _MOST_DIGITS else None


def _page(text: str | None) -> int | None:
    return _number(text) if text is None or not text.startswith("-") else (lambda n: None if n is None else -n)(_number(text[1:]))


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts, folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode(errors="replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and last is not None:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon and name.strip().lower() not in out else None
        if last is not None:
            out[last] = value.strip()
    return out


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _head_end(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the header that starts at ``at`` ends, and how long the empty line is. No byte past that is looked at."""
    end = _HEAD_END.search(data, at)
    return (end.start(), end.end() - end.start()) if end else None


def _frame(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(header fields, where the block begins, its size) of the record at ``at``; None if it is cut or altered."""
    start = _START.match(data, at)
    head = _head_end(data, start.end()) if start else None
    fields = _fields(data[start.end() : head[0]]) if head else {}
    size, number = _number(fields.get("content-length")), fields.get("warc-segment-number")
    stated = fields.get("warc-record-id") and fields.get("warc-type")
    if size is None or not stated or (number is not None and not _number(number)) or head[0] + head[1] + size > len(data):
        return None
    return fields, head[0] + head[1], size


def _whole(data: bytes) -> bool:
    """Whether the bytes are whole records and nothing else."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        frame = _frame(data, at)
        if frame is None:
            return False
        at = frame[1] + frame[2]
    return True


def parse_archive(data: bytes) -> Iterator[dict | None]:
    """The records of an archive's bytes, framed by their Content-Length; None for each piece that can't be read.

    After such a piece it goes on at the next line that begins a record. Of all types, those
    that read_archives has no use for too.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):  # line ends between records, however many
            at += 1
            continue
        frame = _frame(data, at)
        if frame is None:
            yield None
            again = _START.search(data, at + 1)
            if not again:
                return
            at = again.start()
            continue
        fields, begin, size = frame
        record = fields["warc-record-id"]
        yield {
            "record_id": record,
            "kind": fields["warc-type"].lower(),
            "page_id": _page(fields.get("page-id")),
            "url": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"),
            "origin": fields.get("warc-segment-origin-id", record),
            "number": _number(fields.get("warc-segment-number")),
            "total": _number(fields.get("warc-segment-total-length")),
            "block": data[begin : begin + size],
        }
        at = begin + size


_MAGIC = b"\x1f\x8b\x08"


#: Bytes of packed data read at a time; what is read past a member's end is copied.
_PACKED_BYTES = 4_096


def _first_member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """(content of the gzip member at ``at``, where it ends); None if it is cut or altered."""
    packer, out, read = zlib.decompressobj(31), [], at
    while not packer.eof and read < len(data):
        piece = data[read : read + _PACKED_BYTES]
        try:
            out.append(packer.decompress(piece))
        except zlib.error:
            return None, at
        read += len(piece)
    return (b"".join(out), read - len(packer.unused_data)) if packer.eof else (None, at)


def members(data: bytes) -> Iterator[bytes | None]:
    """The content of each gzip member; None for each that is cut or altered. Other data is given as it is."""
    if data[:3] != _MAGIC:
        yield data
        return
    at = 0
    while 0 <= at < len(data):
        part, end = _first_member(data, at)
        yield part
        at = data.find(_MAGIC, at + 1) if part is None else end
        if 0 <= at < len(data) and data[at : at + 3] != _MAGIC:
            at = data.find(_MAGIC, at)


def unpacked(data: bytes) -> Iterator[bytes | None]:
    """The contents of runs of whole gzip members, joined; None for each that is cut or altered."""
    for whole, run in groupby(members(data), lambda part: part is not None):
        yield from [b"".join(run)] if whole else run


def read_records(data: bytes) -> Iterator[dict | None]:
    """The records of an archive, packed or not; None for each piece that can't be read.

    Members that are whole records are read one by one; only where a record goes on in the next member are they joined.
    """
    kept: list[bytes] = []
    for part in members(data):
        if kept and (part is None or _START.match(part)) and (part is None or _whole(b"".join(kept))):
            yield from parse_archive(b"".join(kept))
            kept = []
        if part is None:
            yield None
        elif kept or not _whole(part):
            kept.append(part)
        else:
            yield from parse_archive(part)
    if kept:
        yield from parse_archive(b"".join(kept))


_ARROW_RECORD = pa.schema(
    [
        *((x, pa.string()) for x in ("record_id", "kind")),
        ("page_id", pa.int64()),
        *((x, pa.string()) for x in ("url", "refers_to", "origin")),
        ("number", pa.int64()),
        ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)


_DAMAGED = dict.fromkeys(_ARROW_RECORD.names) | {"kind": "damaged"}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            records = read_records(content.as_buffer().to_pybytes())
            while rows := list(islice(records, 512)):
                yield pa.RecordBatch.from_pylist([x or _DAMAGED for x in rows], schema=_ARROW_RECORD)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [Counter("damaged" if x is None else x["kind"] for x in read_records(c.as_buffer().to_pybytes())) for c in batch.column("content")]
        rows = [(path, kind, n) for path, own in zip(batch.column("path").to_pylist(), kinds, strict=True) for kind, n in sorted(own.items())]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "kind", "n"])


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, n): the records of each archive by type; ``damaged`` counts the pieces that were passed over."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_report, "path string, kind string, n long")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("block")
        payloads = [None if x is None else http_payload(b"".join(x)) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "payload", pa.array(payloads, pa.binary()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind (response or revisit), page_id, url, refers_to (a record_id), payload binary.

    One row per response or revisit of the archives in ``path``, segments put together.
    The payload of a revisit is empty; that of a record with a missing segment, a wrong
    total length or broken framing is null. Copies of a segment count once. Records of other
    types, and pieces that can't be read, are passed over. No archives: no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parse, RECORD_SCHEMA)
    whole = records.where("number IS NULL AND kind IN ('response', 'revisit')").select("record_id", "kind", "page_id", "url", "refers_to", F.array("block").alias("block"))
    parts = F.array_distinct(F.array_sort(F.collect_list(F.struct("number", "total", "block"))))
    cut = (
        records.where("number IS NOT NULL")
        .groupBy("origin")
        .agg(
            *(F.max(F.when(F.col("number") == 1, F.col(x))).alias(x) for x in ("kind", "page_id", "url", "refers_to")),
            parts.alias("parts"),
        )
        .where("kind IN ('response', 'revisit')")
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    stated = F.element_at("parts", -1)
    # numbers from 1 on without a gap; the last one states the total
    good = (F.size("parts") == stated["number"]) & (F.element_at("parts", 1)["number"] == 1) & (stated["total"] == length)
    # segments are joined where they are decoded, each byte once
    cut = cut.select(F.col("origin").alias("record_id"), "kind", "page_id", "url", "refers_to", F.when(good, F.col("parts.block")).alias("block"))
    fields = "record_id string, kind string, page_id long, url string, refers_to string, payload binary"
    return whole.union(cut).mapInArrow(_decode, fields)
