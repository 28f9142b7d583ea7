"""WARC archives of web pages: written by Spark's text writer, read back by a reader that survives damage."""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EOL = "\r\n"
RECORD_END = EOL * 2
# Fixed value: the profile name of a revisit whose payload is the same as another record's.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Shorter payloads are always written out.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
# Uncompressed bytes after which a gzipped file is closed.
FILE_BYTES = 1 << 26
# The records of a gzipped file are parted by an empty member, which readers of gzip pass over.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
# A header is mostly shorter; the end of a longer one is sought up to the next version line.
HEADER_BYTES = 1 << 16

# Bytes that are inflated at once, and payload bytes that a worker hands over at once.
STEP = 1 << 16
HANDED_OVER = 1 << 22
NUMBERS = ("x-page-id", "x-refers-to-page-id", "http:content-length")

MEMBERS = pa.schema([("file", pa.int64()), ("value", pa.binary())])

VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
HEADER_LINE = re.compile(rb"\r?\n")
# Lengths of more digits are longer than any file; identifiers have 64 bits.
LENGTH = re.compile(r"[0-9]{1,18}")
IDENTIFIER = re.compile(r"-?[0-9]{1,19}")
BLANKS = " \t"
# Digests that a reader can check; of any other a claim is taken as it is.
DIGESTS = ("md5", "sha1", "sha256", "sha512")


# ---- writing


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Pages with the ``digest`` of their payload and, where a larger id has the same payload, what it ``refers_to``.

    Copies are counted by digest before anything is joined. The pages then meet the few digests that occur more than
    once, in a join that adaptive execution splits where one payload is very frequent.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    several = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
    )
    # Another spelling of the key: both sides are shuffled for the join, which lets it be split.
    joined = rows.join(several.select(F.upper("digest").alias("same"), "original"), F.upper("digest") == F.col("same"), "left")
    refers = F.when(F.col("page_id") != F.col("original"), F.col("original"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(kind: str, fields: list[Column], block: Column) -> Column:
    """The text of a record up to the last byte of its block."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *fields, length), F.lit(RECORD_END), block)


def _field(name: str, value: Column) -> Column:
    """A header line, null without a value."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name that follows from the page and its payload, so that a revisit can tell that of its original."""
    name = F.sha1(F.concat_ws(":", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(name, start, length) for start, length in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    # Version 5, variant 8: a name made of a SHA-1.
    uuid = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4])
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def record_text(date: str) -> Column:
    """A page with its digest as a response record, or as a revisit that has the HTTP header without the payload."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
        _field("Content-Length", F.octet_length("payload")),
        F.lit(RECORD_END),
    )
    fields = [
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        _field("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        _field("X-Page-Id", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    points = [
        F.lit(f"WARC-Profile: {SAME_PAYLOAD}"),
        _field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))),
        _field("X-Refers-To-Page-Id", F.col("refers_to")),
    ]
    response = _record("response", fields, F.concat(http, F.col("payload")))
    return F.when(F.col("refers_to").isNull(), response).otherwise(_record("revisit", [*fields, *points], http))


def _members(records: DataFrame, file_bytes: int) -> DataFrame:
    """Each record as a gzip member, and the number of the file that it goes to: a task begins another one before
    the records of a file pass ``file_bytes`` bytes."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        for batch in batches:
            files, members, held = [], [], 0
            for text in batch.column("value"):
                data = text.as_buffer().to_pybytes() + RECORD_END.encode()
                if size and size + len(data) > file_bytes:
                    number, size = number + 1, 0
                size += len(data)
                files.append(number)
                members.append(gzip.compress(data, 6, mtime=0))
                held += len(members[-1])
                if held > HANDED_OVER:
                    yield pa.RecordBatch.from_pydict({"file": files, "value": members}, schema=MEMBERS)
                    files, members, held = [], [], 0
            if files:
                yield pa.RecordBatch.from_pydict({"file": files, "value": members}, schema=MEMBERS)

    return records.mapInArrow(written, "file long, value binary")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = REVISIT_BYTES,
    compression: str = "gzip",
    records_per_file: int = RECORDS_PER_FILE,
    file_bytes: int = FILE_BYTES,
    date: str | None = None,
) -> None:
    """Write one record per row to WARC files of at most ``records_per_file`` records; other columns are left out.

    With ``gzip`` each record is a member of its own, so that damage costs no later record, and a file holds at most
    ``file_bytes`` bytes of records before compression, or a single record. The members are written as they are by
    Spark's text writer, whose line separator is an empty member. With any other compression the separator is the end
    of a record, and only the records of a file are bounded. Null payloads are empty. Of rows with one payload
    of at least ``least_bytes`` bytes, that of the largest id holds it and those of smaller ids are revisits of it;
    equal rows of the largest id all hold it. A row without an id holds its payload and is never referred to. Line
    ends are left out of urls. ``date`` is the time of the records as ``2025-01-31T00:00:00Z``, by default the
    present; equal rows have equal record names.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = with_revisits(pages, id_col, url_col, payload_col, least_bytes).select(record_text(date).alias("value"))
    if compression == "gzip":
        # A binary value as text keeps its bytes; the separator's are spelled in Latin-1.
        members = _members(records, file_bytes).select("file", F.col("value").cast("string").alias("value"))
        writer = members.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        compression = "none"
    else:
        writer = records.write.option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", records_per_file).option("compression", compression).text(folder)


# ---- reading


@dataclass
class Part:
    """A record, or a gap of bytes where ``kind`` is ``gap``; places count from the start of the member's content.

    The compressed bytes of a broken member that were passed over have member 0: their places are those of the file.
    """

    kind: str
    member: int
    start: int
    end: int
    fields: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str = ""


def _member_at(data: bytes, at: int) -> int:
    """The next place from ``at`` on where a gzip member opens, or the end."""
    found = data.find(MEMBER, at)
    while found >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[found : found + 4096], 64):
                return found
        except zlib.error:
            pass
        found = data.find(MEMBER, found + 1)
    return len(data)


def _inflated(data: bytes, at: int) -> tuple[bytes, int, bool, int]:
    """What the member at ``at`` holds, where it ends, whether it was whole, and up to where it was inflated."""
    inflate, out, place, step = zlib.decompressobj(31), [], at, STEP
    while place < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[place : place + step]))
            place += step
        except zlib.error:
            if step == 1:
                break
            # Nearer to the damage in smaller steps.
            inflate, step = before, step // 16
    if inflate.eof:
        end = min(place, len(data)) - len(inflate.unused_data)
        return b"".join(out), end, True, end
    end = _member_at(data, at + 1)
    # Damage may be noticed behind the next member only.
    return b"".join(out), end, False, min(place, end)


def _headers(data: bytes, start: int, end: int) -> dict[str, str]:
    """The fields of a header. Only line feeds end a line: values may hold other characters that some take for line ends."""
    lines = (line.decode("utf-8", "replace").partition(":") for line in HEADER_LINE.split(data[start:end]))
    return {name.strip(BLANKS).lower(): value.strip(BLANKS) for name, colon, value in lines if colon}


def _digest(claim: str) -> tuple[str, str]:
    """Name and lower-case hex digits of a digest such as ``sha1:...``, written in hex or in base 32."""
    name, colon, value = claim.rpartition(":")
    name, value = name.strip(BLANKS).lower() if colon else "sha1", value.strip(BLANKS)
    if name in DIGESTS and len(value) != 2 * hashlib.new(name).digest_size:
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except (binascii.Error, ValueError):
            # Not base 32 either: it equals no digest.
            pass
    return name, value.lower()


def _is_claimed(claim: str, payload: bytes) -> bool:
    name, value = _digest(claim)
    return name not in DIGESTS or hashlib.new(name, payload).hexdigest() == value


def _record_at(data: bytes, at: int, member: int) -> Part:
    """The record that begins at ``at``, or a gap of unknown end if a check fails."""

    def gap(reason: str, end: int = -1) -> Part:
        return Part("gap", member, at, end, reason=reason)

    version = VERSION_LINE.match(data, at)
    if not version:
        return gap("no version line")
    stop = data.find(b"\r\n\r\n", version.end(), version.end() + HEADER_BYTES)
    if stop < 0:
        # Each byte is searched once only: up to the next version line.
        following = VERSION_LINE.search(data, version.end())
        stop = data.find(b"\r\n\r\n", version.end(), following.start() if following else len(data))
    if stop < 0:
        return gap("header without an end")
    fields = _headers(data, version.end(), stop)
    if not LENGTH.fullmatch(fields.get("content-length", "")):
        return gap("no content length")
    start = stop + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return gap("block of another length")
    block = data[start:end]
    http, _, payload = block.partition(b"\r\n\r\n") if "http" in fields.get("content-type", "") else (b"", b"", block)
    if http:
        fields |= {f"http:{k}": v for k, v in _headers(http, 0, len(http)).items()}
    kind, claimed = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    if kind != "revisit" and claimed and not _is_claimed(claimed, payload):
        return gap("payload of another digest", end + 4)
    return Part(kind, member, at, end + 4, fields, payload)


def _next_record(data: bytes, at: int, member: int) -> int:
    """The next version line from ``at`` on that opens a record, or the end."""
    found = VERSION_LINE.search(data, at)
    while found and _record_at(data, found.start(), member).kind == "gap":
        found = VERSION_LINE.search(data, found.start() + 1)
    return found.start() if found else len(data)


def _plain(data: bytes, member: int) -> Iterator[Part]:
    """Records and gaps of plain content. After a failed check the next version line that opens a record is sought."""
    at = 0
    while at < len(data):
        part = _record_at(data, at, member)
        if part.kind == "gap" and part.end < 0:
            part.end = _next_record(data, at + 1, member)
        yield part
        at = part.end


def salvage(data: bytes) -> Iterator[Part]:
    """All records of an archive, plain or of gzip members or of both, and the gaps between them, in order.

    A broken member gives the records before its damage. The search goes on at the next member that opens, or
    the next version line that opens a record, whichever is first.
    """
    at = 0
    while at < len(data):
        if data.startswith(MEMBER, at) and any((inflated := _inflated(data, at))[:3:2]):
            # A member that holds something, or one that is whole and empty.
            content, end, whole, good = inflated
            yield from _plain(content, at)
            if not whole:
                # The places of this gap are those of the file.
                yield Part("gap", 0, good, end, reason=f"member at {at} broken, {end - good} bytes passed over")
            at = end
            continue
        part = _record_at(data, at, 0)
        if part.kind == "gap" and part.end < 0:
            part.end = min(_member_at(data, at + 1), _next_record(data, at + 1, 0))
        yield part
        at = part.end


PARTS = pa.schema(
    [
        ("archive", pa.string()),
        ("member", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("reason", pa.string()),
    ]
)
PARTS_DDL = (
    "archive string, member long, start long, end long, record_type string, page_id long, target_uri string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long, reason string"
)


def _number(value: str) -> int | None:
    """A whole number of 64 bits, or nothing."""
    number = int(value) if IDENTIFIER.fullmatch(value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _row(archive: str, part: Part) -> tuple:
    fields = part.fields
    own, other, claimed_size = (_number(fields.get(k, "")) for k in NUMBERS)
    if part.kind == "gap":
        size, digest = None, None
    elif part.kind == "revisit":
        size, digest = claimed_size, _digest(fields.get("warc-payload-digest", ""))[1] or None
    else:
        size, digest = len(part.payload), hashlib.sha1(part.payload).hexdigest()
    place = (archive, part.member, part.start, part.end, part.kind)
    return *place, own, fields.get("warc-target-uri"), part.payload, size, digest, other, part.reason or None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, size = [], 0
            for part in salvage(content.as_buffer().to_pybytes()):
                rows.append(_row(archive, part))
                size += len(part.payload)
                if size > HANDED_OVER:
                    yield pa.RecordBatch.from_pydict({f.name: c for f, c in zip(PARTS, zip(*rows))}, schema=PARTS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict({f.name: c for f, c in zip(PARTS, zip(*rows))}, schema=PARTS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record below ``folder``, and every gap with its ``reason``: the quarantine log.

    ``payload_bytes`` and ``payload_digest`` are taken from the bytes that were read; a revisit has them from its
    header. A file is read as a whole, which ``records_per_file`` and ``file_bytes`` bound when it is written.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read, PARTS_DDL)
