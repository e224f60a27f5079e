"""WARC archives: a writer of gzip members and a salvage reader.

`write_warc` turns a table of payloads into archives, one per partition, in which each record is a
gzip member of its own. Records of equal payloads are deduplicated: one response, the rest
`revisit` records without the payload. `read_warc` reads any archives, compressed by member or
plain. After a failed check it searches for the next gzip member or version line that begins a valid
record, goes on there, and reports the bytes between as a row of kind `gap`.

Both go through Spark's own file sources, so that any store Spark reads will do.

Defined cases. Null payload: empty payload. Null id: an empty page URN, last in the choice of the
response. Null URL: no WARC-Target-URI. Repeated rows with the smallest id of their payload are all
responses. An empty table gives archives without records, and these read as no rows. Other columns
of the table, whatever their names, are ignored.

Scale: one shuffle of the payloads, by their SHA-256 (a hot payload is split by AQE's skew join), and
one small aggregation. Archives are rolled at ROLL_BYTES, as they are on disk, whatever the sizes of pages: tasks pack
records into lines of LINE_BYTES, each with a warcinfo record, and a file has a fixed number of lines. The reader holds one archive in memory per task and reads it in linear time, damaged or not;
archives of other origin may have up to the 2 GB that Spark's `binaryFile` reads. A member or record that
is larger than MEMBER_BYTES is a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = b"WARC/1.1\r\n"
URN = "urn:lexigrid:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"
HEADER_END = b"\r\n\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
FLUSH_BYTES = 8 << 20
#: Bytes of an archive, some, and of what is written at once; a larger record is a line, or an archive, of its own.
ROLL_BYTES, LINE_BYTES = 512 << 20, 4 << 20
#: The most that a member may inflate to, compressed bytes inflated at once, and the longest header.
MEMBER_BYTES, SLICE, HEADER_BYTES = 1 << 30, 1 << 16, 1 << 20
_ZEROS = re.compile(rb"\0*")

RECORD_SCHEMA = (
    "file string, offset long, length long, kind string, reason string, warc_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def _header_value(text: str) -> str:
    return " ".join(text.split())


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that holds only the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", EPOCH),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{_b32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_b32(block)}"),
    ]
    if url and url.strip():
        fields.append(("WARC-Target-URI", _header_value(url)))
    if revisit:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return _record(fields, block)


def info_record() -> bytes:
    block = b"software: lexigrid\r\nformat: WARC File Format 1.1\r\n"
    return _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:lexigrid:info>"), ("WARC-Date", EPOCH), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{_b32(block)}")],
        block,
    )


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(member: bytes) -> bytes:
    """The member as a line ended by a zero byte: that byte is the last of its length field, or legal padding."""
    return member[:-1] if member.endswith(b"\0") else member


def _members(line_bytes: int):
    """Lines of so many bytes, some: a warcinfo record, so that any archive begins with one, and records of pages."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda parts: pa.RecordBatch.from_arrays([pa.array([_line(b"".join(parts))], pa.binary())], ["line"])
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                if not out:
                    out.append(gzip_member(info_record()))
                out.append(gzip_member(page_record(page_id, url, payload or b"", refers_to, revisit)))
                size += len(out[-1])
                if size >= line_bytes:
                    yield line(out)
                    out, size = [], 0
        if out:
            yield line(out)

    return members


def with_revisits(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload (binary), refers_to, revisit: which rows repeat an earlier payload."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest", "left").select("id", "url", "payload", F.when(repeats, F.col("first_id")).alias("refers_to"), repeats.alias("revisit"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> str:
    """Write a record for each row to archives in the new folder `path`."""
    rows = with_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes)
    lines = rows.mapInArrow(_members(LINE_BYTES), "line binary")
    # lines are as long as their records ask for, so as many of them are a file of ROLL_BYTES, whatever the pages' sizes
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", max(1, ROLL_BYTES // LINE_BYTES)).text(path)
    return path


class Invalid(Exception):
    """Why bytes aren't a record."""


def parse_record(data: bytes, at: int = 0, end: int | None = None) -> tuple[dict, int]:
    """The record that begins at `at`, and where it ends; `end`: of its header, if known. Raises Invalid."""
    if data[at : at + 7] != b"WARC/1.":
        raise Invalid("no version line")
    end = data.find(HEADER_END, at) if end is None else end
    if not at <= end <= at + HEADER_BYTES:
        raise Invalid("header has no end")
    if data[end : end + 4] != HEADER_END:
        raise Invalid("header has no end")
    fields, line_end = {}, data.find(b"\r\n", at)
    while line_end < end:  # line by line, so that a false start ends at its first bad line
        begin, line_end = line_end + 2, data.find(b"\r\n", line_end + 2)
        name, colon, value = data[begin:line_end].partition(b":")
        if not colon:
            raise Invalid("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Invalid("bad Content-Length")
    begin, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Invalid("block isn't followed by a record end")
    block = data[begin:stop]
    if "warc-type" not in fields or "warc-record-id" not in fields:
        raise Invalid("mandatory field missing")
    if (digest := fields.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != _b32(block):
        raise Invalid("block digest differs")
    payload = block
    fields["payload_bytes"] = len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields["payload_bytes"] = len(payload)
        if fields["warc-type"] == "revisit":
            lengths = [h.partition(b":")[2].strip() for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:")]
            fields["payload_bytes"] = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    if fields["warc-type"] == "response" and (digest := fields.get("warc-payload-digest", "")).startswith("sha1:") and digest[5:] != _b32(payload):
        raise Invalid("payload digest differs")
    fields["payload"] = payload
    return fields, stop + 4


def _member_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member that begins at `at`, and where the member ends."""
    z, parts, size, end = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + SLICE]))
            end, size = min(end + SLICE, len(data)), size + len(parts[-1])
            if size > MEMBER_BYTES:
                raise Invalid("gzip member is too large")
    except zlib.error as e:
        raise Invalid(f"bad gzip member: {e}") from None
    if not z.eof:
        raise Invalid("gzip member has no end")
    end, plain = end - len(z.unused_data), b"".join(parts)
    found, pos = [], 0
    while pos < len(plain):
        record, pos = parse_record(plain, pos)
        found.append(record)
    if not found:
        raise Invalid("empty gzip member")
    return found, end


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict]]:
    """(kind, offset, length, reason, record) of everything in an archive, in order; gaps cover all other bytes."""
    at, gap, why = 0, None, None
    following = dict.fromkeys((GZIP_MAGIC, b"WARC/1.", HEADER_END), -1)  # where each next stands, by `seek`

    def seek(mark: bytes, begin: int) -> int:
        """Looks for a mark again only once it is passed, so that all searches take one scan."""
        if following[mark] < begin:
            place = data.find(mark, begin)
            following[mark] = place if place >= 0 else len(data)
        return following[mark]

    while at < len(data):
        zipped = data.startswith(GZIP_MAGIC, at)
        try:
            found, end = _member_at(data, at) if zipped else (lambda r: ([r[0]], r[1]))(parse_record(data, at, seek(HEADER_END, at)))
        except Invalid as e:
            if gap is None and not data[at : at + 1] == b"\0":
                gap, why = at, str(e)
            if data[at : at + 1] == b"\0" and gap is None:  # padding between members
                at = _ZEROS.match(data, at).end()
                continue
            at = min(seek(GZIP_MAGIC, at + 1), seek(b"WARC/1.", at + 1))
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, {}
            gap = None
        for record in found:
            yield "record", at, end - at, None, record
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, {}


def _strip_urn(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _parse(payloads: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, offset, length, reason, r in salvage(content.as_py()):
                    digest = r.get("warc-payload-digest", "")
                    body = r.get("payload") if payloads else None
                    rows.append((file.as_py(), offset, length, kind, reason, r.get("warc-type"), _strip_urn(r.get("warc-record-id")), r.get("warc-target-uri"), _strip_urn(r.get("warc-refers-to")), digest.removeprefix("sha1:") or None, r.get("payload_bytes"), body))
                    size += 200 + len(body or b"")
                    if size >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return parse


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives in `path`."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_parse(payloads), RECORD_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of the page records."""
    number = lambda c: F.expr(f"try_cast(replace({c}, '{URN}', '') AS bigint)")
    return records.where(F.col("warc_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), F.col("target_uri").alias("url")
    )
