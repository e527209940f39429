"""Legacy ARC archives to WARC, and WARC archives written and read as Spark tables.

An ARC record is a header line and as many bytes as the line declares. Version 1 lines have five
fields (URL, IP address, date, type, length), version 2 lines ten (URL, IP address, date, type, result code,
checksum, location, offset, file name, length). The converter parses the line by its version, takes the declared
bytes and makes the equivalent WARC record: identifier, timestamp, type, and payload and block digests.

Archives are written by Spark's text writer, which copies the bytes of a row and the end of a record unchanged,
into compressed files in the shared folder; they are read line by line within tasks, and a record is put
together from its declared length, so that a task holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import scratch_path
from .tables import salted_lookup, stage

RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE_URL = bytes(range(33, 127))


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    version: int = 1
    extra: dict[str, str] = field(default_factory=dict)


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, if it has one."""
        if self.headers.get("Content-Type", "").startswith("application/http"):
            return http_payload(self.block)
        return self.block

    def to_bytes(self) -> bytes:
        """Without the two line ends that follow every record."""
        lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in self.headers.items()]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_payload(block: bytes) -> bytes:
    """What follows the first empty line of an HTTP message."""
    ends = [(block.find(e), len(e)) for e in (b"\r\n\r\n", b"\n\n") if block.find(e) >= 0]
    return block[sum(min(ends)):] if ends else b""


def header_url(url: str | None) -> str:
    """The URL as one field: bytes outside printable ASCII are percent-encoded; none is ``unknown:``."""
    raw = (url or "").encode("utf-8", "surrogatepass")
    return "".join(chr(b) if b in _SAFE_URL else f"%{b:02X}" for b in raw) or "unknown:"


def arc_bytes(r: ArcRecord) -> bytes:
    """The record as ARC of its version."""
    fields = [r.url, r.ip, r.date, r.mime]
    if r.version == 2:
        fields += [r.extra.get(k, "-") for k in ("code", "checksum", "location", "offset", "filename")]
    return " ".join(fields + [str(len(r.content))]).encode() + b"\n" + r.content + b"\n"


def parse_arc_header(line: bytes) -> tuple[ArcRecord, int]:
    """The record without its content, and the declared length. Raises ValueError on other lines."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if len(parts) == 5:
        url, ip, date, mime, length = parts
        return ArcRecord(url, ip, date, mime, b"", 1), int(length)
    if len(parts) == 10:
        url, ip, date, mime, code, checksum, location, offset, filename, length = parts
        extra = {"code": code, "checksum": checksum, "location": location, "offset": offset, "filename": filename}
        return ArcRecord(url, ip, date, mime, b"", 2, extra), int(length)
    raise ValueError(f"an ARC header line has 5 or 10 fields, not {len(parts)}")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records one after the other by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        if end == at or data[at:end] == b"\r":  # the line end after a record
            at = end + 1
            continue
        record, length = parse_arc_header(data[at:end])
        record.content = data[end + 1:end + 1 + length]
        at = end + 1 + length
        yield record


def warc_date(date: str) -> str:
    """ISO 8601 from an ARC date of 14 (or fewer: the rest is the earliest) digits."""
    d = "".join(c for c in date if c.isdigit())[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    """The same identifier for the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def convert(r: ArcRecord) -> WarcRecord:
    """The equivalent WARC record: filedesc becomes warcinfo, HTTP messages response, others resource."""
    http = r.content[:5] == b"HTTP/"
    if r.url.startswith("filedesc:"):
        kind, mime = "warcinfo", "text/plain"
    elif http:
        kind, mime = "response", "application/http;msgtype=response"
    else:
        kind, mime = "resource", r.mime if "/" in r.mime else "application/octet-stream"
    payload = http_payload(r.content) if http else r.content
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(r.url, r.date, sha1_base32(r.content)),
               "WARC-Date": warc_date(r.date)}
    if kind != "warcinfo":
        headers |= {"WARC-Target-URI": r.url}
        if r.ip not in ("", "-", "0.0.0.0"):
            headers |= {"WARC-IP-Address": r.ip}
        headers |= {"WARC-Payload-Digest": "sha1:" + sha1_base32(payload)}
    headers |= {"WARC-Block-Digest": "sha1:" + sha1_base32(r.content), "Content-Type": mime,
                "Content-Length": str(len(r.content))}
    return WarcRecord(headers, r.content)


def revisit(original: WarcRecord, refers_to: str) -> WarcRecord:
    """A record that states that the payload equals that of ``refers_to``; it keeps the HTTP head only."""
    head = original.block[:len(original.block) - len(original.payload)]
    headers = original.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to,
                                  "WARC-Block-Digest": "sha1:" + sha1_base32(head), "Content-Length": str(len(head)),
                                  "X-Payload-Length": str(len(original.payload))}
    return WarcRecord(headers, head)


def read_warc(lines: Iterable[bytes]) -> Iterator[WarcRecord]:
    """Records of archives given as lines without their newline, by their declared lengths.

    Every archive ends with a whole record, so lines of several archives may follow each other."""
    headers: dict[str, str] | None = None
    block: list[bytes] = []
    missing = 0
    for line in lines:
        if missing > 0:
            block.append(line)
            missing -= len(line) + 1
            if missing <= 0:
                whole = b"\n".join(block) + b"\n"
                yield WarcRecord(headers, whole[:int(headers["Content-Length"])])
                headers, block = None, []
            continue
        text = line.rstrip(b"\r")
        if headers is None:
            if text.startswith(b"WARC/"):
                headers = {}
        elif text:
            name, _, value = text.decode("utf-8", "replace").partition(": ")
            headers[name] = value
        else:
            missing = int(headers.get("Content-Length", "0"))
            if missing == 0:
                yield WarcRecord(headers, b"")
                headers = None


def _page_record(page_id, url: str | None, html: str | None, date: str) -> WarcRecord:
    """A page as the legacy record that a crawler left (version by the parity of its id), parsed and converted."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    version = 2 if page_id is not None and page_id % 2 else 1
    legacy = arc_bytes(ArcRecord(header_url(url), "0.0.0.0", date, "text/html", head + payload, version, {"code": "200"}))
    out = convert(next(read_arc(legacy)))
    out.headers["WARC-Record-ID"] = _page_urn(page_id, out)
    if page_id is not None:
        out.headers["X-Page-Id"] = str(page_id)
    return out


def _page_urn(page_id, record: WarcRecord | None = None) -> str:
    return record.headers["WARC-Record-ID"] if page_id is None else record_id("page", str(page_id))


def _in_arrow(df: DataFrame, ddl: str, make) -> DataFrame:
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        rows = []
        for row in make(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            rows.append(row)
            if len(rows) == 256:
                yield batch(rows)
                rows = []
        yield batch(rows)

    return df.mapInArrow(run, schema)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "19960101000000") -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) into archives under ``path``.

    Of records with equal payloads (SHA-1 and length) of at least ``least_bytes`` bytes the one with the
    smallest page_id is a response and the others revisit it; smaller payloads are all responses.
    Null html is an empty payload, a null url ``unknown:``. A row with a null page_id is a response. Rows
    repeated with the smallest page_id are all responses, of which revisits name the page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def facts(rows):
        for page_id, url, html in rows:
            r = _page_record(page_id, url, html, date)
            size = len(r.payload)
            yield page_id, f"{r.headers['WARC-Payload-Digest']}:{size}", size

    known = stage(_in_arrow(source.filter("page_id is not null"), "page_id long, payload string, size long", facts), "payloads")
    first = known.filter(F.col("size") >= least_bytes).groupBy("payload").agg(F.min("page_id").alias("first"))
    revisits = salted_lookup(known.select("page_id", "payload"), first, "payload", "page_id").filter(
        "first < page_id").select("page_id", F.col("first").alias("refers_to"), "payload").distinct()

    def records(rows):
        for page_id, url, html, payload, refers_to in rows:
            r = _page_record(page_id, url, html, date)
            same = f"{r.headers['WARC-Payload-Digest']}:{len(r.payload)}" == payload
            if refers_to is not None and same:
                r = revisit(r, _page_urn(refers_to))
                r.headers["X-Refers-To-Page"] = str(refers_to)
            yield (r.to_bytes(),)

    # A page_id may come with several payloads; the decision is that of its own payload.
    mine = revisits.groupBy("page_id").agg(F.collect_set(F.struct("payload", "refers_to")).alias("found"))
    rows = source.join(mine, "page_id", "left")
    out = _in_arrow(rows.select("page_id", "url", "html", F.to_json("found").alias("found")), "record binary",
                    lambda rs: records(_own(r, date) for r in rs))
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip").text(path)


def _own(row: tuple, date: str) -> tuple:
    """(page_id, url, html, payload, refers_to) with the decision that belongs to this row's payload."""
    import json
    page_id, url, html, found = row
    if not found:
        return page_id, url, html, None, None
    r = _page_record(page_id, url, html, date)
    key = f"{r.headers['WARC-Payload-Digest']}:{len(r.payload)}"
    return page_id, url, html, key, next((x["refers_to"] for x in json.loads(found) if x["payload"] == key), None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: (page_id, url, date, record_type, refers_to, payload_bytes, payload_digest, digest_ok).

    Length and digest of a response are those of the bytes read, of a revisit those it states; digest_ok
    says whether a response's payload has the digest stated."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))

    def rows(raw):
        for r in read_warc(x[0] for x in raw):
            h = r.headers
            stated = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            again = h["WARC-Type"] == "revisit"
            size = int(h["X-Payload-Length"]) if again else len(r.payload)
            digest = stated if again else sha1_base32(r.payload)
            page = int(h["X-Page-Id"]) if "X-Page-Id" in h else None
            first = int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None
            yield page, h.get("WARC-Target-URI"), h.get("WARC-Date"), h["WARC-Type"], first, size, digest, again or digest == stated

    return _in_arrow(lines, "page_id long, url string, date string, record_type string, refers_to long, "
                            "payload_bytes long, payload_digest string, digest_ok boolean", rows)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives in the shared folder and read them back; an empty table gives an empty result.
    Columns other than page_id, url and html are ignored."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_pages(pages, path, least_bytes)
    return read_archives(spark, path)
