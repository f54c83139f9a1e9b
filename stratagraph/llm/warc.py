"""Web archives: legacy ARC files converted to WARC, written and read back.

An ARC file is a run of records, each a header line of space-separated fields
whose last one declares how many bytes follow.  The first record, the version
block, says which fields the lines have: version 1 has five, version 2 ten.
The converter follows declared lengths, never delimiters, and gives each record
what WARC wants besides: an identifier, an ISO timestamp, a type and digests.

Of records with equal payloads, one is a response and the others revisit it.
Only (digest, id) pairs are grouped; hot digests are left to AQE's skew join.
Archives are written and read by Spark's own writers and readers, so they may be
in any store; a file holds what one task wrote.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, written

ARC_BYTES = 4 << 20
SALTS = 8
FILE_RECORDS = 10_000  # of one WARC file, which a task reads whole
MIN_REVISIT_BYTES = 0
DATE = "20200101000000"
END = "\r\n\r\n"
# The field names of the two versions' header lines, and a profile's name.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = "page_id long, record_id string, type string, date string, url string, ip string, head binary, payload binary, payload_digest string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(version: int, offset: int, name: str, url: str, date: str, mime: str, length: int, status: str = "200", ip: str = "0.0.0.0") -> bytes:
    given = {
        "URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": status,
        "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length),
    }
    return (" ".join(given[f] for f in FIELDS[version]) + "\n").encode("utf-8", "surrogatepass")


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 origin\n{' '.join(FIELDS[version])}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body + b"\n"


@dataclass
class ArcRecord:
    """A record of an ARC file: its fields by name, where it starts, and its bytes."""

    fields: dict[str, str]
    offset: int
    body: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, version blocks left out; a line that doesn't fit the version, or a short record, fails."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogatepass")
        length = int(line.rsplit(" ", 1)[1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"ARC record at byte {at} has {len(body)} of {length} bytes")
        if line.startswith("filedesc://"):
            names = tuple(body.split(b"\n")[1].decode().split(" "))
            if names != FIELDS[int(body[:1])]:
                raise ValueError(f"unknown ARC fields: {names}")
        else:
            if names is None:
                raise ValueError("an ARC file starts with a version block")
            # a URL may hold spaces, other fields don't
            parts = line.rsplit(" ", len(names) - 1)
            yield ArcRecord(dict(zip(names, parts, strict=True)), at, body)
        at = end + 1 + length


def clean_url(url: str | None) -> str:
    """A URL fit for a header line: line ends and other controls are percent-encoded; null and empty become ``about:blank``."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url or "") or "about:blank"


def as_arc(pages: DataFrame) -> DataFrame:
    """(arc, content): ARC files of about ARC_BYTES with a record for each page, versions 1 and 2 by turns.

    The page's id is the X-Page-Id of its HTTP header, left out where null; a null html has no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, version = [], 0, 2

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    version = 3 - version
                    parts, held = [version_block(version, "pages.arc")], 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                known = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n".encode() + payload
                parts += [arc_line(version, held, "pages.arc", clean_url(url), DATE, "text/html", len(block)), block, b"\n"]
                held += len(block)
                if held >= ARC_BYTES:
                    yield flush()
                    parts = []
        if parts:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(run, "content binary").withColumn("arc", F.monotonically_increasing_id()), "arcs")


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_RECORD = pa.schema(
    [(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))]
)


def converted(arc: int, content: bytes) -> Iterator[tuple]:
    """A RECORD for each record of an ARC file."""
    for r in read_arc(content):
        f = r.fields
        head, gap, payload = r.body.partition(b"\r\n\r\n") if r.body.startswith(b"HTTP/") else (b"", b"", r.body)
        url, stamp = f["URL"], f["Archive-date"]
        kind = "response" if head else "resource"
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{arc}/{r.offset}/{url}")
        date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
        page = http_fields(head).get("x-page-id")
        yield (None if page is None else int(page), f"urn:uuid:{name}", kind, date, url, f["IP-address"], head + gap, payload, digest(payload))


def from_arc(arcs: DataFrame) -> DataFrame:
    """RECORD rows from ARC files given as (content, arc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, arc in zip(batch.column(0), batch.column(1), strict=True):
                yield _rows(list(converted(arc.as_py(), content.as_py())), _RECORD)

    return arcs.select("content", "arc").mapInArrow(run, RECORD)


def with_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the record_id of the response that the record revisits, null for responses.

    Of equal payloads of MIN_REVISIT_BYTES and more, the record with the smallest page_id is the response; a null id
    is larger than others, and equal ids go by record_id.
    """
    slim = records.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).select("record_id", "page_id", "payload_digest")
    slim = written(slim.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")), "digests")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id"))["record_id"]
    groups = slim.groupBy("payload_digest").agg(first.alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a payload that many records have is dealt by salt; payloads themselves are only exchanged by record_id
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = slim.join(salted.hint("merge"), ["payload_digest", "salt"]).where(F.col("refers_to") != F.col("record_id"))
    return records.join(later.select("record_id", "refers_to").hint("merge"), "record_id", "left")


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block


def _warc(page_id, record_id, kind, date, url, ip, head, payload, payload_digest, refers_to) -> bytes:
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", ip),
        ("Content-Type", "application/http; msgtype=response" if head else "text/html"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
    ]
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return warc_record("revisit" if refers_to else kind, fields, block)


def write_warc(records: DataFrame, path: str) -> None:
    """Write gzipped WARC files into ``path``, of FILE_RECORDS records at most; a task's first begins with a warcinfo record."""
    names = [f.name for f in _RECORD] + ["refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            out = [_warc(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if not begun and out:
                name = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(out[0]).hexdigest())
                about = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
                out.insert(0, warc_record("warcinfo", about, b"format: WARC File Format 1.0\r\n"))
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = records.select(*names).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; a record that is cut short fails."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"WARC record at byte {at} has {len(block)} of {length} bytes")
        yield fields, block
        at = end + 4 + length + 4


READ = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_record string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ rows from the WARC files in ``path``; payloads are checked against their digests."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in READ.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(_unzipped(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    known = http_fields(head)
                    if kind == "revisit":
                        size = int(known["content-length"])
                    else:
                        size = len(payload)
                        if digest(payload) != said:
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
                    page = known.get("x-page-id")
                    refers = fields.get("warc-refers-to")
                    rows.append(
                        (None if page is None else int(page), fields["warc-record-id"][1:-1], kind, fields["warc-target-uri"], size, said, refers and refers[1:-1])
                    )
                yield _rows(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, READ)


def _unzipped(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page, by way of ARC files, written to WARC files and read back from them.

    Null html is an empty payload; repeated rows are records of their own, the first by record_id the response; other
    columns aren't read, whatever their names.  An empty table gives an empty result.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_warc(with_revisits(from_arc(as_arc(pages))), path)
    read = written(read_warc(spark, path), "read")
    pages_of = read.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    wanted = read.where("refers_to_record IS NOT NULL").select("refers_to_record").distinct()
    return read.join(pages_of.join(wanted, "refers_to_record"), "refers_to_record", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {"op6_arc_to_warc": op6_arc_to_warc}

ORACLES = {
    "op6_arc_to_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
}
