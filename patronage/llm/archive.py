"""Legacy web archives: ARC files in, WARC records out.

An ARC file begins with a version block; each record is a header line (five
fields in version 1, ten in version 2) and as many bytes as the line declares.
The converter gives every record a WARC identifier (from the archive's name and
the record's offset, so a repeated task gives the same one), an ISO time stamp,
a type and SHA-256 digests.  Records whose payload an earlier one has become
``revisit`` records.

Archives are written and read with Spark's own text and binary-file sources, in
the folder of ``spark.checkpoint.dir``.  A task holds one compressed archive (as
large as one input split) and one record.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import ensure_checkpoint_dir

from .common import materialize

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
             "Archive-length")
#: Revisits up to which their table is broadcast; it is counted first.
BROADCAST_ROWS = 100_000


# -- ARC ------------------------------------------------------------------

@dataclass
class ArcRecord:
    version: int
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def _field(text: str | None, empty: str) -> str:
    """A header field: no white space, never empty."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or empty


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 crawl\n{V1_FIELDS if version == 1 else V2_FIELDS}\n"
    url = f"filedesc://{name}"
    return arc_record(version, url, "0.0.0.0", date, "text/plain", body.encode(), name)


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, name: str, code: int = 200) -> bytes:
    line = [_field(url, "http://unknown.invalid/"), ip, date, mime]
    if version == 2:
        line += [str(code), "-", "-", "0", _field(name, "-")]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_arc(stream) -> Iterator[ArcRecord]:
    """Records of an open archive.  Fields are counted from the line's end, since
    old URLs may hold spaces; blank lines between records are skipped."""
    offset, version = 0, 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not version and not text.startswith("filedesc:"):
            raise ValueError(f"no version block at the archive's start: {text[:80]!r}")
        tail = 9 if version == 2 or (not version and len(text.split(" ")) == 10) else 4
        fields = text.rsplit(" ", tail)
        if len(fields) != tail + 1 or not fields[-1].isdigit():
            raise ValueError(f"not a version-{version or '?'} header line at byte {at}: {text[:80]!r}")
        size = int(fields[-1])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"the record at byte {at} declares {size} bytes and has {len(body)}")
        offset += size
        if not version:
            version = int(body.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"unknown archive version {version}")
        yield ArcRecord(version, at, fields[0], fields[1], fields[2], fields[3], body)


# -- conversion -----------------------------------------------------------

@dataclass
class Converted:
    record_id: str
    kind: str          # warcinfo, response or resource
    uri: str
    ip: str
    date: str
    mime: str
    head: bytes        # HTTP status line and header fields, with the blank line
    payload: bytes
    digest: str
    page_id: int | None


def warc_date(date: str) -> str:
    """14-digit (or shorter) archive date as an ISO time stamp."""
    d = (date + "00000101000000"[len(date):]) if date.isdigit() and len(date) < 14 else date
    if not re.fullmatch(r"\d{14}", d):
        return "1970-01-01T00:00:00Z"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(record: ArcRecord, archive: str) -> Converted:
    own = sha256(f"{archive}\0{record.offset}\0{record.url}".encode()).digest()[:16]
    record_id = f"<urn:uuid:{UUID(bytes=own, version=4)}>"
    head, payload, mime, page_id = b"", record.body, record.mime, None
    if record.url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        payload = f"software: archive converter\r\nformat: ARC {record.version}\r\n".encode()
    elif record.body.startswith(b"HTTP/"):
        kind, mime = "response", "application/http;msgtype=response"
        head, blank, payload = record.body.partition(b"\r\n\r\n")
        head += blank
        if found := re.search(rb"(?im)^x-page-id: *(-?\d+)\r?$", head):
            page_id = int(found[1])
    else:
        kind = "resource"
    return Converted(record_id, kind, record.url, record.ip, warc_date(record.date), mime, head, payload,
                     sha256(payload).hexdigest(), page_id)


# -- WARC -----------------------------------------------------------------

@dataclass
class WarcRecord:
    fields: dict[str, str]
    block: bytes


def parse_warc(stream) -> Iterator[WarcRecord]:
    """Records of an open archive, by their declared lengths."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"a record declares {size} bytes and has {len(block)}")
        yield WarcRecord(fields, block)


def _open(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


# -- over tables ----------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-{name}-{uuid.uuid4().hex}"


def _write_lines(df: DataFrame, path: str, line_end: str) -> None:
    """The binary column ``value``, as it is, with ``line_end`` after each row."""
    (df.select(F.col("value").cast("string")).write.option("lineSep", line_end)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> None:
    """An ARC file per task, of version 1 and 2 in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        version, name, begun = 1 + task % 2, f"pages-{task:06d}.arc.gz", False
        for batch in batches:
            out = []
            if not begun:
                out.append(arc_version_block(name, version, "20200101000000")[:-1])
                begun = True
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8")
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}"
                        f"Content-Length: {len(payload)}\r\n\r\n")
                out.append(arc_record(version, url, "0.0.0.0", "20200101000000", "text/html",
                                      head.encode() + payload, name)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])

    made = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, "value binary")
    _write_lines(made, path, "\n")


def _archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_CONVERTED = ("record_id string, kind string, uri string, ip string, date string, mime string, "
              "payload_bytes long, payload_digest string, page_id long, head binary, payload binary")


def convert_archives(spark, path: str, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per ARC record under ``path``, as equivalent WARC fields."""
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(_CONVERTED)
    names = schema.names if payloads else schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "head": pa.binary(), "payload": pa.binary()}

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], type=kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names)

        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for record in parse_arc(_open(content)):
                    c = convert(record, name.rsplit("/", 1)[-1])
                    rows.append((c.record_id, c.kind, c.uri, c.ip, c.date, c.mime, len(c.payload), c.digest,
                                 c.page_id, c.head, c.payload))
                    size += len(record.body) if payloads else 300
                    if size > batch_bytes:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return _archives(spark, path).mapInArrow(run, schema if payloads else ", ".join(_CONVERTED.split(", ")[:-2]))


def revisits(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(record_id, first_id, first_uri, first_date) of the responses whose payload, of at
    least ``least_bytes``, another one of smaller (page_id, record_id) has.  NULL ids come last."""
    r = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id", "uri", "date")
    first = (r.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    return (r.select("record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"])
            .where("record_id <> first.record_id")
            .select("record_id", F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"),
                    F.col("first.date").alias("first_date")))


def arc_to_warc(spark, arc_path: str, warc_path: str, least_bytes: int = 100) -> None:
    """Convert the ARC files under one path into WARC files under another."""
    plain = convert_archives(spark, arc_path, payloads=False)
    again = materialize(revisits(materialize(plain, "arc-records"), least_bytes), "revisits")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    r = convert_archives(spark, arc_path).join(again, "record_id", "left")
    is_again = F.col("first_id").isNotNull()
    block = F.when(is_again, F.col("head")).otherwise(F.concat("head", "payload"))

    def field(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    refers = F.concat(
        field("WARC-Refers-To", F.col("first_id")), field("WARC-Refers-To-Target-URI", F.col("first_uri")),
        field("WARC-Refers-To-Date", F.col("first_date")),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(is_again, F.lit("revisit")).otherwise(F.col("kind"))),
        field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", F.col("date")),
        F.when(F.col("kind") == "warcinfo", F.lit("")).otherwise(F.concat(
            field("WARC-Target-URI", F.col("uri")), field("WARC-IP-Address", F.col("ip")))),
        F.coalesce(refers, F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        field("Content-Type", F.col("mime")), field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"))
    rows = r.withColumn("block", block).select(F.concat(header.cast("binary"), F.col("block")).alias("value"))
    _write_lines(rows, warc_path, "\r\n\r\n")


_READ = "record_id string, kind string, page_id long, payload_bytes long, payload_digest string, first_id string"


def read_warc(spark, path: str) -> DataFrame:
    """(record_id, kind, page_id, payload_bytes, payload_digest, first_id) of every response and
    revisit under ``path``.  Digests of blocks and payloads are computed anew and must agree;
    a revisit's payload length is that of its HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for record in parse_warc(_open(content)):
                    f = record.fields
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    if f["warc-block-digest"] != "sha256:" + sha256(record.block).hexdigest():
                        raise ValueError(f"{name}: block digest of {f['warc-record-id']}")
                    head, blank, payload = record.block.partition(b"\r\n\r\n")
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    page = re.search(rb"(?im)^x-page-id: *(-?\d+)\r?$", head + b"\r\n")
                    size = len(payload)
                    if f["warc-type"] == "revisit":
                        size = int(re.search(rb"(?im)^content-length: *(\d+)\r?$", head + b"\r\n")[1])
                    elif sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: payload digest of {f['warc-record-id']}")
                    rows.append((f["warc-record-id"], f["warc-type"], int(page[1]) if page else None, size, digest,
                                 f.get("warc-refers-to")))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=[c.split()[0] for c in _READ.split(", ")])

    return _archives(spark, path).mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 100) -> DataFrame:
    """Write pages as legacy ARC files, convert those to WARC, read the WARC files back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per input row.
    NULL html is an empty payload; a NULL url gets a placeholder; NULL ids come last among
    equal payloads; of repeated rows one is the response and the others revisit it; an empty
    table gives an empty one; other columns are ignored."""
    spark = pages.sparkSession
    arc, warc = _folder(spark, "arc"), _folder(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    arc_to_warc(spark, arc, warc, least_bytes)
    read = materialize(read_warc(spark, warc), "warc-records")
    cols = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type")]
    targets = read.where("first_id is not null").select("first_id").distinct()
    named = (read.select(F.col("record_id").alias("first_id"), F.col("page_id").alias("refers_to"))
             .join(targets, "first_id", "left_semi"))
    first = read.where("first_id is null").select(*cols, F.lit(None).cast("long").alias("refers_to"))
    again = read.where("first_id is not null").join(named, "first_id").select(*cols, "refers_to")
    return first.union(again)
