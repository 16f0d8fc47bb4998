"""Legacy archive conversion: ARC 1 and ARC 2 files to WARC.

An archive is a row (archive, content): gzip members, one per record. Records are
parsed by the header fields of their version and the declared length, never by
searching for what looks like a header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import among, stage

ARCHIVE_BYTES = 4_000_000
TASK_BYTES = 24_000_000  # of packed archives that one task converts
COMMON = 1000  # digests with more than one in COMMON records are at most COMMON
LEAST_REVISIT = 100
FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
TITLES = {
    1: b"URL IP-address Archive-date Content-type Archive-length\n",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("content", T.BinaryType())])


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member; plain content counts as one."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        data = z.decompress(content[at:] if at == 0 and len(content) < 1 << 16 else memoryview(content)[at:])
        yield at, data + z.flush()
        at = len(content) - len(z.unused_data)


# --- ARC


def arc_line(version: int, url: str, date: str, mime: str, length: int, status: int = 200, name: str = "-", offset: int = 0) -> bytes:
    fields = [url, "0.0.0.0", date, mime, str(length)] if version == 1 else [url, "0.0.0.0", date, mime, str(status), "-", "-", str(offset), name, str(length)]
    return " ".join(fields).encode() + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tripleflow\n".encode() + TITLES[version]
    return arc_line(version, f"filedesc://{name}", date, "text/plain", len(body), 200, name) + body + b"\n"


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, header fields, content) of the records after the version block.

    A member may hold any number of records. A record that is cut short gives what is
    there; lines that are no header of the version end the member.
    """
    version, number = 1, 0
    for _, raw in members(content):
        at = 0
        while at < len(raw):
            while raw[at : at + 1] in (b"\n", b"\r"):
                at += 1
            end = raw.find(b"\n", at)
            if end < 0:
                break
            parts = raw[at:end].decode("utf-8", "replace").strip("\r").split(" ")
            if parts[0].startswith("filedesc://"):
                size = int(parts[-1])
                body = raw[end + 1 : end + 1 + size]
                version = 2 if body[:1] == b"2" else 1
                at = end + 1 + size
                continue
            names = FIELDS[version]
            if len(parts) != len(names) or not parts[-1].isdigit():
                break
            head = dict(zip(names, parts, strict=True))
            size = int(head["length"])
            yield number, head, raw[end + 1 : end + 1 + size]
            number += 1
            at = end + 1 + size


def http_split(content: bytes) -> tuple[dict[str, str] | None, bytes, bytes]:
    """(HTTP headers by lower-case name or None, header block, payload)."""
    if not content.startswith(b"HTTP/"):
        return None, b"", content
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return {}, content, b""
    heads = (x.partition(b":") for x in content[:end].split(b"\r\n")[1:])
    return {k.decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in heads}, content[: end + 4], content[end + 4 :]


def write_arcs(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as ARC archives, versions 1 and 2 in turn.

    A null html is an empty payload, a null or empty url ``urn:page:<id>``, white space
    in a url is escaped; a null id is written as ``-``. A page larger than
    ``archive_bytes`` has an archive of its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0

        def begin() -> tuple[str, int, list[bytes]]:
            name, version = f"pages-{part:06d}-{serial:05d}.arc.gz", 1 + (part + serial) % 2
            return name, version, [member(arc_head(version, name, "20200101000000"))]

        name, version, out = begin()
        size = at = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], names=ARCHIVES.names)

        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                shown = "-" if page is None else str(page)
                target = "%20".join((url or "").split()) or f"urn:page:{shown}"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {shown}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                second = (page or 0) % 86400
                date = f"20200101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
                out.append(member(arc_line(version, target, date, "text/html", len(body), 200, name, at) + body + b"\n"))
                at += len(out[-1])
                size += len(body)
                if size >= archive_bytes:
                    yield done()
                    serial += 1
                    name, version, out = begin()
                    size = at = 0
        if size:
            yield done()

    return pages.select("page_id", "url", "html").mapInArrow(pack, ARCHIVES)


INDEX = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)


def page_of(http: dict[str, str] | None) -> int | None:
    text = (http or {}).get("x-page-id", "")
    return int(text) if text.lstrip("-").isdigit() else None


def index_arcs(arcs: DataFrame) -> DataFrame:
    """One row per ARC record: where it is, its page, payload length and SHA-256."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for number, _, body in arc_records(content):
                    http, _, payload = http_split(body)
                    rows.append((name, number, page_of(http), len(payload), hashlib.sha256(payload).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=INDEX.names)

    return arcs.select("archive", "content").mapInArrow(scan, INDEX)


# --- WARC


def record_id(name: str, number: int) -> str:
    """From the place of the ARC record: unique, and the same in every run over the same archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}:{number}')}>"


def warc_date(date: str) -> str:
    d = (date + "00000000000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def to_warc(name: str, number: int, head: dict[str, str], body: bytes, refers: dict | None) -> bytes:
    """The WARC record that an ARC record amounts to; ``refers``: page_id, archive and number of the record whose payload this one repeats."""
    http, block, payload = http_split(body)
    kind = "revisit" if refers is not None else "resource" if http is None else "response"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(name, number)),
        ("WARC-Date", warc_date(head["date"])),
        ("WARC-Target-URI", head["url"]),
        ("WARC-IP-Address", head["ip"]),
        ("WARC-Payload-Digest", warc_digest(payload)),
        ("Content-Type", head["mime"] if http is None else "application/http; msgtype=response"),
    ]
    if refers is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers["archive"], refers["number"])),
            ("X-Refers-To-Page", str(refers["page_id"])),
            ("X-Payload-Length", str(len(payload))),
        ]
        return warc_record([*headers, ("WARC-Block-Digest", warc_digest(block))], block)
    return warc_record([*headers, ("WARC-Block-Digest", warc_digest(body))], body)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for _, raw in members(content):
        at = 0
        while (end := raw.find(b"\r\n\r\n", at)) >= 0:
            lines = raw[at:end].decode().split("\r\n")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            yield head, raw[end + 4 : end + 4 + size]
            at = end + 8 + size


def convert_arcs(arcs: DataFrame, index: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """ARC archives as WARC archives, repeated payloads of ``least`` bytes or more as revisits.

    ``index`` is index_arcs(arcs). Of equal payloads, the record with the smallest page
    id is the response, under one id the first by archive and number, all others refer
    to it; records without a page id are never revisits nor referred to.
    Only the table of repeated digests is joined by digest: those of more than one in
    COMMON records, which are COMMON at most, are broadcast, so that no digest is a hot
    key. Archives without revisits stay where they are; the others meet the lists of
    theirs in tasks of about TASK_BYTES, as many as the archives' bytes ask for.
    """
    large = index.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    total = large.count()
    firsts = stage(large.groupBy("digest").agg(F.min(F.struct("page_id", "archive", "number")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "arc-firsts")
    common = firsts.where(F.col("n") * COMMON > total).select("digest", "first")
    rare = firsts.where(F.col("n") * COMMON <= total).select("digest", "first")
    by_common = large.join(F.broadcast(common), "digest", "left")
    known = by_common.where("first is not null").select("archive", "number", "first")
    met = by_common.where("first is null").drop("first").join(rare, "digest").select("archive", "number", "first")
    own = stage(known.unionAll(met).where("archive <> first.archive or number <> first.number").groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("number", "first"))).alias("revisits")), "arc-revisits")
    some = among(own.select(F.xxhash64("archive").alias("name")), "name")
    rows = arcs.withColumn("some", some(F.xxhash64("archive")))
    parts = max(1, -(-rows.where("some").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).first()["n"] // TASK_BYTES))
    meet = rows.where("some").select("archive", "content").repartition(parts, "archive").join(own.repartition(parts, "archive").hint("shuffle_hash"), "archive", "left")
    still = rows.where("not some").select("archive", "content", F.lit(None).cast(own.schema["revisits"].dataType).alias("revisits"))
    joined = meet.select("archive", "content", "revisits").unionAll(still)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, known in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first = dict(known or ())
                warc = name.replace(".arc", ".warc")
                info = f"software: tripleflow\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                out = [member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, warc)}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Filename", warc), ("Content-Type", "application/warc-fields")], info))]
                out += [member(to_warc(name, number, head, body, first.get(number))) for number, head, body in arc_records(content)]
                yield pa.RecordBatch.from_arrays([pa.array([warc]), pa.array([b"".join(out)], pa.binary())], names=ARCHIVES.names)

    return joined.mapInArrow(convert, ARCHIVES)


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
    ]
)


def read_warcs(warcs: DataFrame) -> DataFrame:
    """What the records of WARC archives say; payloads that are there are held against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                rows = []
                for head, block in warc_records(content):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = http_split(block)
                    text = head["warc-payload-digest"].partition(":")[2]
                    digest = base64.b32decode(text + "=" * (-len(text) % 8)).hex()
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {head['warc-record-id']} is wrong")
                    refers = int(head["x-refers-to-page"]) if revisit else None
                    rows.append((page_of(http), int(head["x-payload-length"]) if revisit else len(payload), digest, head["warc-type"], refers, head["warc-record-id"], head["warc-target-uri"], head["warc-date"]))
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=READ.names)

    return warcs.select("archive", "content").mapInArrow(read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as ARC, converted to WARC, and read back; archives stay in the shared folder."""
    arcs = stage(write_arcs(pages), "arcs")
    return read_warcs(stage(convert_arcs(arcs, stage(index_arcs(arcs), "arc-index")), "warcs"))
