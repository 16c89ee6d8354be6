r"""WARC writing with segmented, chunk-framed records, and reading back.

Writer: every page becomes a response or revisit record. A response block is an
HTTP response whose body, the html in UTF-8, has chunked transfer framing; a
block longer than ``segment_bytes`` is cut, the first part in the response record
and the rest in continuation records. Equal payloads of at least ``least`` bytes
are stored once, with the largest page_id; the others become revisits.

Reader: archives are parsed record by record; continuation records are grouped
by the identifier of their origin, ordered by segment number, checked for gaps
and against the total length, joined, and the chunked framing is decoded.

Archives are written, gzipped, by Spark's own text writer, so any file system
that Spark reaches can hold them; records are bytes and end in \r\n\r\n. A file
holds about FILE_BYTES before compression, and its reader some copies of that;
the segments of one page meet in one task, which holds that page.
Null html is an empty payload. A row without page_id gives a record without one,
and is a revisit if a row with an id has its payload. Rows that share page_id
and payload are all responses if theirs is the largest id. An empty table gives
an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize
from . import groups
from .textkernel import small_batches

LEAST = 1000
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 4 << 10
#: An archive file holds records of about so many bytes before compression; its reader holds it whole.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


class BrokenRecord(ValueError):
    """A record, its segments or its framing can't be put together."""


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (body[k : k + size] for k in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise BrokenRecord("chunk size without line end")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise BrokenRecord("chunk longer than its size")
        out.append(framed[at : at + size])
        at += size + 2


def _uuid(*parts: object) -> str:
    h = hashlib.md5("\x00".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(url: str | None) -> str:
    """A header value: no control characters or spaces."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str | None] | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page, and its continuation records."""
    name = _uuid(page_id, url, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("X-Page-ID", page_id)]
    if refers is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{digest}")]
        head += [("WARC-Refers-To", _uuid(refers[0], refers[1], digest)), ("WARC-Refers-To-Target-URI", _clean(refers[1])), ("Content-Type", "application/http; msgtype=response")]
        yield _record(head, _HTTP)
        return
    block = _HTTP + chunked(payload)
    cuts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for number, part in enumerate(cuts, 1):
        head = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", name if number == 1 else _uuid(name, number)), *common]
        if number == 1:
            head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        if len(cuts) > 1:
            head.append(("WARC-Segment-Number", number))
            if number > 1:
                head.append(("WARC-Segment-Origin-ID", name))
            if number == len(cuts):
                head.append(("WARC-Segment-Total-Length", len(block)))
        head.append(("WARC-Block-Digest", f"sha1:{hashlib.sha1(part).hexdigest()}"))
        yield _record(head, part)


def write(pages: DataFrame, path: str, least: int = LEAST, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of all ``pages`` (page_id, url, html) under ``path``. Who keeps
    a payload is decided on slim rows; payloads are shuffled only if the revisits
    are too many to be broadcast, and then by page, never by digest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = small_batches(pages).select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    slim = materialize(rows.select("page_id", "url", "digest", "size"), "digests")
    large = slim.where(F.col("size") >= least)
    copies = large.groupBy("digest", "size").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("keeper"), F.count("*").alias("c"))
    copies = materialize(copies.where("c > 1 and keeper is not null").drop("c"), "keepers")
    again = large.select("page_id", "digest", "size").join(groups.few(copies), ["digest", "size"]).where("page_id is null or page_id < keeper.page_id")
    again = again.select("page_id", "digest", F.col("keeper.page_id").alias("to_id"), F.col("keeper.url").alias("to_url")).distinct()
    again = groups.few(materialize(again, "revisits")).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "to_id", "to_url")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = joined.select("page_id", "url", "digest", F.when(F.col("to_id").isNull(), F.col("payload")).alias("payload"), "to_id", "to_url")
    mean = slim.agg(F.avg(F.least(F.col("size"), F.lit(segment_bytes)))).first()[0] or 0.0
    file_records = max(1, int(FILE_BYTES / (mean + 1024)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    refers = None if r["to_id"] is None else (r["to_id"], r["to_url"])
                    # the writer adds the last \n
                    out += [x[:-1] for x in records(r["page_id"], r["url"], r["payload"] or b"", r["digest"], refers, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def inflated(archive: bytes) -> bytes:
    """The records of an archive file, which may be gzip members."""
    parts = []
    while archive.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        parts.append(member.decompress(archive))
        archive = member.unused_data
    return b"".join(parts) if parts else archive


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise BrokenRecord(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) < size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise BrokenRecord(f"record at byte {at} is cut off")
        digest = headers.get("warc-block-digest", "")
        if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
            raise BrokenRecord(f"block digest of {headers.get('warc-record-id')}")
        yield headers, block
        at = end + 8 + size


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without chunked framing if it has that."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head)
    return unchunked(body) if framed else body


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block whose segments (number, total length or None, bytes) are given
    in any order; a segment that was stored twice counts once."""
    by_number = {n: part for n, _, part in parts}
    total = {t for _, t, _ in parts if t is not None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or len(total) != 1:
        raise BrokenRecord("a segment is missing")
    block = b"".join(by_number[n] for n in range(1, len(by_number) + 1))
    if len(block) != total.pop():
        raise BrokenRecord("segments don't have the total length")
    return block


_ROW = "record_id string, page_id long, type string, digest string, refers string, origin string, segment int, total long, payload binary, bytes long, sha1 string"
_NAMES = [f.split(" ")[0] for f in _ROW.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]


def _parsed(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Records; whole responses have their payload, or with ``payloads`` false
    its size and digest; segments have their bare block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for archive in batch.column(0):
                parsed = parse(inflated(archive.as_py()))
                while part := list(islice(parsed, 256)):
                    rows = []
                    for h, block in part:
                        segment = whole(h.get("warc-segment-number"))
                        kind = h.get("warc-type")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        origin = h.get("warc-segment-origin-id", h["warc-record-id"]) if segment else None
                        row = (h["warc-record-id"], whole(h.get("x-page-id")), kind, digest, h.get("warc-refers-to"), origin, segment, whole(h.get("warc-segment-total-length")))
                        body = block if segment else payload_of(block) if kind == "response" else None
                        rows.append((*row, *_held(body, payloads or bool(segment))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _ROW)


def _held(body: bytes | None, payloads: bool) -> tuple[bytes | None, int | None, str | None]:
    """The payload, if wanted, and its size and digest."""
    if body is None:
        return None, None, None
    return (body, len(body), None) if payloads else (None, len(body), hashlib.sha1(body).hexdigest())


def _reassembled(segments: DataFrame, payloads: bool) -> DataFrame:
    """Whole responses from their segments, as ``_parsed`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.runs(batches, ["origin"]):
            for first, last in groups.bounds(batch, ["origin"]):
                rows = batch.slice(first, last - first).select(["record_id", "page_id", "type", "digest", "refers", "segment", "total", "payload"]).to_pylist()
                payload = payload_of(reassemble([(r["segment"], r["total"], r["payload"]) for r in rows]))
                fields = [(r["record_id"], r["page_id"], r["type"], r["digest"], r["refers"], None, None, None, *_held(payload, payloads)) for r in rows if r["type"] == "response"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*fields), _TYPES)], names=_NAMES)

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts, "origin").sortWithinPartitions("origin", "segment").mapInArrow(run, _ROW)


def _records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """All records. Archives are parsed once; what that gives is written."""
    parsed = materialize(_parsed(spark, path, payloads), "parsed")
    return parsed.where("segment is null").unionByName(_reassembled(parsed.where("segment is not null"), payloads))


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, type (response or revisit), digest, refers (a record
    id), payload (null for revisits) of each page in the archives."""
    return _records(spark, path, True).select("record_id", "page_id", "type", "digest", "refers", "payload")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages``, read the archives, and give page_id, payload_bytes,
    payload_digest, record_type, refers_to of each record; a revisit has size
    and digest of the response that it refers to, found in the archives."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, least, segment_bytes)
    slim = materialize(_records(spark, path, False).select("record_id", "page_id", "type", "refers", "bytes", "sha1", F.col("digest").alias("claimed")), "records")
    stored = slim.where("type = 'response'")
    wrong = stored.where("sha1 <> claimed").limit(1).collect()
    if wrong:
        raise BrokenRecord(f"payload digest of {wrong[0]['record_id']}")
    target = stored.groupBy("record_id").agg(F.first("page_id").alias("to"), F.first("bytes").alias("to_bytes"), F.first("sha1").alias("to_sha1"))
    revisit = slim.where("type = 'revisit'").join(target.withColumnRenamed("record_id", "refers"), "refers", "left")
    own = stored.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisit.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to")))


#: DuckDB's form of the query op9_warc.
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= {LEAST} GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < k.keeper THEN k.keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest, payload_bytes)
"""
