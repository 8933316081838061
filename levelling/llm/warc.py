"""WARC archives: writing with segments and revisits, reading back with reassembly (operator 5).

Writing.  Payloads are compared by SHA-256; of records with equal payloads of
at least ``min_bytes`` the one with the largest page id is a response, the
others are revisits of it.  A record is an HTTP response with chunked transfer
framing; one whose block exceeds ``segment_bytes`` becomes a first segment and
continuation records with the origin's id, a segment number and, on the last,
the total length.  Tasks bundle records and Spark's text writer puts the
bundles into gzip-compressed archives of at most ``FILE_BUNDLES`` bundles (the
line separator is the empty line that ends a WARC record), so every archive
has a bounded size and reaches any file system that Spark can write.

Reading.  Archives are parsed by content length, one file at a time.  Whole
records are decoded where they lie; only segments are shuffled, by origin id,
sorted by segment number and streamed through the HTTP decoder, so a task holds
one segment at a time.  Segment numbers must run from 1 without a gap, the
lengths must add up to the stated total, the framing must end properly and the
payload must have the stated digest, or ``verified`` is false.

Defined results: null html is an empty payload; a null page id is smaller than
every other (and rows with a null id revisit rows with one, never each other);
rows that repeat the page id and the payload of a response are responses too;
control characters in a url are percent-encoded, a null url is left out; an
empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch_path, stash

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 15
BUNDLE_BYTES = 8 << 20
FILE_BUNDLES = 4
DATE = "2000-01-01T00:00:00Z"  # the tables carry no fetch time
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _chunked(payload: bytes) -> bytes:
    out = []
    for i in range(0, len(payload), CHUNK_BYTES):
        part = payload[i:i + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def _record(kind: str, rid: str, block: bytes, **fields) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{rid}>".encode(),
            f"WARC-Date: {DATE}".encode()]
    head += [f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block]) + _END


def page_records(page_id, url, payload: bytes, refers_to, tag: str, segment_bytes: int):
    """The WARC records of one page."""
    name = f"urn:page:{'null' if page_id is None else page_id}"
    rid = f"{name}:{tag}"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest(payload)}"}
    if refers_to is not None:
        yield _record("revisit", rid, _HTTP, **common, WARC_Refers_To=f"<urn:page:{refers_to}>",
                      WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      Content_Type="application/http;msgtype=response")
        return
    block = _HTTP + _chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", rid, block, **common, Content_Type="application/http;msgtype=response")
        return
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", rid, parts[0], **common, WARC_Segment_Number=1,
                  Content_Type="application/http;msgtype=response")
    for k, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"{rid}:{k}", part, WARC_Target_URI=uri,
                      WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=k,
                      WARC_Segment_Total_Length=len(block) if k == len(parts) else None)


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0,
                   segment_bytes: int = SEGMENT_BYTES) -> str:
    """Archive ``page_id, url, html``; the folder of the archives (a new shared one unless given)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
             .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("sha", "first"))
    marked = rows.join(stash(first, "repeated"), "sha", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def bundle(batches):
        part, row, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, payload, ref in zip(b["page_id"].to_pylist(), b["url"].to_pylist(),
                                                  b["payload"], b["refers_to"].to_pylist()):
                for r in page_records(page_id, url, payload.as_py(), ref, f"{part}-{row}", segment_bytes):
                    held.append(r)
                    size += len(r)
                    if size >= BUNDLE_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)[:-4]], pa.binary())})
                        held, size = [], 0
                row += 1
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)[:-4]], pa.binary())})

    (marked.mapInArrow(bundle, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_BUNDLES).text(path))
    return path


class HttpBody:
    """Decodes an HTTP message fed in pieces; ``take`` gets the pieces of the payload."""

    def __init__(self, take):
        self.take, self.buf, self.state, self.left = take, bytearray(), "head", 0

    def feed(self, data: bytes) -> None:
        self.buf += data
        at = 0
        while True:
            if self.state == "head":
                end = self.buf.find(_END, at)
                if end < 0:
                    break
                head = bytes(self.buf[at:end]).lower()
                self.state = "size" if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked", head) else "plain"
                at = end + 4
            elif self.state == "plain":
                self.take(bytes(self.buf[at:]))
                at = len(self.buf)
                break
            elif self.state == "size":
                end = self.buf.find(b"\r\n", at)
                if end < 0:
                    break
                try:
                    self.left = int(bytes(self.buf[at:end]).split(b";")[0], 16)
                except ValueError:
                    self.state = "broken"
                    break
                at = end + 2
                self.state = "data" if self.left else "trailer"
            elif self.state == "data":
                part = bytes(self.buf[at:at + self.left])
                self.take(part)
                at += len(part)
                self.left -= len(part)
                if self.left:
                    break
                self.state = "gap"
            elif self.state == "gap":
                if len(self.buf) - at < 2:
                    break
                self.state = "size" if self.buf[at:at + 2] == b"\r\n" else "broken"
                at += 2
            elif self.state == "trailer":
                end = self.buf.find(b"\r\n", at)
                if end < 0:
                    break
                self.state = "end" if end == at else "trailer"
                at = end + 2
            else:
                break
        del self.buf[:at]

    @property
    def whole(self) -> bool:
        return self.state in ("end", "plain") and not self.buf


class Payload:
    """Length, digest and, if asked for, bytes of a message's payload."""

    def __init__(self, keep: bool):
        self.size, self.sha, self.kept = 0, hashlib.sha1(), [] if keep else None
        self.http = HttpBody(self._take)

    def _take(self, part: bytes) -> None:
        self.size += len(part)
        self.sha.update(part)
        if self.kept is not None:
            self.kept.append(part)

    def row(self, want: str | None, fits: bool) -> dict:
        got = base64.b32encode(self.sha.digest()).decode()
        return {"payload_bytes": self.size, "payload_digest": got,
                "verified": fits and self.http.whole and want in (None, got),
                "payload": b"".join(self.kept) if self.kept is not None else None}


def parse(archive: bytes):
    """(headers by lower-case name, block) of each record of an archive, gzip or plain."""
    if archive[:2] == b"\x1f\x8b":
        out, rest = [], archive
        while rest:  # one member or one per record
            z = zlib.decompressobj(31)
            out.append(z.decompress(rest))
            rest = z.unused_data
        archive = b"".join(out)
    at = 0
    while at < len(archive):
        end = archive.index(_END, at)
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:60]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if end + 4 + size > len(archive):
            raise ValueError(f"record at byte {at} is cut off")
        yield head, archive[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def _page(urn: str | None):
    m = re.match(r"<urn:page:(null|-?\d+)[:>]", urn or "")
    return int(m[1]) if m and m[1] != "null" else None


_META = "page_id long, url string, record_type string, refers_to long, want string"
_FOUND = "payload_bytes long, payload_digest string, verified boolean, payload binary"
_SCANNED = f"{_META}, {_FOUND}, origin string, seg int, total long, block binary"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified`` per record.

    With ``payload`` also the payload's bytes (null for revisits).  A revisit's
    size is that of the response it refers to.
    """
    schema = spark.createDataFrame([], _SCANNED).schema
    names = schema.names
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    def scan(batches):
        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for head, block in parse(content.as_py()):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    rid = head["warc-record-id"]
                    want = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    row = {"page_id": _page(rid), "url": head.get("warc-target-uri"), "record_type": kind,
                           "refers_to": _page(head.get("warc-refers-to")), "want": want}
                    if kind == "continuation" or "warc-segment-number" in head:
                        row |= {"origin": head.get("warc-segment-origin-id", rid),
                                "seg": int(head["warc-segment-number"]), "block": block,
                                "total": head.get("warc-segment-total-length") and
                                int(head["warc-segment-total-length"])}
                        size += len(block)
                    elif kind == "response":
                        body = Payload(payload)
                        body.http.feed(block)
                        row |= body.row(want, True)
                        size += body.size if payload else 0
                    else:
                        row |= {"payload_digest": want}
                    rows.append(row)
                    if len(rows) >= 4096 or size > BUNDLE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def join_segments(batches):
        """Rows by origin and segment number: one row per origin."""
        origin, first, body, length, total, fits = None, None, None, 0, None, True

        def done():
            ok = fits and first is not None and total == length
            return (first or {"page_id": _page(origin), "record_type": "response"}) | body.row(
                (first or {}).get("want"), ok)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["origin"] != origin:
                    if origin is not None:
                        out.append(done())
                    origin, first, body = r["origin"], None, Payload(payload)
                    length, total, fits, next_ = 0, None, True, 1
                if r["seg"] == 1:
                    first = {k: r[k] for k in ("page_id", "url", "record_type", "refers_to", "want")}
                fits &= r["seg"] == next_
                next_ += 1
                length += len(r["block"])
                total = r["total"] if r["total"] is not None else total
                body.http.feed(r["block"])
            if out:
                yield batch(out)
        if origin is not None:
            yield batch([done()])

    if not _has_files(spark, path):
        scanned = spark.createDataFrame([], schema)
    else:
        scanned = stash(spark.read.format("binaryFile").load(path).select("content")
                        .mapInArrow(scan, schema), "records")
    parts = (scanned.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "seg")
             .mapInArrow(join_segments, schema))
    found = scanned.where("origin is null").unionByName(parts).drop("origin", "seg", "total", "block", "want")
    response = found.where("record_type = 'response'")
    sizes = response.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("__size"), F.min("verified").alias("__ok"))
    revisit = (found.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
               .withColumn("payload_bytes", F.col("__size"))
               .withColumn("verified", F.coalesce("__ok", F.lit(False))).drop("__size", "__ok"))
    out = response.unionByName(revisit)
    return out if payload else out.drop("payload")


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p))
