"""Web archives packed in ZIP files, written and read by ranges.

A ZIP holds two stored members: the WARC records and an index line for each
(offset, length, page id). A reader parses the end records and the central
directory, with their 64-bit forms, finds the members' bytes, and reads single
records by range without extracting anything.

Of pages with equal payloads of at least a given size, those with the largest
page id are responses and the others revisit it; a page with a null id never is
the target while another has an id. A null html is an empty payload; a null url
gives a record without target. Rows that repeat a page are all written. An
empty table gives no files and an empty result. Only page_id, url and html are
read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import attempt_name, dealt_join, filesystem, put_file, shared_folder, table, written

RECORDS, INDEX = "archive/records.warc", "indexes/index.json"
SMALLEST = 1000
#: Payload digests that may be sent to every worker; more are joined by shuffling.
BROADCAST_DIGESTS = 200_000
#: Fixed values of the public ZIP layout.
LOCAL, CENTRAL, END, END64, LOCATOR64, FULL16, FULL32 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members, appended in pieces. Sizes follow in a data descriptor, so
    nothing is held back; large members and offsets, or zip64=True, use the
    64-bit fields."""

    def __init__(self, out, *, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, raw: bytes) -> int:
        """Append to the open member; returns where in the member it begins."""
        member = self.members[-1]
        begin = member[2]
        member[2] += len(raw)
        member[3] = zlib.crc32(raw, member[3])
        self._put(raw)
        return begin

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def finish(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            wide = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            short = (FULL32, FULL32, FULL32) if wide else (size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, short[0], short[1], len(name), len(extra), 0, 0, 0, 0, short[2]) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or n >= FULL16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


class ZipReader:
    """The members of a ZIP, read by range. Only stored members have ranges."""

    def __init__(self, file):
        self.file, total = file, file.size()
        tail_at = max(0, total - 22 - FULL16)
        tail = self.range(tail_at, total - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        if end < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, end + 10)
        if (FULL16 in (n,) or FULL32 in (size, start)) and end + tail_at >= 20:
            magic, _, at, _ = struct.unpack("<IIQI", self.range(end + tail_at - 20, 20))
            if magic == LOCATOR64:
                n, size, start = struct.unpack_from("<QQQ", self.range(at, 56), 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        raw, at = self.range(start, size), 0
        for _ in range(n):
            method, crc, packed, plain = struct.unpack_from("<10xH4xIII", raw, at)
            names, extras, comments = struct.unpack_from("<HHH", raw, at + 28)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + names].decode()
            x, stop = at + 46 + names, at + 46 + names + extras
            while x + 4 <= stop:
                kind, length = struct.unpack_from("<HH", raw, x)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, x + 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                x += 4 + length
            self.members[name] = method, offset, plain, crc
            at = stop + comments

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the file, and how many."""
        method, offset, size, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; it has no ranges")
        names, extras = struct.unpack("<HH", self.range(offset + 26, 4))
        return offset + 30 + names + extras, size


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response, or a revisit (without payload) of the page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def write_archives(pages: DataFrame, folder: str, smallest: int = SMALLEST, date: str = "1970-01-01T00:00:00Z", *, zip64: bool = False) -> DataFrame:
    """Write one ZIP per partition and return the table of files: (file, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = rows.filter(F.octet_length("html") >= smallest).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1 AND target IS NOT NULL").select(F.col("digest").alias("shared_digest"), "target")
    shared = written(shared, f"{folder}/shared")
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    shared = shared.withColumnRenamed("shared_digest", "digest")
    joined = rows.join(F.broadcast(shared), "digest", "left") if few else dealt_join(rows, shared, "digest", "page_id", "left")
    joined = joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        lines: list[str] = []

        def write(out) -> None:
            pack = ZipWriter(out, zip64=zip64)
            pack.begin(RECORDS)
            for batch in (x for some in ([first], batches) for x in some):
                for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    record = warc_record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to, date)
                    lines.append(json.dumps([pack.write(record), len(record), page_id]))
            pack.end()
            pack.begin(INDEX)
            pack.write("\n".join(lines).encode())
            pack.end()
            pack.finish()

        file = f"{folder}/pages-{attempt_name(context)}.zip"
        put_file(file, write)
        yield pa.record_batch([[file], [len(lines)]], schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return written(joined.mapInArrow(run, "file string, records bigint"), f"{folder}/files")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. A response's payload is checked against its digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = filesystem(file)
                out = []
                with fs.open_input_file(path) as f:
                    reader = ZipReader(f)
                    begin, _ = reader.locate(RECORDS)
                    for line in reader.range(*reader.locate(INDEX)).decode().split("\n"):
                        offset, length, _ = json.loads(line)
                        warc, http, payload = parse_record(reader.range(begin + offset, length))
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{file}: the payload at {offset} doesn't match its digest")
                        size = len(payload) if warc["warc-type"] == "response" else int(http["content-length"])
                        number = lambda k, w=warc: int(w[k]) if k in w else None
                        out.append((number("x-page-id"), warc.get("warc-target-uri"), size, digest, warc["warc-type"], number("x-refers-to-page-id")))
                for k in range(0, len(out), 10_000):
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out[k : k + 10_000], strict=True), schema, strict=True)], schema=schema)

    n = files.count()
    return files.select("file").repartition(max(1, n), "file").mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark))
    return read_archives(files).drop("url")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS target FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM q
"""
