"""WARC archives, index first.

Writing puts one gzip member per record into archives and returns the index:
file, offset, length, URL and digest of every record.  Reading takes any selection
of index rows, sorts it by file and offset, joins neighbouring byte ranges into
few large reads, and parses the records out of them.

Of equal payloads of ``least_bytes`` or more, the one with the smallest page_id
is a response, the others are revisits that name it; its digest's group is
never gathered: a ``min`` per digest, combined before its shuffle, is joined back
(of digests that occur once there is no row in it).

Archives go through ``pyarrow.fs``, to any store that it knows by URI.  A task
writes files of its own attempt's name; only files of the index, which Spark
commits, count, so a lost executor or a second attempt leaves nothing wrong.

Defined cases: a null html is an empty payload; a null page_id comes after all
others, is written without the field, and reads back as null; a null URL is
written without the field; rows that repeat page_id and payload are one response
and revisits to the same page_id; an empty table writes no archive; other
columns are ignored.  A payload must fit in one task's memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._workspace import Workspace

#: A new archive begins beyond this size; a coalesced read ends at READ bytes or at a gap over GAP.
ARCHIVE, READ, GAP, STRETCH = 1 << 30, 8 << 20, 64 << 10, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
READ_BACK = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def _clean(value: str) -> str:
    """A URL in one header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, is_first: bool, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of the response of page ``first``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_first else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_first else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest) if is_first else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if not is_first:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(first, digest)}"]
        if first is not None:
            head.append(f"WARC-Page-Refers-To: {first}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(raw: bytes) -> tuple:
    """A record's page id, URL, payload size, digest, type, response's page id and payload."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(fields[name]) if name in fields else None
    payload, size = None, number("WARC-Page-Payload-Length")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"page {fields.get('WARC-Page-ID')}: the payload doesn't have its digest")
    return number("WARC-Page-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("WARC-Page-Refers-To"), payload


def _writer(root: str, date: str):
    def run(batches):
        store, path = fs.FileSystem.from_uri(root)
        context = TaskContext.get()
        name, out, at, files = "", None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, is_first, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "is_first", "first_page")), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at, files = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files:04d}.warc.gz", 0, files + 1
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)  # records are members already
                    payload = html or b""
                    digest = base32_sha1(payload)
                    raw = record(page, url, payload, digest, first, is_first, date)
                    out.write(raw)
                    rows.append((name, at, len(raw), url, digest, page, "response" if is_first else "revisit"))
                    at += len(raw)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, root: str, ws: Workspace, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives below ``root`` (a URI); the index, to be stored before it is used twice."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    each = rows.where("sha is not null").groupBy("sha", "page_id").agg(F.count("*").alias("same"))
    groups = each.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "same")).alias("first"), F.sum("same").alias("n")).where("n > 1")
    groups = ws.table(groups.select("sha", F.col("first.page_id").alias("first_page"), F.col("first.same").alias("same")), "groups")
    met = rows.join(groups, "sha", "left")
    of_first = F.col("same").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_page"))
    if groups.where("same > 1").limit(1).count():  # rows that repeat a response's page: one of them is it
        twice = of_first & (F.col("same") > 1)
        nth = F.row_number().over(Window.partitionBy("sha").orderBy("url"))
        met = met.where(~twice).withColumn("is_first", F.col("same").isNull() | of_first).unionByName(met.where(twice).withColumn("is_first", nth == 1))
    else:
        met = met.withColumn("is_first", F.col("same").isNull() | of_first)
    return met.select("page_id", "url", "html", "is_first", "first_page").mapInArrow(_writer(root, date), INDEX)


def _reader(root: str):
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches):
        store, path = fs.FileSystem.from_uri(root)
        name, source = None, None

        def fetch(ranges):
            """One read for ranges that follow each other closely."""
            low = ranges[0][0]
            raw = source.read_at(ranges[-1][0] + ranges[-1][1] - low, low)
            rows = [parse(raw[a - low : a - low + n]) for a, n in ranges]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ranges: list = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if ranges and (file != name or offset - sum(ranges[-1]) > GAP or offset + length - ranges[0][0] > READ):
                    yield fetch(ranges)
                    ranges = []
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{path}/{file}")
                ranges.append((offset, length))
            if ranges:
                yield fetch(ranges)
        if source is not None:
            source.close()

    return run


def read(selected: DataFrame, root: str) -> DataFrame:
    """The records of ``selected`` rows of an index.

    Tasks take stretches of at most ``STRETCH`` bytes of an archive, so that one large archive is read by
    many; their number follows from the bytes to be read, not from those of the index.
    """
    size = selected.agg(F.sum("length")).first()[0] or 0
    cores = selected.sparkSession.sparkContext.defaultParallelism
    step = max(min(STRETCH, size // (4 * cores)), 1 << 20)
    stretch = F.floor(F.col("offset") / step).alias("stretch")
    ranges = selected.select("file", "offset", "length", stretch).repartition(max(-(-size // step), 1), "file", "stretch").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_reader(root), READ_BACK)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads every record back, and returns what the records say."""
    with Workspace(spark, "warc") as ws:
        root = f"{ws.root}/archives"
        root = root if "://" in root else f"file://{root.removeprefix('file:')}"
        index = ws.table(write(pages, root, ws, least_bytes), "index")
        return ws.finish(read(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
