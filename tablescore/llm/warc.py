"""WARC archives with a two-level capture index.

Writing: one gzip member for each record, so that a record can be read by itself. Pages are written
where they are; Spark's text writer puts the members into files (through any file system that Spark
knows, committed task by task). Its line separator is the zero byte that ends each member: the last
byte of a member is the top byte of its length, zero below 16 MiB; a longer record is followed by
an empty member.

Archives are rolled by bytes: members go to the writer in parts of up to part_bytes, and a file takes
file_parts of those, so a reader, which holds a file, holds about their product at most.

Deduplication: of equal payloads of at least `least` bytes (same SHA-1, SHA-256 and length), the
page with the largest id is a response and the others are revisits that refer to it. Groups are counted
on narrow rows; pages of small payloads aren't joined, and those of a large group get the answer by broadcast.

Index: captures are sorted by URL key (host parts reversed) into compressed blocks of block_rows
lines; a sparse directory holds one row for each block. A lookup finds its blocks in the directory,
binary-searches their lines, and reads byte ranges of archives.

Defined cases: null html is an empty payload; a null url has an empty key and no Target-URI; a null
page id is kept (and compares as smallest); rows that repeat the largest id are all responses;
control characters in urls are percent-encoded; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ._exchange import free, stored, with_groups


@dataclass(frozen=True)
class WarcParams:
    """least: bytes from which equal payloads are revisits. block_rows: captures in an index block.
    file_rows: most records in an archive file. file_parts, part_bytes: a file has at most so many parts, each of
    so many bytes, or one longer record. date: WARC-Date of all records."""

    least: int = 1000
    block_rows: int = 1000
    file_rows: int = 5000
    file_parts: int = 16
    part_bytes: int = 4_000_000
    date: str = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The host's parts in reverse order, then the path and query: org,example,www)/path?q."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def clean_url(url: str) -> str:
    return "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    """An uncompressed WARC record; a revisit, without payload, if original is another page's id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    head += [f"WARC-Target-URI: {clean_url(url or "")}"] * bool(url) + [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """raw as gzip; ends in a zero byte."""
    out = gzip.compress(raw, 4, mtime=0)
    return out if not out[-1] else out + gzip.compress(b"", mtime=0)


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", params: WarcParams = WarcParams()) -> None:
    """Writes a record for each page to gzipped archive files under path."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "size": F.length("payload")})
    rows = rows.withColumn("same", F.concat_ws("-", "sha1", "sha256", "size")).drop("sha256")
    narrow = stored(rows.filter(F.col("size") >= params.least).select("page_id", "same"))
    copies = stored(narrow.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    free(narrow)
    names = ["page_id", "url", "payload", "sha1"]
    large = with_groups(rows.filter(F.col("size") >= params.least), copies, "same", "n", apart="page_id")
    marked = large.select(*names, F.expr("if(page_id <=> first, null, first)").alias("original")).unionByName(rows.filter(F.col("size") < params.least).select(*names, F.lit(None).cast("long").alias("original")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in (*names, "original")), strict=True):
                new = member(record(*(x.as_py() for x in row), params.date))
                if held and (size + len(new) > params.part_bytes or len(held) >= max(1, params.file_rows // params.file_parts)):
                    yield part()
                    held, size = [], 0
                held.append(new)
                size += len(new)
        if held:
            yield part()

    files = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", params.file_parts).text(path)


def parse_record(raw: bytes) -> dict:
    """A record's capture: page_id, url, record_type, refers_to, payload_bytes, payload_digest; the payload's
    length and digest are computed anew where the record holds it."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest}


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; an empty one belongs to the one before it."""
    at, held = 0, None
    while at < len(content):
        begin, unzip, out = at, zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(content):
                raise ValueError("an archive ends inside a record")
            out.append(unzip.decompress(content[at : at + 65536]))
            at = min(at + 65536, len(content)) - len(unzip.unused_data)
        raw = b"".join(out)
        if raw:
            if held:
                yield held
            held = (begin, at - begin, raw)
        elif held:
            held = (held[0], at - held[0], held[2])
    if held:
        yield held


_CAPTURE = [("url_key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
_DDL = "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all records of the archives under path, with their byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = []
                for offset, length, raw in members(memoryview(content.as_buffer())):
                    row = parse_record(raw)
                    rows.append(row | {"url_key": url_key(row.pop("url")), "file": file, "offset": offset, "length": length})
                yield pa.RecordBatch.from_pylist(rows, pa.schema(_CAPTURE))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, _DDL)


def build_index(captures: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Writes the index under path: blocks (compressed lines in order of key) and the sparse directory."""
    order = ["url_key", "page_id", "file", "offset"]
    names = [n for n, _ in _CAPTURE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block(rows: list[dict]) -> pa.RecordBatch:
            lines = "\n".join(json.dumps([r[n] for n in names], ensure_ascii=False) for r in rows)
            return pa.RecordBatch.from_pydict({"first_key": [rows[0]["url_key"]], "last_key": [rows[-1]["url_key"]], "captures": [len(rows)], "lines": [zlib.compress(lines.encode(), 6)]})

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= params.block_rows:
                yield block(held[: params.block_rows])
                held = held[params.block_rows :]
        if held:
            yield block(held)

    blocks = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "first_key string, last_key string, captures long, lines binary")
    named = blocks.withColumn("block", F.monotonically_increasing_id())
    kept = stored(named, f"{path}/blocks")
    stored(kept.select("first_key", "last_key", "block", "captures"), f"{path}/directory")


def _unpack(lines: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(lines).decode().split("\n")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in batch["lines"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*_unpack(lines), strict=True), _CAPTURE, strict=True)], schema=pa.schema(_CAPTURE))

    return spark.read.parquet(f"{path}/blocks").select("lines").mapInArrow(run, _DDL)


def lookup(spark: SparkSession, path: str, url: str) -> list[dict]:
    """The captures of one URL: its blocks by the directory, then binary search among their lines."""
    key = url_key(clean_url(url))
    near = spark.read.parquet(f"{path}/directory").filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("block").collect()
    if not near:
        return []
    found = []
    for (lines,) in spark.read.parquet(f"{path}/blocks").filter(F.col("block").isin([r[0] for r in near])).select("lines").collect():
        rows = _unpack(lines)
        a, b = bisect.bisect_left(rows, key, key=lambda r: r[0]), bisect.bisect_right(rows, key, key=lambda r: r[0])
        found += [dict(zip((n for n, _ in _CAPTURE), r, strict=True)) for r in rows[a:b]]
    return found


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """The record in a byte range of an archive, through Spark's file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return gzip.decompress(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length)))
    finally:
        stream.close()


def archive_pages(pages: DataFrame, path: str | None = None, *, key: str = "page_id", url: str = "url", html: str = "html", params: WarcParams = WarcParams()) -> str:
    """Writes archives and their index; returns the folder that holds `archives` and `index`."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(pages, f"{path}/archives", key=key, url=url, html=html, params=params)
    captures = stored(scan_archives(spark, f"{path}/archives"))  # sorting samples its input: archives are read once
    build_index(captures, f"{path}/index", params)
    free(captures)
    return path
