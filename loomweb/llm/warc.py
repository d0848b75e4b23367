"""WARC archives: written with an index first, read by coalesced byte ranges.

Each task writes its records, gzip members of their own, to one archive file under the
shared folder and returns an index row per record: file, offset, length, URL and digest.  The
index is a table; files that a lost task left behind are in no index row and are never
read.  The index rows wanted are dealt to tasks by stretches of ``DEAL`` archive bytes, so that the number of reading tasks grows with
the archives.  Each task sorts its rows by file and offset, joins neighbouring byte ranges up to ``MAX_RANGE`` bytes across gaps of at most ``MAX_GAP``, and reads each
range once.

Of records with equal payloads that with the smallest id is the response, others are
revisits that refer to it.  Only (id, payload hash) travels to find them, in sums that are taken
before the shuffle, so a payload that a third of the pages share stays spread out.  Pages meet the list of revisits where they
lie while that list is small enough to be broadcast; beyond that, payloads are shuffled once.

Defined cases: null or empty payloads are empty ones and equal each other; null URLs are
written empty; null ids are written empty and sort before all others; repeated rows each get a record, and all rows with the smallest id are
responses; an empty table writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

MAX_GAP, MAX_RANGE, DEAL = 64 << 10, 8 << 20, 16 << 20
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
#: Records carry ids in their WARC-Record-ID as urn:page:<id>.
URN = "urn:page:"


def _filesystem(path: str):
    """The file system of a folder that driver and executors share, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP header, with the payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """The fields of RECORD; a response's size and digest are taken from its payload itself."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(t) if (t := fields[name].strip("<>").removeprefix(URN)) else None
    url, page_id = fields["WARC-Target-URI"], number("WARC-Record-ID")
    if fields["WARC-Type"] == "revisit":
        size = int(next(line[16:] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")))
        return page_id, url, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number("WARC-Refers-To"), None
    return page_id, url, len(payload), digest_of(payload), "response", None, payload


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    member = gzip.compress(make_record(page_id, url or "", payload, refers_to), 6, mtime=0)
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((name, at, len(member), page_id, url, digest_of(payload), "response" if refers_to is None else "revisit"))
                    at += len(member)
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Archives of pages(page_id, url, html) under a new shared folder; the folder and the index."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    keys = rows.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("key"))
    first = keys.groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(written(first, "first"), "key").where("page_id <> first_id").select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), F.col("first_id").alias("refers_to")).distinct()
    joined = rows.withColumn("_key2", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).join(written(revisits, "revisits"), (F.col("page_id") == F.col("_id")) & (F.col("_key2") == F.col("_key")), "left")
    index = written(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), INDEX), "index")
    return folder, index


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of joined byte ranges; places are (file, offset, length) in order."""
    held: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for file, offset, length in places:
        if held and file == held[0] and offset - held[2] <= MAX_GAP and max(held[2], offset + length) - held[1] <= MAX_RANGE:
            held[3].append((offset, length))
            held = (file, held[1], max(held[2], offset + length), held[3])
            continue
        if held:
            yield held
        held = (file, offset, offset + length, [(offset, length)])
    if held:
        yield held


def read_archives(folder: str, wanted: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records (as RECORD) of the index rows wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, opened = None, None
        try:
            for batch in batches:
                rows = []
                for file, start, end, members in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                    if name != file:
                        if opened is not None:
                            opened.close()
                        name, opened = file, files.open_input_file(f"{root}/{file}")
                    data = opened.read_at(end - start, start)
                    for offset, length in members:
                        found = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                        rows.append(found if with_payload else (*found[:-1], None))
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        finally:
            if opened is not None:
                opened.close()

    size = wanted.agg(F.sum("length")).first()[0] or 0
    dealt = wanted.select("file", "offset", "length").repartition(1 + int(size) // DEAL, "file", F.floor(F.col("offset") / DEAL)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)
