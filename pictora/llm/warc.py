"""WARC archives with revisit records, and their capture index by an external merge.

Writing: each page becomes a record whose payload is the html in UTF-8. Of pages with equal payloads the one with the
smallest page_id is a response, the others are revisits that refer to it and carry its digest and length. Records are
written through Spark's text sink (record headers and payload are text, the separator is the record's closing blank lines), so the
archives go to any file system that Spark writes; a file holds at most ``records_per_archive`` records.

Reading: archives are parsed by Content-Length, so payloads may hold anything; a response's digest is verified. The
entries of one archive, sorted by URL key and timestamp, are a run. The runs are dealt out by key ranges (ranges also
cut a URL that holds a large part of all captures, by its timestamps) and the pieces of all runs that fall in a range are
merged by a loser tree, so the partitions, in order, are one globally ordered history of captures.

Defined cases: null html is an empty payload; a null url has an empty key; rows under one page_id that is the smallest of its payload are
all responses; a null page_id is kept and is a revisit where another page has its payload; an empty table gives no archive entries; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictora.llm.common import durable, scratch, small

VERSION = "WARC/1.1"
URN = "urn:pictora:page:"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
RECORDS_PER_ARCHIVE = 2048
#: Entries merged in one task, on average.
SLICE_ENTRIES = 100_000
ENTRY = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query; no scheme, fragment, port 80 or 443, or leading www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def _id(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: str, found: str, size: int, refers_to: int | None, revisit: bool) -> str:
    """One record without the blank lines that close it."""
    when = FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{found}", f"X-Payload-Length: {size}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}", "Content-Length: 0"]
    else:
        head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    return "\r\n".join(head) + "\r\n\r\n" + ("" if revisit else payload)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x.as_py() or b"") for x in batch.column(1)], pa.string())], ["page_id", "digest"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, html, found, first in zip(*(c.to_pylist() for c in batch.columns)):
            html = html or ""
            out.append(record(page_id, url, html, found, len(html.encode()), first, first is not None and first != page_id))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([digest((x.as_py() or "").encode()) for x in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], ["page_id", "url", "html", "digest"])


def write(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE, least_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as archives under ``path``; payloads under ``least_bytes`` are never revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).select("page_id", F.col("html").cast("binary").alias("html")).mapInArrow(_digests, "page_id long, digest string")
    shared = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select(F.col("digest").alias("shared"), "first_id")
    marked = rows.mapInArrow(_with_digest, "page_id long, url string, html string, digest string")
    joined = marked.join(small(durable(shared)), (F.col("digest") == F.col("shared")) & (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes), "left")
    records = joined.select("page_id", "url", "html", "digest", "first_id").mapInArrow(_records, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_archive).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (names in lower case), content, offset and length of each record."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        body = archive.index(b"\r\n\r\n", at) + 4
        lines = archive[at:body].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
        end = body + int(head["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its Content-Length says")
        yield head, archive[body:end], at, end + 4 - at
        at = end + 4


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(URN)
    return int(number) if number else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run for each archive: its entries, sorted, each with its place in the run."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run, name = [], path.rsplit("/", 1)[-1]
            for head, body, at, length in parse(content.as_py()):
                found, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                if head["warc-type"] == "response" and (digest(body), len(body)) != (found, size):
                    raise ValueError(f"{path}: the payload at byte {at} doesn't have the digest {found}")
                run.append((url_key(head.get("warc-target-uri")), re.sub(r"\D", "", head["warc-date"]), _page(head["warc-record-id"]), head["warc-type"], _page(head.get("warc-refers-to")), found, size, name, at, length))
            run.sort(key=_order)
            if run:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*run), kinds)), pa.array(range(len(run)), pa.int64())], [*NAMES, "place"])


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[7], entry[8]


class LoserTree:
    """Merges sorted lists: inner nodes keep the losers of their matches, the overall winner stands above the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.at = [0] * self.n
        self.key = [_order(r[0]) if r else None for r in runs]
        self.loser = [-1] * self.n
        for leaf in range(self.n):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.key[a] is None or self.key[b] is None:
            return self.key[b] is None and (self.key[a] is not None or a < b)
        return (self.key[a], a) < (self.key[b], b)

    def _play(self, leaf: int) -> None:
        """Send a leaf up: at each node the loser stays; while the tree is built, the first to arrive waits."""
        node, winner = (leaf + self.n) // 2, leaf
        while node:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.key[w := self.loser[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.key[w] = _order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, rows = None, []
    for batch in batches:
        schema = batch.schema
        rows += zip(*(c.to_pylist() for c in batch.columns))
    if not rows:
        return
    merged = list(LoserTree([list(run) for _, run in groupby(rows, key=lambda e: e[7])]))
    for at in range(0, len(merged), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*merged[at : at + 10_000]), schema)], schema.names)


def index(spark: SparkSession, path: str, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """The ordered capture history of the archives under ``path``: one entry for each record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = durable(files.mapInArrow(_entries, ENTRY + ", place long"))
    slices = max(1, -(-runs.count() // slice_entries))
    ranged = runs.repartitionByRange(slices, "url_key", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", "place")
    return ranged.select(*NAMES).mapInArrow(_merge, ENTRY)


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
