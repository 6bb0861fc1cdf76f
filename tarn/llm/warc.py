"""WARC archives with a two-level capture index.

Each task writes one archive of gzip members, a record each, into the shared
folder under a name of its own; only the names that Spark's commit keeps are
used, so a task that is tried again leaves at most a file that nothing refers
to. Captures are sorted by reversed-host URL key, range by range, into
compressed blocks of LINES lines; the directory has the first key of each block.
A look-up sorts its keys, binary-searches the part of the directory that its
range needs, deals the blocks found out by place, so that a key of many captures
is read by many tasks, reads them by range, and then the records by range. Pages
wait on a shelf while their digests are compared: html is never shuffled.

Of records with equal payloads of at least LEAST bytes, that with the largest
page_id is the response and the others are revisits of it.

Defined cases: a null html is an empty payload, a null url has the empty key; a
row without page_id is a response and is never referred to; repeated rows of the
largest page_id are all responses; of equal payloads without a page_id all are
responses; payloads of any length are kept whole, one in memory at a time beside
a batch; other columns are not read, whatever their names; an empty table gives
no archive and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, delete, rows_of, scratch, stored
from .shelf import Shelf, open_store

LEAST = 1000
LINES = 500
ID = "urn:x-page:"
CAPTURE = "urlkey string, page_id long, file string, offset long, length long"
BLOCK = "first string, last string, file string, offset long, length long, lines long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/path?query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with the response or revisit record of a page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = "".join(url.split()) if url else "about:blank"
    headers = [
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        body = _record("response", headers, http + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        body = _record("revisit", [*headers, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{ID}{refers_to}>")], http)
    return gzip.compress(body, 1, mtime=0)


def read_record(member: bytes) -> dict:
    """Fields of a record; a response's payload is tested against its digest."""
    body = zlib.decompress(member, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda k: (lambda s: int(s) if s else None)(named[k][1 + len(ID) : -1]) if k in named else None
    if named["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload digest")
    return {
        "page_id": number("WARC-Record-ID"), "url": named["WARC-Target-URI"], "record_type": named["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


class _Ranges:
    """Range reads from files of one folder; the last file stays open."""

    def __init__(self, uri: str):
        self.fs, self.path = open_store(uri)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


CAPTURE_ARROW = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
BLOCK_ARROW = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


class _Archive:
    """The archive that one task writes, begun with its first record."""

    def __init__(self, folder: str):
        self.store, self.path = open_store(folder)
        self.name, self.out, self.at = f"{uuid.uuid4().hex}.warc.gz", None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.store.create_dir(self.path, recursive=True)
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    @classmethod
    @contextmanager
    def opened(cls, folder: str):
        own = cls(folder)
        try:
            yield own
        finally:
            if own.out is not None:
                own.out.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in a folder; returns their stored captures."""
    shelf = Shelf(pages.select("page_id", "url", "html"), "html")
    page_id = F.col("rest").getField("page_id")
    rows = shelf.rows.filter((F.octet_length("text") >= LEAST) & page_id.isNotNull()).select("row", page_id.cast("long").alias("page_id"), F.sha1("text").alias("digest"))
    large, large_path = stored(rows, "digests")
    # Digests that occur once need no entry.
    shared, shared_path = stored(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper"), "originals")
    again = large.join(shared, "digest").filter("page_id <> keeper").select("row", F.col("keeper").alias("refers_to"))

    def make(rows: pa.RecordBatch, asked: pa.Table, out: _Archive) -> Iterator[pa.RecordBatch]:
        refers = dict(zip(asked.column("row").to_pylist(), asked.column("refers_to").to_pylist(), strict=True))
        found: dict[str, list] = {f.name: [] for f in CAPTURE_ARROW}
        for row, html, rest in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2).to_pylist(), strict=True):
            member = make_record(rest["page_id"], rest["url"], html.as_py() or b"", refers.get(row))
            for k, v in zip(found, (url_key(rest["url"]), rest["page_id"], *out.add(member)), strict=True):
                found[k].append(v)
        yield _rows(found, CAPTURE_ARROW)

    captures, _ = stored(shelf.visit(again, make, CAPTURE, columns=("text", "rest"), every=True, opened=partial(_Archive.opened, folder)), "captures")
    for path in (large_path, shared_path):
        delete(pages.sparkSession, path)
    shelf.drop()
    return captures


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by key into compressed blocks in a folder; returns the stored block directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        name = f"{uuid.uuid4().hex}.cdx.gz"
        out, at, lines, keys = None, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            block = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(block)
            row = {"first": [keys[0]], "last": [keys[-1]], "file": [name], "offset": [at], "length": [len(block)], "lines": [len(lines)]}
            at += len(block)
            lines.clear()
            keys.clear()
            return _rows(row, BLOCK_ARROW)

        try:
            for batch in rows_of(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines.append(json.dumps(row))
                    keys.append(row[0])
                    if len(lines) == LINES:
                        yield flush()
            if lines:
                yield flush()
        finally:
            if out is not None:
                out.close()

    order = ("urlkey", "file", "offset")
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(arrow_map(ranged, run, BLOCK), "directory")[0]


ASKED = "urlkey string, file string, offset long, length long"
ASKED_ARROW = pa.schema([("urlkey", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: Captures of one output batch of a look-up.
FOUND_ROWS = 4096


def look_up(urls: DataFrame, directory: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """Captures of every distinct URL key of a column, through the directory."""
    where = sorted({f.rpartition("/")[0] for f in directory.inputFiles()})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(dict.fromkeys(map(url_key, batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["urlkey"])

    wanted = arrow_map(urls.select(url), keys, "urlkey string").distinct().repartitionByRange("urlkey").sortWithinPartitions("urlkey")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each key may lie in."""
        import pyarrow.dataset as ds

        known = None
        for batch in rows_of(batches):
            asked = batch.column(0).to_pylist()
            if not asked or not where:
                continue
            if known is None:
                store, path = open_store(where[0])
                known = ds.dataset(path, filesystem=store, format="parquet")
            # Only the part of the directory that this range of keys can need.
            part = known.to_table(filter=(ds.field("first") <= asked[-1]) & (ds.field("last") >= asked[0])).sort_by([("first", "ascending"), ("last", "ascending")]).to_pylist()
            firsts = [b["first"] for b in part]
            found: dict[str, list] = {f.name: [] for f in ASKED_ARROW}
            for key in asked:
                # The blocks that can hold the key end with the last that starts at or before it.
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and part[at]["last"] >= key:
                    for k, v in zip(found, (key, part[at]["file"], part[at]["offset"], part[at]["length"]), strict=True):
                        found[k].append(v)
                    at -= 1
            yield _rows(found, ASKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, last, lines = _Ranges(folder), None, []
        try:
            for batch in rows_of(batches):
                found: dict[str, list] = {f.name: [] for f in CAPTURE_ARROW}
                for key, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != last:
                        raw = gzip.decompress(ranges.read(*block)).decode("utf-8", "surrogatepass")
                        last, lines = block, [json.loads(x) for x in raw.split("\n")]
                    for row in lines[bisect.bisect_left(lines, key, key=lambda r: r[0]) : bisect.bisect_right(lines, key, key=lambda r: r[0])]:
                        for k, v in zip(found, row, strict=True):
                            found[k].append(v)
                    if len(found["urlkey"]) >= FOUND_ROWS:
                        yield _rows(found, CAPTURE_ARROW)
                        found = {f.name: [] for f in CAPTURE_ARROW}
                yield _rows(found, CAPTURE_ARROW)
        finally:
            ranges.close()

    order = ("file", "offset", "urlkey")
    dealt = stored(arrow_map(wanted, blocks, ASKED), "blocks")[0].repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(arrow_map(dealt, run, CAPTURE), "found")[0]


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of captures, by range reads in the order of files and offsets; with their payload if asked."""
    ranged = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = RECORD_ARROW.append(pa.field("payload", pa.binary())) if payload else RECORD_ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        try:
            for batch in rows_of(batches):
                found: dict[str, list] = {f.name: [] for f in schema}
                for at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = read_record(ranges.read(*at))
                    for k in found:
                        found[k].append(row[k])
                yield _rows(found, schema)
        finally:
            ranges.close()

    return arrow_map(ranged, run, RECORD + (", payload binary" if payload else ""))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages and their index, then reads every page's record through the index."""
    folder = scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    directory = write_index(captures, folder)
    return read_records(look_up(pages, directory, folder), folder)
