"""WARC archives with a two-level capture index.

Archives are files of one gzip member per record. The index is a sorted list of captures (reversed-host URL key, id, archive, offset,
length) in compressed blocks; a sparse directory holds each block's first and last key, and the list of index files the first and last
key of each. A look-up finds the index file and the blocks by binary search, reads just those blocks, and reads the records by range.

Executors write files through pyarrow.fs into the folder that the cluster shares, under names of their own; only those that a
successful task reports are ever read, so lost or repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import arrow_map, batch, materialise, pieces, shared_path, small, store_of

#: Lines of an index block; bytes after which a task starts another archive.
BLOCK_LINES, ARCHIVE_BYTES = 2000, 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "page_id bigint, urlkey string, archive string, offset bigint, length bigint"
DIRECTORY = "first string, last string, file string, offset bigint, length bigint, lines bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: str | None) -> str:
    """http://www.Example.com:80/a?b -> com,example)/a?b; a URL without a host is its own key, null is '-'."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host, port = None, None
    if not host:
        return quote(url.strip(), safe="!#$%&'()*+,/:;=?@[]~") or "-"
    host = re.sub(r"^www\d*\.", "", host.rstrip("."))
    port = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme.lower())) else f":{port}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + tail.lower(), safe="!#$%&'()*+,/:;=?@[]~")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parsed(data: bytes) -> dict:
    """A record's fields; the payload is None for a revisit. Its digest is computed anew where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda s: None if s is None or s == "<urn:page:none>" else int(s[len("<urn:page:") : -1])
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


@lru_cache(64)
def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return store_of(folder)


@lru_cache(32)
def _opened(folder: str, name: str) -> pa.NativeFile:
    store, path = _store(folder)
    return store.open_input_file(f"{path}/{name}")


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    file = _opened(folder, name)
    file.seek(offset)
    return file.read(length)


def _write(folder: str, date: str):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("urlkey", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        out = name = None
        offset = 0
        store, path = _store(folder)
        for b in pieces(it, 2):
            rows = []
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = gzipped(record(page_id, url, (html or "").encode(), kind, refers_to, date))
                out.write(data)
                rows.append((page_id, url_key(url), name, offset, len(data)))
                offset += len(data)
                if offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield batch(schema, *map(list, zip(*rows)))
        if out is not None:
            out.close()

    return fn


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html, ...) -> the captures written (page_id, urlkey, archive, offset, length), one record per row.

    Of rows with equal payloads of at least min_bytes the one with the largest page_id is a response and the others are revisits of
    it; repeated rows of that page_id are responses each. A null html is an empty payload; a null url leaves out the target; a row with a null
    page_id revisits if its group has any page_id, and is a response otherwise. No rows: no archives.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = materialise(pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= min_bytes).select("page_id", "sha"), "warc-digests")
    largest = narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("sha", "refers_to")
    # a join only, with a shuffle of its own behind it: where a third of all pages are equal, adaptive execution splits that partition
    revisits = materialise(narrow.join(largest, "sha").where("page_id IS NULL OR page_id <> refers_to").groupBy("page_id", "sha").agg(F.first("refers_to").alias("refers_to")), "warc-revisits")
    named = revisits.select(F.col("page_id").alias("p"), "sha", "refers_to")
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("own"))
    rows = rows.join(small(named), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("own") == F.col("sha")), "left")
    kind: Column = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return materialise(rows.select("page_id", "url", "html", kind.alias("kind"), "refers_to"), "captures", _write(folder, date), CAPTURES)


def _index(folder: str):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])
        store, path = _store(folder)
        out, name, offset, lines, ends = None, f"{uuid.uuid4().hex}.idx", 0, [], []
        blocks: list[tuple] = []

        def block():
            nonlocal out, offset, lines, ends
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            blocks.append((ends[0], ends[-1], name, offset, len(data), len(lines)))
            offset, lines, ends = offset + len(data), [], []

        for b in it:
            for page_id, key, archive, at, length in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(f"{key} {json.dumps([page_id, archive, at, length])}")
                ends.append(key)
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            # the file's own directory lies beside it: look-ups read it after they chose the file
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write(json.dumps([[x[0], x[1], x[3], x[4]] for x in blocks]).encode())
            yield batch(schema, *map(list, zip(*blocks)))

    return fn


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by URL key into compressed blocks -> the block directory (first, last, file, offset, length, lines)."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.repartitionByRange(n, "urlkey", "archive", "offset").sortWithinPartitions("urlkey", "archive", "offset")
    return materialise(rows.select("page_id", "urlkey", "archive", "offset", "length"), "directory", _index(folder), DIRECTORY)


@lru_cache(16)
def _directory(folder: str, file: str) -> tuple[list, list]:
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{file}.dir") as f:
        blocks = json.loads(f.read())
    return blocks, [x[1] for x in blocks]


@lru_cache(8)
def _lines(folder: str, file: str, offset: int, length: int) -> tuple[list[str], list[list]]:
    found = [x.split(" ", 1) for x in zlib.decompress(read_range(folder, file, offset, length)).decode().split("\n")]
    return [x[0] for x in found], [json.loads(x[1]) for x in found]


def _choose(folder: str, files: list[tuple[str, str, str]]):
    """URL keys -> the index blocks that may hold each, by binary search in the list of files and in their directories. files: (first, last, file) by key."""
    lasts = [x[1] for x in files]

    def chosen(key: str) -> Iterator[tuple]:
        for first, _, file in files[bisect.bisect_left(lasts, key) :]:
            if first > key:
                return
            blocks, block_lasts = _directory(folder, file)
            for lo, _, offset, length in blocks[bisect.bisect_left(block_lasts, key) :]:
                if lo > key:
                    break
                yield key, file, offset, length

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("urlkey", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in it:
            rows: list[tuple] = []
            for key in b.column(0).to_pylist():
                for row in chosen(key):
                    rows.append(row)
                    if len(rows) == 10_000:  # a key may fill any number of blocks
                        yield batch(schema, *map(list, zip(*rows)))
                        rows = []
            if rows:
                yield batch(schema, *map(list, zip(*rows)))

    return fn


def _fetch(folder: str):
    """(urlkey, file, offset, length) -> the captures of the key in that block; a block has BLOCK_LINES at most."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("urlkey", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in it:
            rows: list[tuple] = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                keys, found = _lines(folder, file, offset, length)
                rows += [(x[0], key, *x[1:]) for x in found[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
                if len(rows) >= 10_000:
                    yield batch(schema, *map(list, zip(*rows)))
                    rows = []
            if rows:
                yield batch(schema, *map(list, zip(*rows)))

    return fn


def _url_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["urlkey"])


def look_up(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """urls(url, ...) -> the captures of each distinct key of theirs, found through the index in `folder`.

    Blocks are chosen first and then dealt out, so that a key with a third of all captures is read by as many tasks as it has blocks.
    """
    # one row an index file, and there is one for each range partition at most
    files = [tuple(r) for r in directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last", "file").orderBy("first", "last").collect()]
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = arrow_map(urls.select("url"), _url_keys, "urlkey string").distinct().repartitionByRange(n, "urlkey").sortWithinPartitions("urlkey")
    chosen = arrow_map(keys, _choose(folder, files), "urlkey string, file string, offset bigint, length bigint")
    return arrow_map(chosen.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "urlkey"), _fetch(folder), CAPTURES)


def _read(folder: str, payloads: bool):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in it:
            rows: list[dict] = []
            held = 0
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                row = parsed(zlib.decompress(read_range(folder, archive, offset, length), 31))
                row["payload"] = row["payload"] if payloads else None
                held += len(row["payload"] or b"") + 200
                rows.append(row)
                if held >= 8 << 20:
                    yield batch(schema, *([r[n] for r in rows] for n in schema.names))
                    rows, held = [], 0
            if rows:
                yield batch(schema, *([r[n] for r in rows] for n in schema.names))

    return fn


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Reads captured records by range, in the archives' order -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return arrow_map(rows, _read(folder, payloads), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives, indexes them, looks every URL up in the index and reads the records back, one row per row of pages."""
    folder = shared_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, min_bytes)
    directory = write_index(captures, folder)
    found = materialise(look_up(pages, directory, folder), "warc-found")
    return read_records(found, folder, payloads=False).drop("payload")
