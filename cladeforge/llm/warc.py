"""WARC archives with a two-level capture index.

Pages go into gzip-per-record WARC files in the shared folder, one writer a task. The index has two levels: captures sorted
by reversed-host URL key, packed into compressed blocks (one after another in index files), and a sparse directory of the
blocks' first keys and places. A look-up binary searches the directory, reads the block's range, binary searches the block,
and yields (file, offset, length); records are then fetched by range reads, dealt out by place so that each file is read in
one direction.

A task that is run again writes files with new names; only the rows of the attempt that counted name a file, and those rows
are written to a table at once, so a lost executor leaves unnamed files behind and nothing else.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .common import materialize, table

#: Captures a block holds at least; blocks grow once the directory would have more than MAX_DIRECTORY entries.
BLOCK_LINES, MAX_DIRECTORY, MAX_FILE_BYTES = 512, 65_536, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits that are broadcast at most; more are joined by id and digest.
MAX_REVISITS = 500_000
#: Compressed record bytes of a fetching task at most, and at least where that gives fewer tasks than there are cores.
FETCH_BYTES, LEAST_FETCH_BYTES = 64 << 20, 1 << 20
INDEX = "url_key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; ``http://www.Ex.org/a?b`` gives ``org,ex,www)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column, by built-in functions: 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    if re.match(r"file:/+", uri):
        uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC 1.1 record. A revisit keeps the HTTP headers, with the length of the payload, but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {(refers_url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; the payload's length and digest are of the full payload for revisits too."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.partition(": ")[::2] for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != told or len(payload) != size:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} has digest {found}, not {told}")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": told, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "payload": payload}


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write one record for each row of ``pages(page_id, url, html)``; returns a capture's key and place for each.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest ``page_id`` are responses,
    the others revisits. Null html is an empty payload, null url an empty key. A null ``page_id`` is never the smallest;
    where a payload has only null ids, all are responses. Repeated rows are records of their own. Other columns are ignored.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    held = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    firsts = held.filter(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")).filter((F.col("n") > 1) & F.col("first").isNotNull())
    repeated = materialize(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-repeated")
    # ids and digests meet first: a payload that very many rows share brings together rows of a few bytes only
    told = held.select("page_id", "digest").join(repeated, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    revisits = materialize(told.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first_id").alias("refers_to"), F.col("first_url").alias("refers_url")), "warc-revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= MAX_REVISITS else revisits
    rows = held.join(revisits, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to", "refers_url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        task, stream, name, size, n = TaskContext.get(), None, "", 0, 0
        try:
            for batch in batches:
                columns = [_column(batch, c) for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")]
                places = []
                for page_id, url, body, digest, refers_to, refers_url in zip(*columns, strict=True):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, body, digest, refers_to, refers_url, date)) + packer.flush()
                    if stream is None or size + len(raw) > MAX_FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, size, n = f"part-{task.partitionId():06d}-{n:04d}-{uuid.uuid4().hex}.warc.gz", 0, n + 1
                        store.create_dir(at, recursive=True)
                        stream = store.open_output_stream(f"{at}/{name}", compression=None, buffer_size=1 << 20)
                    stream.write(raw)
                    places.append((url_key(url), page_id, name, size, len(raw)))
                    size += len(raw)
                if places:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*places, strict=True), kinds, strict=True)], names=["url_key", "page_id", "file", "offset", "length"])
        finally:
            if stream is not None:
                stream.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-captures")


def span(keys: list[str], key: str) -> list[int]:
    """Blocks that may hold a key: from the last that begins before it to the last that begins with it."""
    return list(range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)))


class CaptureIndex:
    """The directory of an index: first keys and places of its blocks (at most MAX_DIRECTORY and one a partition)."""

    def __init__(self, blocks: DataFrame, folder: str):
        self.spark, self.folder = blocks.sparkSession, folder
        rows = sorted((r.first_key, r.file, r.offset, r.length) for r in blocks.collect())
        self.keys, self.places = [r[0] for r in rows], [tuple(r[1:]) for r in rows]

    def lookup(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """``url_key, page_id, file, offset, length`` of all captures of the (distinct) URL keys of a column; null URLs count.

        Keys are dealt out in order of block, and a task reads the range of each block that it needs once. Keys that fall
        into one block may go to several tasks, so a crowd of unknown keys does no harm.
        """
        directory, folder = self.spark.sparkContext.broadcast((self.keys, self.places)), self.folder

        @F.pandas_udf("string")
        def keys(u):
            return u.map(lambda x: url_key(x) if isinstance(x, str) else "")

        @F.pandas_udf("array<int>")
        def spans(k):
            return k.map(lambda x: span(directory.value[0], x))

        asked = urls.select(keys(F.col(url)).alias("url_key")).distinct().select(F.explode(spans("url_key")).alias("block"), "url_key")

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, at = open_store(folder)
            now, lines, held, name, handle = None, [], [], None, None
            for batch in batches:
                hits = []
                for block, key in zip(_column(batch, "block"), _column(batch, "url_key"), strict=True):
                    if block != now:
                        now, (file, offset, length) = block, directory.value[1][block]
                        if file != name:
                            name, handle = file, store.open_input_file(f"{at}/{file}")
                        handle.seek(offset)
                        lines = [line.split("\t") for line in zlib.decompress(handle.read(length)).decode().split("\n")]
                        held = [_unescape(x[0]) for x in lines]
                    hits += lines[bisect.bisect_left(held, key) : bisect.bisect_right(held, key)]
                yield pa.RecordBatch.from_pydict({"url_key": pa.array([_unescape(h[0]) for h in hits], pa.string()), "page_id": pa.array([int(h[1]) if h[1] else None for h in hits], pa.int64()), "file": pa.array([h[2] for h in hits], pa.string()), "offset": pa.array([int(h[3]) for h in hits], pa.int64()), "length": pa.array([int(h[4]) for h in hits], pa.int64())})

        return asked.repartitionByRange("block", "url_key").sortWithinPartitions("block", "url_key").mapInArrow(search, INDEX)

    def fetch(self, places: DataFrame, payload: bool = True) -> DataFrame:
        """The records at ``file, offset, length``, parsed; a payload whose digest is wrong is an error.

        The number of tasks follows the bytes to be read, not the rows of ``places``.
        """
        schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 6 + payload]
        folder, places = self.folder, materialize(places.select("file", "offset", "length"), "warc-places")
        size = places.agg(F.sum("length")).first()[0] or 0
        tasks = max(-(-size // FETCH_BYTES), min(size // LEAST_FETCH_BYTES, self.spark.sparkContext.defaultParallelism), 1)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, at = open_store(folder)
            name, handle = None, None
            for batch in batches:
                out = []
                for file, offset, length in zip(*[_column(batch, c) for c in ("file", "offset", "length")], strict=True):
                    if file != name:
                        name, handle = file, store.open_input_file(f"{at}/{file}")
                    handle.seek(offset)
                    out.append(parse(zlib.decompress(handle.read(length), 31)))
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in out], type=t) for k, t in kinds})

        return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def _escape(key: str) -> str:
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _unescape(key: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), key) if "\\" in key else key


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures by URL key and pack them into compressed blocks; larger blocks keep the directory at its bound."""
    n = captures.count()
    lines = max(block_lines, -(-n // MAX_DIRECTORY))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        name, stream, size = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx", None, 0
        told, held = [], []

        def close_block() -> None:
            nonlocal stream, size, held
            data = zlib.compress("\n".join("\t".join((_escape(k), "" if p is None else str(p), f, str(o), str(s))) for k, p, f, o, s in held).encode(), 6)
            if stream is None:
                store.create_dir(at, recursive=True)
                stream = store.open_output_stream(f"{at}/{name}", compression=None, buffer_size=1 << 20)
            stream.write(data)
            told.append((held[0][0], name, size, len(data)))
            held, size = [], size + len(data)

        try:
            for batch in batches:
                for row in zip(*[_column(batch, c) for c in ("url_key", "page_id", "file", "offset", "length")], strict=True):
                    held.append(row)
                    if len(held) >= lines:
                        close_block()
            if held:
                close_block()
        finally:
            if stream is not None:
                stream.close()
        if told:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)], names=["first_key", "file", "offset", "length"])

    # bytewise order in Spark is code-point order in Python, for both strings and this sort
    ordered = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return CaptureIndex(materialize(ordered.mapInArrow(pack, "first_key string, file string, offset long, length long"), "warc-directory"), folder)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cladeforge/warc-{uuid.uuid4().hex}"


def op1_warc_index(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives: payload size and digest, and what it revisits. Null html is empty."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = archive_folder(spark)
    index = build_index(write_archives(pages, folder), folder)
    return index.fetch(index.lookup(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
