"""FASTA as a source format of Spark, in batches and as a stream: ``spark.read.format("fasta").load(path)``.

A file is read in byte ranges, a task each. A range holds the records whose header begins in it: it starts at the first header
at or after its first byte and reads on past its last byte to the end of its last record, so no range needs another, and a
record is held one at a time. Files are listed and opened through Arrow's file systems (local paths and URIs).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range by default, of a read, and letters of an Arrow batch, about.
RANGE_BYTES, READ_BYTES, BATCH_LETTERS = 64 << 20, 1 << 20, 4 << 20
SCHEMA = "seq_id long, name string, seq string, len int, file string, at long"
#: Bits of a record's number within its range.
PLACE_BITS = 33
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass
class Range(InputPartition):
    """Bytes [begin, end) of a file; ``number``: the range's place among all, or -1 in a stream."""

    file: str
    begin: int
    end: int
    number: int = -1


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[pafs.FileInfo]:
    """The file, or the files below the folder, without hidden ones; in order of path."""
    system, inner = located(path)
    found = system.get_file_info(inner)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.is_file:
        return [found]
    files = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def records(stream, begin: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Byte place and bytes (without the ``>``) of each record whose header begins in [begin, end)."""
    base = max(begin - 1, 0)
    stream.seek(base)
    held, header, done = b"", None, False
    at = 0  # searched up to here
    while True:
        if header is None and base == 0 and begin == 0 and held.startswith(b">"):
            header, at = 0, 1
        found = held.find(b"\n>", at)
        if found >= 0:
            if header is not None:
                yield base + header, held[header + 1 : found]
            header = found + 1
            if base + header >= end:
                return
            # what lies before the header is not needed any more
            base, held, header, at = base + header, held[header:], 0, 1
            continue
        if done:
            if header is not None:
                yield base + header, held[header + 1 :]
            return
        if header is None:
            if base + len(held) > end:  # no header can begin in the range any more
                return
            keep = held[-1:]
            base, held = base + len(held) - len(keep), keep
        at = max(len(held) - 1, 0) if header is None else max(len(held) - 1, 1)
        more = stream.read(read_bytes)
        done = not more
        held += more


def parsed(record: bytes) -> tuple[str, str] | None:
    """Name and sequence (upper case, lines joined); None of a record without either."""
    name, _, body = record.partition(b"\n")
    if not record.strip(b" "):
        return None
    return name.removesuffix(b"\r").decode("utf-8", "replace"), body.translate(None, _SPACE).decode("utf-8", "replace").upper()


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    system, inner = located(part.file)
    rows, letters, place = [], 0, 0

    def told() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    with system.open_input_file(inner) as stream:
        for at, record in records(stream, part.begin, part.end):
            found = parsed(record)
            if found is None:
                continue
            name, seq = found
            if part.number >= 0:
                seq_id = (part.number << PLACE_BITS) + place
            else:  # of a stream: the same whenever the record is read
                seq_id = int.from_bytes(hashlib.blake2b(f"{part.file}:{at}".encode(), digest_size=8).digest(), "little") >> 1
            rows.append((seq_id, name, seq, len(seq), part.file, at))
            place, letters = place + 1, letters + len(seq) + len(name)
            if letters >= BATCH_LETTERS:
                yield told()
                rows, letters = [], 0
    if rows:
        yield told()


def ranges(files: list[pafs.FileInfo], size: int, uri: str, numbered: bool) -> list[Range]:
    """Ranges of ``size`` bytes of all files, in order; an empty file has none."""
    scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
    name = lambda f: f"{scheme}{f.path}" if scheme else f.path
    out = [Range(name(f), begin, min(begin + size, f.size)) for f in files for begin in range(0, f.size, size)]
    return [Range(r.file, r.begin, r.end, k) for k, r in enumerate(out)] if numbered else out


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(listed(self.path), self.size, self.path, True) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from _batches(partition)


class FastaStreamReader(DataSourceStreamReader):
    """New files of a folder, by time of change and path; the offset is the last file that was taken."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    @staticmethod
    def _key(f: pafs.FileInfo) -> tuple[int, str]:
        return f.mtime_ns or 0, f.path

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        time, file = max((self._key(f) for f in listed(self.path)), default=(-1, ""))
        return {"time": time, "file": file}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return ranges([f for f in listed(self.path) if low < self._key(f) <= high], self.size, self.path, False) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from _batches(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is held for an offset


class FastaSource(DataSource):
    """Options: ``path`` (a file, folder or URI) and ``rangeBytes``. Ids grow in file order and are not dense (``fasta_table``)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def streamReader(self, schema) -> FastaStreamReader:
        return FastaStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(FastaSource)


def fasta_table(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``seq_id, name, seq, len`` with dense ids in file order: a record's place in its range, and the counts of the ranges before.

    A row a range is all that is gathered for the ids; nothing is sorted.
    """
    register(spark)
    rows = spark.read.format("fasta").option("rangeBytes", range_bytes).load(path)
    number = F.shiftright("seq_id", PLACE_BITS).alias("range")
    sizes = rows.groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    place = F.col("seq_id") - F.shiftleft(F.col("range"), PLACE_BITS)
    return rows.withColumn("range", number).join(F.broadcast(before), "range").select((place + F.col("before")).alias("seq_id"), "name", "seq", "len")
