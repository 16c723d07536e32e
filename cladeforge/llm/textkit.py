"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, digests, chunks.

Equality of words, lines and other ranges is told by their content within a chunk (``interned``) and by 128 bits of BLAKE2b
under a key of each run (``digests``) between chunks, so nobody can build two texts that agree. ``prefix`` and ``span_hash``
are a polynomial, which can be solved: it only picks places and groups whose bytes are compared afterwards. All functions here
are plain numpy on one chunk of rows; Spark deals the rows out.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base modulo 2**64; kept between calls, since all chunks need the same ones."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), _BASE, dtype=U64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a chunk of its own and is never cut."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


def pieces(batch: pa.RecordBatch, column: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a string or binary column each, so that work on one stays small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    for a, b in chunks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), size):
        yield batch.slice(a, b - a)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def new_key() -> bytes:
    """A key for the digests of one run; drawn on the driver and sent along with its tasks, so that those run again agree."""
    return secrets.token_bytes(16)


def digests(values: pa.Array, key: bytes) -> np.ndarray:
    """(n, 2) of 64 bits: BLAKE2b under ``key`` of each binary value."""
    return np.frombuffer(b"".join(hashlib.blake2b(v, digest_size=16, key=key).digest() for v in values.to_pylist()), dtype=U64).reshape(-1, 2)


def range_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """64 bits of BLAKE2b under ``key`` of each range [start, end), which may overlap."""
    held = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(hashlib.blake2b(held[i:j], digest_size=8, key=key).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)), dtype=U64)


def prefix(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of the polynomial hash."""
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each range [start, end): equal bytes give equal values in any chunk."""
    with np.errstate(over="ignore"):
        raw = (sums[end] - sums[start]) * powers(len(sums))[len(sums) - 1 - start]
        # the shift to a common origin depends on the chunk's length; undo that part
        raw = raw * _inverse_power(len(sums) - 1)
        return mix(raw ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def _inverse_power(n: int) -> np.uint64:
    return U64(pow(pow(_BASE, n, 1 << 64), -1, 1 << 64))


class Runs:
    """Maximal runs of bytes of a chunk for which ``inside`` is true; none crosses rows.

    start, end: byte ranges; row: the row of each; first: n+1 offsets, the runs of row r are first[r]:first[r+1].
    """

    def __init__(self, inside: np.ndarray, offsets: np.ndarray):
        n = len(inside)
        held = np.zeros(n + 2, dtype=bool)
        held[1:-1] = inside
        begins = held[1:-1] & ~held[:-2]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = held[1:-1][cut]
        ends = held[1:-1] & ~held[2:]
        ends[cut - 1] = held[1:-1][cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


class Words(Runs):
    """Words ``[^\x20\x09-\x0D]+`` of the rows of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(~_SPACE[data], offsets)


def interned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of each range [start, end) and the bytes of each code: by content, so equal codes are equal bytes. Ranges are in order."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    cuts = np.empty(2 * n, dtype=np.int64)
    cuts[0::2], cuts[1::2] = start, end
    # ranges and what stands between them take turns; every second one is taken
    spaced = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    named = spaced.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode()
    return named.indices.to_numpy().astype(np.int64), named.dictionary


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Chained mix of each run of ``k`` consecutive digests; len(values) - k + 1 of them. Order and ``k`` count."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, mix(np.array([k], dtype=U64))[0])
    for i in range(k):
        out = mix(out ^ values[i : i + n])
    return out
