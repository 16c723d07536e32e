"""Near-duplicate documents by HyperMinHash sketches of their five-word shingles.

A document's set of shingles goes into STREAMS x BUCKETS registers; a register holds the leading-zero count and MANTISSA
bits of the least hash of its bucket. Bands of three registers make keys, and documents that share a key are candidates. A
register-match count, corrected for chance collisions, estimates the Jaccard similarity of a candidate pair; pairs that may
reach the threshold are confirmed on full sets. Sets too small to fill the registers keep their shingles instead, and their
keys are the rarest ones, as many as two similar sets must share one of (prefix filter), so none of those pairs is missed.

Equal sets count as one from the start. Within a key, all are held against its smallest member first (a star, not all
pairs). What that leaves in different components is compared in blocks inside the tasks, on sketches: each document names its
best partner in a block first, and once those links have joined components, all partners that remain. Before that, documents
drop out whose shingles occur too seldom outside their component for any link.

A shingle is held as 128 bits, a chain over the keyed digests of its words (``textkit.digests``) in two lanes of 64. The first
lane alone makes registers and keys, which only find candidates; set sizes, equal sets and confirmed links take both. The key
is drawn for each run, so no two texts can be built that agree without the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, table
from .components import components

SHINGLE, STREAMS, BUCKETS, MANTISSA, ROWS = 5, 4, 32, 10, 3
REGISTERS = STREAMS * BUCKETS
BANDS = REGISTERS // ROWS
#: Sets of at most SPARSE shingles are found by their rarest shingles, those of more than DENSE by bands; both, in between.
DENSE, SPARSE = 64, 85
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
MARGIN, BLOCK = 5.0, 1024
#: Ids that are broadcast at most (8 bytes each).
MAX_BROADCAST = 1_000_000
# Fixed value: expected chance collisions of a register with sets of equal size, times 2**mantissa bits.
COLLISION = 0.169919487159739093975315012348
#: Streams and bits of the fine registers, which only documents in still open keys get.
FINE_STREAMS, FINE_BITS = 32, 8
FINE = FINE_STREAMS * BUCKETS
_SALTS = tk.mix(np.arange(101, 101 + FINE_STREAMS, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, secret: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order of row and first lane: both lanes, and n+1 offsets into them."""
    low = tk.lower(data)
    words = tk.Words(low, offsets)
    code, named = tk.interned(low, words.start, words.end)
    lanes = tk.digests(named, secret)[code].T
    n = np.diff(words.first)
    rows, found = [], []
    for k in range(1, SHINGLE + 1):
        # a text of fewer words is one shingle
        whole = words.first[:-1][n == k] if k < SHINGLE else np.flatnonzero(words.row[: max(len(words) - k + 1, 0)] == words.row[k - 1 :])
        rows.append(words.row[whole])
        found.append([tk.window_hash(lane, k)[whole] if len(whole) else np.zeros(0, tk.U64) for lane in lanes])
    row, h, g = np.concatenate(rows), *(np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.lexsort((g, h, row))
    row, h, g = row[order], h[order], g[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    row, h, g = row[fresh], h[fresh], g[fresh]
    return h, g, np.searchsorted(row, np.arange(len(offsets)))


def registers(h: np.ndarray, first: np.ndarray, streams: int = STREAMS) -> np.ndarray:
    """(rows, streams * BUCKETS) of 16 bits: 1 + (leading zeros << MANTISSA | mantissa) of the least hash of a bucket, 0 if it is empty."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, streams * BUCKETS), dtype=np.uint16)
    top = tk.U64(0xFFFFFFFFFFFFFFFF)
    for s in range(streams):
        g = tk.mix(h ^ _SALTS[s])
        least = np.full(n * BUCKETS, top)
        np.minimum.at(least, row * BUCKETS + (g >> tk.U64(59)).astype(np.int64), g & tk.U64((1 << 59) - 1))
        filled = least != top
        value = np.maximum(least, tk.U64(1))
        # place of the leading one bit; values have 59 bits
        high = np.frexp((value >> tk.U64(27)).astype(np.float64))[1].astype(np.int64)
        bits = np.where(high > 0, high + 27, np.frexp((value & tk.U64((1 << 27) - 1)).astype(np.float64))[1])
        zeros = 59 - bits
        shift = bits - 1 - MANTISSA
        mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(tk.U64), value << np.maximum(-shift, 0).astype(tk.U64)) & tk.U64((1 << MANTISSA) - 1)
        out[:, s * BUCKETS : (s + 1) * BUCKETS] = np.where(filled, 1 + (zeros << MANTISSA) + mantissa.astype(np.int64), 0).reshape(n, BUCKETS)
    return out


def fine_registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, FINE) of 8 bits: registers of more streams, folded; 0 still means empty."""
    wide = registers(h, first, FINE_STREAMS).astype(np.uint32)
    return np.where(wide > 0, 1 + (wide * np.uint32(2654435761) >> np.uint32(8)) % np.uint32((1 << FINE_BITS) - 1), 0).astype(np.uint8)


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row's bands, and which count: a band with two empty registers or more tells too little."""
    bands = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(tk.U64)
    packed = bands[:, :, 0] | bands[:, :, 1] << tk.U64(16) | bands[:, :, 2] << tk.U64(32)
    keys = tk.mix(packed ^ tk.mix(np.arange(BANDS, dtype=tk.U64) + tk.U64(7))[None, :])
    return keys, (bands == 0).sum(axis=2) < ROWS - 1


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, folded: float = 0.0) -> np.ndarray:
    """Jaccard similarity from register matches, less the matches that chance would give; arrays broadcast, registers last.

    ``folded``: the chance that two different registers are folded into one.
    """
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    ratio = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    chance = COLLISION * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA
    chance = chance + (1 - chance) * folded
    return (same - chance * used) / np.maximum(used * (1 - chance), 1)


def floor_of(threshold: float, n: float | np.ndarray = REGISTERS) -> float | np.ndarray:
    """The least estimate from ``n`` registers that a pair at the threshold may be expected to show."""
    return threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / n)


def similar_sizes(a: F.Column, b: F.Column, percent: int) -> F.Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (a > 0)


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, regs binary, keys array<long>, shingles array<long>"


def sketches(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Set size, digest of the set, registers and band keys (sets over DENSE), and shingles (sets up to SPARSE) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            for a, b in tk.chunks(offsets):
                h, g, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], secret)
                n = np.diff(first)
                row = np.repeat(np.arange(b - a), n)
                d1, d2 = np.zeros(b - a, tk.U64), np.zeros(b - a, tk.U64)
                np.add.at(d1, row, tk.mix(h ^ tk.U64(0x1234567)))
                np.add.at(d2, row, tk.mix(g ^ tk.U64(0x89ABCDEF)))
                dense, sparse = n > DENSE, (n > 0) & (n <= SPARSE)
                part = dense[row]
                regs = registers(h[part], np.concatenate([[0], np.cumsum(n[dense])]))
                keys, counts = band_keys(regs)
                ids = np.cumsum(dense) - 1
                spread = np.zeros(b - a + 1, dtype=np.int32)
                spread[1:][dense] = counts.sum(axis=1)
                small = np.zeros(b - a + 1, dtype=np.int32)
                small[1:][sparse] = n[sparse]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array([regs[i].tobytes() if d else None for i, d in zip(ids, dense, strict=True)], type=pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(spread, dtype=np.int32)), pa.array(keys[counts].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(small, dtype=np.int32)), pa.array(h[sparse[row]].view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "regs", "keys", "shingles"],
                )

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, SKETCH)


def rare_keys(nodes: DataFrame, percent: int) -> DataFrame:
    """``key, id`` of small sets: of each set's shingles, rarest first, as many as a similar set can't all lack.

    A set of n that is similar to another misses at most n - ceil(n * percent / 100) of its own shingles, so one more of any
    must be shared. Shingles in one set only come first in the order and make no key.
    """
    each = materialize(nodes.filter(F.size("shingles") > 0).select("id", "n", F.explode("shingles").alias("shingle")), "small-shingles")
    common = materialize(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "small-shared")
    listed = each.join(common, "shingle").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    needed = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) - (F.col("n") - F.size("held"))
    return listed.filter(needed > 0).select("id", F.explode(F.slice("held", F.lit(1), needed.cast("int"))).alias("s")).select(F.xxhash64(F.lit("rare"), F.col("s.shingle")).alias("key"), "id")


def _matrix(column: pa.Array, width: int = REGISTERS, kind: type = np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """Registers of a binary column, zeros where null; and where it is not null."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=kind)
    out[has] = np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=kind).reshape(-1, width)
    return out, has


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes, and estimate where both have registers, allow the threshold."""
    least = floor_of(percent / 100)
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(similar_sizes(F.col("n_a"), F.col("n_b"), percent))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, has_x), (y, has_y) = _matrix(batch.column(4)), _matrix(batch.column(5))
            e = estimate(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array((e >= least) | ~(has_x & has_y)))

    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def shingle_tables(wanted: DataFrame, docs: DataFrame, secret: bytes, text: str, key: str) -> DataFrame:
    """``id, held, more``: both lanes of the full shingle sets of the documents in ``wanted(id)``, rebuilt from their texts.

    The ids are broadcast if their counted number allows, so that texts stay where they are; else texts are shuffled.
    """
    wanted = materialize(wanted.distinct(), "wanted-sets")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted.hint("shuffle_hash")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            for a, b in tk.chunks(offsets):
                h, g, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], secret)
                lanes = [pa.array([raw[8 * i : 8 * j] for i, j in zip(first[:-1], first[1:], strict=True)], type=pa.binary()) for raw in (h.tobytes(), g.tobytes())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lanes], names=["id", "held", "more"])

    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(wanted, "id", "left_semi")
    return materialize(texts.mapInArrow(sets, "id long, held binary, more binary"), "shingle-sets")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, secret: bytes, text: str, key: str) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. Only documents in a pair have their sets rebuilt."""
    held = shingle_tables(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, secret, text, key)
    side = lambda x: held.select(F.col("id").alias(x), F.col("held").alias(f"held_{x}"), F.col("more").alias(f"more_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for raw in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                u, v, u_more, v_more = (np.frombuffer(x, dtype=np.uint64) for x in raw)
                at = np.minimum(np.searchsorted(v, u), max(len(v) - 1, 0))
                shared = int(((v[at] == u) & (v_more[at] == u_more)).sum()) if len(v) else 0
                ok.append(100 * shared >= percent * (len(u) + len(v) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, type=pa.bool_()))

    return materialize(both.select("a", "b", "held_a", "held_b", "more_a", "more_b").mapInArrow(run, "a long, b long"), "near-links")


def first_shared(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is that of the first band that two rows of registers share, or they share none.

    Of all keys in which a pair meets, it needs to be told in this one only; the pair is known already if one of the two is
    that key's leader.
    """
    keys, counts = band_keys(a)
    same = (a == b)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2) & counts
    return ~same.any(axis=1) | (keys[np.arange(len(a)), same.argmax(axis=1)].view(np.int64) == key)


def _in_parts(f, u: np.ndarray, v: np.ndarray, size: int = 4096) -> np.ndarray:
    return np.concatenate([f(u[s : s + size], v[s : s + size]) for s in range(0, len(u), size)])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that rows with equal first ``keys`` columns are never apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, dtype=bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            last &= column == column[-1]
        same = held and all(batch.column(k)[0] == held[-1].column(k)[held[-1].num_rows - 1] for k in range(keys))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        begin = int(np.flatnonzero(last)[0])
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def still_open(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, apart from leaders, of the keys whose members are in two components or more; with the component of each."""
    named = entries.filter("id <> leader").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    return materialize(named.join(materialize(mixed, "open-keys"), "key"), "open-members")


def linkable(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, secret: bytes, text: str, key: str) -> DataFrame:
    """The nodes that may have a link out of their component, with ``most``: how many shingles such a link can share.

    Those are the shingles that stand in open members of another component too; a document where they are too few of all
    can't reach the threshold with any. This is exact, and settles large groups whose members are just too far apart.
    """
    ids = materialize(members.select("id", "comp").distinct(), "open-ids")
    held = shingle_tables(ids.select("id"), docs, secret, text, key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            take = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(take)) for i in range(2)), pa.array(np.frombuffer(b"".join(raw), dtype=np.int64))], names=["id", "comp", "shingle"])

    each = ids.join(held.dropDuplicates(["id"]), "id").select("id", "comp", "held").mapInArrow(run, "id long, comp long, shingle long")
    each = materialize(each, "open-shingles")
    outside = each.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("shingle")
    most = each.join(materialize(outside, "open-shared"), "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("most"))
    able = materialize(nodes.select("id", "n", "regs").join(most, "id").filter(100 * F.col("most") >= percent * F.col("n")), "open-nodes")

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            fine = fine_registers(np.frombuffer(b"".join(raw), dtype=np.uint64), np.cumsum([0, *(len(x) // 8 for x in raw)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in fine], type=pa.binary())], names=["id", "fine"])

    fine = held.dropDuplicates(["id"]).join(able.select("id"), "id", "left_semi").mapInArrow(sketch, "id long, fine binary")
    return materialize(able.join(fine, "id"), "open-sketches")


def cross_pairs(members: DataFrame, nodes: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Plausible pairs that share a key but no component, found in blocks within tasks; ``nodes(id, n, most, regs, fine)``.

    In each key the component with most members is never held against itself: only the others are, and against it.
    ``best_only``: of each document's partners in a block, the one with the highest estimate.
    """
    least = floor_of(percent / 100)
    named = members if best_only else materialize(members.join(nodes.select("id"), "id", "left_semi"), "open-members")
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("most")).filter("comps > 1")
    open_keys = materialize(sizes.select("key", "main", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int").alias("ask_blocks")), "open-keys")
    rows = named.join(open_keys, "key").join(nodes.select("id", "n", "most", "regs", "fine"), "id").withColumn("other", F.col("comp") != F.col("main"))
    place = F.xxhash64("id")
    last = ["id", "comp", "n", "most", "regs", "fine", "other"]
    # where all fit in one block, the rows that are told ask too
    asks = rows.filter("other AND blocks > 1").select("key", F.pmod(place, F.col("ask_blocks")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"), *last, F.lit(True).alias("asks"))
    told = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("q"), F.pmod(place, F.col("blocks")).cast("int").alias("c"), *last, (F.col("other") & (F.col("blocks") == 1)).alias("asks"))
    dealt = asks.withColumn("told", F.lit(False)).union(told.withColumn("told", F.lit(True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 3):
            part = part.combine_chunks()
            key, q, c, ids, comp, n, most = (part.column(i).to_numpy() for i in range(7))
            regs, has = _matrix(part.column(7).combine_chunks())
            fine, has_fine = _matrix(part.column(8).combine_chunks(), FINE, np.uint8)
            asks, told = (part.column(i).to_numpy(zero_copy_only=False) for i in (10, 11))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (q[1:] != q[:-1]) | (c[1:] != c[:-1])) + 1
            out_a, out_b = [], []
            for i, j in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]]), strict=True):
                x, y = i + np.flatnonzero(asks[i:j]), i + np.flatnonzero(told[i:j])
                if not len(x) or not len(y):
                    continue
                u, v = x[:, None], y[None, :]
                ok = (comp[u] != comp[v]) & (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v])) & ((100 + percent) * np.minimum(most[u], most[v]) >= percent * (n[u] + n[v]))
                u, v = np.nonzero(ok)
                if not len(u):
                    continue
                u, v = x[u], y[v]
                e = _in_parts(lambda a, b: np.where(has[a] & has[b], estimate(regs[a], regs[b], n[a], n[b]), 1.0), u, v)
                u, v, e = u[e >= least], v[e >= least], e[e >= least]
                if len(u) and has_fine.any():
                    close = _in_parts(lambda a, b: estimate(fine[a], fine[b], n[a], n[b], 1 / ((1 << FINE_BITS) - 1)) >= floor_of(percent / 100, ((fine[a] != 0) | (fine[b] != 0)).sum(axis=1)), u, v)
                    u, v, e = u[close], v[close], e[close]
                if not best_only and len(u):
                    told_here = _in_parts(lambda a, b: ~(has[a] & has[b]) | first_shared(regs[a], regs[b], key[a]), u, v)
                    u, v = u[told_here], v[told_here]
                if best_only and len(u):
                    order = np.lexsort((ids[v], -e, u))
                    u, v = u[order], v[order]
                    first = np.append(True, u[1:] != u[:-1])
                    u, v = u[first], v[first]
                out_a.append(ids[u])
                out_b.append(ids[v])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    grouped = dealt.repartition("key", "q", "c").sortWithinPartitions("key", "q", "c")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; links have 100 * intersection >= percent * union.

    Null, empty and wordless texts have no shingles and link with nothing: each is its own component and is kept. A text of
    fewer than five words has one shingle. Equal sets are one component. Rows that repeat an id are one document. A null id
    links with nothing, its component is that of its exact copies or null, and it is kept if it has none. Other columns are
    ignored; an empty table gives an empty one.
    """
    secret = tk.new_key()
    made = materialize(sketches(docs, secret, text, key), "sketches")
    groups = made.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups, "equal-sets")
    firsts = made.join(groups.select(F.col("id").alias("doc_id"), F.col("d1").alias("e1"), F.col("d2").alias("e2")), "doc_id").filter("d1 = e1 AND d2 = e2")
    nodes = materialize(firsts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "regs", "keys", "shingles").dropDuplicates(["id"]), "near-nodes")
    found = nodes.select(F.explode("keys").alias("key"), "id").union(rare_keys(nodes, percent))
    entries = materialize(found, "near-keys")
    leaders = materialize(entries.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-leaders")
    shared = materialize(entries.join(leaders, "key").select("key", "id", "leader", "members"), "near-shared")
    stars = shared.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    checked = materialize(plausible(stars, nodes, percent), "near-pairs")
    links = confirm(checked, docs, percent, secret, text, key)
    labels = components(links)
    crowded = shared.filter("members > 2").select("key", "id", "leader")
    for best_only in (True, False):
        members = still_open(crowded, labels)
        if members.isEmpty():
            break
        able = nodes.withColumns({"most": F.col("n"), "fine": F.lit(None).cast("binary")}) if best_only else linkable(members, nodes, docs, percent, secret, text, key)
        more = materialize(cross_pairs(members, able, percent, best_only).join(checked, ["a", "b"], "left_anti"), "near-pairs")
        if not more.isEmpty():
            checked = checked.union(more)
            links = links.union(confirm(more, docs, percent, secret, text, key))
            labels = components(links)
    copies = groups.filter("copies > 1").select("n_shingles", "d1", "d2", F.col("id").alias("first_id"))
    rows = made.select("doc_id", "n_shingles", "d1", "d2").join(copies, ["n_shingles", "d1", "d2"], "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    rows = rows.join(labels.select(F.col("node").alias("first_id"), "component"), "first_id", "left")
    component = F.coalesce("component", "first_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = near_duplicates(docs, percent, text, key).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct()
    gone = materialize(gone, "near-gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone.hint("shuffle_hash")
    return docs.join(gone, key, "left_anti").select(docs.columns)


def op2_hyperminhash(spark, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is kept."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
