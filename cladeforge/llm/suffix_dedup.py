"""Exact removal of repeated byte strings by induced sorting of suffixes on Spark's disk-backed sort.

Only the suffixes that start windows of ``window`` bytes matter, and only whether two of them share ``window`` bytes.

1. sample: each window has an anchor (its leftmost gram of least hash), so equal windows have equal anchors at equal places.
   The suffixes at anchors are the sample; grams that occur once end here.
2. names: a gram's runs of windows are named by all bytes they cover. Names that occur twice settle all their windows at
   once, and one run of each name goes on.
3. sort: suffix tuples (gram, bytes from the anchor on, place, bytes before it) are sorted by Spark, whose sort spills runs
   to disk and merges them by a priority queue, so a shard may be far larger than memory.
4. induction: in each group of one gram, common-prefix values of neighbours are taken, and order and values of the suffixes
   one byte further left are induced from those before, as far as the windows of the anchors reach (``induced``). A start
   whose value with a neighbour is ``window`` or more repeats. Bytes are compared here, not hashes.
5. crowded grams: a group is induced in one piece, so grams with more than MAX_GROUP different runs (a passage shorter than
   a window in as many surroundings) are split instead: their runs are cut into blocks of windows at fixed places from the
   anchor, a block's core (the bytes that all its windows share) must repeat, and blocks that stay open are counted window by
   window, by groups of equal hashes with map-side partial sums. So no group of any size meets in one task.

Names of runs, cores and windows are BLAKE2b of their bytes and places, under a key drawn for each run, so nothing is removed
for a hash that could be solved. The polynomial of ``textkit`` only picks anchors and groups grams. Joins are on names; a hot
passage has few of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import fresh, materialize, table
from .induced import repeated_starts
from .minhash import whole_groups
from .repeats import anchors

WINDOW, GRAM, BLOCK = 200, 64, 16
#: Different runs of one gram that are induced together at most; about 7 MB of bytes. AT_ONCE: runs of many grams in a step.
MAX_GROUP, AT_ONCE = 20_000, 8_000
SPAN = "doc_id long, row long, begin long, end long"


def _chunked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tk.utf8(batch.column(column))
    for a, b in tk.chunks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def grams(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The gram of every anchor of ``rows(.., text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _chunked(batch, 0):
                found = anchors(data, offsets, window, gram)
                if len(found["row"]):
                    yield pa.RecordBatch.from_pydict({"gram": found["hash"][found["anchor"]].view(np.int64)})

    return rows.select("text").mapInArrow(run, "gram long")


def named_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, secret: bytes) -> np.ndarray:
    """Names of ranges: their bytes, and their place relative to an anchor."""
    return tk.mix(tk.range_digests(data, start, end, secret) ^ tk.mix(place.astype(tk.U64)))


def runs(rows: DataFrame, window: int, gram: int, secret: bytes) -> DataFrame:
    """For every anchor: its gram, the name of its run of windows, and their places in the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in _chunked(batch, 2):
                f = anchors(data, offsets, window, gram)
                if not len(f["row"]):
                    continue
                name = named_digests(data, f["first"], f["last"] + window, f["anchor"] - f["first"], secret)
                at = offsets[f["row"]]
                take = pa.array(f["row"] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(f["hash"][f["anchor"]].view(np.int64)), pa.array(name.view(np.int64)), *(pa.array((f[k] - at).astype(np.int32)) for k in ("anchor", "first", "last"))],
                    names=["doc_id", "row", "gram", "name", "anchor", "first", "last"],
                )

    return rows.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, gram long, name long, anchor int, first int, last int")


def packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` with ``text`` as compressed bytes ``body``, so that a shuffle moves less."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in tk.pieces(batch, len(keep)):
                texts = [None if t is None else press.compress(t.encode()) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, type=pa.binary())], names=[*keep, "body"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, ", ".join([*fields, "body binary"]))


def _contexts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of one run of each name that is still open."""
    asked = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("gram", "name", "single", "anchor", "first", "last")).alias("asked"))
    joined = packed(rows.select("doc_id", "row", "text"), ["doc_id", "row"]).join(asked.hint("shuffle_hash"), ["doc_id", "row"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in tk.pieces(whole, 2)):
            lists = batch.column(3)
            flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(batch.num_rows), count)
            bodies = [loose.decompress(b) for b in batch.column(2).to_pylist()]
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            cut = [bodies[i][s : e + window] for i, s, e in zip(at, first, last, strict=True)]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), flat.field("gram"), flat.field("name"), flat.field("single"), pa.array((flat.field("anchor").to_numpy() - first).astype(np.int32)), pa.array(first), pa.array(cut, type=pa.binary())],
                names=["doc_id", "row", "gram", "name", "single", "lead", "first", "body"],
            )

    return joined.select("doc_id", "row", "body", "asked").mapInArrow(run, "doc_id long, row long, gram long, name long, single boolean, lead int, first int, body binary")


def induced(contexts: DataFrame, window: int) -> DataFrame:
    """``doc_id, row, begin, end`` of the repeated windows of runs that stand alone, by induced sorting within each gram."""
    tuples = contexts.select("gram", F.expr("substring(body, lead + 1)").alias("right"), "doc_id", "row", "single", (F.col("first") + F.col("lead")).alias("anchor"), F.expr("substring(body, 1, lead)").alias("left"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in whole_groups(batches, 1):
            held, n = [*held, part], n + part.num_rows
            if n >= AT_ONCE:
                yield told(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield told(pa.concat_tables(held))

    def told(part: pa.Table) -> pa.RecordBatch:
        place, d = repeated_starts(part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(6).to_pylist(), window)
        alone = part.column(4).to_numpy()[place]
        place, d = place[alone], d[alone]
        order = np.lexsort((-d, place))
        place, d = place[order], d[order]
        new = np.append(True, (place[1:] != place[:-1]) | (d[1:] != d[:-1] - 1))[: len(place)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))[: len(first)] - 1
        at = part.column(5).to_numpy().astype(np.int64)[place]
        take = pa.array(place[first])
        columns = [part.column(k).combine_chunks().take(take) for k in (2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at[first] - d[first]), pa.array(at[last] - d[last] + window)], names=["doc_id", "row", "begin", "end"])

    return tuples.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(run, SPAN)


def _bodies(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tk.utf8(column)
    for a, b in tk.chunks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def blocks(contexts: DataFrame, window: int, secret: bytes) -> DataFrame:
    """Blocks of each run's windows by their distance before the anchor: the names of core and whole, and the windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _bodies(batch.column(3)):
                part = batch.slice(a, b - a)
                lead, gram = part.column(2).to_numpy().astype(np.int64), part.column(0).to_numpy().view(np.uint64)
                windows = np.diff(offsets) - window + 1
                # window o starts lead - o bytes before the anchor
                low, high = (lead - windows + 1) // BLOCK, lead // BLOCK
                count = high - low + 1
                at = np.repeat(np.arange(b - a), count)
                block = low[at] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.maximum(lead[at] - block * BLOCK - BLOCK + 1, 0)
                stop = np.minimum(lead[at] - block * BLOCK, windows[at] - 1)
                base = offsets[:-1][at]
                core_at = base + lead[at] - block * BLOCK
                core = tk.mix(named_digests(data, core_at, core_at + window - BLOCK + 1, block, secret) ^ tk.mix(gram[at]))
                whole = tk.mix(named_digests(data, base + start, base + stop + window, lead[at] - start, secret) ^ core)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(4).take(take), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["gram", "name", "single", "core", "whole", "start", "stop"])

    return materialize(contexts.select("gram", "name", "lead", "body", "single").mapInArrow(run, "gram long, name long, single boolean, core long, whole long, start int, stop int"), "suffix-blocks")


def windows(contexts: DataFrame, opened: DataFrame, window: int, secret: bytes) -> DataFrame:
    """Single windows of the blocks that are still open."""
    asked = opened.groupBy("gram", "name").agg(F.collect_list(F.struct("core", "start", "stop")).alias("asked"))
    joined = contexts.join(asked, ["gram", "name"]).select("gram", "name", "single", "body", "asked", "lead")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _bodies(batch.column(3)):
                part = batch.slice(a, b - a)
                lists = part.column(4)
                flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
                at = np.repeat(np.arange(b - a), count)
                start, stop = flat.field("start").to_numpy().astype(np.int64), flat.field("stop").to_numpy().astype(np.int64)
                core = flat.field("core").to_numpy().view(np.uint64)
                n = stop - start + 1
                each = np.repeat(np.arange(len(at)), n)
                place = start[each] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                base = offsets[:-1][at[each]] + place
                lead = part.column(5).to_numpy().astype(np.int64)[at[each]]
                h = tk.mix(named_digests(data, base, base + window, lead - place, secret) ^ core[each])
                take = pa.array(at[each])
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32))], names=["gram", "name", "single", "window", "place"])

    return materialize(joined.mapInArrow(run, "gram long, name long, single boolean, window long, place int"), "suffix-windows")


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, row, begin, end``: byte ranges that repeated windows cover, of ``rows(doc_id, row, text)``; they may overlap."""
    n = lambda: F.count(F.lit(1)).alias("n")
    secret = tk.new_key()
    repeated = materialize(grams(rows, window, gram).groupBy("gram").agg(n()).filter("n > 1").select("gram"), "suffix-grams")
    hits = materialize(runs(rows, window, gram, secret).join(repeated, "gram"), "suffix-runs")
    named = materialize(hits.groupBy("gram", "name").agg(n(), F.min(F.struct("doc_id", "row", "anchor", "first", "last")).alias("one")), "suffix-names")
    settled = materialize(named.filter("n > 1").select("gram", "name"), "suffix-settled")
    spans = hits.join(settled, ["gram", "name"]).select("doc_id", "row", F.col("first").cast("long").alias("begin"), (F.col("last") + window).cast("long").alias("end"))

    mixed = materialize(named.groupBy("gram").agg(n()).filter("n > 1").select("gram", (F.col("n") > MAX_GROUP).alias("crowded")), "suffix-mixed")
    wanted = materialize(named.join(mixed, "gram").select("gram", "name", (F.col("n") == 1).alias("single"), "crowded", "one.*"), "suffix-wanted")
    spans = spans.union(induced(_contexts(rows, wanted.filter("NOT crowded"), window), window))
    if not mixed.filter("crowded").isEmpty():
        spans = spans.union(counted(materialize(_contexts(rows, wanted.filter("crowded"), window), "suffix-contexts"), window, secret))
    return spans


def counted(contexts: DataFrame, window: int, secret: bytes) -> DataFrame:
    """``doc_id, row, begin, end`` of the repeated windows of runs that stand alone, by counting names of blocks and windows."""
    n = lambda: F.count(F.lit(1)).alias("n")
    cut = blocks(contexts, window, secret)
    wholes = materialize(cut.groupBy("core", "whole").agg(n()), "suffix-wholes")
    whole = materialize(wholes.filter("n > 1").select("core", "whole"), "suffix-whole")
    opened = materialize(wholes.groupBy("core").agg(n()).filter("n > 1").select("core"), "suffix-open")
    found = cut.filter("single").join(whole, ["core", "whole"]).select("gram", "name", "start", "stop")
    last = windows(contexts, cut.join(opened, "core"), window, secret)
    twice = materialize(last.groupBy("window").agg(n()).filter("n > 1").select("window"), "suffix-twice")
    found = found.union(last.filter("single").join(twice, "window").select("gram", "name", "place", F.col("place").alias("stop")))
    fine = found.join(contexts.select("gram", "name", "doc_id", "row", "first"), ["gram", "name"])
    return fine.select("doc_id", "row", (F.col("first") + F.col("start")).cast("long"), (F.col("first") + F.col("stop") + window).cast("long"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes, n_removed, n_spans`` and binary ``kept`` (what is left, joined).

    With ``as_text``, ``kept`` is a string; bytes of a character that was cut through are left out of it.

    Removes each byte of a ``window``-byte string that starts anywhere else too, in the same text or another; matches are on
    UTF-8 bytes, never cross rows, and are judged on the input. Null texts count as empty; texts shorter than a window stay
    whole. Repeated rows are copies of each other, so all their windows go. Input columns with the names of results are
    replaced. An empty table gives an empty one.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in docs.columns if c != text and (c == key or c.lower() not in made)]
    # one struct keeps the columns of docs apart from those made here
    held = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias(fresh(docs, "row"))).alias("held")
    whole = docs.select(held, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spans = repeated_spans(whole.select("doc_id", "row", "text"), window, gram).groupBy("doc_id", "row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    carried = packed(whole, ["held", "doc_id", "row"])
    joined = carried.join(spans.hint("shuffle_hash"), ["doc_id", "row"], "left")
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "string" if as_text else "binary"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in (part for many in batches for part in tk.pieces(many, 1)):
            bodies, lists = [loose.decompress(x) for x in batch.column(1).to_pylist()], batch.column(2)
            sizes, removed, counts, kept = [], [], [], []
            flat = lists.flatten()
            begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
            count = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            at = np.concatenate([[0], np.cumsum(count)])
            for i, body in enumerate(bodies):
                cut = []
                s, e = begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
                if len(s):
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
                    cut = list(zip(s[new].tolist(), reach[np.append(new[1:], len(s)) - 1].tolist(), strict=True))
                left, pieces = 0, []
                for s_, e_ in cut:
                    pieces.append(body[left:s_])
                    left = e_
                pieces.append(body[left:])
                rest = b"".join(pieces)
                sizes.append(len(body))
                removed.append(len(body) - len(rest))
                counts.append(len(cut))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=["held", *kinds])

    kind = carried.schema["held"].dataType.simpleString()
    cut = joined.select("held", "body", "spans").mapInArrow(run, ", ".join([f"held {kind}", *(f"{k} {v}" for k, v in kinds.items())]))
    return cut.select(*[F.col("held").getField(c).alias(c) for c in keep], *kinds)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated strings cut from the text; bytes of a character that was cut through go with it."""
    # one struct keeps the columns of docs apart from those made here
    held = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("held"))
    cut = remove_repeats(held, as_text=True)
    return cut.select(*[F.col("kept").alias(c) if c == text else F.col(f"held.`{c}`").alias(c) for c in docs.columns])


def op7_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many are removed in how many spans, and the digest of the rest."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
