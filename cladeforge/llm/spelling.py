"""Spelling variants: words one edit apart, found in forward and reversed dictionaries.

One inserted, deleted or replaced letter leaves at least half of a word intact, at its front or at its end. So a pair of
lengths c and c, or c and c + 1, shares its first or its last c // 2 letters: it lies in one prefix block of the forward
dictionary or one suffix block of the reversed one. A block (c, first a letters, last b letters) of too many pairs is
subdivided by the same rule on what is free between them, until a letter or two are free, so that a block is bounded by the
alphabet; blocks are only counted (with map-side sums) before they are small enough to meet in a task. Of the blocks that a
pair shares, one tells it: where the common prefix reaches a step's half, the prefix side, else the suffix side. Each pair of
a block is verified on its letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, table
from .minhash import whole_groups

#: Least code points and occurrences of a word, how much more frequent a form is, and the divisor that picks misspelt runs.
MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Pairs of a block that are verified as they are; rows of a list of crowded blocks that is broadcast at most.
MAX_PAIRS, MAX_BROADCAST = 4096, 1_000_000
#: Cells of letters that are compared at once; longest run (bytes) whose checksum comes from the table of shifts.
CELLS, LONG = 1 << 22, 64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)


def _inside(data: np.ndarray) -> np.ndarray:
    """Letters A-Z, a-z and U+00C0 to U+00FF, which are two bytes, the first 0xC3."""
    wide = data == 0xC3
    after = np.zeros(len(data), dtype=bool)
    after[1:] = wide[:-1]
    return _LETTER[data] | wide | after


def _shifts(starts: np.ndarray) -> np.ndarray:
    """(rows, LONG + 1): checksums after 0 to LONG more bytes, less what those bytes add themselves."""
    out = np.zeros((len(starts), LONG + 1), dtype=np.uint32)
    out[:, 0] = starts
    for k in range(LONG):
        out[:, k + 1] = _CRC[out[:, k] & 0xFF] ^ out[:, k] >> 8
    return out


def run_counts(rows: DataFrame, every: int = EVERY, least: int = MIN_LENGTH) -> DataFrame:
    """``word, n`` of the runs of ``rows(key, text)``, a letter taken out of those that the checksum picks; key null: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = tk.utf8(batch.column(1))
            for a, b in tk.chunks(offsets):
                part, at = tk.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                found = tk.Runs(_inside(part), at)
                code, words = tk.interned(part, found.start, found.end)
                listed = [w.decode() for w in words.to_pylist()]
                points = np.array([len(w) for w in listed], dtype=np.int64)
                own = np.array([zlib.crc32(w.encode()) for w in listed], dtype=np.uint32)
                named = [f"{'' if k is None else k}:".encode() for k in keys[a:b]]
                shifted = _shifts(np.array([zlib.crc32(k) for k in named], dtype=np.uint32))
                size = found.end - found.start
                h = shifted[found.row, np.minimum(size, LONG)] ^ own[code]
                for i in np.flatnonzero(size > LONG):
                    h[i] = zlib.crc32(listed[code[i]].encode(), zlib.crc32(named[found.row[i]]))
                picked = h % every == 0
                n = np.bincount(code[~picked], minlength=len(listed))
                changed: Counter[str] = Counter()
                for i in np.flatnonzero(picked & (points[code] > least)):
                    w, p = listed[code[i]], int(h[i]) % int(points[code[i]])
                    changed[w[:p] + w[p + 1 :]] += 1
                plain = np.flatnonzero((n > 0) & (points >= least))
                yield pa.RecordBatch.from_arrays([pa.array([listed[i] for i in plain] + list(changed), pa.string()), pa.array(np.concatenate([n[plain], np.array(list(changed.values()), dtype=np.int64)]))], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entries(rows: DataFrame, *blocks: Column) -> DataFrame:
    """``key, c, a, b, bar, word, n``: a row for each block of each row's word."""
    each = rows.select("word", "n", F.explode(F.array(*blocks)).alias("block")).select("block.*", "word", "n").filter("c >= 1")
    # the ends that a block shares, and how it came about: pairs whose common prefix reaches ``bar`` are told elsewhere
    key = F.xxhash64("c", "a", "b", "bar", F.left("word", F.col("a")), F.right("word", F.col("b")))
    return each.select(key.alias("key"), "c", "a", "b", "bar", "word", "n")


def _block(c: Column, a: Column, b: Column, bar: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), a.cast("int").alias("a"), b.cast("int").alias("b"), bar.cast("int").alias("bar"))


def _of_class(c: Column) -> list[Column]:
    half = F.floor(c / 2)
    return [_block(c, half, F.lit(0), F.lit(1 << 30)), _block(c, F.lit(0), half, half)]


def near_pairs(words: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """``u, n_u, v, n_v``: every two words of ``words(word, n)``, which are distinct, at one edit from each other, once."""
    length = F.length("word")
    level = materialize(_entries(words, *_of_class(length), *_of_class(length - 1)), "spelling-blocks")
    found = []
    while True:
        short = F.count_if(F.length("word") == F.col("c"))
        sizes = level.groupBy("key").agg(short.alias("same"), F.count(F.lit(1)).alias("all"), F.first("c").alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
        pairs = F.col("same") * (F.col("same") - 1) / 2 + F.col("same") * (F.col("all") - F.col("same"))
        crowded = materialize(sizes.filter((pairs > most) & (F.col("c") - F.col("a") - F.col("b") > 1)).select("key"), "spelling-crowded")
        n = crowded.count()
        keys = F.broadcast(crowded) if n <= MAX_BROADCAST else crowded
        found.append(_verified(level.join(keys, "key", "left_anti") if n else level))
        if not n:
            break
        again = level.join(keys, "key", "left_semi").withColumn("d", F.floor((F.col("c") - F.col("a") - F.col("b")) / 2))
        c, a, b, bar, d = (F.col(x) for x in ("c", "a", "b", "bar", "d"))
        rows = again.withColumn("blocks", F.array(_block(c, a + d, b, bar), _block(c, a, b + d, F.least(bar, a + d)))).select("word", "n", F.explode("blocks").alias("block"))
        level = materialize(_entries(rows, F.col("block")), "spelling-blocks")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return materialize(out, "spelling-pairs")


def _verified(entries: DataFrame) -> DataFrame:
    """Pairs of each block at one edit, told here and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 1):
            part = part.combine_chunks()
            key, c, bar = (part.column(i).to_numpy() for i in (0, 1, 2))
            words = [w.encode("latin-1") for w in part.column(3).to_pylist()]
            size = np.array([len(w) for w in words])
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                short = i + np.flatnonzero(size[i:j] == c[i:j])
                if len(short) and j - i > 1:
                    u, v = (x.ravel() for x in np.broadcast_arrays(short[:, None], np.arange(i, j)[None, :]))
                    ok = (size[v] > c[i]) | (u < v)
                    us.append(u[ok])
                    vs.append(v[ok])
            u, v = np.concatenate(us), np.concatenate(vs)
            near = _one_edit(words, size, u, v, bar)
            if near.any():
                n, told = part.column(4), part.column(3)
                u, v = pa.array(u[near]), pa.array(v[near])
                yield pa.Table.from_arrays([told.take(u), n.take(u), told.take(v), n.take(v)], names=["u", "n_u", "v", "n_v"]).combine_chunks().to_batches()[0]

    dealt = entries.select("key", "c", "bar", "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u string, n_u long, v string, n_v long")


def _one_edit(words: list[bytes], size: np.ndarray, u: np.ndarray, v: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Whether words u and v (v of u's length or one longer) are one edit apart with a common prefix shorter than u's ``bar``."""
    out = np.zeros(len(u), dtype=bool)
    order = np.argsort(size[u], kind="stable")
    at = 0
    while at < len(order):
        # longest last: the width follows the words at hand
        step = max(CELLS // (int(size[u[order[min(at + 20_000, len(order)) - 1]]]) + 2), 1)
        here = order[at : at + min(step, 20_000)]
        at += len(here)
        x, y = u[here], v[here]
        width = int(size[x].max()) + 1
        ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        front, back = np.zeros((len(ids), width), np.uint8), np.zeros((len(ids), width), np.uint8)
        held = size[ids]
        flat = np.frombuffer(b"".join(words[i] for i in ids), np.uint8)
        row, col = np.repeat(np.arange(len(ids)), held), np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        front[row, col] = flat
        back[row, held[row] - 1 - col] = flat
        x, y = place[: len(here)], place[len(here) :]
        shorter = size[u[here]]

        def common(m: np.ndarray, x=x, y=y, shorter=shorter) -> np.ndarray:
            differ = m[x] != m[y]
            return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), shorter)

        p = common(front)
        out[here] = (p < bar[u[here]]) & (p + common(back) >= np.where(size[v[here]] == shorter, shorter - 1, shorter))
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, by pointer jumping; a form is several times as frequent, so there are no cycles."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = held.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(held.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        held = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return held


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", every: int = EVERY, least: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, most: int = MAX_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each frequent word, its most frequent near word if that is ``ratio`` times as frequent, and where forms lead.

    Null and empty texts have no words; a null id stands as an empty string in the checksum. Rows that repeat an id count
    each. Ties go to the word that is first in code-point order. A word without near words has ``n_near`` 0, null ``form``
    and ``form_n``, and itself as root. Words of any length count. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    words = materialize(run_counts(rows, every, least).filter(F.col("n") >= min_count), "spelling-words")
    pairs = near_pairs(words, most)
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("n_v").alias("n_near")).union(pairs.select("v", "u", "n_u"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left").withColumn("big", -F.col("best.less") >= ratio * F.col("n"))
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("big"), F.col("best.near")).alias("form"), F.when(F.col("big"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(told.filter("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All frequent words of ``documents`` with their forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
