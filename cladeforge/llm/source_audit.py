"""Source divergence audit: how far the term shares of each source lie from those of the other sources of its language.

The distance of two sources is a sum over all kept terms, of which most occur in one of the two or in neither. It is made by
inclusion and exclusion over supports, so that no term has to meet a source that lacks it:

1. one-sided: every term of A is priced as if B lacked it. The price follows from the term's count alone, so a histogram of
   counts a group is enough; sums up to a price are looked up in its running totals.
2. overlaps: postings of a term meet in one place, and terms of both A and B correct the two prices of step 1. Sources are
   dealt in blocks of BLOCK, and a task keeps one matrix a pair of blocks and sends its sums only.
3. neither: the terms that both lack are V less the supports plus the overlap, at one constant price.

Shares are whole numbers (billionths), made in decimals, so all results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, table
from .minhash import whole_groups

#: Least documents of a kept term, what is added to each count, unit of a share, ranks of terms that are told.
MIN_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a language that are held against each other in one matrix; terms in a step.
BLOCK, TERMS = 256, 1000
COUNTED = "lang string, source string, term string, n long, docs long"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group of ``rows(lang, source, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (pc.dictionary_encode(batch.column(i)) for i in (0, 1))
            data, offsets = tk.utf8(batch.column(2))
            for a, b in tk.chunks(offsets):
                part, at = tk.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                found = tk.Runs(_LETTER[part], at)
                code, terms = tk.interned(part, found.start, found.end)
                size = max(len(terms), 1)
                each, n = np.unique(found.row * size + code, return_counts=True)
                row, code = np.divmod(each, size)
                group = langs.indices.to_numpy()[a:b][row].astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()[a:b][row]
                cell, place = np.unique(group * size + code, return_inverse=True)
                total = np.zeros(len(cell), np.int64)
                np.add.at(total, place, n)
                group, code = np.divmod(cell, size)
                lang, source = np.divmod(group, max(len(sources.dictionary), 1))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms.take(pa.array(code)).cast(pa.large_string()).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(cell)))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    made = rows.mapInArrow(run, COUNTED)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)), in decimals since the product outgrows a long; null without kept terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.floor(_div(top, total + ADDED * kept))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b.cast("decimal(20,0)"))


def one_sided(groups: DataFrame) -> DataFrame:
    """``lang, a, b, price``: the terms of group a as if b lacked them all, for all others of the language.

    ``groups(lang, g, hist, zeros)``: hist is (p, m) for m terms of share p, zeros the share of an absent term in each group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                hist, zeros = (batch.column(k)[i].values for k in (2, 3))
                p, m = (hist.field(k).to_numpy() for k in ("p", "m"))
                other, x = zeros.field("g").to_numpy(), zeros.field("zero").to_numpy()
                other, x = other[other != g[i]], x[other != g[i]]
                order = np.argsort(p)
                p, m = p[order], m[order]
                many, worth = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m * p)])
                k = np.searchsorted(p, x)
                price = x * many[k] - worth[k] + (worth[-1] - worth[k]) - x * (many[-1] - many[k])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(x), pa.string()), pa.array(np.full(len(x), g[i]), pa.int32()), pa.array(other, pa.int32()), pa.array(price)], names=["lang", "a", "b", "price"])

    return groups.select("lang", "g", "hist", "zeros").mapInArrow(run, "lang string, a int, b int, price long")


def overlaps(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, a, b, both, more``: terms that a < b share, and what their prices differ from the two one-sided ones.

    ``postings(lang, x, y, term, g, p, zero)``: a term of group g (g // block is x or y), its share there and that of an
    absent term. Partial sums: a row a pair of groups and task.
    """

    def told(key: tuple, both: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        lang, x, y = key
        a, b = np.nonzero(both)
        value = more[a, b]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + x * block, pa.int32()), pa.array(b + y * block, pa.int32()), pa.array(both[a, b]), pa.array(value)], names=["lang", "a", "b", "both", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, both, more = None, None, None
        for part in whole_groups(batches, 4):
            part = part.combine_chunks()
            langs, xs, ys, terms = (part.column(k).combine_chunks() if isinstance(part.column(k), pa.ChunkedArray) else part.column(k) for k in range(4))
            langs, xs, ys, terms = pc.dictionary_encode(langs), xs.to_numpy(), ys.to_numpy(), pc.dictionary_encode(terms).indices.to_numpy()
            code, (g, p, zero) = langs.indices.to_numpy(), (part.column(k).to_numpy() for k in (4, 5, 6))
            new = np.append(True, (code[1:] != code[:-1]) | (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1]))
            edges = np.append(np.flatnonzero(new), len(code))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                here = (langs.dictionary[int(code[i])].as_py(), int(xs[i]), int(ys[i]))
                if here != key:
                    if key is not None:
                        yield told(key, both, more)
                    key, both, more = here, np.zeros((block, block), np.int64), np.zeros((block, block), np.int64)
                t = np.concatenate([[0], np.cumsum(terms[i + 1 : j] != terms[i : j - 1])])
                for s in range(0, int(t[-1]) + 1, TERMS):
                    u, v = i + np.searchsorted(t, s), i + np.searchsorted(t, s + TERMS)
                    _correct(t[u - i : v - i] - s, g[u:v], p[u:v], zero[u:v], here[1:], both, more)
        if key is not None:
            yield told(key, both, more)

    return postings.mapInArrow(run, "lang string, a int, b int, both long, more long")


def _correct(t: np.ndarray, g: np.ndarray, p: np.ndarray, zero: np.ndarray, blocks: tuple[int, int], both: np.ndarray, more: np.ndarray) -> None:
    """Add the overlaps of some terms' postings to the matrices of one pair of blocks."""
    size, sides = len(both), []
    for block in blocks:
        of = np.flatnonzero(g // size == block)
        local = g[of] - block * size
        held, absent = np.zeros((int(t[-1]) + 1, size), np.int64), np.zeros(size, np.int64)
        held[t[of], local], absent[local] = p[of], zero[of]
        sides.append((held, absent))
    (left, left_zero), (right, right_zero) = sides
    for a in np.flatnonzero(left.any(axis=0)):
        rows = np.flatnonzero(left[:, a])
        some = left[rows, a][:, None]
        first = a + 1 if blocks[0] == blocks[1] else 0
        other = right[rows, first:]
        shared = other > 0
        both[a, first:] += shared.sum(axis=0)
        more[a, first:] += np.where(shared, np.abs(some - other) - np.abs(some - right_zero[None, first:]) - np.abs(other - left_zero[a]), 0).sum(axis=0)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language by distance, and the terms most overused.

    Null text, language and source count as empty strings. Terms are runs of letters A-Z (lower-cased) and of characters
    beyond ASCII, in documents of any length. Each language keeps the terms of ``min_docs`` documents or more (rows that
    repeat an id count each). A group without kept terms has the shares of absent terms only; in a language that keeps none,
    all distances are 0 and no terms are told. A source alone in its language has no pairs. Ties go to the smaller item in
    UTF-8. Other columns are ignored; an empty table gives an empty one.
    """
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(read(lang).alias("lang"), read(source).alias("source"), F.col(f"`{text}`").alias("text"))
    counts = materialize(term_counts(rows), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= min_docs).select("lang", "term", "n_lang")
    kept = materialize(kept, "audit-kept")
    postings = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "audit-postings")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "support", "kept", "lang_total"])
    groups = groups.withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "zero": share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))})
    groups = materialize(groups, "audit-groups")

    named = postings.join(groups.select("lang", "source", "g", "total", "kept", "lang_total", "zero"), ["lang", "source"])
    priced = materialize(named.select("lang", "source", "g", "term", "zero", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("lang_total"), F.col("kept")).alias("q")), "audit-priced")
    return _pairs(groups, priced, block).unionByName(_terms(priced, top))


def _pairs(groups: DataFrame, priced: DataFrame, block: int) -> DataFrame:
    hist = priced.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "m")).alias("hist"))
    zeros = groups.groupBy("lang").agg(F.collect_list(F.struct("g", F.coalesce("zero", F.lit(0)).alias("zero"))).alias("zeros"))
    none = F.array().cast("array<struct<p:long,m:long>>")
    sided = one_sided(groups.select("lang", "g").join(hist, ["lang", "g"], "left").join(zeros, "lang").withColumn("hist", F.coalesce("hist", none)))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("g") / block).cast("int").alias("last"))
    own = F.floor(F.col("g") / block).cast("int")
    dealt = priced.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), "last")).alias("k"), own.alias("own"), "term", "g", "p", "zero")
    dealt = dealt.select("lang", F.least("k", "own").alias("x"), F.greatest("k", "own").alias("y"), "term", "g", "p", "zero")
    met = overlaps(dealt.repartition("lang", "x", "y", "term").sortWithinPartitions("lang", "x", "y", "term"), block)

    nothing = F.lit(0).cast("long")
    parts = sided.select("lang", "a", "b", F.col("price").alias("value"), nothing.alias("both")).union(met.select("lang", "a", "b", F.col("more"), "both"))
    parts = parts.union(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "both"))
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    side = lambda x: groups.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("support").alias(f"support_{x}"), F.col("zero").alias(f"zero_{x}"), *(["kept"] if x == "a" else []))
    both = summed.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    neither = (F.col("kept") - F.col("support_a") - F.col("support_b") + F.col("both")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    told = both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), F.when(F.col("kept") > 0, F.col("value") + neither).otherwise(0).cast("long").alias("value"))
    # a group has a row for each other source, no more
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(priced: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms by excess over the language's share; partitions cut theirs to as many before they meet."""
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of ``documents`` against each other, and the 50 terms that each uses most beyond its language."""
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
