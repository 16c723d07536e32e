"""Quality rules: divergence of a text's histograms from its language's reference, besides plain word and line rules.

A first pass counts characters by class and words of each language; Spark sums them by (language, word), with map-side
combining. A language of LEAST_WORDS words or more gives a reference: its character classes, and its common words, those that
make up a COMMON_SHARE-th of its words or more (so COMMON_SHARE of them at most).

A second pass takes each whole text to its counts and to the Jensen-Shannon distances from the reference of its own language.
A document is rejected if a distance is above its limit; that of words is a share of the distance that a text without any
common word has. Minimum-length guards: texts of too few characters or words, languages of fewer words than LEAST_WORDS or
whose common words make up less than LEAST_MASS of them, and rows without a language are not judged by divergence, since what
they would be held against tells nothing. Every language is judged alike, however many there are and however large others
are: beyond MAX_ENTRIES of references, languages are dealt into blocks, each of which is sent out in its turn.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Classes of other characters by the first byte of their UTF-8 code, so by ranges of code points.
WIDE = {"latin": (0xC2, 0xC9), "phonetic": (0xCA, 0xCD), "greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD4), "semitic": (0xD5, 0xDF), "indic": (0xE0, 0xE0), "asian": (0xE1, 0xE1), "signs": (0xE2, 0xE2), "han": (0xE3, 0xE9), "hangul": (0xEA, 0xED), "private": (0xEE, 0xEF), "planes": (0xF0, 0xFF)}
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other", *WIDE)
N_CLASSES = len(CLASSES)
#: Share of a language's words that makes one common (one in this many); least words of a reference and least share of common ones.
COMMON_SHARE, LEAST_WORDS, LEAST_MASS = 1000, 1000, 0.2
#: Words and classes of references that are sent to all tasks at once, about; rows of language totals that are.
MAX_ENTRIES, MAX_TOTALS = 2_000_000, 1_000_000
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DISTANCES = ("char_distance", "word_distance", "word_limit")
MADE = (*STATS, "char_distance", "word_distance", "base_failed", "kept")
LIMITS = {"max_char_distance": 0.35, "word_share": 0.95, "min_chars": 200, "min_words": 60}
#: Stand in the place of a word; no word holds a line break.
CLASS_MARK, TOTAL = "\n", "\ntotal"


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 get one past the last class, and are not counted."""
    out = np.full(256, CLASSES.index("point"), dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    out[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    out[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    out[[9, 10, 11, 12, 13, 32]] = CLASSES.index("space")
    out[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
    out[:9] = out[14:32] = out[127] = CLASSES.index("other")
    out[128:194] = N_CLASSES
    for name, (first, last) in WIDE.items():
        out[first : last + 1] = CLASSES.index(name)
    return out


_CLASS = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _seen_before(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands earlier in its row, and whether it occurs twice or more there."""
    order = np.lexsort((keys, row))
    same = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    earlier, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return earlier, twice


def char_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, N_CLASSES): characters of each class."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(owner * (N_CLASSES + 1) + _CLASS[data], minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES]


def text_stats(data: np.ndarray, offsets: np.ndarray, words: tk.Words) -> dict[str, np.ndarray]:
    """The plain counts of each row of a chunk of UTF-8 bytes."""
    n = len(offsets) - 1
    begins = (data & 0xC0) != 0x80

    code_points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(begins, out=code_points[1:])
    word_chars = np.bincount(words.row, weights=code_points[words.end] - code_points[words.start], minlength=n)

    # lines that hold a word: the word that starts first in its line tells so
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_of = np.searchsorted(breaks, words.start, side="right") - 1
    lines = np.unique(line_of)
    start = breaks[lines]
    end = breaks[lines + 1] if len(lines) else start
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10))
    row = np.searchsorted(offsets, start, side="right") - 1
    again, _ = _seen_before(row, tk.interned(data, start, end)[0])
    dup_lines = np.bincount(row[again], minlength=n)

    code, _ = tk.interned(data, words.start, words.end)
    repeat = np.zeros(n, dtype=np.int64)
    if len(words) >= WINDOW:
        row = words.row
        whole = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :])
        # windows of equal mixes may be equal: those are told apart by all their words
        _, maybe = _seen_before(row[whole], tk.window_hash(tk.mix(code.astype(tk.U64)), WINDOW)[whole])
        whole = whole[maybe]
        order = np.lexsort((*(code[whole + k] for k in range(WINDOW)), row[whole]))
        sorted_ = whole[order]
        same = row[sorted_[1:]] == row[sorted_[:-1]]
        for k in range(WINDOW):
            same &= code[sorted_[1:] + k] == code[sorted_[:-1] + k]
        twice = np.zeros(len(whole), dtype=bool)
        twice[1:] = same
        twice[:-1] |= same
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, sorted_[twice], 1)
        np.add.at(edge, sorted_[twice] + WINDOW, -1)
        repeat = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {"n_words": np.diff(words.first), "word_chars": word_chars.astype(np.int64), "n_symbols": _row_sums(_IS_SYMBOL[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat}


# --- references -------------------------------------------------------------------------------------------------------


def language_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, word, n``: how often each lower-cased (A-Z) word stands in the documents of a language, summed by Spark.

    Character classes are counted beside, as CLASS_MARK and the class, and all words as TOTAL. Null languages are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pc.dictionary_encode(batch.column(0))
            codes, names = named.indices.to_numpy(), named.dictionary
            data, offsets = tk.utf8(batch.column(1))
            for a, b in tk.chunks(offsets):
                part, at, code = tk.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], codes[a:b]
                words = tk.Words(part, at)
                place, listed = tk.interned(part, words.start, words.end)
                size = max(len(listed), 1)
                each, n = np.unique(code[words.row].astype(np.int64) * size + place, return_counts=True)
                of, place = np.divmod(each, size)
                yield _counted(names, of, listed.take(pa.array(place)).cast(pa.large_string()).cast(pa.string()), n)
                chars = np.zeros((len(names), N_CLASSES + 1), dtype=np.int64)
                np.add.at(chars, code, np.concatenate([char_counts(data[offsets[a] : offsets[b]], at), np.diff(words.first)[:, None]], axis=1))
                here = np.unique(code)
                marks = pa.array([CLASS_MARK + c for c in CLASSES] + [TOTAL])
                yield _counted(names, np.repeat(here, N_CLASSES + 1), pa.concat_arrays([marks] * len(here)), chars[here].ravel())

    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(names: pa.Array, code: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(code)), words, pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


@dataclass
class References:
    """Languages of a block (in order of name): shares of character classes, of their common words, and of all those together.

    words: all common words, in order of bytes; keys: sorted (language * words + word) of each share.
    """

    names: list[str]
    chars: np.ndarray
    words: pa.Array
    keys: np.ndarray
    share: np.ndarray
    mass: np.ndarray

    def limits(self, share: float) -> np.ndarray:
        """``share`` of the word distance that a text without a common word has from each reference."""
        return share * np.sqrt(np.maximum(self.mass + _halves(np.ones(len(self.mass)), 1 - self.mass), 0) / 2)

    def char_distance(self, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Jensen-Shannon distance (base 2, so 0 to 1) of each row of counts to its language's classes; NaN where ``lang`` is -1."""
        out = np.full(len(counts), np.nan)
        of = np.flatnonzero(lang >= 0)
        p = counts[of] / np.maximum(counts[of].sum(axis=1, keepdims=True), 1)
        out[of] = np.sqrt(np.maximum(_halves(p, self.chars[lang[of]]).sum(axis=1) / 2, 0))
        return out

    def word_distance(self, row: np.ndarray, word: np.ndarray, lang: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Distance of each row to its language, from the row and place in ``words`` (-1: none) of every word; NaN where ``lang`` is -1.

        All words that are not common in a language are one bin of its histogram.
        """
        n, size = len(n_words), max(len(self.words), 1)
        found = np.flatnonzero((word >= 0) & (lang[row] >= 0))
        cell, count = np.unique(row[found] * size + word[found], return_counts=True)
        r, w = np.divmod(cell, size)
        key = lang[r] * size + w
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(0, bool)
        r, p, q = r[hit], count[hit] / np.maximum(n_words[r[hit]], 1), self.share[at[hit]]
        # what a text lacks of a reference counts in full, as q * log2(2)
        inside = np.bincount(r, weights=p * np.log2(2 * p / (p + q)) + q * np.log2(2 * q / (p + q)) - q, minlength=n)
        rest = np.maximum(1 - np.bincount(r, weights=p, minlength=n), 0)
        out, of = np.full(n, np.nan), np.flatnonzero(lang >= 0)
        mass = self.mass[lang[of]]
        out[of] = np.sqrt(np.maximum(inside[of] + mass + _halves(rest[of], np.maximum(1 - mass, 0)), 0) / 2)
        return out


def _halves(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)


def language_entries(docs: DataFrame, text: str = "text", lang: str = "lang", least_words: int = LEAST_WORDS) -> DataFrame:
    """``lang, word, n, total``: common words and character classes of each language that is large enough, from all documents."""
    counted = materialize(language_counts(docs, text, lang), "quality-words")
    totals = counted.filter((F.col("word") == TOTAL) & (F.col("n") >= least_words) & (F.col("n") > 0)).select("lang", F.col("n").alias("total"))
    large = F.broadcast(totals) if totals.count() <= MAX_TOTALS else totals
    common = F.col("word").startswith(CLASS_MARK) | (F.col("n") * COMMON_SHARE >= F.col("total"))
    return materialize(counted.filter(F.col("word") != TOTAL).join(large, "lang").filter(common).select("lang", "word", "n", "total"), "quality-references")


def references(entries: DataFrame) -> References:
    """The rows of one block of ``language_entries``, for all tasks."""
    rows = entries.collect()
    names = sorted({r["lang"] for r in rows})
    place, kind = {name: i for i, name in enumerate(names)}, {CLASS_MARK + c: i for i, c in enumerate(CLASSES)}
    chars, mass = np.zeros((len(names), N_CLASSES)), np.zeros(len(names))
    words = sorted({r["word"].encode() for r in rows if r["word"] not in kind})
    at = {w: i for i, w in enumerate(words)}
    shares = {}
    for r in rows:
        i = place[r["lang"]]
        if r["word"] in kind:
            chars[i, kind[r["word"]]] = r["n"]
        else:
            shares[i * max(len(words), 1) + at[r["word"].encode()]] = r["n"] / r["total"]
    keys = np.array(sorted(shares), dtype=np.int64)
    share = np.array([shares[k] for k in keys.tolist()], dtype=float)
    np.add.at(mass, keys // max(len(words), 1), share)
    return References(names, chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), pa.array(words, pa.large_binary()), keys, share, mass)


# --- verdicts ---------------------------------------------------------------------------------------------------------


def with_stats(rows: DataFrame, refs: References, limits: dict[str, float]) -> DataFrame:
    """``rows(held, text, lang)`` to ``held, stats``: counts, distances (null where a guard applies) and the limit of the word distance."""
    held = rows.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = held.value
        names, most = pa.array(refs.names, pa.string()), refs.limits(limits["word_share"])
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            langs = pc.fill_null(pc.index_in(batch.column(2), value_set=names, skip_nulls=True), -1).to_numpy()
            for a, b in tk.chunks(offsets):
                body, at, lang = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b]
                words = tk.Words(body, at)
                stats, chars = text_stats(body, at, words), char_counts(body, at)
                place, listed = tk.interned(tk.lower(body), words.start, words.end)
                word = pc.fill_null(pc.index_in(listed, value_set=refs.words), -1).to_numpy()[place]
                heavy = np.append(refs.mass, 0)[lang] >= LEAST_MASS
                by_char = pa.array(refs.char_distance(chars, lang), mask=~((chars.sum(axis=1) >= limits["min_chars"]) & (lang >= 0)))
                by_word = pa.array(refs.word_distance(words.row, word, lang, stats["n_words"]), mask=~((stats["n_words"] >= limits["min_words"]) & (lang >= 0) & heavy))
                columns = [*(pa.array(stats[k].astype(np.int64)) for k in STATS), by_char, by_word, pa.array(np.append(most, 1.0)[lang])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.StructArray.from_arrays(columns, names=[*STATS, *DISTANCES])], names=["held", "stats"])

    kind = rows.schema["held"].dataType.simpleString()
    return rows.select("held", "text", "lang").mapInArrow(run, f"held {kind}, stats struct<{','.join(f'{k}:long' for k in STATS)},{','.join(f'{k}:double' for k in DISTANCES)}>")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_ENTRIES, least_words: int = LEAST_WORDS, **limits: float) -> DataFrame:
    """``held`` (a struct of all columns of ``docs``, which keeps them apart from those made here), counts, distances and verdicts.

    Texts are read once more for each block of references, and neither shuffled nor stored.
    """
    unknown = set(limits) - set(LIMITS)
    if unknown:
        raise TypeError(f"no such limits: {sorted(unknown)}")
    told = LIMITS | limits
    entries = language_entries(docs, text, lang, least_words)
    blocks = max(-(-entries.count() // most), 1)
    block = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(blocks))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    parts = []
    for k in range(blocks):
        of = lambda df: df if blocks == 1 else df.filter(block(F.col("lang")) == k)  # noqa: B023, E731
        parts.append(with_stats(of(rows), references(of(entries)), told))
    stats = functools.reduce(DataFrame.union, parts).select("held", *[F.col(f"stats.{k}").alias(k) for k in (*STATS, *DISTANCES)])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = F.coalesce(F.col("char_distance") <= told["max_char_distance"], F.lit(True)) & F.coalesce(F.col("word_distance") <= F.col("word_limit"), F.lit(True))
    return stats.select("held", *STATS, "char_distance", "word_distance", failed.alias("base_failed"), (~failed & near).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", **limits: float) -> DataFrame:
    """``docs`` without ``text``, plus counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    ``limits``: those of LIMITS, and what ``judged`` takes. Null or empty text: all counts 0, ``base_failed``. Distances are
    null where a guard applies (below ``min_chars`` characters or ``min_words`` words, or a language that gives no reference,
    or none): such a row passes unless the plain rules reject it. A row with null ``lang`` feeds no reference. Repeated rows
    are judged one by one; an empty table gives an empty one. Added columns take the place of input columns of the same names.
    """
    keep = [c for c in docs.columns if c != text and c.lower() not in MADE]
    rows = judged(docs, text, lang, **limits)
    return rows.select(*[F.col("held").getField(c).alias(c) for c in keep], *STATS, "char_distance", "word_distance", "base_failed", "kept")


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    return judged(docs, text, lang, **limits).filter("kept").select(*[F.col("held").getField(c).alias(c) for c in docs.columns])


def op10_quality_divergence(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, distances to six places (-1: not judged)."""
    rounded = [F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("char_distance", "word_distance")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *STATS, "base_failed", "kept", *rounded)


def relative_quality_divergence(spark, sf_dir: str) -> DataFrame:
    """The verdicts and distances of ``op10_quality_divergence`` alone."""
    return op10_quality_divergence(spark, sf_dir).select("doc_id", "base_failed", "kept", "char_distance", "word_distance")
