"""Language ID: a byte convolutional network, trained in numpy and applied to batches of fixed-length windows.

Filters of several widths slide over one-hot bytes, so a filter is a table with a row for each byte at each of its places;
each filter keeps its maximum over a window, and a softmax layer reads the maxima. A whole text is cut into consecutive
windows, and the windows' probabilities are averaged by their length.

Training sees a bounded sample: TRAIN_DOCS documents over all languages, the same share of each as far as they go, with
TRAIN_WINDOWS windows each at places told by a hash. Prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import fresh, table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH, RATE, SEED = 8000, 3, 500, 256, 0.01, 7
AT_ONCE = 1024  # windows
MAX_LANGUAGES = 10_000  # whose counts are broadcast


class ByteCNN:
    """Filter tables (place, byte, filter) for each width, biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _maxima(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of each filter over each window (rows of bytes, zero where a text has ended), and its place."""
        best, at = [], []
        for w, kernel in zip(WIDTHS, self.tables, strict=True):
            n = x.shape[1] - w + 1
            total = kernel[0][x[:, :n]]
            for j in range(1, w):
                total += kernel[j][x[:, j : j + n]]
            if where:
                p = total.argmax(axis=1)
                at.append(p)
                best.append(np.take_along_axis(total, p[:, None], axis=1)[:, 0])
            else:
                best.append(total.max(axis=1))
        return np.concatenate(best, axis=1), at

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._softmax(np.maximum(self._maxima(x[i : i + AT_ONCE])[0] + self.bias, 0)) for i in range(0, len(x), AT_ONCE)])

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> ByteCNN:
        """Adam on the cross-entropy, classes drawn evenly. Through the maximum only one place of a window has a gradient."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            classes = rng.integers(0, len(of), BATCH)
            rows = np.array([of[c][rng.integers(0, len(of[c]))] for c in classes])
            b = x[rows]
            top, at = self._maxima(b, where=True)
            pre = top + self.bias
            hidden = np.maximum(pre, 0)
            delta = self._softmax(hidden)
            delta[np.arange(BATCH), y[rows]] -= 1
            delta /= BATCH
            back = (delta @ self.out.T) * (pre > 0)
            grads = []
            for i, (w, kernel) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                g, part = np.zeros_like(kernel), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(b, at[i] + j, axis=1), np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each row of a chunk: the mean over its windows, weighted by their bytes; rows without bytes get zeros."""
        size = np.diff(offsets)
        count = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros((len(size), len(self.languages)))
        if not first[-1]:
            return out
        owner = np.repeat(np.arange(len(size)), count)
        start = offsets[:-1][owner] + (np.arange(first[-1]) - first[owner]) * WINDOW
        held = np.minimum(WINDOW, offsets[1:][owner] - start)
        spread = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        for i in range(0, len(start), AT_ONCE):
            s, n = start[i : i + AT_ONCE], held[i : i + AT_ONCE]
            x = spread[s[:, None] + np.arange(WINDOW)]
            x[np.arange(WINDOW) >= n[:, None]] = 0
            np.add.at(out, owner[i : i + AT_ONCE], self.probabilities(x) * n[:, None])
        return out / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = TRAIN_DOCS) -> ByteCNN | None:
    """Fit on at most about ``max_docs`` rows with non-null text and language; None where there are none."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = rows.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    each = max(1, max_docs // n_languages)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_000))
    counts = F.broadcast(counts) if n_languages <= MAX_LANGUAGES else counts
    picked = rows.join(counts, rows[lang] == F.col("__lang")).filter(draw < F.lit(1e6) * each / F.col("__n"))
    body = F.encode(F.col(text), "UTF-8")
    room = F.greatest(F.length(body) - WINDOW, F.lit(0)) + 1
    cuts = F.array(*[F.substring(body, (F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1 + j)), room) + 1).cast("int"), WINDOW) for j in range(TRAIN_WINDOWS)])
    got = picked.select(F.col(lang).alias("lang"), F.col(key).alias("key"), cuts.alias("cuts")).toPandas().sort_values(["lang", "key"], kind="stable")
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    windows = [bytes(w) for ws in got["cuts"] for w in ws]
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(languages).fit(x, np.repeat(np.searchsorted(languages, got["lang"]), TRAIN_WINDOWS))


def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score`` (the probability of that language).

    ``und`` and 0 for null texts and texts without a letter, and for all without a model. Whole texts are read; repeated
    rows are repeated; input columns with the names of results are replaced.
    """
    keep = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    letter = fresh(docs, "has_letter")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter), F.col(f"`{text}`").alias(text))
    if model is None:
        return rows.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            data, offsets = tk.utf8(batch.column(len(keep) + 1))
            for a, b in tk.chunks(offsets):
                p = model.texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                known = part.column(len(keep)).to_numpy(zero_copy_only=False)
                best = np.where(known, p.argmax(axis=1), len(model.languages))
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def op8_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language and score, learnt from rows that are not held out; ``und`` without a letter or text."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model)
