"""Quality classifier: a sparse ensemble of conjunctive rules over document statistics.

Small boosted trees are grown on a bounded labelled sample; every path from a root to a node is a rule (a conjunction of
comparisons). Lasso logistic regression over the rules keeps the few that matter, and these are compiled into one Spark
column expression, which scores all documents from the table of their statistics.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import fresh, materialize, table
from .language_id import held_out
from .quality_rules import char_counts, text_stats

#: About so many labelled documents are learnt from at most; where there are more, a hash of the id draws them.
TRAIN_ROWS, SEED = 20_000, 5
TREES, DEPTH, BINS, SHRINK, MIN_LEAF, LASSO, STEPS = 40, 3, 32, 0.3, 10, 0.002, 400
THRESHOLD = 0.3


# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and a to in is that it was for on are as with be at this from or by not".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "le la de et les des en un une du que est pour dans qui par sur au aux pas il elle".split(),
    "es": "el la de que y en los se del las por un para con no una su al lo como más".split(),
}
SHARES = ("lower", "upper", "digit", "space", "point", "symbol", "other", "wide")
FEATURES = (*(f"{c}_share" for c in SHARES), "symbols_per_word", "points_per_word", "word_length", "log_words", "repeat_share", "dup_lines_per_word", "common_share", "top_common_share")


@functools.cache
def _common_words() -> pa.Array:
    return pa.array(sorted({w.encode() for words in COMMON_WORDS.values() for w in words}), pa.large_binary())


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES): statistics of each text of a chunk; all are 0 for an empty one."""
    n, words, common = len(offsets) - 1, tk.Words(data, offsets), _common_words()
    stats, classes = text_stats(data, offsets, words), char_counts(data, offsets)
    plain = len(SHARES) - 1
    chars = np.concatenate([classes[:, :plain], classes[:, plain:].sum(axis=1, keepdims=True)], axis=1)
    code, named = tk.interned(tk.lower(data), words.start, words.end)
    at = pc.fill_null(pc.index_in(named, value_set=common), -1).to_numpy()[code]
    known = at >= 0
    bins = np.bincount(words.row[known] * len(common) + at[known], minlength=n * len(common)).reshape(n, -1)
    per_word = 1 / np.maximum(stats["n_words"], 1)
    columns = [stats["n_symbols"] * per_word, chars[:, SHARES.index("point")] * per_word, stats["word_chars"] * per_word, np.log1p(stats["n_words"]), stats["n_repeat_words"] * per_word, stats["n_dup_lines"] * per_word, bins.sum(axis=1) * per_word, bins.max(axis=1, initial=0) * per_word]
    return np.concatenate([chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), np.stack(columns, axis=1)], axis=1)


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree on binned features: the rules of its nodes, and the step of each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def node(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for f in range(x.shape[1]):
                n = len(cuts[f]) + 1
                if n < 2:
                    continue
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], (f, i))
        if best[1] is None:
            step[rows] = -g / (h + 1)
            return
        f, i = best[1]
        below = bins[rows, f] <= i
        for side, part in ((True, rows[below]), (False, rows[~below])):
            rule = (*path, (f, side, float(cuts[f][i])))
            rules.append(rule)
            node(part, rule)

    node(np.arange(len(x)), ())
    return rules, step


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, without repeats; conditions are (feature, at most or above, threshold)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, step = _grow(x, bins, cuts, p - y, p * (1 - p))
        margin += SHRINK * step
        found.update(dict.fromkeys(tuple(sorted(r)) for r in rules))
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, below, cut in rule:
            out[:, j] *= (x[:, f] <= cut) if below else (x[:, f] > cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    a = np.concatenate([np.ones((len(r), 1)), r], axis=1)
    lipschitz = np.linalg.norm(a, 2) ** 2 / (4 * len(a)) + 1e-12
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -50, 50)))
        v = z - a.T @ (p - y) / len(a) / lipschitz
        new = np.sign(v) * np.maximum(np.abs(v) - penalty / lipschitz, 0)
        new[0] = v[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass
class RuleEnsemble:
    names: list[str]
    intercept: float
    rules: list[tuple[float, Rule]]

    def column(self, columns: dict[str, Column]) -> Column:
        """The score as one expression over statistics columns."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            test = F.lit(True)
            for f, below, cut in rule:
                value = columns[self.names[f]]
                test = test & ((value <= F.lit(cut)) if below else (value > F.lit(cut)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[f]} {'<=' if below else '>'} {cut:.4g}" for f, below, cut in rule) for w, rule in sorted(self.rules, key=lambda x: -abs(x[0]))]


def train(stats: DataFrame, labels: DataFrame, names: list[str], key: str = "doc_id", label: str = "quality", max_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fit on about ``max_rows`` labelled documents at most, drawn by hash; of repeated labels the smallest counts.

    Without rows of both classes there are no rules, and the score is the share of label 1 (one half without labels).
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("__label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_000))
    known = known.filter(draw < F.lit(1e6) * min(1.0, max_rows / max(n, 1)))
    rows = stats.join(known, key).select("__label", key, *names).toPandas().drop_duplicates(key).sort_values(key).drop(columns=[key])
    y = (rows.pop("__label").to_numpy() > 0).astype(float)
    x = rows.to_numpy(dtype=float)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleEnsemble(names, float(np.log(share / (1 - share))), [])
    rules = extract_rules(x, y)
    intercept, weights = lasso_logistic(holds(rules, x), y)
    return RuleEnsemble(names, intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6])


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` without ``text`` and with a column for each of FEATURES, as a table in the shared folder; and those columns' names.

    Null text counts as empty. A feature whose name an input column has (``log_words``, in any case) gets ``_`` behind its
    own. Rows are told one by one, so repeated rows give repeated results and ties can't arise; an empty table gives an
    empty one.
    """
    keep = [c for c in docs.columns if c != text]
    taken = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [fresh(taken, k) for k in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(len(keep)))
            for a, b in tk.chunks(offsets):
                told = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(c) for c in told.T)], names=[*keep, *names])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{k}` double" for k in names]
    return materialize(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, ", ".join(fields)), "quality-features"), names


def op5_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """Every document's score and prediction, learnt from labelled rows that are not held out. Null texts score as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats, names = statistics(docs)
    model = train(stats.filter(~held_out(F.col("doc_id"), 5, 0)), table(spark, sf_dir, "labels").select("doc_id", "quality"), names)
    scored = stats.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.column({n: F.col(n) for n in names}).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
