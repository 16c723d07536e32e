"""License scans by ordered signature rules, in DataFrame functions only.

A text passes a gate first: only one that holds the keyword of a rule (or a licence word, where the keyword is an ordinary
word) is normalised (lower case, words joined by single spaces) and scanned. Each rule (``license_rules``) is a regular
expression over the normalised text with a keyword of its own, and runs only where the keyword occurs. Detections that lie inside a detection of a higher or equal rank are suppressed; what is
left gives the labels. All of it is one projection over the scan: no shuffle, no Python, and a row never meets another row,
so neither copies nor hot sources matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table
from .license_rules import LEVELS, ORDINARY_WORDS, TRIGGERS, gate, rules
from .spans import spans

# The phrases of the base labels.
BASE_PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before lower-casing; between them stand the separators.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, BETWEEN = f"[^{SEPARATORS}]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gate_phrases() -> list[str]:
    """Phrases one of which stands in every text that a base phrase or a rule can match."""
    keywords = {r.keyword for r in rules()} | set(BASE_PHRASES.values())
    return sorted(keywords - set(ORDINARY_WORDS) | set(TRIGGERS))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(norm: Column) -> Column:
    """All matches of all rules whose keyword occurs, in order of start, the longer and the higher in rank first."""
    known = F.expr("array(" + ", ".join(f"named_struct('rank', {r.rank}, 'confidence', {r.confidence}D, 'label', '{r.label}', 'keyword', ' {r.keyword} ', 'pattern', r'{r.pattern}')" for r in rules()) + ")")
    hit = F.filter(known, lambda r: F.contains(norm, r["keyword"]))
    each = F.transform(hit, lambda r: F.transform(spans(norm, r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), r["rank"].alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
    return F.array_sort(F.flatten(each))


def surviving(found: Column) -> Column:
    """Labels and best confidence after suppression: a detection inside an earlier one of no lower rank goes."""
    ends = [f"end{i}" for i in range(LEVELS)]
    start = F.struct(*[F.lit(-1).alias(e) for e in ends], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(state: Column, d: Column) -> Column:
        end = -d["to"]
        inside = F.lit(False)
        for i, e in enumerate(ends):
            inside = inside | ((d["rank"] >= i) & (state[e] >= end))
        kept = [F.when(d["rank"] == i, F.greatest(state[e], end)).otherwise(state[e]).alias(e) for i, e in enumerate(ends)]
        return F.struct(*kept, F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"), F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["confidence"])).alias("score"))

    return F.aggregate(found, start, step)


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` besides ``text``, and ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words, no labels (empty strings), null ``first_word`` and ``last_word``, score 0. Every row
    is judged by itself: repeated rows give repeated results, an empty table an empty one. A text of any length is scanned
    whole. Of detections with equal ranges the higher rank wins, then the label that sorts first. Input columns with the
    names of results are replaced.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in docs.columns if c != text and c.lower() not in made]
    # one struct keeps the columns of docs apart from those made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias(fresh(docs, "row"))).alias("held"), F.col(f"`{text}`").alias("text"))
    t = F.col("text")
    words = F.trim(F.regexp_replace(F.translate(t, UPPER, LOWER), BETWEEN, " "))
    stage = rows.select("held", F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(t.rlike(gate(gate_phrases(), SEPARATORS)), F.concat(F.lit(" "), words, F.lit(" "))).alias("norm"))
    norm = F.col("norm")
    pieces = {f"pieces{i}": F.split(norm, f"(?<= ){phrase}(?= )", -1) for i, phrase in enumerate(BASE_PHRASES.values())}
    stage = stage.withColumns(pieces | {"found": surviving(detections(norm))})
    places, first, last = [], [], []
    for name, phrase in zip(pieces, BASE_PHRASES.values(), strict=True):
        p, k = F.col(name), len(phrase.split())
        n = F.coalesce(F.size(p) - 1, F.lit(0))
        places.append(F.when(norm.isNull(), 0).otherwise(n))
        first.append(F.when(n > 0, _spaces(F.element_at(p, 1)) - 1))
        last.append(F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(p, -1)) - 1) - k))
    base = F.array_sort(F.filter(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(places, BASE_PHRASES, strict=True)]), lambda x: x.isNotNull()))
    least, most = F.least(*first), F.greatest(*last)
    method = F.coalesce(F.col("found.labels"), F.array().cast("array<string>"))
    score = F.greatest(F.coalesce(F.col("found.score"), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0))
    return stage.select(
        *[F.col("held").getField(c).alias(c) for c in keep],
        "n_words",
        sum(places[1:], places[0]).cast("long").alias("n_base"),
        least.cast("long").alias("first_word"),
        most.cast("long").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, method))).alias("labels"),
        score.alias("score"),
    )


def op9_license_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's words, base phrases, labels and best score."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
