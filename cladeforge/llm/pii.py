"""Personal data by weak supervision, in DataFrame functions only.

1. candidates: the four base patterns, and looser ones over what those leave (written-out addresses, colon addresses, shorter
   cards, numbers without a plus). Matches that fail a base check stay candidates too, as evidence.
2. votes: LABELERS (patterns, checksums, gazetteers, words around, what stands next to it) each vote yes, no or nothing.
3. reliabilities: votes are counted by pattern over all documents, and expectation-maximisation over that bounded table
   (kinds x 3 ** labelers x sizes) tells how often each labeler votes what on true and on false spans.
4. classifier: logistic weights over votes, kind and size, fitted to the posteriors and compiled into a column expression,
   which decides on the looser candidates. Base spans always stay.

A text is scanned once, in one projection; what is stored of it are places and votes, never the texts of spans. A row never
meets another, so neither copies nor hot sources matter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import fresh, materialize, table
from .spans import bound, running

# The base kinds in their order, each with its pattern; possessive forms and look-behinds keep them linear, and
# match what the plain forms match (a match begins where a run of its first letters begins, or where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
# What a text must hold for a pattern to be tried.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    # plain words "at" and "dot" count only before a common ending
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++){0,3}\x20dot\x20(?:com|org|net|edu|gov|info)\b)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\x20.-]?[0-9A-Za-z])",
}
LOOSE_GATES = {"email": r"[\(\[\{]at[\)\]\}]|\x20dot\x20", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9][\)\x20.-]"}
# Gazetteers and words around.
DOMAINS = "com org net edu gov info biz io co us uk de fr es it nl eu ch at be se no dk pl pt br ru cn jp in au ca mx".split()
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 98".split()
ISSUERS = r"^(?:3[47]|3[068]|4|5[1-5]|2[2-7]|35|60|62|64|65)"
NEAR = {
    "email": "mail e-mail email contact write kontakt correo courriel adresse address",
    "ip": "ip host server address logged login from client visitor adresse",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel telephone telefon call mobile fax cell contact whatsapp handy teléfono téléphone",
}
AGAINST = "version v isbn issn order serial invoice page pages section chapter id ref figure table article no nr number build release doi rfc".split()
MADE_UP = r"^(?:([0-9])\1+|0?123456789[0-9]*|9876543210?)$"
#: Code points before and after a match that labelers see, not beyond the next match.
BEFORE, AFTER = 40, 10
LABELERS = ("pattern", "checked", "gazetteer", "context", "against", "made_up", "alone")
SIZES = (8, 12, 16, 24)
#: Least score of a span that is added; rounds and smoothing of the estimates; strength of the classifier's ridge.
THRESHOLD, ROUNDS, SMOOTH, RIDGE = 0.8, 60, 1.0, 1.0
MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"
COUNTS = tuple(f"n_{k}" for k in KINDS)
MADE = (*COUNTS, "base_sha256", "spans", "n_added")


def matches(text: Column, pattern: str) -> Column:
    """Array of MATCH: all matches in order, their places in code points, and what stands around them."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def around(f: Column) -> Column:
        def with_pieces(s: Column) -> Column:
            before = F.zip_with(f, F.slice(s, 1, F.size(f)), lambda m, p: F.struct(m.alias("value"), F.length(p).alias("gap"), F.lower(F.right(p, F.lit(BEFORE))).alias("before")))
            return F.zip_with(before, F.slice(s, 2, F.size(f)), lambda x, p: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), x["before"].alias("before"), F.left(p, F.lit(AFTER)).alias("after")))

        return bound(pieces, with_pieces)

    def told(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))

    return running(bound(found, around), MATCH, lambda x: x["gap"] + F.length(x["value"]), told)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass: from the right, every second one counts twice, less 9 above 9; false for others."""

    def total(back: Column) -> Column:
        def add(so_far: Column, i: Column) -> Column:
            d = (F.ascii(F.substr(back, i, F.lit(1))) - 48) * (F.lit(2) - i % 2)
            return so_far + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return F.when(F.length(number).between(13, 19), bound(F.reverse(number), total) % 10 == 0).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def checked(kind: str, value: Column) -> Column:
    """The check of a base kind; a match that fails it is dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return bound(digits(value), lambda d: (F.length(d) >= 16) & luhn(d))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def votes(kind: str, m: Column, base: bool) -> Column:
    """One struct of a match: place, whether a base span, the labelers' votes (1, -1, 0) and a size class."""
    return bound(F.struct(digits(m["value"]).alias("d"), checked(kind, m["value"]).alias("ok")), lambda x: _votes(kind, m, base, x["d"], x["ok"]))


def _votes(kind: str, m: Column, base: bool, d: Column, ok: Column) -> Column:
    value = m["value"]
    near = rf"(?:^|[^\p{{L}}])(?:{'|'.join(NEAR[kind].split())})[^\p{{L}}]"
    against = rf"(?:^|[^\p{{L}}])(?:{'|'.join(AGAINST)})[.:#\s]*$"
    known = {
        "email": _vote(F.lower(value).rlike(rf"(?:\.|dot[\)\]\}} ]* ?)(?:{'|'.join(DOMAINS)})$"), F.lit(True)),
        "ip": _vote(~value.rlike(r"^(?:0|10|127|255|192\.168|::)[.:]"), F.lit(True)),
        "card": _vote(d.rlike(ISSUERS), F.lit(True)),
        "phone": _vote(value.rlike(rf"^\+(?:{'|'.join(CALLING)})") | value.rlike(r"^\(?0"), value.startswith("+")),
    }[kind]
    sound = {"email": _vote(~value.rlike(r"\.\.|^\.|-@|@-"), F.lit(True)), "ip": _vote(ok | F.contains(value, F.lit(":")), F.lit(True)), "card": _vote(luhn(d), F.lit(True)), "phone": _vote(F.length(d).between(8, 15), F.lit(True))}[kind]
    alone = ~m["before"].rlike(r"[\p{L}\p{N}]$") & ~m["after"].rlike(r"^[\p{L}\p{N}]")
    made_up = F.regexp_replace(value, "^.*@", "").rlike(r"^(?:test|localhost|invalid)\b") if kind == "email" else d.rlike(MADE_UP)
    told = dict(zip(LABELERS, (_vote(ok, F.lit(True)) if base else F.lit(0), sound, known, _vote(m["before"].rlike(near)), _vote(F.lit(False), m["before"].rlike(against)), _vote(F.lit(False), made_up), _vote(alone, F.lit(True))), strict=True))
    size = sum(((F.length(value) > s).cast("int") for s in SIZES), F.lit(0))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (ok if base else F.lit(False)).alias("base"), F.lit(not base).alias("open"), *[v.cast("int").alias(k) for k, v in told.items()], size.cast("int").alias("size"))


def _masked(kind: str, text: Column) -> Column:
    """The text with the base spans of a kind blanked, lengths unchanged."""
    found, pieces = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), F.split(text, BASE[kind], -1)
    blank = lambda p, m: F.concat(p, F.when(m.isNull(), "").when(checked(kind, m), F.repeat(F.lit("\n"), F.length(m))).otherwise(m))
    return F.when(text.rlike(GATES[kind]), F.array_join(F.zip_with(pieces, found, blank), "")).otherwise(text)


def candidates(text: Column) -> Column:
    """All candidates of a text, kind by kind, base patterns first."""
    none = F.array().cast(f"array<{MATCH}>")

    def of(t: Column, kind: str, base: bool) -> Column:
        pattern, gate = (BASE[kind], GATES[kind]) if base else (LOOSE[kind], LOOSE_GATES[kind])
        return F.transform(F.when(t.rlike(gate), matches(t, pattern)).otherwise(none), lambda m: votes(kind, m, base))

    def loose(t: Column) -> Column:
        return F.concat(*[of(t, k, False) for k in KINDS])

    rest = functools.reduce(lambda t, kind: bound(t, functools.partial(_masked, kind)), KINDS, text)
    return F.concat(*[of(text, k, True) for k in KINDS], bound(rest, loose))


# --- reliabilities and classifier ------------------------------------------------------------------------------------


@dataclass
class Model:
    """prior: share of true spans of each kind; rates[l, y, v]: how often labeler l votes v - 1 where the truth is y; weights of the classifier."""

    prior: np.ndarray
    rates: np.ndarray
    weights: np.ndarray


def features(kind: int, told: tuple[int, ...], size: int) -> list[float]:
    """The classifier's inputs; ``score`` says the same in columns."""
    return [1.0, *(float(kind == k) for k in range(1, len(KINDS))), *(float(v == s) for v in told for s in (1, -1)), *(float(size >= s) for s in range(1, len(SIZES) + 1))]


def expectation_maximisation(kind: np.ndarray, told: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prior of each kind, vote rates, and the posterior of each pattern of votes that occurs ``n`` times; begins at the majority."""
    one_hot = told[:, :, None] == np.array([-1, 0, 1])
    posterior = 1 / (1 + np.exp(-told.sum(axis=1).astype(float)))
    prior = np.zeros(len(KINDS))
    rates = np.zeros((told.shape[1], 2, 3))
    for _ in range(ROUNDS):
        for y, share in ((1, posterior), (0, 1 - posterior)):
            counted = np.einsum("p,plv->lv", n * share, one_hot) + SMOOTH
            rates[:, y] = counted / counted.sum(axis=1, keepdims=True)
        for k in range(len(KINDS)):
            of = kind == k
            prior[k] = ((n * posterior)[of].sum() + SMOOTH) / (n[of].sum() + 2 * SMOOTH)
        fit = [np.log(rates[:, y])[None].repeat(len(told), 0)[one_hot].reshape(told.shape).sum(axis=1) for y in (0, 1)]
        odds = np.log(prior / (1 - prior))[kind] + fit[1] - fit[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return prior, rates, posterior


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic weights for soft labels ``y``, each row counted ``n`` times, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (y - p)) - RIDGE * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(counted: list[Row]) -> Model | None:
    """The model of all counted patterns of votes; None without any."""
    if not counted:
        return None
    rows = sorted((r["kind"], *(r[k] for k in LABELERS), r["size"], r["n"]) for r in counted)
    kind, told, n = np.array([r[0] for r in rows]), np.array([r[1:-2] for r in rows]), np.array([float(r[-1]) for r in rows])
    prior, rates, posterior = expectation_maximisation(kind, told, n)
    return Model(prior, rates, logistic(np.array([features(r[0], r[1:-2], r[-2]) for r in rows]), posterior, n))


def score(c: Column, model: Model) -> Column:
    """The classifier as a column expression over a candidate."""
    w = iter(float(x) for x in model.weights)
    z = F.lit(next(w))
    for k in range(1, len(KINDS)):
        z = z + F.when(c["kind"] == k, next(w)).otherwise(0.0)
    for name in LABELERS:
        z = z + F.when(c[name] == 1, next(w)).when(c[name] == -1, next(w)).otherwise(0.0)
    for s in range(1, len(SIZES) + 1):
        z = z + F.when(c["size"] >= s, next(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def _of_kind(kind: int, c: Column) -> Column:
    return c["kind"] == kind


def personal_data(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, learnt: Callable[[Model | None], None] | None = None) -> DataFrame:
    """Columns of ``docs`` besides ``text``, and ``n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Counts and ``base_sha256`` are of base spans; ``spans`` has those and the added ones as kind:start:end, by kind and start,
    in code points. Null and empty texts have no spans (an empty string, and its digest). Every row is judged by itself, so
    repeated rows give repeated results; the model is of all rows. Texts are scanned whole. Without any candidate there is no
    model and nothing is added. Input columns with the names of results are replaced; an empty table gives an empty one.
    ``learnt`` is told the model.
    """
    keep = [c for c in docs.columns if c != text and c.lower() not in MADE]
    # one struct keeps the columns of docs apart from those made here
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias(fresh(docs, "row"))).alias("held"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    made = materialize(held.select("held", F.when(F.col("text").rlike(f"[0-9@]|{LOOSE_GATES['email']}"), candidates(F.col("text"))).alias("found")), "pii-candidates")
    made = made.withColumn("found", F.coalesce("found", F.array().cast(made.schema["found"].dataType)))
    each = made.filter(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.kind", *[f"c.{k}" for k in LABELERS], "c.size")
    model = fit(each.groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1)).alias("n")).collect())
    if learnt is not None:
        learnt(model)
    takes = (lambda c: F.lit(False)) if model is None else (lambda c: c["open"] & (score(c, model) >= threshold))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")
    base = F.filter("found", lambda c: c["base"])
    both = made.select("held", base.alias("base"), F.filter("found", lambda c: c["base"] | takes(c)).alias("taken"))
    places = F.array_sort(F.transform("taken", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    counts = [F.size(F.filter("base", functools.partial(_of_kind, k))).cast("long").alias(name) for k, name in enumerate(COUNTS)]
    return both.select(
        *[F.col("held").getField(c).alias(c) for c in keep],
        *counts,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(places).alias("spans"),
        (F.size("taken") - F.size("base")).cast("long").alias("n_added"),
    )


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document's base spans, counted and digested, and all spans."""
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
