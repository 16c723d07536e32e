"""The source audit, personal data and spelling variants against brute force, on awkward rows and with splitting forced."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.llm import pii, source_audit, spelling
from tests.llm.helpers import AZ, awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def audited(rows, least=30, top=50):
    """All results for rows (text, lang, source), by the definition."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(AZ) for w in TERM.findall(text or "")]
        n[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, c in df[lang].items() if c >= least]

        def shares(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        q, p = shares(whole), {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            order = sorted((-sum(abs(p[s][w] - p[u][w]) for w in kept), u.encode()) for u in sources if u != s)
            out |= {(lang, s, "pair", u.decode(), -v, k + 1) for k, (v, u) in enumerate(order)}
            order = sorted((q[w] - p[s][w], w.encode()) for w in kept if n[lang, s][w] > 0 and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", u.decode(), -v, k + 1) for k, (v, u) in enumerate(order)}
    return out


def as_set(df):
    return {tuple(r) for r in df.collect()}


def sources_of(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "äöxyz漢"] + ["Ünit", "THE", "the"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ".", "1a_b"]), rng.choice(["en", "en", "de", None]), f"s{min(rng.randint(0, 9), rng.randint(0, 9))}") for _ in range(n)]


@pytest.mark.parametrize("block", [256, 3])
def test_source_divergence_against_all_pairs(spark, block):
    """Blocks of three sources: pairs within a block and across blocks."""
    rows = sources_of(1) + [("", "xx", "only"), (None, None, None), ("few words", "xx", "two")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert as_set(source_audit.source_divergence(docs, min_docs=20, top=4, block=block)) == audited(rows, 20, 4)


def test_source_divergence_on_awkward_rows(spark):
    docs, _ = awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert as_set(source_audit.source_divergence(docs, min_docs=2)) == audited(rows, 2)
    assert as_set(source_audit.source_divergence(docs.limit(0))) == set()
    assert all(r.value == 0 for r in source_audit.source_divergence(docs, min_docs=10**6).collect())


def test_shares_beyond_a_long(spark):
    big = 4 * 10**18
    row = spark.range(1).select(source_audit.share(F.lit(big), F.lit(2 * big), F.lit(3).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (2 * big + 15)


# --- personal data ----------------------------------------------------------------------------------------------------


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    def passes(kind, value):
        d = re.sub("[^0-9]", "", value)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in value.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def check_base(rows, texts):
    for r in rows:
        expected = base_spans(texts[r.doc_id])
        told = ",".join(f"{k}:{i}:{j}" for k, i, j in expected)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in expected) for k in PATTERNS], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), texts[r.doc_id]
        spans = r.spans.split(",") if r.spans else []
        assert set(told.split(",")) - {""} <= set(spans) and len(spans) == len(set(spans)) == len(expected) + r.n_added
        order = [(list(PATTERNS).index(k), int(i)) for k, i, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_base_spans_of_odd_strings(spark):
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "..", "_x@y.z", "-", " ", "1", "22", "256", "1.2.3.4", "+", "+4", "(0)", "4111 1111 1111 1111", "378282246310005", "é", "😀", "\n", "a.b%c", "x@y", ".5.6.7.8", "000", "+1 (555) 123-4567", "at example dot com"]
    texts = {i: "".join(rng.choices(pieces, k=rng.randint(0, 14))) for i in range(800)}
    texts |= {1000: None, 1001: "", 1002: "a@b.c.d_e@f.g", 1003: "1.2.3.4.5.6.7.8", 1004: "0000255.1.1.1 1.1.1.256", 1005: "12345678901234567890123456789012", 1006: "1" * 30_000, 1007: "a" * 30_000 + "@", 1008: "+" * 20_000 + "1 234 567 8", 1009: "4111-1111 1111-1111 5"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_personal_data_adds_what_the_labelers_agree_on(spark):
    rng = random.Random(4)
    names = ["anna", "li", "jo.doe", "max_m", "k99"]
    mails = [f"write to {rng.choice(names)}@mail{i % 7}.example.com soon" for i in range(60)]
    phones = [f"call +1 (212) 555-{rng.randint(1000, 9999)} today" for _ in range(60)]
    noise = [f"order {rng.randint(10**17, 10**18 - 1)} of version {rng.randint(1, 900)}.{rng.randint(300, 900)}.1.2 pages {i}" for i in range(60)]
    clean = [f"plain words at the dot of noon, chapter {i}, at noon dot commas" for i in range(60)]
    texts = dict(enumerate([*mails, *phones, *noise, *clean, "mail: anna (at) example (dot) com", "phone: (212) 555-0199, thanks"]))
    seen = []
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs, learnt=seen.append).collect()}
    check_base(rows.values(), texts)
    assert rows[240].spans == f"email:6:{len(texts[240])}" and rows[241].spans == "phone:7:21"
    assert [(texts[i], rows[i].spans) for i in range(240) if rows[i].n_added] == []
    assert all(rows[i].spans == "" for i in range(180, 240))
    model = seen[0]
    yes = pii.LABELERS.index("checked")
    assert model.rates[yes, 1, 2] > 0.8 > model.rates[yes, 0, 2]


def test_expectation_maximisation_finds_known_rates():
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    truth = rng.random(20_000) < 0.4
    told = np.where((rng.random((20_000, 5)) < right) == truth[:, None], 1, -1)
    told[rng.random(told.shape) < 0.2] = 0
    patterns, place, n = np.unique(told, axis=0, return_inverse=True, return_counts=True)
    prior, rates, posterior = pii.expectation_maximisation(np.zeros(len(patterns), int), patterns, n.astype(float))
    assert abs(prior[0] - 0.4) < 0.03
    assert np.abs(rates[:, 1, 2] / (rates[:, 1, 2] + rates[:, 1, 0]) - right).max() < 0.03
    assert ((posterior[place.ravel()] > 0.5) == truth).mean() > 0.93


def test_personal_data_on_awkward_rows(spark):
    docs, texts = awkward(spark)
    clashing = docs.withColumnsRenamed({"n_chars": "found", "source": "held", "lang": "base"}).withColumns({"spans": F.lit(1), "row": F.lit(2), "taken": F.lit(3)})
    rows = pii.personal_data(clashing).collect()
    assert len(rows) == len(texts) and {"found", "held", "base", "row", "taken", "spans"} <= set(rows[0].asDict())
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id not in (15,))
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_many_spans_of_one_text_take_no_square(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "call +1 (017) 555-7713 or a.b@c.de now " * n)], "doc_id long, text string")
    row = pii.personal_data(docs).first()
    assert (row.n_email, row.n_phone) == (n, n) and row.n_ip == row.n_card == 0


# --- spelling variants ------------------------------------------------------------------------------------------------


def variants(rows, every=199, least=6, min_count=5, ratio=5):
    counts = Counter()
    for key, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
    for (_, x), ws in gaps.items():
        for w in ws:
            near[w] |= ws - {w}
            if x in counts:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def crowded(seed):
    """Words that share their first or last half, some frequent, with edits of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        words = ["straße" + "".join(rng.choices("aebé", k=rng.randint(0, 4))) for _ in range(20)] + ["".join(rng.choices("xyzÿ", k=rng.randint(0, 4))) + "ending" for _ in range(20)]
        words += ["frequentword"] * 9 + rng.choices(["frequentwords", "frequntword", "frequentwosds", "Frequentword"], k=1)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [4096, 3])
def test_variants_against_deletions(spark, most):
    rows = crowded(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_set(spelling.spelling_variants(docs, every=7, most=most)) == variants(rows, every=7)


def test_variants_on_awkward_rows(spark):
    docs, texts = awkward(spark)
    rows = [(i, t) for i, t, *_ in texts] + [(None, None), (77, "y" * 200 + " " + ("y" * 200 + "x ") * 9), (78, ("y" * 200 + " ") * 60)]
    more = spark.createDataFrame(rows[len(texts) :], "doc_id long, text string")
    both = docs.select("doc_id", "text", "gram", F.col("lang").alias("word"), F.lit(1).alias("n"), F.lit(2).alias("key")).unionByName(more, allowMissingColumns=True)
    got = as_set(spelling.spelling_variants(both, every=3))
    assert got == variants(rows, every=3) and any(f for _, f, *_ in got)
    assert as_set(spelling.spelling_variants(docs.limit(0))) == set()


def test_checksums_of_long_runs():
    starts = np.array([zlib.crc32(b"12:"), zlib.crc32(b":")], dtype=np.uint32)
    told = spelling._shifts(starts)
    for k, word in enumerate((b"a", b"hello", b"z" * 64)):
        assert told[0, len(word)] ^ zlib.crc32(word) == zlib.crc32(b"12:" + word), k
