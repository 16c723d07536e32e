"""Brute-force versions and awkward rows for the tests of the training-data operators."""

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {i: i + 32 for i in range(65, 91)}
NULLS = "doc_id long, text string, lang string, source string, n_chars long, stats string, kept string, gram int, row int, component_id int, ids int"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as operators name theirs."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=30_000))
    prose = " ".join(rng.choices(words, k=90))
    texts = [(1, prose, "en", "s1"), (2, prose + " tail", "en", "s1"), (3, None, "en", None), (4, "", None, "s2"), (5, " \t\n", "fr", "s2"), (6, "one two", "fr", "s2"), (7, "ONE two", "fr", "s2"), (8, long, "de", "s3"), (9, long[:150_000], "de", "s3"), (10, prose, None, None), (10, prose, None, None), (None, "the of and " * 30, "en", "s1"), (12, "é ß 漢字 😀 " * 40, "de", "s1"), (13, "x" * 5000, "en", "s1"), (14, "|".join(words[:60]), "en", "s1"), (15, "GNU  General-Public\nLicense, Apache License MIT License CC BY 4.0", "en", "s1")]
    rows = [(i, t, la, so, None if t is None else len(t), "s", None, 1, None, 2, 3) for i, t, la, so in texts]
    return spark.createDataFrame(rows, NULLS), texts


def shingles(text):
    words = SPACE_WORD.findall((text or "").translate(AZ))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(rows, percent=75):
    """Component of each id by comparing all pairs of sets."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def repeats(texts, window=200):
    """For each text: its length, bytes removed, number of spans, and what is left."""
    bodies = [(t or "").encode() for t in texts]
    count = {}
    for b in bodies:
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            count[w] = count.get(w, 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out
