"""Sequence columns by built-in functions: cleaning, counts, checksums, alphabets, distances from counts, CIGAR strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the distance model.
SATURATED, MIN_SITES, NEAR_ONE = 30.0, 5, 0.75 * (1 - math.exp(-40))
# Letters of each alphabet, and the probability that the model gives to all of them together.
DNA_LETTERS, PROTEIN_LETTERS, KNOWN = "acgtunACGTUN", "acdefghiklmnpqrstvwyACDEFGHIKLMNPQRSTVWY", 0.9999
# Places of the five spaced seeds in six letters.
SPACED_SEEDS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5))


def clean(text: Column) -> Column:
    """Upper-case sequence of the letters A C G T N of a text; others are dropped."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]", ""))


def fasta_records(text: Column) -> Column:
    """Array of (name, seq) of FASTA held in a column: wrapped lines joined, upper case; null text has no records (null).

    As in files: text before the first header is no record, CR LF ends lines, and a record without lines has an empty sequence.
    """
    parts = F.split(F.concat(F.lit("\n"), F.replace(text, F.lit("\r"), F.lit(""))), "\n>")
    lines = lambda x: F.when(F.instr(x, "\n") > 0, F.upper(F.regexp_replace(F.substr(x, F.instr(x, "\n") + 1), r"\s", ""))).otherwise("")
    return F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x) != ""), lambda x: F.struct(F.substring_index(x, "\n", 1).alias("name"), lines(x).alias("seq")))


def letters(seq: Column, letter: str) -> Column:
    """How often a letter occurs."""
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))).cast("long")


def is_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGTUN-]*$")


def base_codes(seq: Column) -> Column:
    """Digits for bases: A 0, C 1, G 2, T and U 3, anything else 4."""
    return F.regexp_replace(F.translate(seq, "ACGTU", "01233"), "[^0123]", "4")


def degap(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def gcg_checksum(seq: Column) -> Column:
    """Sum of ((i mod 57) + 1) times the upper-case ASCII code of letter i, modulo 10000."""
    codes = F.transform(F.split(F.upper(seq), ""), lambda x, i: ((i % 57) + 1) * F.ascii(x))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x) % 10000).cast("long")


def letter_scores(counts: dict[str, Column]) -> tuple[Column, Column]:
    """Log-likelihood of letter counts under the DNA and the protein alphabet."""
    dna, protein = F.lit(0.0), F.lit(0.0)
    for letter, n in counts.items():
        for known, others, score in ((DNA_LETTERS, 116.0, "dna"), (PROTEIN_LETTERS, 88.0, "protein")):
            p = math.log(KNOWN / len(known)) if letter in known else math.log((1 - KNOWN) / others)
            if score == "dna":
                dna = dna + n * F.lit(p)
            else:
                protein = protein + n * F.lit(p)
    return dna, protein


def jukes_cantor(different: Column, sites: Column) -> Column:
    """Distance from counts of differing and of comparable sites: 1 below MIN_SITES sites, SATURATED from three quarters on."""
    p = different / sites
    return F.when(sites < MIN_SITES, 1.0).when(p >= NEAR_ONE, SATURATED).otherwise(F.abs(-0.75 * F.log(1 - 4 * p / 3)))


def cigar_runs(cigar: Column) -> Column:
    """Array of (n, op) of a run-length CIGAR such as 3M1X2D."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MXID])"), 1), lambda r: F.struct(F.regexp_extract(r, r"\d+", 0).cast("long").alias("n"), F.substr(r, F.length(r), F.lit(1)).alias("op")))


def _fold(cigar: Column, f) -> Column:
    return F.aggregate(cigar_runs(cigar), F.lit(0).cast("long"), lambda a, r: a + f(r))


def cigar_matches(cigar: Column) -> Column:
    return _fold(cigar, lambda r: F.when(r["op"] == "M", r["n"]).otherwise(0))


def cigar_edits(cigar: Column) -> Column:
    return _fold(cigar, lambda r: F.when(r["op"] == "M", 0).otherwise(r["n"]))


def cigar_linear_cost(cigar: Column, mismatch: int = 4, gap: int = 2) -> Column:
    return _fold(cigar, lambda r: F.when(r["op"] == "X", mismatch * r["n"]).when(r["op"] == "M", 0).otherwise(gap * r["n"]))


def cigar_affine_cost(cigar: Column, mismatch: int = 4, opening: int = 6, extending: int = 2) -> Column:
    return _fold(cigar, lambda r: F.when(r["op"] == "X", mismatch * r["n"]).when(r["op"] == "M", 0).otherwise(opening + extending * r["n"]))


def cigar_affine2_cost(cigar: Column, mismatch: int = 4, opening: int = 6, extending: int = 2, opening2: int = 24, extending2: int = 1) -> Column:
    """The cheaper of two affine gap costs for each gap."""
    return _fold(cigar, lambda r: F.when(r["op"] == "X", mismatch * r["n"]).when(r["op"] == "M", 0).otherwise(F.least(opening + extending * r["n"], opening2 + extending2 * r["n"])))


def cigar_lengths(cigar: Column) -> Column:
    """Letters of the first and of the second sequence that a CIGAR covers; I stands in the second only, D in the first."""
    return F.struct(_fold(cigar, lambda r: F.when(r["op"] == "I", 0).otherwise(r["n"])).alias("a"), _fold(cigar, lambda r: F.when(r["op"] == "D", 0).otherwise(r["n"])).alias("b"))


def cigar_is_valid(cigar: Column, a: Column, b: Column) -> Column:
    """Whether a CIGAR covers both sequences, matches where they agree and has no other letters."""
    gapped_a, gapped_b = gapped(cigar, a, b)
    ops = F.array_join(F.transform(cigar_runs(cigar), lambda r: F.repeat(r["op"], r["n"].cast("int"))), "")
    told = F.transform(F.split(ops, ""), lambda o, i: F.struct(o.alias("o"), F.substr(gapped_a, i + 1, F.lit(1)).alias("a"), F.substr(gapped_b, i + 1, F.lit(1)).alias("b")))
    lengths = cigar_lengths(cigar)
    agree = F.forall(told, lambda t: F.when(t["o"] == "M", t["a"] == t["b"]).when(t["o"] == "X", t["a"] != t["b"]).otherwise(F.lit(True)))
    return cigar.rlike(r"^(\d+[MXID])*$") & (lengths["a"] == F.length(a)) & (lengths["b"] == F.length(b)) & agree


def gapped(cigar: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Both sequences with gaps, as the CIGAR aligns them."""
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit("").alias("x"), F.lit("").alias("y"))

    def step(s: Column, r: Column) -> Column:
        n, gap = r["n"].cast("int"), F.repeat(F.lit("-"), r["n"].cast("int"))
        return F.struct(
            F.when(r["op"] == "I", s["i"]).otherwise(s["i"] + n).alias("i"),
            F.when(r["op"] == "D", s["j"]).otherwise(s["j"] + n).alias("j"),
            F.concat(s["x"], F.when(r["op"] == "I", gap).otherwise(F.substr(a, s["i"], n))).alias("x"),
            F.concat(s["y"], F.when(r["op"] == "D", gap).otherwise(F.substr(b, s["j"], n))).alias("y"),
        )

    return F.aggregate(cigar_runs(cigar), start, step, lambda s: s["x"]), F.aggregate(cigar_runs(cigar), start, step, lambda s: s["y"])


def seed_codes(seq: Column) -> Column:
    """Array of (code, place): each spaced seed at each place, as seed * 4**5 and five letters in base 4 (all but C, G, T count as A)."""
    weight = len(SPACED_SEEDS[0])

    def coded(d: Column) -> Column:
        def at(o: Column) -> Column:
            each = [sum((d[o + p] * 4 ** (weight - 1 - k) for k, p in enumerate(seed)), F.lit(x * 4**weight)) for x, seed in enumerate(SPACED_SEEDS)]
            return F.array(*[F.struct(code.cast("int").alias("code"), o.alias("place")) for code in each])

        last = F.size(d) - 1 - max(map(max, SPACED_SEEDS))
        return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)))

    letters = F.filter(F.split(F.translate(F.coalesce(seq, F.lit("")), "ACGTUN", "012330"), ""), lambda c: c != "")
    # a one-element array binds the digits, so that they are made once
    return F.transform(F.array(F.transform(letters, lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))), coded)[0]
