"""Table functions for SQL, used in LATERAL: ``cigar_ops(cigar)``, ``spaced_seeds(seq)`` and ``fasta_records(text)``.

Each turns one value into rows, value by value, in Arrow batches on the executors; ``register`` makes them known to a session.
``seed_totals(TABLE(SELECT grp, seq ...))`` takes a table instead, where its partitions are, and tells partial sums of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .seeds import coded, seed_table
from .sequence import SPACED_SEEDS

_OP = re.compile(r"(\d+)([MXID])")


@udtf(returnType="place int, op string, n long, a_start long, b_start long", useArrow=True)
class CigarOps:
    """The operations of a run-length CIGAR in order, and where each begins in the first and the second sequence; null: none."""

    def eval(self, cigar: str) -> Iterator[tuple]:
        a = b = 0
        for place, (n, op) in enumerate(_OP.findall(cigar or "")):
            n = int(n)
            yield place, op, n, a, b
            a, b = a + n * (op != "I"), b + n * (op != "D")


@udtf(returnType="code int, place int", useArrow=True)
class SpacedSeeds:
    """Each spaced seed at each place that has six letters: seed * 4**5 and five letters in base 4 (all but C, G, T count as A)."""

    def eval(self, seq: str) -> Iterator[tuple]:
        letters = [c & 3 for c in coded(seq or "").tolist()]
        weight = len(SPACED_SEEDS[0])
        for place in range(len(letters) - max(map(max, SPACED_SEEDS))):
            for x, seed in enumerate(SPACED_SEEDS):
                code = x
                for p in seed:
                    code = code * 4 + letters[place + p]
                assert code < (x + 1) * 4**weight
                yield code, place


#: Groups whose sums a task holds at most: beyond, they are told and begun anew.
MAX_GROUPS = 1000
_NOWHERE = 2**31 - 1


@udtf(returnType="grp string, code int, n long, place int")
class SeedTotals:
    """How often each spaced seed stands in the sequences of a group, and its first place: a row a group, code and partition.

    The rows of a group in several partitions are partial, to be summed. Codes as of ``spaced_seeds``.
    """

    def __init__(self) -> None:
        self.held: dict = {}

    def _told(self) -> Iterator[tuple]:
        for group, (n, place) in self.held.items():
            at = np.flatnonzero(n)
            yield from zip([group] * len(at), at.tolist(), n[at].tolist(), place[at].tolist(), strict=True)
        self.held = {}

    def eval(self, row) -> Iterator[tuple]:
        group, seq = row[0], row[1]
        codes, places = seed_table(coded(seq or ""))
        if len(codes):
            if group not in self.held and len(self.held) >= MAX_GROUPS:
                yield from self._told()
            size = len(SPACED_SEEDS) << 10
            n, place = self.held.setdefault(group, (np.zeros(size, np.int64), np.full(size, _NOWHERE)))
            n += np.bincount(codes, minlength=size)
            # codes are sorted, and those of a code are in order of their seed's places
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            place[codes[first]] = np.minimum(place[codes[first]], places[first])

    def terminate(self) -> Iterator[tuple]:
        yield from self._told()


@udtf(returnType="place int, name string, seq string", useArrow=True)
class FastaRecords:
    """Records of FASTA text: wrapped lines joined, upper case; what stands before the first header is none."""

    def eval(self, text: str) -> Iterator[tuple]:
        parts = re.split(r"(?:^|(?<=\n))>", text or "")
        place = 0
        for record in parts[1:]:
            name, _, body = record.partition("\n")
            if record.strip(" \n"):
                yield place, name.removesuffix("\r"), re.sub(r"[ \t\n\r\x0b\x0c]", "", body).upper()
                place += 1


def register(spark: SparkSession) -> None:
    for name, function in (("cigar_ops", CigarOps), ("spaced_seeds", SpacedSeeds), ("seed_totals", SeedTotals), ("fasta_records", FastaRecords)):
        spark.udtf.register(name, function)
