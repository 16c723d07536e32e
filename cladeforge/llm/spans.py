"""Places of all matches of a pattern, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are folded in one step: a fold that appends to an array copies it at each step, so it goes by blocks.
FOLD = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and in whatever lambda ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, kind: str, total: Callable[[Column], Column], each: Callable[[Column, Column], Column]) -> Column:
    """Array of ``each(sum of totals before, value)``; ``kind``: type of an element of the result."""

    def fold(array: Column, begin: Column, out: str, made: Callable[[Column, Column], Column], size: Callable[[Column], Column]) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(f"array<{out}>").alias("out"))
        return F.aggregate(array, start, lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(made(s["at"], x))).alias("out")), lambda s: s["out"])

    def in_blocks(v: Column) -> Column:
        n = F.size(v)
        blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int")), lambda k: F.slice(v, k * FOLD + 1, F.lit(FOLD)))).otherwise(F.slice(F.array(v), 1, 0))

        def whole(b: Column) -> Column:
            sums = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + total(y)))
            return F.flatten(F.zip_with(b, fold(sums, F.lit(0), "int", lambda at, x: at, lambda x: x), lambda x, o: fold(x, o, kind, each, total)))

        return bound(blocks, whole)

    return bound(values, in_blocks)


def spans(text: Column, pattern: Column) -> Column:
    """Array of (start, end) of all matches: between them stand the pieces of a split."""
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    lengths = bound(found, lambda f: F.zip_with(f, F.slice(pieces, 1, F.size(f)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))))
    return running(lengths, "struct<start:int,end:int>", lambda x: x["gap"] + x["size"], lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end")))
