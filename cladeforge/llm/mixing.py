"""Temperature mixing of sources: weights are token shares to a power, realised by whole passes and permuted blocks.

The exponent is found by sectioning its range until a target entropy, or a limit on how often a source is repeated, is met;
each step is one aggregate over the table of source totals. A source's budget is a number of whole passes and a rest. For the
rest, the source's documents are dealt into blocks by hash, the blocks are permuted, and blocks are taken up to the budget;
in the block that holds the end, documents are taken in order of their hashes. That block is narrowed by leading bits of the
hash, an aggregate a step, until it is few enough for one task to order. So a decision for a document needs only its own hash
and its block's row, and no text is moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, table

#: Tokens a block has about, and blocks a source has at most; rows of the block table that are broadcast at most.
BLOCK_TOKENS, MAX_BLOCKS, MAX_BROADCAST = 65_536, 4096, 1_000_000
#: Documents of the block that holds a source's end which one task orders at most; bits of the hash a step narrows it by beyond.
CUT_ROWS, CUT_BITS = 100_000, 10
SECTIONS, WIDTH = 16, 1e-6
MAX_REPEATS, SEED = 2.0, 11


def tokens(text: Column) -> Column:
    """Words between ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def totals(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Tokens and documents of each source (null is a source), as a table in the shared folder."""
    counted = docs.select(F.col(f"`{source}`").alias("source"), tokens(F.col(f"`{text}`")).alias("tokens"))
    return materialize(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "source-totals")


def measures(sums: DataFrame, exponents: list[float], budget: float | None) -> list[dict]:
    """Entropy of the weights, total of the powers and largest number of repeats at each exponent, in one aggregate."""
    whole = sums.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    share = F.col("tokens") / F.lit(float(whole.t))
    logs = F.log(share)
    columns = [c for i, a in enumerate(exponents) for c in (F.sum(F.pow(share, F.lit(a))).alias(f"s{i}"), F.sum(F.pow(share, F.lit(a)) * logs).alias(f"l{i}"))]
    row = sums.filter("tokens > 0").agg(F.min(share).alias("least"), F.max(share).alias("top"), *columns).first()
    out = []
    for i, a in enumerate(exponents):
        s, mean_log = row[f"s{i}"], row[f"l{i}"] / row[f"s{i}"]
        # without a budget, the largest source is passed once
        spend = budget if budget is not None else whole.t * s * row.top ** (1 - a)
        out.append({"exponent": a, "power_sum": s, "entropy": math.log(s) - a * mean_log, "budget": spend, "repeats": spend / whole.t / s * row.least ** (a - 1)})
    return out


def solve(sums: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> dict | None:
    """The measures at the exponent in 0..1 that is nearest to the target; None without tokens.

    With ``target_entropy`` (nats): the largest exponent whose weights have at least that entropy, 0 if none has. Else: the
    smallest exponent that repeats no source more than ``max_repeats`` times, 1 if none does.
    """
    if not sums.filter("tokens > 0").count():
        return None
    low, high = 0.0, 1.0
    if target_entropy is not None:
        good = lambda m: m["entropy"] >= target_entropy - 1e-12  # noqa: E731  holds on a lower part of the range
    else:
        good = lambda m: m["repeats"] > (math.inf if max_repeats is None else max_repeats) + 1e-12
    while high - low > WIDTH:
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        n = sum(1 for m in measures(sums, grid, budget) if good(m))
        if n == 0:
            high = low
        elif n == len(grid):
            low = high
        else:
            low, high = grid[n - 1], grid[n]
    return measures(sums, [low if target_entropy is not None else high], budget)[0]


def weighted(sums: DataFrame, at: dict) -> DataFrame:
    """Weight, repeats, whole passes, rest (tokens) and number of blocks of each source; no tokens: one pass, no weight."""
    total = sums.agg(F.sum("tokens")).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(at["exponent"])) / at["power_sum"]).otherwise(0.0)
    repeats = F.when(F.col("tokens") > 0, F.round(weight * at["budget"] / F.col("tokens"), 9)).otherwise(1.0)
    rows = sums.withColumns({"weight": weight, "repeats": repeats})
    passes = F.floor("repeats")
    return rows.withColumns({
        "passes": passes,
        "rest": F.round((F.col("repeats") - passes) * F.col("tokens")).cast("long"),
        "blocks": F.least(F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)), F.lit(MAX_BLOCKS)),
    })


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns, F.lit(SEED))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ends(dealt: DataFrame, cut: DataFrame, few: bool = True) -> DataFrame:
    """``of, block, last``: the hash up to which documents of ``dealt(of, block, h, n)`` are taken in each block of ``cut``.

    ``cut(of, block, room, rows)`` has a row a source: its block that holds the end, the tokens to take there and its
    documents; ``few``: it may go to all tasks. Documents of one hash are taken together or not at all; no row where none is.
    While a block has more than CUT_ROWS documents, its hashes are counted by their next CUT_BITS bits and only those that
    hold the end are looked at again, so a window has 2 ** CUT_BITS or CUT_ROWS rows at most; at the last bit a hash is one row.
    """
    nothing = F.lit(None).cast("long")
    at, shift = cut.select("of", "block", "room", "rows", nothing.alias("prefix"), nothing.alias("last")), 64

    def inside() -> DataFrame:
        named = at.select(*[F.col(c).alias(f"cut_{c}") for c in at.columns])
        near = dealt.join(F.broadcast(named) if few else named, _same(F.col("of"), F.col("cut_of")) & (F.col("block") == F.col("cut_block")))
        # a shift by 64 bits would be one by none
        return near if shift == 64 else near.filter(F.shiftright("h", shift) == F.col("cut_prefix"))

    while shift and (at.agg(F.max("rows")).first()[0] or 0) > CUT_ROWS:
        step = max(shift - CUT_BITS, 0)
        counted_by = inside().groupBy("of", "block", F.shiftright("h", step).alias("prefix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("h").alias("top"), F.first("cut_room").alias("room"), F.first("cut_last").alias("was"))
        run = counted_by.withColumn("run", F.sum("n").over(Window.partitionBy("of", "block").orderBy("prefix")))
        taken = F.col("run") <= F.col("room")
        end = F.min(F.when(~taken, F.struct("prefix", (F.col("room") - F.col("run") + F.col("n")).alias("room"), "rows"))).alias("end")
        found = run.groupBy("of", "block").agg(end, F.coalesce(F.max(F.when(taken, F.col("top"))), F.first("was")).alias("last"))
        at = materialize(found.select("of", "block", "end.room", "end.rows", "end.prefix", "last"), "mix-ends")
        shift = step
    if not shift:
        return at.filter("last IS NOT NULL").select("of", "block", "last")
    order = Window.partitionBy("of", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside().withColumn("run", F.sum("n").over(order)).filter("run <= cut_room").groupBy("of", "block").agg(F.max("h").alias("h"))
    before = at.filter("last IS NOT NULL").select("of", "block", F.col("last").alias("h"))
    return taken.union(before).groupBy("of", "block").agg(F.max("h").alias("last"))


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, text: str = "text", source: str = "source", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sources with their weights; and blocks with ``share`` (1 taken, 0 not, between: hashes up to ``last``) and rank."""
    sums = totals(docs, text, source)
    at = solve(sums, target_entropy, max_repeats, budget)
    if at is None:
        at = {"exponent": 1.0, "power_sum": 1.0, "budget": 0.0}
    sources = materialize(weighted(sums, at), "source-weights")
    few = F.broadcast(sources) if sources.count() <= MAX_BROADCAST else sources
    meta = docs.select(F.col(f"`{source}`").alias("of"), _hash(F.col(f"`{key}`")).alias("h"), tokens(F.col(f"`{text}`")).alias("n"))
    dealt = materialize(meta.join(few, _same(F.col("of"), F.col("source"))).select("of", F.pmod("h", F.col("blocks")).alias("block"), "h", "n"), "mix-tokens")
    sized = dealt.groupBy("of", "block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("of").orderBy(_hash(F.col("block")), "block")
    ranked = sized.withColumns({"rank": F.row_number().over(order), "before": F.sum("n").over(order) - F.col("n")})
    ranked = ranked.join(few.select("source", "rest"), _same(F.col("of"), F.col("source"))).drop("source")
    state = F.when(F.col("rest") == 0, 0).when(F.col("before") + F.col("n") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    ranked = materialize(ranked.withColumn("state", state), "mix-blocks")
    cut = ranked.filter("state = 2").select("of", "block", (F.col("rest") - F.col("before")).alias("room"), "rows")
    last = ends(dealt, cut, few is not sources).select(F.col("of").alias("last_of"), F.col("block").alias("last_block"), "last")
    blocks = ranked.join(last, _same(F.col("of"), F.col("last_of")) & (F.col("block") == F.col("last_block")), "left")
    return sources, materialize(blocks.select("of", "block", "rank", "state", "last"), "mix-plan")


def counted(docs: DataFrame, sources: DataFrame, blocks: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``mix``: a struct of weight, repeats, block, rank and copies of each row."""
    few = F.broadcast(sources) if sources.count() <= MAX_BROADCAST else sources
    held = F.broadcast(blocks) if blocks.count() <= MAX_BROADCAST else blocks
    s, b = few.select([F.col(c).alias(f"s_{c}") for c in ("source", "weight", "repeats", "passes", "blocks")]), held.select([F.col(c).alias(f"b_{c}") for c in ("of", "block", "rank", "state", "last")])
    # one struct keeps the columns of docs apart from those made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), _hash(F.col(f"`{key}`")).alias("h"), F.col(f"`{source}`").alias("of"))
    rows = rows.join(s, _same(F.col("of"), F.col("s_source"))).join(b, _same(F.col("of"), F.col("b_of")) & (F.pmod("h", F.col("s_blocks")) == F.col("b_block")))
    more = F.when(F.col("b_state") == 1, 1).when((F.col("b_state") == 2) & (F.col("h") <= F.col("b_last")), 1).otherwise(0)
    made = F.struct(F.col("s_weight").alias("weight"), F.col("s_repeats").alias("repeats"), F.col("b_block").alias("block"), F.col("b_rank").alias("rank"), (F.col("s_passes") + more).cast("long").alias("copies"))
    return rows.select(*[F.col("held").getField(c).alias(c) for c in docs.columns], made.alias(fresh(docs, "mix")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **target) -> DataFrame:
    """``docs`` with each row repeated as often as its source's budget says, columns unchanged.

    Null sources are one source. Documents without tokens cost nothing and go with their blocks; a source without any tokens
    is passed once. Rows that repeat an id share its hash, and so its fate. Without a ``budget`` each source is passed
    once at least, so that no document is lost. An empty table gives an empty one.
    """
    rows = counted(docs, *plan(docs, text=text, source=source, key=key, **target), source, key)
    name = rows.columns[-1]
    many = rows.filter(F.col(f"{name}.copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_temperature_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's weight and repeats, its block, and how often it is taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = counted(docs, *plan(docs))
    name = rows.columns[-1]
    return rows.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), *[F.col(f"{name}.{c}").alias(c) for c in ("weight", "repeats", "block", "rank", "copies")])
