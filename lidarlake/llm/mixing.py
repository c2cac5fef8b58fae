"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt to the sources, and each source's words to its shards of the documents. Seat s
of a party with claim t has the quotient t / (2 s + 1), and words go to the highest quotients.
So a quota is a rounded share of the claim, for the one threshold at which all words are dealt;
equal quotients at the threshold go by order. The threshold over the sources is found by
counting quotas for many thresholds at once; no list of seats exists. A source's total is
fixed before its shards are, so their number doesn't change it. A shard's documents of a source
then lie on a tape in a seeded order. The quota buys whole passes over the tape, and for the
rest, blocks of it that a seeded permutation picks, the last one in part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.operators.ids import row_ids
from lidarlake.session import stage

#: Words of a block of the tape.
BLOCK = 64
#: Documents of a shard, about.
SHARD = 20_000
WEIGHTS = (5.0, 2.0, 1.0)
_WORDS = r"[^\x20\x09-\x0D]+"
# Strides of the block permutation; one that doesn't divide the number of blocks is taken.
_STRIDES = (7919, 104729, 1299709, 15485863)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``source, _null, source_size, target``: shares by weight, none above ``most`` times its size."""
    ranked = row_ids(sources.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = stage(ranked.select("source", "_null", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "mix-sources")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    wanted = share * (total or 0)
    rate, before = wanted / (weights or 1), -1
    while True:  # each round at least one more source is full
        full = F.col("cap") <= F.col("w") * rate
        n, taken, left = ranked.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))
        ).first()
        if n == before or not left:
            break
        before, rate = n, (wanted - (taken or 0.0)) / left
    return ranked.select("source", "_null", "source_size", F.least("cap", F.col("w") * rate).alias("target"))


def _deal(sources: DataFrame, most: float) -> DataFrame:
    """``sources`` with ``quota``: as many words as all targets make up, to the highest quotients."""
    top = F.floor(F.col("source_size") * most)

    def seats(threshold: float) -> Column:
        return F.least(F.floor(F.col("target") / F.lit(2 * threshold) + 0.5), top)

    def dealt(steps: list[float]) -> list[int]:
        return list(sources.agg(*[F.sum(seats(t)).alias(f"c{i}") for i, t in enumerate(steps)]).first())

    wanted, high, tops = sources.agg(F.sum("target"), F.max("target"), F.sum(top)).first()
    words = min(round(wanted or 0), tops or 0)
    if not words:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    low, high = wanted / (4 * words), 2 * high  # none reaches high
    while dealt([low])[0] < words:
        low /= 16
    left = words
    for _ in range(10):
        steps = [low, *[low * (high / low) ** (i / 64) for i in range(1, 64)], high]
        counts = dealt(steps)
        at = next(i for i, c in enumerate(counts) if c <= words or i == 64)
        low, high, left = steps[max(0, at - 1)], steps[at], words - counts[at]
        if not left or high <= low * (1 + 1e-14):
            break
    sources = sources.withColumn("quota", seats(high))
    if not left:
        return sources
    tied = row_ids(sources.where(seats(low) > F.col("quota")).select("_null", "source"), ["_null", "source"], "_turn")
    extra = tied.where(F.col("_turn") <= left).select(F.col("source").alias("_tied"), F.lit(1).alias("_more"))
    return (
        sources.join(extra, F.col("source").eqNullSafe(F.col("_tied")), "left")
        .withColumn("quota", F.col("quota") + F.coalesce("_more", F.lit(0)))
        .drop("_tied", "_more")
    )


def highest(claims: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each party, none above ``most``; equal quotients go to the first parties."""
    seats = min(seats, int(most.sum()))
    if seats <= 0:
        return np.zeros(len(claims), np.int64)

    def won(threshold: float) -> np.ndarray:
        return np.minimum(np.floor(claims / (2 * threshold) + 0.5), most).astype(np.int64)

    low, high = claims.sum() / (4 * seats), 2 * claims.max()
    while won(low).sum() < seats:
        low /= 16
    while low < (middle := (low + high) / 2) < high:
        if won(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = won(high)
    tied = np.flatnonzero(won(low) > got)[: seats - int(got.sum())]
    got[tied] += 1
    return got


def _deal_shards(most: float):
    """The quota of one source, dealt to its shards by their tapes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        tape = table["tape"].to_numpy()
        quota = highest(tape.astype(float), np.floor(tape * most), table["quota"][0].as_py())
        return table.drop_columns("quota").append_column("quota", pa.array(quota, pa.int64()))

    return run


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7,
        carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of ``docs``.

    ``taken`` is how many words of the document the mix takes, a second pass counted again;
    it is never above ``most`` times its size for the default of two. Sources come by code
    point, null last, and weigh 5, 2, 1, repeating. A null or empty text has size 0 and gives
    nothing; without any words all targets are 0. Repeated rows are documents like any other.
    Equal inputs and seeds give equal results. A source's words come to its target, rounded,
    at any number of shards. With ``carried``, the last column ``rest`` is a struct of these
    columns of the row; others are ignored.
    """
    rest = [F.struct(*carried).alias("_carried")] if carried else []
    sized = stage(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count().alias("size"),
            F.xxhash64("doc_id", "text", F.lit(seed)).alias("_order"),
            *rest,
        ),
        "mix-sizes",
    )
    shards = max(1, math.ceil(sized.count() / SHARD))
    sized = sized.withColumn("shard", F.pmod("_order", F.lit(shards)).cast("int"))
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    targets = stage(_deal(stage(targets, "mix-targets"), most).drop("_null"), "mix-quotas")
    tape = sized.groupBy("source", "shard").agg(F.sum("size").alias("tape"))
    parties = stage(
        tape.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select("source", "shard", "tape", "source_size", "target", "quota")
        .groupBy("source")
        .applyInArrow(
            _deal_shards(most),
            "source string, shard int, tape long, source_size long, target double, quota long",
        ),
        "mix-parties",
    )
    nb = F.ceil(F.col("tape") / block)
    stride = F.coalesce(*[F.when(nb % s != 0, F.lit(s)) for s in _STRIDES], F.lit(1)).cast("long")
    parties = (
        parties.withColumn("passes", F.coalesce(F.expr("quota div nullif(tape, 0)"), F.lit(0)))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tape"))
        .withColumn("nb", F.greatest(nb, F.lit(1)).cast("long"))
        .withColumn("stride", stride)
        .withColumn("shift", F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("nb")))
        .select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target",
                "passes", "rest", "nb", "stride", "shift", (F.col("nb") * block - F.col("tape")).alias("short"))
    )
    along = Window.partitionBy("source", "shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0)))
    placed = laid.join(parties, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    b = F.lit(block).cast("long")
    end = F.col("start") + F.col("size")

    def part(total: Column, j: Column) -> Column:
        """Words of the document in block j, as far as the block is picked."""
        turn = (j * F.col("stride") + F.col("shift")) % F.col("nb")
        last = ((F.col("nb") - 1) * F.col("stride") + F.col("shift")) % F.col("nb")
        # The last block lacks some words, which blocks after its turn get.
        before = turn * b - F.when(turn > last, F.col("short")).otherwise(0)
        picked = F.greatest(F.lit(0).cast("long"), F.least(b, F.col("rest") - before))
        words = F.least(end, j * b + picked) - F.greatest(F.col("start"), j * b)
        return total + F.greatest(F.lit(0).cast("long"), words)

    touched = F.sequence(F.expr(f"start div {block}L"), F.expr(f"(start + size - 1) div {block}L"))
    extra = F.when(
        (F.col("rest") > 0) & (F.col("size") > 0), F.aggregate(touched, F.lit(0).cast("long"), part)
    ).otherwise(F.lit(0))
    return placed.select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"),
        "source",
        *[F.col("_carried").alias("rest") for _ in rest],
    )
