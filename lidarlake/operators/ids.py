"""Exact positions in a sorted order, without a window over everything.

The rows are range-partitioned and sorted into *runs*, each of which is written
down with the position of every row inside its run. A second, tiny table holds how
many rows come before each run; adding the two gives the global position. Rows of
one group may spread over many runs, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.session import stage

# monotonically_increasing_id puts the partition above bit 33, the row below.
_ROW_BITS = 33
# Starts of runs are broadcast up to so many rows, and joined by shuffle beyond.
_MOST_STARTS = 200_000


def sorted_runs(df: DataFrame, order: Sequence[str], runs: int, distinct_order: bool) -> DataFrame:
    """``df`` cut into sorted runs and written: adds ``_run`` and ``_pos`` (from 0).

    With ``distinct_order=False`` equal rows may be many (a group of copies), and a
    range partitioner cannot tell them apart. They first get a written ``_salt``, so
    that copies spread over runs and a repeated task sees the same salt again.
    """
    order = list(order)
    if not distinct_order:
        df = stage(df.withColumn("_salt", F.monotonically_increasing_id()), "salted")
        order = [*order, "_salt"]
    marked = (
        df.repartitionByRange(runs, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_run", F.shiftright("_id", _ROW_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id", "_salt")
    )
    return stage(marked, "runs")


def number_runs(runs: DataFrame, group: Sequence[str], name: str, most: int) -> DataFrame:
    """Position from 1 of each row of ``runs`` inside its group, as column ``name``.

    The table of starts has one row per run and group met in it. Groups are
    contiguous in the sort order, so it has at most (runs + groups) rows: ``most``.
    """
    renamed = {g: f"_g_{g}" for g in group}
    starts = runs.groupBy("_run", *group).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("_run").alias("_g_run"),
        *[F.col(g).alias(renamed[g]) for g in group],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = F.col("_run") == F.col("_g_run")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(renamed[g]))
    joined = runs.join(F.broadcast(starts) if most <= _MOST_STARTS else starts.hint("merge"), match)
    helpers = ["_run", "_pos", "_g_run", "_shift", *renamed.values()]
    return joined.withColumn(name, F.col("_pos") + F.col("_shift")).drop(*helpers)


def row_ids(
    df: DataFrame,
    order: Sequence[str],
    name: str = "gid",
    runs: int | None = None,
    distinct_order: bool = True,
) -> DataFrame:
    """Number the rows 1, 2, 3 … in the given order; ids are stable between runs.

    Name enough columns to make the order distinct. If equal rows may exist, say
    ``distinct_order=False`` and they are numbered among themselves.
    """
    if runs is None:
        runs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return number_runs(sorted_runs(df, order, runs, distinct_order), [], name, runs)
