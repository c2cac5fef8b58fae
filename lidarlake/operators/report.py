"""Reports on a cloud and on the quality of its patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patch_sizes(patches: DataFrame) -> DataFrame:
    """How many patches hold ``n`` points, for each ``n``."""
    return patches.groupBy("n").agg(F.count(F.lit(1)).alias("patches"))


def patch_size_profile(patches: DataFrame, nearly_empty: int = 5) -> DataFrame:
    """One row: share of nearly empty patches, quartiles of points per patch.

    The percentiles are exact: they are taken over the distribution, weighted.
    """
    sizes = patch_sizes(patches)
    small = F.sum(F.when(F.col("n") < nearly_empty, F.col("patches")).otherwise(F.lit(0)))
    weighted = [F.percentile("n", q, F.col("patches")).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return sizes.agg(
        F.sum("patches").alias("patches"),
        small.alias("nearly_empty"),
        (small / F.sum("patches")).alias("nearly_empty_share"),
        *weighted,
        F.max("n").alias("largest"),
    )


def patch_summary(patches: DataFrame) -> DataFrame:
    """One row: patches, points, extent and time span; arrays are not read."""
    ends = [
        end(F.col(f"{d}_{name}")).alias(f"{d}_{name}")
        for d in ("x", "y", "z", "t")
        for name, end in (("min", F.min), ("max", F.max))
        if f"{d}_{name}" in patches.columns
    ]
    return patches.agg(F.count(F.lit(1)).alias("patches"), F.sum("n").alias("points"), *ends)


def duplicate_points(points: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """Points that occur more than once, with their count.

    Loading a file twice doubles its points. Copies are counted before the shuffle.
    """
    return (
        points.groupBy(*(dims or points.columns))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def without_duplicates(points: DataFrame) -> DataFrame:
    """Each distinct point once."""
    return points.dropDuplicates()
