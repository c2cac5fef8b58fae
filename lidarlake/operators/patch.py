"""Patches: one row per group of points.

A patch row holds its key columns, ``chunk`` (0, 1, … when a group is larger than
one patch may be), ``n``, the minimum and maximum of the indexed dimensions as
plain columns that Parquet can prune on, and one array per dimension. All arrays of
a patch share one point order: acquisition time first, then the other dimensions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.text import wkt_box, wkt_point

STAT_DIMS = ("gps_time", "x", "y", "z")


def stat_prefix(dim: str) -> str:
    """``gps_time`` keeps its range in ``t_min`` and ``t_max``, ``d`` in ``d_min`` …"""
    return "t" if dim.lower() == "gps_time" else dim


def patch_dims(patches: DataFrame) -> list[str]:
    """The dimensions stored in a patch table, in order."""
    return [f.name for f in patches.schema if isinstance(f.dataType, T.ArrayType)]


def patch_keys(patches: DataFrame) -> list[str]:
    """The columns that identify a patch: everything before ``n``."""
    names = patches.columns
    return names[: names.index("n")]


def range_aggregates(points: DataFrame, stats: Sequence[str]) -> list[Column]:
    """Minimum and maximum per dimension, blind to NaN (all NaN gives null)."""
    columns = []
    for dim in stats:
        value = F.col(dim)
        if isinstance(points.schema[dim].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        prefix = stat_prefix(dim)
        columns += [F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max")]
    return columns


def tile_size(named: str) -> float:
    """The size of a tile as its column name tells it."""
    return float(named.replace("p", "."))


def tile_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def tile_columns(patches: DataFrame, dim: str) -> list[tuple[str, str, float]]:
    """Tiles of ``dim`` that the table is partitioned by: low, high column and size."""
    found = []
    for name in patches.columns:
        match = re.fullmatch(rf"({re.escape(stat_prefix(dim))}_tile_([0-9p]+))_lo", name)
        if match and f"{match[1]}_hi" in patches.columns:
            found.append((name, f"{match[1]}_hi", tile_size(match[2])))
    return found


def _array_numbers(patches: DataFrame, dim: str) -> Column:
    element = patches.schema[dim].dataType.elementType
    if isinstance(element, (T.DoubleType, T.FloatType)):
        return F.filter(F.col(dim), lambda v: ~F.isnan(v))
    return F.col(dim)


def patch_min(patches: DataFrame, dim: str) -> Column:
    """Smallest value of ``dim`` in the patch: the stored one, or from its array."""
    stored = f"{stat_prefix(dim)}_min"
    if stored in patches.columns:
        return F.col(stored)
    return F.array_min(_array_numbers(patches, dim))


def patch_max(patches: DataFrame, dim: str) -> Column:
    """Largest value of ``dim`` in the patch."""
    stored = f"{stat_prefix(dim)}_max"
    if stored in patches.columns:
        return F.col(stored)
    return F.array_max(_array_numbers(patches, dim))


def patch_range(patches: DataFrame, dim: str) -> Column:
    """The closed range of ``dim``: ``struct<lo, hi, lo_inc, hi_inc>``."""
    return F.struct(
        patch_min(patches, dim).alias("lo"),
        patch_max(patches, dim).alias("hi"),
        F.lit(True).alias("lo_inc"),
        F.lit(True).alias("hi_inc"),
    )


def patch_box(patches: DataFrame) -> Column:
    """The flat bounding box: ``struct<x_min, y_min, x_max, y_max>``."""
    return F.struct(
        patch_min(patches, "x").alias("x_min"),
        patch_min(patches, "y").alias("y_min"),
        patch_max(patches, "x").alias("x_max"),
        patch_max(patches, "y").alias("y_max"),
    )


def patch_wkt(patches: DataFrame, decimals: int | None = None) -> Column:
    """The bounding box as WKT."""
    return wkt_box(
        patch_min(patches, "x"),
        patch_min(patches, "y"),
        patch_max(patches, "x"),
        patch_max(patches, "y"),
        decimals,
    )


def point_wkt(decimals: int | None = None) -> Column:
    """A point row as WKT."""
    return wkt_point(F.col("x"), F.col("y"), F.col("z"), decimals)


def explode_patches(
    patches: DataFrame,
    dims: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    position: str | None = None,
) -> DataFrame:
    """One row per point. Only the arrays of ``dims`` are read from the table.

    ``keep`` carries patch columns along; ``position`` names a column for the place
    of the point in its patch, from 0.
    """
    dims = list(dims) if dims is not None else [d for d in patch_dims(patches) if d not in keep]
    zipped = F.arrays_zip(*dims)
    if position is None:
        return patches.select(*keep, F.inline(zipped))
    placed = patches.select(*keep, F.posexplode(zipped).alias(position, "_point"))
    return placed.select(*keep, position, *[F.col(f"_point.{d}").alias(d) for d in dims])


def patch_text(patches: DataFrame, dims: Sequence[str] | None = None) -> Column:
    """A patch as JSON for people to read: its size and its points."""
    dims = list(dims) if dims is not None else patch_dims(patches)
    head = [F.col("pcid")] if "pcid" in patches.columns else []
    points = F.arrays_zip(*dims).alias("pts")
    return F.to_json(F.struct(*head, F.col("n"), points), {"ignoreNullFields": "false"})


def point_text(point: str) -> Column:
    """A point value (see ``make_point``) as JSON."""
    return F.to_json(F.col(point), {"ignoreNullFields": "false"})


def edit_in_place(patches: DataFrame, dim: str, change) -> DataFrame:
    """Change one dimension of every point where the grouping does not depend on it.

    ``change`` maps a Column to a Column. The stored range and the tiles of the dimension
    follow. For a change that moves points to other groups, explode, change and group again.
    """
    edited = patches.withColumn(dim, F.transform(F.col(dim), change))
    prefix = stat_prefix(dim)
    if f"{prefix}_min" not in patches.columns:
        return edited
    numbers = _array_numbers(edited, dim)
    edited = edited.withColumns(
        {f"{prefix}_min": F.array_min(numbers), f"{prefix}_max": F.array_max(numbers)}
    )
    tiles = {}
    for low, high, size in tile_columns(patches, dim):
        tiles |= {low: tile_of(F.col(f"{prefix}_min"), size), high: tile_of(F.col(f"{prefix}_max"), size)}
    return edited.withColumns(tiles) if tiles else edited
