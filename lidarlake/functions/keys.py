"""Grouping criteria: each builder returns the named key columns of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lidarlake.functions.rounding import round_half_away
from lidarlake.functions.zorder import morton

Key = list[Column]


def snapped(value: Column, step: float) -> Column:
    """``step * round(value / step)``: the centre of the cell that holds ``value``."""
    if step == 1:
        return round_half_away(value)
    return F.lit(step) * round_half_away(value / F.lit(step))


def cell(
    size: float,
    dims: Sequence[str] = ("x", "y", "z"),
    names: Sequence[str] = ("cx", "cy", "cz"),
) -> Key:
    """Cubes of edge ``size`` centred on multiples of it."""
    return [snapped(F.col(d), size).alias(n) for d, n in zip(dims, names, strict=True)]


def cubic_metre() -> Key:
    """Cubes of one metre: cell k holds [k - 1/2, k + 1/2)."""
    return cell(1)


def snap_grid(step_x: float, step_y: float) -> Key:
    """A flat grid with its own step in each direction; height plays no part."""
    return [snapped(F.col("x"), step_x).alias("cx"), snapped(F.col("y"), step_y).alias("cy")]


def time_bin(milliseconds: float, time: str = "gps_time", name: str = "tbin") -> Key:
    """Bins of so many milliseconds of acquisition time, centred on multiples."""
    return [round_half_away(F.lit(1000) * F.col(time) / F.lit(milliseconds)).alias(name)]


def period(seconds: float, time: str = "gps_time", name: str = "tbin") -> Key:
    """Bins of so many seconds of acquisition time, centred on multiples."""
    return [round_half_away(F.col(time) / F.lit(seconds)).alias(name)]


def attribute(dim: str, name: str | None = None, step: float | None = None) -> Key:
    """Equal values of an attribute, or equal bins of it when ``step`` is given.

    With its own name, ``name=dim``, the attribute moves from the points to the key.
    """
    if step is None and name == dim:
        return [F.col(dim)]
    value = F.col(dim) if step is None else snapped(F.col(dim), step)
    return [value.alias(name or f"{dim}_key")]


def per_file(key: Key, source: str = "source_file") -> Key:
    """The same criterion, applied to each input file on its own."""
    return [F.col(source), *key]


def along_curve(cell_size: float = 1.0, x: str = "cx", y: str = "cy") -> Column:
    """Place of a spatial group on a Z-curve over its cell."""
    return morton(F.col(x), F.col(y), cell_size)


def along_time(name: str = "tbin") -> Column:
    """Place of a time bin in time."""
    return F.col(name).try_cast("long")


def key_names(df, key: Key) -> list[str]:
    """Names the key columns take when selected from ``df``."""
    return df.select(*key).columns
