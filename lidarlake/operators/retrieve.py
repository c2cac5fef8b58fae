"""Two-phase retrieval: candidate patches by their ranges, then exact points.

A criterion states itself twice: ``on_patch`` over the stored ranges, as plain
comparisons that reach the Parquet scan, and ``on_point`` over the points. The
second implies the first, so the result never depends on how points are grouped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.operators.patch import explode_patches, patch_max, patch_min, tile_columns

BOUNDS = ("[)", "[]", "(]", "()")


@dataclass(frozen=True)
class Span:
    """Values of one dimension between ``lo`` and ``hi``; None leaves a side open.

    ``bounds`` says which ends belong to it, as in ``"[)"``.
    """

    dim: str
    lo: float | None = None
    hi: float | None = None
    bounds: str = "[)"

    def __post_init__(self):
        if self.bounds not in BOUNDS:
            raise ValueError(f"bounds must be one of {BOUNDS}")
        if self.lo is not None and self.hi is not None and self.lo > self.hi:
            raise ValueError("lower bound above upper bound")

    @property
    def dims(self) -> list[str]:
        return [self.dim]

    @property
    def _empty(self) -> bool:
        return self.lo is not None and self.lo == self.hi and self.bounds != "[]"

    def _within(self, least: Column, most: Column) -> Column:
        if self._empty:
            return F.lit(False)
        tests = []
        if self.lo is not None:
            low = F.lit(self.lo)
            tests.append(most >= low if self.bounds[0] == "[" else most > low)
        if self.hi is not None:
            high = F.lit(self.hi)
            tests.append(least <= high if self.bounds[1] == "]" else least < high)
        return _all(tests)

    def on_patch(self, patches: DataFrame) -> Column:
        near = self._within(patch_min(patches, self.dim), patch_max(patches, self.dim))
        return near & _in_tiles(patches, self.dim, self.lo, self.hi)

    def on_point(self) -> Column:
        value = F.col(self.dim)
        # NaN sorts above every number in Spark, and lies in no range.
        return self._within(value, value) & ~F.isnan(value)


@dataclass(frozen=True)
class Disc:
    """Places within ``r`` of (x, y), in the plane; the edge belongs to it."""

    x: float
    y: float
    r: float

    dims = ("x", "y")

    def on_patch(self, patches: DataFrame) -> Column:
        x_min, x_max = patch_min(patches, "x"), patch_max(patches, "x")
        y_min, y_max = patch_min(patches, "y"), patch_max(patches, "y")
        dx = F.greatest(x_min - F.lit(self.x), F.lit(0.0), F.lit(self.x) - x_max)
        dy = F.greatest(y_min - F.lit(self.y), F.lit(0.0), F.lit(self.y) - y_max)
        # The box tests follow from the distance test; only they can prune files.
        # They are wider by a hair, since subtraction rounds.
        reach = self.r + 1e-9 * (abs(self.x) + abs(self.y) + self.r)
        return (
            (x_min <= F.lit(self.x + reach))
            & (x_max >= F.lit(self.x - reach))
            & (y_min <= F.lit(self.y + reach))
            & (y_max >= F.lit(self.y - reach))
            & (dx * dx + dy * dy <= F.lit(self.r * self.r))
            & _in_tiles(patches, "x", self.x - reach, self.x + reach)
            & _in_tiles(patches, "y", self.y - reach, self.y + reach)
        )

    def on_point(self) -> Column:
        dx, dy = F.col("x") - F.lit(self.x), F.col("y") - F.lit(self.y)
        return dx * dx + dy * dy <= F.lit(self.r * self.r)


@dataclass(frozen=True)
class Ball:
    """Places within ``r`` of (x, y, z)."""

    x: float
    y: float
    z: float
    r: float

    dims = ("x", "y", "z")

    def on_patch(self, patches: DataFrame) -> Column:
        reach = self.r + 1e-9 * (abs(self.z) + self.r)
        height = Span("z", self.z - reach, self.z + reach, "[]")
        return Disc(self.x, self.y, self.r).on_patch(patches) & height.on_patch(patches)

    def on_point(self) -> Column:
        dx, dy = F.col("x") - F.lit(self.x), F.col("y") - F.lit(self.y)
        dz = F.col("z") - F.lit(self.z)
        return dx * dx + dy * dy + dz * dz <= F.lit(self.r * self.r)


@dataclass(frozen=True)
class Box:
    """Places in a rectangle, edges included."""

    x_lo: float
    x_hi: float
    y_lo: float
    y_hi: float

    dims = ("x", "y")

    def _spans(self) -> list[Span]:
        return [Span("x", self.x_lo, self.x_hi, "[]"), Span("y", self.y_lo, self.y_hi, "[]")]

    def on_patch(self, patches: DataFrame) -> Column:
        return _all([s.on_patch(patches) for s in self._spans()])

    def on_point(self) -> Column:
        return _all([s.on_point() for s in self._spans()])


Criterion = Span | Disc | Ball | Box


def _in_tiles(patches: DataFrame, dim: str, lo: float | None, hi: float | None) -> Column:
    """What the range means for the folders of a tiled table."""
    tests = []
    for low, high, size in tile_columns(patches, dim):
        if hi is not None and math.isfinite(hi):
            tests.append(F.col(low) <= math.floor(hi / size))
        if lo is not None and math.isfinite(lo):
            tests.append(F.col(high) >= math.floor(lo / size))
    return _all(tests)


def _all(tests: Sequence[Column]) -> Column:
    whole = F.lit(True)
    for test in tests:
        whole = whole & test
    return whole


def candidates(patches: DataFrame, *criteria: Criterion) -> DataFrame:
    """Patches that may hold points of all the criteria; arrays stay unread."""
    return patches.where(_all([c.on_patch(patches) for c in criteria]))


def matching_points(points: DataFrame, *criteria: Criterion) -> DataFrame:
    """Points that meet all the criteria."""
    return points.where(_all([c.on_point() for c in criteria]))


def retrieve(
    patches: DataFrame,
    *criteria: Criterion,
    dims: Sequence[str],
    keep: Sequence[str] = (),
    precision: str = "point",
) -> DataFrame:
    """Points of the candidate patches.

    ``precision="point"`` tests each point as well; ``"patch"`` returns every point
    of a candidate. Arrays outside ``dims`` and the criteria are not read.
    """
    found = candidates(patches, *criteria)
    if precision == "patch":
        return explode_patches(found, dims, keep)
    if precision != "point":
        raise ValueError("precision is 'point' or 'patch'")
    tested = [d for c in criteria for d in c.dims if d not in keep]
    needed = list(dict.fromkeys([*dims, *tested]))
    exact = matching_points(explode_patches(found, needed, keep), *criteria)
    return exact.select(*keep, *dims)


def first_rows(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """The first ``count`` rows of an order, for a look at the data."""
    return df.orderBy(*order).limit(count)
