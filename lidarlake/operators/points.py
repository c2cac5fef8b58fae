"""Points against a declared schema: naming, values, quantising, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.rounding import round_half_away
from lidarlake.sources.schemas import Dimension, PointSchema

Bounds = Mapping[str, tuple[float | None, float | None]]

# The ranges of the IEEE types.
_FLOAT_MAX = 3.4028234663852886e38
_DOUBLE_MAX = 1.7976931348623157e308


def attach_schema(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Bind columns to ``(name, type)`` pairs by position, whatever they were called."""
    if len(df.columns) != len(columns):
        raise ValueError(f"{len(df.columns)} columns for {len(columns)} dimensions")
    renamed = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return renamed.select(
        *[F.col(f"_{i}").cast(kind).alias(name) for i, (name, kind) in enumerate(columns)]
    )


def make_point(schema: PointSchema, values: Column | None = None) -> Column:
    """A point value: a struct with the dimensions in schema order.

    Takes the columns of the same names, or the items of an array of doubles.
    """
    if values is None:
        return F.struct(*[F.col(d.name).alias(d.name) for d in schema.dimensions])
    return F.struct(
        *[F.element_at(values, d.position).alias(d.name) for d in schema.dimensions]
    )


def get_attribute(point: str, dim: str) -> Column:
    """One dimension of a point value; the case of the name does not matter."""
    return F.col(f"{point}.{dim}")


def quantise(value: Column, scale: float, offset: float = 0.0) -> Column:
    """The value as stored under ``scale`` and ``offset`` and read back (ties away from 0)."""
    scale_, offset_ = F.lit(float(scale)), F.lit(float(offset))
    return offset_ + scale_ * round_half_away((value - offset_) / scale_)


def quantise_points(df: DataFrame, schema: PointSchema) -> DataFrame:
    """Quantise every dimension of the schema that the points have."""
    present = {c.lower() for c in df.columns}
    return df.withColumns(
        {
            d.name: quantise(F.col(d.name), d.scale, d.offset).cast(df.schema[_match(df, d)].dataType)
            for d in schema.dimensions
            if d.name.lower() in present
        }
    )


def _match(df: DataFrame, dim: Dimension) -> str:
    return next(c for c in df.columns if c.lower() == dim.name.lower())


def georeference(value: Column, offset: float) -> Column:
    """From the file's local coordinate to the absolute one."""
    return value + F.lit(float(offset))


def georeference_points(df: DataFrame, schema: PointSchema) -> DataFrame:
    """Shift every dimension that the schema gives an offset. Never done by itself."""
    present = {c.lower() for c in df.columns}
    shifted = {
        _match(df, d): georeference(F.col(d.name).cast("double"), d.offset)
        for d in schema.dimensions
        if d.offset and d.name.lower() in present
    }
    return df.withColumns(shifted) if shifted else df


def type_bounds(schema: PointSchema) -> Bounds:
    """The real values that fit the storage type of each dimension.

    The interpretation decides, and for whole numbers the size in bytes.
    """
    bounds = {}
    for d in schema.dimensions:
        kind = d.interpretation.lower()
        if kind == "double":
            bounds[d.name] = (-_DOUBLE_MAX, _DOUBLE_MAX)
        elif kind == "float":
            bounds[d.name] = (-_FLOAT_MAX, _FLOAT_MAX)
        elif kind.startswith("u"):
            bounds[d.name] = _scaled(d, 0, 2 ** (8 * d.size) - 1)
        else:
            bounds[d.name] = _scaled(d, -(2 ** (8 * d.size - 1)), 2 ** (8 * d.size - 1) - 1)
    return bounds


def _scaled(d: Dimension, lo: int, hi: int) -> tuple[float, float]:
    return lo * d.scale + d.offset, hi * d.scale + d.offset


def _floating(df: DataFrame, dim: str) -> bool:
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    return isinstance(kinds[dim.lower()], (T.DoubleType, T.FloatType))


def _outside(df: DataFrame, dim: str, lo: float | None, hi: float | None) -> Column:
    value = F.col(dim)
    test = F.lit(False)
    if lo is not None:
        test = test | (value < F.lit(lo))
    if hi is not None:
        test = test | (value > F.lit(hi))
    if _floating(df, dim):
        test = test & ~F.isnan(value)
    return F.coalesce(test, F.lit(False))


def validate(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Per dimension: values out of range, NaN and null, in one pass. NaN is in range."""
    rows = [
        F.struct(F.lit(dim).alias("dim"), *[F.col(f"_{i}.{c}").alias(c) for c in ("out_of_range", "nans", "nulls")])
        for i, dim in enumerate(bounds)
    ]
    judged = [judgement(df, dim, lo, hi).alias(f"_{i}") for i, (dim, (lo, hi)) in enumerate(bounds.items())]
    return df.agg(*judged).select(F.inline(F.array(*rows)))


def judgement(df: DataFrame, dim: str, lo: float | None, hi: float | None) -> Column:
    """The aggregate ``out_of_range, nans, nulls`` of a dimension."""
    nans = F.count_if(F.isnan(dim)) if _floating(df, dim) else F.lit(0).cast("long")
    outside = F.count_if(_outside(df, dim, lo, hi)).alias("out_of_range")
    return F.struct(outside, nans.alias("nans"), F.count_if(F.col(dim).isNull()).alias("nulls"))


def misfit(df: DataFrame, bounds: Bounds) -> Column:
    """Whether any dimension of the point is out of its range."""
    test = F.lit(False)
    for dim, (lo, hi) in bounds.items():
        test = test | _outside(df, dim, lo, hi)
    return test


def split_valid(df: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """The points that fit, and those that do not."""
    bad = misfit(df, bounds)
    return df.where(~bad), df.where(bad)


def require_valid(df: DataFrame, bounds: Bounds) -> DataFrame:
    """The same points; the job fails at the first one that does not fit."""
    message = F.concat(F.lit("point out of range: "), F.to_json(F.struct(*bounds)))
    return df.where(F.when(misfit(df, bounds), F.raise_error(message)).otherwise(F.lit(True)))
