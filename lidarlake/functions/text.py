"""Text forms of numbers and geometries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def c_number(value: Column, digits: int) -> Column:
    """C's ``%.<digits>g``: 8 for float32, 16 for float64."""
    pattern = f"%.{digits}g"

    @F.pandas_udf("string")
    def formatted(numbers: pd.Series) -> pd.Series:
        text = pd.Series(np.char.mod(pattern, numbers.to_numpy(dtype="float64", na_value=np.nan)))
        text.index = numbers.index
        return text

    return F.when(value.isNotNull(), formatted(value.cast("double")))


def fixed(value: Column, decimals: int | None) -> Column:
    """Number as text: shortest exact form, or with a fixed count of decimals."""
    if decimals is None:
        return value.cast("string")
    return value.cast(f"decimal(38,{decimals})").cast("string")


def wkt_point(x: Column, y: Column, z: Column, decimals: int | None = None) -> Column:
    """``POINT Z (x y z)``."""
    spaced = F.concat_ws(" ", *[fixed(v, decimals) for v in (x, y, z)])
    return F.concat(F.lit("POINT Z ("), spaced, F.lit(")"))


def wkt_box(
    x_min: Column, y_min: Column, x_max: Column, y_max: Column, decimals: int | None = None
) -> Column:
    """The box as a closed ``POLYGON`` ring."""
    x0, y0, x1, y1 = (fixed(v, decimals) for v in (x_min, y_min, x_max, y_max))
    corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    ring = F.concat_ws(",", *[F.concat_ws(" ", x, y) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))
