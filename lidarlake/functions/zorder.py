"""Z-order number of a 2-D grid cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells are counted from the middle of a 31-bit range, so negative ones fit.
_MIDDLE = 1 << 30
_SPREAD_STEPS = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread(value: Column) -> Column:
    for shift, mask in _SPREAD_STEPS:
        value = F.shiftleft(value, shift).bitwiseOR(value).bitwiseAND(F.lit(mask))
    return value


def morton(x: Column, y: Column, cell: float) -> Column:
    """Interleave the bits of the cell numbers of ``x`` and ``y``.

    Cells beyond ±2^30 share the outermost number; rows without a coordinate get null.
    """

    def number(v: Column) -> Column:
        index = F.floor(v / F.lit(float(cell))).cast("long")
        inside = F.least(F.greatest(index, F.lit(-_MIDDLE)), F.lit(_MIDDLE - 1))
        return F.when(v.isNotNull() & ~F.isnan(v), inside + F.lit(_MIDDLE))

    return _spread(number(x)).bitwiseOR(F.shiftleft(_spread(number(y)), 1))
