"""The predicates of retrieval for users who write SQL.

They are SQL functions, so Catalyst sees through them: ranges still reach the scan.
Points come out of patches with ``LATERAL VIEW inline(arrays_zip(gps_time, x, …))``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(arguments) -> expression
_FUNCTIONS = {
    # A closed range and [a, b) have a value in common.
    "range_overlaps(lo DOUBLE, hi DOUBLE, a DOUBLE, b DOUBLE)": "lo < b AND hi >= a AND a < b",
    # A value lies in [a, b).
    "in_range(v DOUBLE, a DOUBLE, b DOUBLE)": "v >= a AND v < b AND NOT isnan(v)",
    # A box comes within r of (cx, cy). The first four tests are there to prune.
    "box_near(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, cx DOUBLE, cy DOUBLE, r DOUBLE)": """
        x0 <= cx + r + 1e-9D * (abs(cx) + r) AND x1 >= cx - r - 1e-9D * (abs(cx) + r)
        AND y0 <= cy + r + 1e-9D * (abs(cy) + r) AND y1 >= cy - r - 1e-9D * (abs(cy) + r)
        AND greatest(x0 - cx, 0D, cx - x1) * greatest(x0 - cx, 0D, cx - x1)
          + greatest(y0 - cy, 0D, cy - y1) * greatest(y0 - cy, 0D, cy - y1) <= r * r""",
    # A point lies within r of (cx, cy).
    "point_near(x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE, r DOUBLE)": """
        (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r""",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for signature, expression in _FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS BOOLEAN RETURN {expression}"
        )
