"""Acquisition time: a double in seconds, never tied to the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ wall-clock value, as double.

    A cast to TIMESTAMP moves the value by the offset of the session's zone. Offsets are
    whole seconds, so the cast is right for the fraction; ``unix_timestamp`` takes the
    whole seconds of the wall clock itself, cut off towards 1970.
    """
    fraction = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(_SECOND))
    cut_up = (ts < F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) & (fraction > 0)
    whole = F.unix_timestamp(ts) - F.when(cut_up, F.lit(1)).otherwise(F.lit(0))
    return (whole * F.lit(_SECOND) + fraction) / F.lit(1e6)


def to_timestamp(seconds: Column) -> Column:
    """TIMESTAMP of a double in seconds, to the microsecond."""
    return F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("long"))
