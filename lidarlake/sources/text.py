"""Point text: header-less, one point per line, values separated by one blank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.text import c_number

# C prints a NaN with or without a sign; Spark's parser knows one spelling.
_ANY_NAN = "(?i)[+-]?nan"
_CORRUPT = "_corrupt_record"


def parse_points(
    lines: DataFrame, columns: Sequence[tuple[str, str]], mode: str = "FAILFAST"
) -> DataFrame:
    """Points of a ``value`` column of text lines; columns are bound by position.

    An empty word is a missing value. FAILFAST stops at a line with another count of
    values or one that is not of its type. PERMISSIVE keeps every line: what cannot
    be read is null, and the whole line is then in ``_corrupt_record``.
    """
    fields = [f"`{name}` {kind}" for name, kind in columns]
    if mode == "PERMISSIVE":
        fields.append(f"{_CORRUPT} string")
    elif mode != "FAILFAST":
        raise ValueError("mode is FAILFAST or PERMISSIVE")
    options = {"sep": " ", "nanValue": "nan", "mode": mode, "columnNameOfCorruptRecord": _CORRUPT}
    plain = F.regexp_replace("value", _ANY_NAN, "nan")
    return lines.select(F.from_csv(plain, ", ".join(fields), options).alias("p")).select("p.*")


def read_points_text(
    spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], mode: str = "FAILFAST"
) -> DataFrame:
    """Read a folder or file of point text."""
    return parse_points(spark.read.text(path), columns, mode)


def read_points_text_stream(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str]],
    files_per_batch: int = 100,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Follow a folder in which files of point text arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_points(lines, columns, mode)


def point_lines(points: DataFrame, style: str = "shortest") -> DataFrame:
    """One ``value`` per point: its columns in order, separated by one blank.

    ``shortest`` writes the shortest decimal that reads back to the same number.
    ``c`` writes floats with 8 and doubles with 16 significant digits, as C's %g does.
    """
    words = []
    for field in points.schema:
        column = F.col(field.name)
        if style == "c" and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            word = c_number(column, 8 if isinstance(field.dataType, T.FloatType) else 16)
        elif style in ("c", "shortest"):
            word = column.cast("string")
        else:
            raise ValueError("style is 'shortest' or 'c'")
        words.append(F.coalesce(word, F.lit("")))
    return points.select(F.concat_ws(" ", *words).alias("value"))


def write_points_text(
    points: DataFrame, path: str, style: str = "shortest", mode: str = "error"
) -> None:
    """Export points as text files."""
    point_lines(points, style).write.mode(mode).text(path)
