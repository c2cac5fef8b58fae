"""Tables and files that the queries first load, as a user would, and then ask.

Each is written once per Spark application and folder of given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake import session
from lidarlake.functions.keys import along_curve, along_time, cubic_metre, period
from lidarlake.operators.grouping import build_patches
from lidarlake.operators.layout import read_patches, write_patches
from lidarlake.plans.views import events, points
from lidarlake.session import fresh_path
from lidarlake.sources import ply
from lidarlake.sources.text import write_points_text

WEEK = 604800

_written: dict[tuple, str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The path under which ``write`` has left its output."""
    place = (spark.sparkContext.applicationId, session.generation, sf_dir, name)
    if place not in _written:
        path = fresh_path(spark, name)
        write(path)
        _written[place] = path
    return _written[place]


def cube_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud in cubic-metre patches, laid out by place."""

    def write(path: str) -> None:
        cloud = points(spark, sf_dir)
        write_patches(build_patches(cloud, cubic_metre(), pcid=2, place=along_curve()), path)

    return read_patches(spark, once(spark, sf_dir, "cubes", write))


def week_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud in weekly patches, laid out by time."""

    def write(path: str) -> None:
        cloud = points(spark, sf_dir)
        write_patches(build_patches(cloud, period(WEEK), pcid=2, place=along_time()), path)

    return read_patches(spark, once(spark, sf_dir, "weeks", write))


def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric columns of the cloud, in types that a point file can hold."""
    cloud = points(spark, sf_dir)
    return cloud.select(
        "gps_time", "x", "y", "z", "num_echo", F.col("fiber").cast("int"), "echo_range"
    )


def ply_folder(spark: SparkSession, sf_dir: str) -> str:
    """The cloud as a folder of PLY files."""
    ply.register(spark)

    def write(path: str) -> None:
        file_points(spark, sf_dir).write.format("ply").mode("append").save(path)

    return once(spark, sf_dir, "ply", write)


def encoded_folder(spark: SparkSession, sf_dir: str, encoding: str) -> str:
    """The cloud as PLY files of another encoding."""
    ply.register(spark)

    def write(path: str) -> None:
        cloud = file_points(spark, sf_dir)
        cloud.write.format("ply").option("encoding", encoding).mode("append").save(path)

    return once(spark, sf_dir, f"ply-{encoding}", write)


def mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """The cloud as PLY files of two makers: one keeps float32 and 16 bits where the other has more, and no range.

    Points whose fiber needs more than its 16 bits it keeps in files with 32.
    """
    ply.register(spark)

    def write(path: str) -> None:
        cloud = file_points(spark, sf_dir).select("gps_time", "x", "num_echo", "fiber", "echo_range")
        first = cloud.where("num_echo % 2 = 1")
        second = cloud.where("num_echo % 2 = 0").select("gps_time", F.col("x").cast("float"), "num_echo", "fiber")
        # A missing fiber stays with the narrow ones, where the sink refuses it.
        wide = F.coalesce(~F.col("fiber").between(-(1 << 15), (1 << 15) - 1), F.lit(False))
        narrow = second.where(~wide).withColumn("fiber", F.col("fiber").cast("smallint"))
        for part in (first, narrow, second.where(wide)):
            part.write.format("ply").mode("append").save(path)

    return once(spark, sf_dir, "ply-mixed", write)


def list_folder(spark: SparkSession, sf_dir: str) -> str:
    """Cubes as PLY records with lists: one record per patch."""
    ply.register(spark)

    def write(path: str) -> None:
        cubes = cube_patches(spark, sf_dir)
        rows = cubes.select("cx", "cy", "cz", F.col("n").cast("int").alias("n"), "gps_time", "x", "num_echo")
        rows.write.format("ply").option("element", "patch").option("encoding", "binary_big_endian").mode("append").save(path)

    return once(spark, sf_dir, "ply-lists", write)


def text_folder(spark: SparkSession, sf_dir: str) -> str:
    """The cloud as a folder of point text."""
    return once(
        spark, sf_dir, "text", lambda path: write_points_text(file_points(spark, sf_dir), path)
    )


def landing_folder(spark: SparkSession, sf_dir: str, cloud: str) -> str:
    """A cloud as Parquet files, as if they had just arrived; disordered ones hold each hour in part."""

    def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir).repartition(4, F.col("event_id") % 4)

    view = {"points": points, "disordered": disordered}[cloud]
    return once(
        spark, sf_dir, f"landing-{cloud}", lambda path: view(spark, sf_dir).write.parquet(path)
    )
