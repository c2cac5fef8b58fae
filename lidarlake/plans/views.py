"""The given tables read as point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.functions.times import epoch_seconds

POINT_DIMS = ("gps_time", "x", "y", "z", "num_echo", "fiber", "echo_range", "source_file")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense cloud from ``lineitem``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        epoch_seconds(F.col("l_shipdate")).alias("gps_time"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / F.lit(10000)).alias("y"),
        (F.col("l_discount") * F.lit(10)).alias("z"),
        F.col("l_linenumber").alias("num_echo"),
        F.col("l_suppkey").alias("fiber"),
        F.col("l_tax").alias("echo_range"),
        F.concat("l_returnflag", "l_linestatus").alias("source_file"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse cloud from ``events``."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        "event_id",
        epoch_seconds(F.col("ts")).alias("gps_time"),
        F.col("value").alias("x"),
        F.col("user_id").cast("double").alias("y"),
        ((F.col("event_id") % 100).cast("double") / F.lit(10)).alias("z"),
    )


def areas(spark: SparkSession) -> DataFrame:
    """Three discs to ask for."""
    return spark.sql(
        """SELECT * FROM VALUES (1, 25D, 5D, 2D), (2, 10D, 1D, 1.5D), (3, 40D, 4D, 3D)
           AS areas(area_id, cx, cy, r)"""
    )


def windows(spark: SparkSession) -> DataFrame:
    """Three time windows to ask for: a year, a week, and one before all points."""
    return spark.sql(
        """SELECT * FROM VALUES (1, 883612800D, 915148800D), (2, 915148800D, 915753600D),
           (3, 0D, 1D) AS windows(win_id, lo, hi)"""
    )


def part_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc for each part: most are small, a few cover much of the cloud, some are points."""
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("area_id"),
        F.col("p_size").cast("double").alias("cx"),
        (key % 1000 / F.lit(100.0)).alias("cy"),
        F.when(key % 400 == 0, F.lit(3.0)).otherwise(key % 7 / F.lit(50.0)).alias("r"),
    )


#: Corners of each supplier's polygon, in units of its size around its middle: an outline with a notch, and a hole.
OUTLINE = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.0), (-1.0, 1.0)]
HOLE = [(-0.5, -0.75), (0.5, -0.75), (0.5, -0.25), (-0.5, -0.25)]


def supplier_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concave polygon with a hole for each supplier, of five sizes; many have corners on points."""
    key = F.col("s_suppkey")
    x, y, size = (key % 50).cast("double"), (key % 21) / F.lit(2.0), (1 + key % 5) / F.lit(4.0)

    def ring(corners):
        return F.array(*[F.struct((x + F.lit(a) * size).alias("x"), (y + F.lit(b) * size).alias("y")) for a, b in corners])

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        key.alias("poly_id"), F.array(ring(OUTLINE), ring(HOLE)).alias("rings")
    )


def customer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time window for each customer: days, nested in a few windows of years; some are empty."""
    key = F.col("c_custkey")
    lo = F.lit(788918400) + key % 500 * 432000
    days = F.when(key % 100 == 0, F.lit(700)).otherwise(key % 5)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("win_id"), lo.cast("double").alias("lo"), (lo + days * 86400).cast("double").alias("hi")
    )
