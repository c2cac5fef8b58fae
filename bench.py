"""Headline timings: build a patch table, ask it, read it back. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lidarlake.functions import keys  # noqa: E402
from lidarlake.operators import grouping, joins, layout, patch, report, retrieve  # noqa: E402
from lidarlake.plans import catalogue, stored  # noqa: E402
from lidarlake.plans.views import areas, points, windows  # noqa: E402
from lidarlake.session import fresh_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 5


def drain(df: DataFrame) -> None:
    """Compute every column of every row, and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lidarlake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cloud = points(spark, SF_DIR)
    total = cloud.count()
    cubes = stored.cube_patches(spark, SF_DIR)
    weeks = stored.week_patches(spark, SF_DIR)
    # The same cubes in no particular order, to show what the layout is worth.
    loose_path = fresh_path(spark, "loose")
    cubes.orderBy(F.xxhash64("cx", "cy", "cz")).write.parquet(loose_path)
    loose = layout.read_patches(spark, loose_path)
    disc, week, year = catalogue.DISC, catalogue.ONE_WEEK, catalogue.YEAR_1998
    dims = catalogue.XYZT
    everything = patch.patch_dims(cubes)

    files = spark.read.format("ply").option("splitBytes", str(4 << 20)).load(stored.ply_folder(spark, SF_DIR))

    def build(key, place=None, source=cloud):
        built = grouping.build_patches(source, key, pcid=2, place=place)
        layout.write_patches(built, fresh_path(spark, "bench"))

    work = {
        "import_cubes": lambda: build(keys.cubic_metre()),
        "import_cubes_laid_out": lambda: build(keys.cubic_metre(), keys.along_curve()),
        "import_ply": lambda: build(keys.cubic_metre(), source=files),
        "import_ply_laid_out": lambda: build(keys.cubic_metre(), keys.along_curve(), files),
        "import_weeks_laid_out": lambda: build(keys.period(stored.WEEK), keys.along_time()),
        "build_capped": lambda: drain(
            grouping.build_patches(cloud, keys.cubic_metre(), max_points=300)
        ),
        "group_m3": lambda: drain(grouping.group_stats(cloud, keys.cubic_metre())),
        "group_multiscale": lambda: drain(catalogue.group_multiscale(spark, SF_DIR)),
        "explode_all": lambda: drain(patch.explode_patches(cubes, everything)),
        "retrieve_time": lambda: drain(retrieve.retrieve(weeks, week, dims=dims)),
        "retrieve_disc": lambda: drain(retrieve.retrieve(cubes, disc, dims=dims)),
        "retrieve_disc_unclustered": lambda: drain(retrieve.retrieve(loose, disc, dims=dims)),
        "retrieve_disc_patch": lambda: drain(
            retrieve.retrieve(cubes, disc, dims=dims, precision="patch")
        ),
        "retrieve_space_time": lambda: drain(retrieve.retrieve(cubes, disc, year, dims=dims)),
        "area_join": lambda: drain(joins.area_points(cubes, areas(spark), dims)),
        "time_window_join": lambda: drain(joins.window_points(weeks, windows(spark), dims)),
        "area_join_parts": lambda: drain(catalogue.area_join(spark, SF_DIR)),
        "polygon_join": lambda: drain(catalogue.polygon_join(spark, SF_DIR)),
        "multiscale_levels": lambda: drain(catalogue.multiscale_levels(spark, SF_DIR)),
        "ply_list_read": lambda: drain(catalogue.ply_list_read(spark, SF_DIR)),
        "patch_summary": lambda: drain(report.patch_summary(cubes)),
        "row_ids": lambda: drain(catalogue.row_ids(spark, SF_DIR)),
        "ply_read": lambda: drain(catalogue.ply_read(spark, SF_DIR)),
        "text_read": lambda: drain(catalogue.text_points(spark, SF_DIR)),
    }
    seconds = {}
    for name, run in work.items():
        times = []
        # The first run pays for compilation and caches of the JVM.
        for _ in range(REPEATS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    pruned = catalogue.pruning_report_disc(spark, SF_DIR).first()
    profile = report.patch_size_profile(cubes).first()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "points": total,
        "import_points_per_sec": round(total / seconds["import_cubes"]),
        "import_ply_points_per_sec": round(total / seconds["import_ply"]),
        "output_points_per_sec": round(total / seconds["explode_all"]),
        "points_read_per_returned": round(pruned.points_read / max(pruned.points_returned, 1), 3),
        "points_per_patch_median": profile.p50,
        "points_per_patch_largest": profile.largest,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
