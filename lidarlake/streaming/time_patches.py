"""Time patches of a stream: partial patches per batch, made whole when they are read.

No point is ever too late. Each micro-batch groups its points and adds what it has of
every bin as partial patches; a bin that goes on, or gets late points, has several. Reading merges
them: sums and ranges need no points at all, and only bins with several parts are
built again. ``compact`` does that once for good, so readers find whole patches.

A table is a folder of ``parts/load=<id>/batch_id=<n>`` and ``whole/<generation>``.
``state/<generation>`` names the batches that a generation contains; a reader takes the newest
one and all batches after it. Compaction writes a new generation beside the old and commits it by
the rename of its state, so readers and streams go on meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lidarlake.functions.keys import time_bin
from lidarlake.functions.times import to_timestamp
from lidarlake.operators.grouping import HEAVY_LIMIT, MAX_POINTS, build_patches
from lidarlake.operators.layout import write_patches
from lidarlake.operators.patch import STAT_DIMS, explode_patches, patch_dims, patch_keys, range_aggregates
from lidarlake.session import fresh_path, stage
from lidarlake.sources.files import children, path_exists, read_text, rename_into
from lidarlake.streaming.load import load_patches

NAME = "tbin"


def time_patches(
    points: DataFrame,
    milliseconds: float,
    path: str,
    checkpoint: str,
    once: bool = False,
    time: str = "gps_time",
    **options,
) -> StreamingQuery:
    """Add every micro-batch to the table at ``path`` as partial patches of time bins.

    Options are those of ``build_patches``. A batch that runs again replaces what it left; several
    streams may fill one table.
    """
    return load_patches(points, time_bin(milliseconds, time, NAME), f"{path}/parts", checkpoint, once=once, **options)


def _state(spark: SparkSession, path: str) -> tuple[int, dict[str, int], str | None]:
    """Newest generation, the last batch of each load it contains, and its folder."""
    numbers = [int(name) for name in children(spark, f"{path}/state") if name.isdigit()]
    if not numbers:
        return 0, {}, None
    told = json.loads(read_text(spark, f"{path}/state/{max(numbers)}"))
    return max(numbers), told["through"], told["whole"] and f"{path}/{told['whole']}"


def _batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The finished batches of each load."""
    found = {}
    for load in children(spark, f"{path}/parts"):
        if load.startswith("load="):
            names = [b for b in children(spark, f"{path}/parts/{load}") if b.startswith("batch_id=")]
            done = [b for b in names if path_exists(spark, f"{path}/parts/{load}/{b}/_SUCCESS")]
            found[load] = sorted(int(b.removeprefix("batch_id=")) for b in done)
    return found


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All patches of the table as they are stored: a bin may have several parts."""
    _, through, whole = _state(spark, path)
    folders = [whole] if whole else []
    for load, batches in _batches(spark, path).items():
        folders += [f"{path}/parts/{load}/batch_id={b}" for b in batches if b > through.get(load, -1)]
    if not folders:
        raise ValueError(f"{path} holds no batches yet")
    return spark.read.parquet(*folders)


def bin_stats(patches: DataFrame) -> DataFrame:
    """Key, ``n`` and stored ranges of each group, from all its parts; no array is read."""
    names = [k for k in patch_keys(patches) if k != "chunk"]
    ends = {c: F.min if c.endswith("_min") else F.max for c in patches.columns if c.endswith(("_min", "_max"))}
    merged = [F.sum("n").alias("n"), *[f(c).alias(c) for c, f in ends.items()]]
    return patches.groupBy(*names).agg(*merged)


def merge_parts(patches: DataFrame, max_points: int = MAX_POINTS, **options) -> DataFrame:
    """Whole patches: each group as if all its points had been grouped at once.

    A group that was built once has its chunks numbered without gaps or repeats and stays as it is. The
    points of all others are grouped again. Only key columns are looked at to tell them apart.
    """
    names = [k for k in patch_keys(patches) if k != "chunk"]
    rows = F.count(F.lit(1))
    open_ = patches.groupBy(*names).agg(rows.alias("_rows"), F.max("chunk").alias("_last")).where("_rows <> _last + 1")
    open_ = stage(open_.select(*[F.col(c).alias(f"_o_{c}") for c in names]), "open-bins")
    count = open_.count()
    if not count:
        return patches
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_o_{name}"))
    listed = F.broadcast(open_) if count <= HEAVY_LIMIT else open_.hint("merge")
    groups = [n for n in names if n != "pcid"]
    points = explode_patches(patches.join(listed, same, "left_semi"), patch_dims(patches), names)
    tag = F.first("pcid")  # one table holds one point schema
    pcid = points.agg(tag).first()[0] if "pcid" in names else None
    rebuilt = build_patches(
        points.drop("pcid"), [F.col(n) for n in groups], dims=patch_dims(patches), max_points=max_points, pcid=pcid, **options
    )
    return patches.join(listed, same, "left_anti").unionByName(rebuilt.select(patches.columns))


def read_time_patches(spark: SparkSession, path: str, **options) -> DataFrame:
    """The whole patches of all points that the streams have stored so far."""
    return merge_parts(read_parts(spark, path), **options)


def compact(spark: SparkSession, path: str, **options) -> int:
    """Store whole patches of all finished batches as a new generation; its number.

    Batches that finish meanwhile stay parts. Of two compactions at once, one fails and
    changes nothing. What older generations and merged batches hold is left in place for those who
    still read it, and may be deleted later.
    """
    number, _, _ = _state(spark, path)
    through = {load: batches[-1] for load, batches in _batches(spark, path).items() if batches}
    whole = f"whole/{number + 1}-{fresh_path(spark, 'g').rpartition('-')[2]}"
    write_patches(read_time_patches(spark, path, **options), f"{path}/{whole}")
    rename_into(spark, json.dumps({"through": through, "whole": whole}), f"{path}/state/{number + 1}")
    return number + 1


def time_bins(
    points: DataFrame,
    milliseconds: int,
    delay: str,
    time: str = "gps_time",
    stats: Sequence[str] = STAT_DIMS,
) -> DataFrame:
    """``tbin``, ``n`` and ranges of each bin as the watermark closes it, centred as in ``keys.time_bin``.

    Spark's windows start at multiples of their length, so they are moved by half a
    bin. Bins are emitted once the stream is ``delay`` past their end, and later
    points are lost: this is for live figures. ``time_patches`` keeps every point. Batches too
    are exact, and there nothing is late.
    """
    half = f"{milliseconds * 500} microseconds"
    window = F.window("_ts", f"{milliseconds} milliseconds", startTime=half)
    grouped = (
        points.withColumn("_ts", to_timestamp(F.col(time)))
        .withWatermark("_ts", delay)
        .groupBy(window.alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), *range_aggregates(points, stats))
    )
    centre = F.unix_micros("_w.start") + F.lit(milliseconds * 500)
    tbin = (centre / F.lit(milliseconds * 1000)).cast("double").alias("tbin")
    return grouped.select(tbin, *[c for c in grouped.columns if c != "_w"])
