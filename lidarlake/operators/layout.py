"""How a patch table is laid out, and how well the layout prunes."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.functions.zorder import morton
from lidarlake.operators.grouping import Stretches
from lidarlake.operators.patch import explode_patches, patch_keys, stat_prefix, tile_of, tile_size
from lidarlake.operators.retrieve import Criterion, candidates, matching_points
from lidarlake.session import stage
from lidarlake.sources.files import path_exists


_STEPS = 1 << 40


def cluster_by_space(patches: DataFrame, cell: float = 1.0, files: int | None = None) -> DataFrame:
    """Order patches along a Z-curve of their box centres.

    Many patches may share a place, so time and key go on dividing where the
    Z-number does not, and no file has to take all of one place.
    """
    centre_x = (F.col("x_min") + F.col("x_max")) / 2
    centre_y = (F.col("y_min") + F.col("y_max")) / 2
    return _laid_along(patches, morton(centre_x, centre_y, cell), ["t_min"], files)


def cluster_by_range(patches: DataFrame, dim: str = "t", files: int | None = None) -> DataFrame:
    """Order patches by the low end of one range, acquisition time by default."""
    low = F.col(f"{dim}_min").cast("double")
    finite = ~F.isnan(low) & (F.abs(low) < float("inf"))
    ends = patches.where(finite).agg(F.min(low).alias("lo"), F.max(low).alias("hi")).first()
    if ends.lo is None:
        place = F.lit(0).cast("long")
    else:
        width = max(ends.hi / 2 - ends.lo / 2, 1e-300)
        share = (low / 2 - F.lit(ends.lo / 2)) / F.lit(width)
        place = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(float(_STEPS))).cast("long")
    return _laid_along(patches, place, [f"{dim}_min", f"{dim}_max"], files)


def _laid_along(patches: DataFrame, place: Column, order: Sequence[str], files: int | None) -> DataFrame:
    """Patches dealt to stretches of a place that hold about as many points each.

    The stretches are found from places and sizes alone; arrays move once. Rows without a place come first.
    """
    placed = patches.withColumn("_at", F.coalesce(place, F.lit(-1).cast("long")))
    # Looked at several times; building the patches again for that would be dear.
    sizes = stage(placed.groupBy("_at").agg(F.sum("n").alias("_n")), "places")
    stretches = Stretches(sizes, files)
    keys = patch_keys(patches)
    sent = stretches.send(placed, F.xxhash64(*keys))
    order = list(dict.fromkeys(c for c in ["_at", *order, *keys] if c in placed.columns))
    return sent.sortWithinPartitions(*order).drop("_at", "_part")


def with_tiles(patches: DataFrame, tiles: Mapping[str, float]) -> DataFrame:
    """Add the first and last tile that the range of a dimension touches.

    The size of a tile is part of the column name, for those who read the table. It is kept to
    six decimals, and the tiles are those of the size that the name tells.
    """
    added = {}
    for dim, size in tiles.items():
        prefix = stat_prefix(dim)
        # 7.5 is written 7p5, as dots would need quoting everywhere.
        named = f"{size:f}".rstrip("0").rstrip(".").replace(".", "p")
        if not math.isfinite(size) or tile_size(named) <= 0:
            raise ValueError(f"a tile of {size} is too small or no size")
        for end, stat in (("lo", "min"), ("hi", "max")):
            added[f"{prefix}_tile_{named}_{end}"] = tile_of(F.col(f"{prefix}_{stat}"), tile_size(named))
    return patches.withColumns(added)


def write_patches(
    patches: DataFrame,
    path: str,
    mode: str = "error",
    row_group_bytes: int = 32 * 1024 * 1024,
    tiles: Mapping[str, float] | None = None,
) -> None:
    """Write a patch table: ``overwrite`` replaces it, ``append`` adds to it.

    ``tiles``, such as ``{"x": 500, "y": 500}``, makes folders that retrieval leaves
    out without opening a file; choose them large, for tables of many thousand files.

    One table holds patches of one point schema; appending another is refused.
    Row groups are kept smaller than usual, because each is a unit of skipping. With tiles, patches are
    first sent by tile, a heavy one to several tasks, so there are no more files than need be.
    """
    if mode == "append":
        check_pcid(patches, path)
    folders = []
    if tiles:
        plain = len(patches.columns)
        patches = with_tiles(patches, tiles)
        folders = patches.columns[plain:]
        order = [c for c in ("t_min", *patch_keys(patches)) if c in patches.columns]
        patches = patches.hint("rebalance", *folders).sortWithinPartitions(*folders, *order)
    writer = patches.write.mode(mode).option("parquet.block.size", row_group_bytes)
    writer.partitionBy(*folders).parquet(path)


def check_pcid(patches: DataFrame, path: str) -> None:
    """Refuse patches of another point schema than those of the table, if it has any."""
    if "pcid" not in patches.columns:
        return
    spark = patches.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return
    stored = read_patches(spark, path)
    if "pcid" not in stored.columns:
        raise ValueError(f"{path} holds patches without a pcid")
    there = stored.select("pcid").first()
    if there is None:
        return
    other = patches.where(~F.col("pcid").eqNullSafe(F.lit(there.pcid))).select("pcid").first()
    if other is not None:
        raise ValueError(f"{path} holds patches of pcid {there.pcid}, not {other.pcid}")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Read a patch table."""
    return spark.read.parquet(path)


#: Files whose name begins so are none of the table's.
MANIFEST = "_ranges"


def write_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Store the ranges of each file of a table: ``file, patches, n`` and every stored range.

    Retrieval with ``read_where`` then opens no file that can't hold what is asked for, not even its footer. One
    pass over the ranges; no array is read. Writing the manifest again replaces it.
    """
    patches = read_patches(spark, path)
    ends = {c: F.min if c.endswith("_min") else F.max for c in patches.columns if c.endswith(("_min", "_max"))}
    tiles = {c: F.min if c.endswith("_lo") else F.max for c in patches.columns if "_tile_" in c}
    merged = [f(c).alias(c) for c, f in (ends | tiles).items()]
    files = patches.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("patches"), F.sum("n").alias("n"), *merged
    )
    # By place, so that the manifest prunes itself; it is small beside the table.
    files.sort(*[c for c in ("x_min", "y_min", "t_min") if c in ends], "file").write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_where(spark: SparkSession, path: str, *criteria: Criterion) -> DataFrame:
    """The patches of the files that may hold points of all the criteria, by the table's manifest.

    Files written since the manifest are always read, files that are gone never looked for, and criteria on
    dimensions without a stored range tell nothing; so the manifest changes what is read and never the result.
    """
    table = read_patches(spark, path)
    if not path_exists(spark, f"{path}/{MANIFEST}"):
        return table
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    ranged = [c for c in criteria if all(f"{stat_prefix(d)}_min" in manifest.columns for d in c.dims)]
    wanted = {_plain(r.file) for r in candidates(manifest, *ranged).select("file").toLocalIterator()}
    known = {_plain(r.file) for r in manifest.select("file").toLocalIterator()}
    present = table.inputFiles()
    chosen = [f for f in present if _plain(f) in wanted or _plain(f) not in known]
    if len(chosen) == len(present):
        return table
    if not chosen:
        return table.where("false")
    return spark.read.schema(table.schema).option("basePath", path).parquet(*map(unquote, chosen))


def _plain(file: str) -> str:
    """A file's URI in one spelling, as Spark has several."""
    return unquote(re.sub(r"^file:/+", "/", file))


def pruning_report(patches: DataFrame, *criteria: Criterion) -> DataFrame:
    """One row: patches and points a retrieval reads, and points it returns."""
    found = candidates(patches, *criteria)
    read = found.agg(
        F.count(F.lit(1)).alias("patches_read"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("points_read"),
    )
    dims = list(dict.fromkeys(d for c in criteria for d in c.dims))
    exact = matching_points(explode_patches(found, dims), *criteria)
    returned = exact.agg(F.count(F.lit(1)).alias("points_returned"))
    # Both sides are one row.
    return read.withColumn("_one", F.lit(1)).join(
        F.broadcast(returned.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")
