"""Grouping points into patches.

Statistics need one aggregation, combined before the shuffle, whatever the skew.
Patches with their points need the points of a group in one place, so they are
built under two limits. ``max_points`` is the size of a patch: a larger group gives
several patches, numbered by ``chunk`` along the point order. ``split_rows`` is the
number of rows one task may have to sort for one group: larger groups take the way
of ``operators.ids`` and are cut over many tasks. A run of theirs has ``split_rows`` rows, or
more where that would make more runs than Spark has shuffle partitions, but never more than
``SPLIT_ROWS`` by plan. Neither changes which points are kept, and the second does not change
the result at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.functions.keys import Key, key_names
from lidarlake.operators.ids import number_runs, sorted_runs
from lidarlake.operators.patch import (
    STAT_DIMS,
    explode_patches,
    range_aggregates,
    stat_prefix,
)
from lidarlake.session import stage

MAX_POINTS = 4096
SPLIT_ROWS = 1_000_000

# A list of heavy groups is broadcast up to so many rows, and joined by shuffle beyond.
HEAVY_LIMIT = 100_000

# Laying out along a place: cells of the place told apart at first, bits by which a cell too heavy for
# one task is refined, and rows of a task.
PLACE_CELLS = 50_000
REFINE_BITS = 6
FEWEST_ROWS = 20_000
MOST_ROWS = 5_000_000


def with_key(points: DataFrame, key: Key) -> tuple[DataFrame, list[str]]:
    """Points with their key columns. A key named like a column must be that column."""
    names = key_names(points, key)
    added = {}
    for name, column in zip(names, key, strict=True):
        if name not in points.columns:
            added[name] = column
        elif str(column) != f"Column<'{name}'>":
            raise ValueError(f"key {name} needs a name of its own")
    return (points.withColumns(added) if added else points), names


def group_stats(
    points: DataFrame,
    key: Key,
    stats: Sequence[str] = STAT_DIMS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Key, ``n`` and ranges of each group; points are not collected."""
    keyed, names = with_key(points, key)
    aggregates = [F.count(F.lit(1)).alias("n"), *range_aggregates(points, stats), *extra]
    return keyed.groupBy(*names).agg(*aggregates)


def group_sizes(keyed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per group, ``_n``: reads the key columns alone, and combines before the shuffle."""
    return keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))


def heavy_groups(
    sizes: DataFrame, names: Sequence[str], split_rows: int
) -> tuple[int, DataFrame | None, int]:
    """Size of the largest group; all groups above ``split_rows``, and how many these are."""
    over = F.col("_n") > split_rows
    largest, count = sizes.agg(F.max("_n"), F.count_if(over)).first()
    if not count:
        return largest or 0, None, 0
    renamed = [F.col(n).alias(f"_h_{n}") for n in names]
    return largest, stage(sizes.where(over).select(*renamed, "_n"), "heavy"), count


def run_count(rows: int, split_rows: int, partitions: int) -> int:
    """Runs that the ``rows`` of all heavy groups are cut into.

    Runs of ``split_rows`` rows where these are few; a run is a task, so where there would be more than
    shuffle partitions, runs grow, up to SPLIT_ROWS.
    """
    return min(1 + rows // split_rows, max(partitions, 1 + rows // SPLIT_ROWS))


def split_heavy(
    keyed: DataFrame, names: Sequence[str], heavy: DataFrame, count: int
) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary groups and the rows of heavy ones."""
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_h_{name}"))
    listed = heavy.drop("_n")
    listed = F.broadcast(listed) if count <= HEAVY_LIMIT else listed.hint("merge")
    return keyed.join(listed, same, "left_anti"), keyed.join(listed, same, "left_semi")


def point_order(order: Sequence[str] | None, dims: Sequence[str]) -> list[str]:
    """Time, place, then every other dimension: only equal points are left tied."""
    first = list(order) if order else [d for d in STAT_DIMS if d in dims]
    return first + [d for d in dims if d not in first]


class _Spread:
    """How rows are sent to tasks so that all steps of grouping need one shuffle.

    They go by a hash of the key, ``_g``. Spark rewrites floating-point keys in windows
    and in aggregates, each in its own way, and would shuffle again between the two; a
    whole number it leaves alone.
    """

    by: tuple[str, ...] = ("_g",)

    def hashed(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        parts = []
        for name in names:
            floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
            # Adding zero turns -0.0, which equals 0.0, into it.
            parts.append(F.col(name) + F.lit(0.0) if floating else F.col(name))
        return df.withColumn("_g", F.xxhash64(*parts))

    def send(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return self.hashed(df, names).repartition("_g")


def _place_sums(placed: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """Rows per cell of the place, in order, and the shift that makes these cells.

    Cells grow until there are at most PLACE_CELLS of them; never more are collected.
    """
    for shift in range(0, 64, 6):
        cell = F.shiftright("_at", shift).alias("_cell")
        sums = placed.groupBy(cell).agg(F.sum("_n")).limit(PLACE_CELLS + 1).collect()
        if len(sums) <= PLACE_CELLS:
            break
    return shift, sorted(map(tuple, sums))


class Stretches:
    """Consecutive stretches of a place, of about equal weight, one per task.

    ``placed`` has ``_at``, the place, and ``_n``, a weight. Weights are gathered into at most PLACE_CELLS cells of
    equal length. A cell heavier than a task's share is cut into smaller ones, and these again, as in
    a quadtree, so a task always owns one stretch; only what is all in one place is shared
    by several. No more than a task's number of cells can be too heavy, so what the driver
    gathers is bounded by PLACE_CELLS and 64 cells a task and step.
    """

    def __init__(self, placed: DataFrame, parts: int | None = None):
        spark = placed.sparkSession
        shift, sums = _place_sums(placed)
        rows = sum(n for _, n in sums)
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parts = parts or max(1, min(wanted, rows // FEWEST_ROWS), rows // MOST_ROWS)
        levels = [(shift, sums)]
        cut: list[set[int]] = []
        while True:
            shift, sums = levels[-1]
            heavy = {at for at, n in sums if n * self.parts > rows} if shift else set()
            cut.append(heavy)
            if not heavy:
                break
            finer = max(0, shift - REFINE_BITS)
            inside = spark.createDataFrame([(at,) for at in sorted(heavy)], "_cell long")
            known = placed.withColumn("_cell", F.shiftright("_at", shift)).join(F.broadcast(inside), "_cell", "left_semi")
            found = known.groupBy(F.shiftright("_at", finer)).agg(F.sum("_n")).collect()
            levels.append((finer, sorted(map(tuple, found))))
        # Along the place: each cell that is not cut takes its share of the tasks.
        leaves = sorted((at << s, i, at, n) for i, (s, sums) in enumerate(levels) for at, n in sums if at not in cut[i])
        tasks: list[list[tuple[int, int | None, int | None]]] = [[(at, None, None) for at in sorted(c)] for c in cut]
        before = 0
        for _, i, at, n in leaves:
            first, end = (k * self.parts // rows for k in (before, before + n))
            tasks[i].append((at, first, max(end - first, 1)))
            before += n
        self.levels = []
        types = {"_cell": pa.int64(), "_first": pa.int32(), "_tasks": pa.int32()}
        for (s, _), told in zip(levels, tasks):
            columns = zip(*told, strict=True) if told else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)]
            self.levels.append((s, spark.createDataFrame(pa.table(arrays, list(types)))))

    def send(self, df: DataFrame, scatter: Column) -> DataFrame:
        """``df``, which has ``_at``, dealt to the tasks as ``_part``; ``scatter`` shares one place out."""
        names = df.columns
        first, tasks = [], []
        for i, (shift, told) in enumerate(self.levels):
            told = told.toDF(f"_cell{i}", f"_first{i}", f"_tasks{i}")
            df = df.withColumn(f"_cell{i}", F.shiftright("_at", shift)).join(F.broadcast(told), f"_cell{i}", "left")
            # A cell that was cut has no task of its own: the finer level tells.
            first.append(F.col(f"_first{i}"))
            tasks.append(F.col(f"_tasks{i}"))
        # A row that came after the count may belong to no known cell.
        part = F.coalesce(*first, F.lit(0)) + F.pmod(scatter, F.coalesce(*tasks, F.lit(1))).cast("int")
        return df.select(*names, part.alias("_part")).repartitionById(self.parts, "_part")


class _SpreadAlong(_Spread):
    """The same, but tasks take consecutive stretches of a ``place``.

    The stretches come from the counted sizes of the groups; a range partitioner would read all
    points once more to draw its sample.
    """

    by = ("_part", "_at", "_g")

    def __init__(self, sizes: DataFrame, place: Column):
        self.place = F.coalesce(place.cast("long"), F.lit(-1).cast("long"))
        self.stretches = Stretches(sizes.select(self.place.alias("_at"), "_n"))

    def send(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        placed = self.hashed(df, names).withColumn("_at", self.place)
        return self.stretches.send(placed, F.col("_g"))


def _chunked(
    keyed: DataFrame,
    names: Sequence[str],
    order: Sequence[str],
    max_points: int,
    split_rows: int,
    place: Column | None = None,
) -> tuple[list[DataFrame], _Spread]:
    """The rows with ``chunk``, sent to their tasks: ordinary groups, then heavy ones."""
    sizes = group_sizes(keyed, names)
    if place is not None:
        # Read twice, and dropped as soon as the layout is known.
        sizes = sizes.persist()
    try:
        largest, heavy, count = heavy_groups(sizes, names, split_rows)
        spread = _Spread() if place is None else _SpreadAlong(sizes, place)
    finally:
        sizes.unpersist()
    if largest <= max_points:
        return [spread.send(keyed, names).withColumn("chunk", F.lit(0).cast("long"))], spread
    chunk = F.floor((F.col("_rn") - 1) / F.lit(max_points)).cast("long")
    ordinary = keyed
    branches = []
    if heavy is not None:
        ordinary, large = split_heavy(keyed, names, heavy, count)
        partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        many = run_count(heavy.agg(F.sum("_n")).first()[0], split_rows, partitions)
        runs = sorted_runs(large, [*names, *order], many, distinct_order=False)
        numbered = number_runs(runs, names, "_rn", many + count).withColumn("chunk", chunk).drop("_rn")
        branches.append(spread.send(numbered, [*names, "chunk"]))
    window = Window.partitionBy(*spread.by, *names).orderBy(*order)
    numbered = spread.send(ordinary, names).withColumn("_rn", F.row_number().over(window))
    return [numbered.withColumn("chunk", chunk).drop("_rn"), *branches], spread


def _union(branches: Sequence[DataFrame]) -> DataFrame:
    whole = branches[0]
    for branch in branches[1:]:
        whole = whole.unionByName(branch)
    return whole


def capped_points(
    points: DataFrame,
    key: Key,
    max_points: int = MAX_POINTS,
    order: Sequence[str] | None = None,
    split_rows: int = SPLIT_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Points with key and ``chunk``: no (key, chunk) has more than ``max_points``."""
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    keyed, names = with_key(points, key)
    full_order = point_order(order, [c for c in points.columns if c not in names])
    branches, spread = _chunked(keyed, names, full_order, max_points, split_rows)
    return _union(branches).drop(*spread.by), names


def build_patches(
    points: DataFrame,
    key: Key,
    dims: Sequence[str] | None = None,
    stats: Sequence[str] = STAT_DIMS,
    order: Sequence[str] | None = None,
    max_points: int = MAX_POINTS,
    split_rows: int = SPLIT_ROWS,
    pcid: int | None = None,
    place: Column | None = None,
) -> DataFrame:
    """Group points into patches: the aggregate that makes patches from points.

    ``dims`` limits the stored arrays; by default every column that is not a key.
    ``place`` is a whole number made from key columns (see ``functions.keys``): the
    points are then shuffled straight to where their patch lies along it, which lays
    out the table without a second shuffle.
    """
    keyed, names = with_key(points, key)
    stats = [s for s in stats if s in points.columns]
    if dims is not None:
        keyed = keyed.select(*dict.fromkeys([*names, *dims, *stats]))
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    values = [c for c in keyed.columns if c not in names]
    dims = [c for c in (dims or points.columns) if c not in names]
    full_order = point_order(order, values)
    branches, spread = _chunked(keyed, names, full_order, max_points, split_rows, place)
    ranges = [f"{stat_prefix(s)}_{end}" for s in stats for end in ("min", "max")]
    tag = [F.lit(pcid).alias("pcid")] if pcid is not None else []
    arrays = [F.col(f"_points.{d}").alias(d) for d in dims]
    whole = [
        F.count(F.lit(1)).alias("n"),
        *range_aggregates(keyed, stats),
        F.sort_array(F.collect_list(F.struct(*point_order(order, dims)))).alias("_points"),
    ]
    built = []
    for branch in branches:
        patches = branch.groupBy(*spread.by, *names, "chunk").agg(*whole)
        if place is not None:
            patches = patches.sortWithinPartitions(*spread.by, "chunk")
        built.append(patches.select(*tag, *names, "chunk", "n", *ranges, *arrays))
    return _union(built)


def regroup(patches: DataFrame, key: Key, keep: Sequence[str] = (), **options) -> DataFrame:
    """The same points under another criterion.

    ``keep`` names key columns that are attributes of the points, so that they stay.
    """
    return build_patches(explode_patches(patches, keep=keep), key, **options)


def _scale_key(fine: Key, coarse: Key, threshold: int, names: Sequence[str]) -> list[Column]:
    dense = F.col("_n_fine") >= threshold
    return [
        F.when(dense, F.lit(0)).otherwise(F.lit(1)).alias("lvl"),
        *[F.when(dense, F.col(f"_f_{n}")).otherwise(F.col(f"_c_{n}")).alias(n) for n in names],
    ]


def _both_scales(points: DataFrame, fine: Key, coarse: Key) -> tuple[DataFrame, list[str]]:
    names = key_names(points, fine)
    if key_names(points, coarse) != names:
        raise ValueError("both scales must name their key columns alike")
    scales = {f"_f_{n}": k for n, k in zip(names, fine, strict=True)}
    scales |= {f"_c_{n}": k for n, k in zip(names, coarse, strict=True)}
    return points.withColumns(scales), names


def multiscale_stats(
    points: DataFrame,
    fine: Key,
    coarse: Key,
    threshold: int,
    stats: Sequence[str] = STAT_DIMS,
) -> DataFrame:
    """Fine groups where they hold ``threshold`` points or more, else coarse groups.

    ``lvl`` is 0 for fine and 1 for coarse. The points are reduced once, to one row
    per (fine, coarse) pair; all that follows works on those rows.
    """
    both, names = _both_scales(points, fine, coarse)
    fine_names = [f"_f_{n}" for n in names]
    cells = both.groupBy(*fine_names, *[f"_c_{n}" for n in names]).agg(
        F.count(F.lit(1)).alias("n"), *range_aggregates(points, stats)
    )
    total = F.sum("n").over(Window.partitionBy(*fine_names))
    keyed = cells.withColumn("_n_fine", total).withColumns(
        dict(zip(["lvl", *names], _scale_key(fine, coarse, threshold, names), strict=True))
    )
    merged = [F.sum("n").alias("n")]
    for s in stats:
        p = stat_prefix(s)
        merged += [
            F.min(f"{p}_min").alias(f"{p}_min"),
            F.max(f"{p}_max").alias(f"{p}_max"),
        ]
    return keyed.groupBy("lvl", *names).agg(*merged)


def multiscale_patches(
    points: DataFrame, scales: Sequence[Key], threshold: int, max_points: int = MAX_POINTS, **options
) -> DataFrame:
    """Patches on any number of scales, finest first: ``lvl`` 0, 1, … before the key columns.

    A group of ``threshold`` points or more is a patch of its scale; the points of all others go on to
    the next one, and the last takes what is left. Points are shuffled once, for the finest scale; then only
    those of sparse groups move again, out of the patches already built.
    """
    if threshold > max_points:
        raise ValueError("a patch must be able to hold threshold points")
    names = key_names(points, scales[0])
    levels, rest = [], points
    for lvl, key in enumerate(scales):
        if key_names(points, key) != names:
            raise ValueError("all scales must name their key columns alike")
        built = build_patches(rest, key, max_points=max_points, **options)
        tag = ["pcid"] if "pcid" in built.columns else []
        order = [*tag, F.lit(lvl).alias("lvl"), *[c for c in built.columns if c not in tag]]
        if lvl == len(scales) - 1:
            levels.append(built.select(*order))
            break
        built = stage(built, f"scale-{lvl}")
        # A group of several patches has more than max_points.
        dense = (F.col("chunk") > 0) | (F.col("n") >= threshold)
        levels.append(built.where(dense).select(*order))
        rest = explode_patches(built.where(~dense), options.get("dims") or points.columns)
    return _union(levels)


def multiscale_points(
    points: DataFrame,
    fine: Key,
    coarse: Key,
    threshold: int,
    split_rows: int = SPLIT_ROWS,
) -> tuple[DataFrame, Key]:
    """Points with the key of the scale they belong to, and that key for building.

    A heavy fine group is dense whatever the threshold, so its points are marked by
    the list of these; the rest are counted group by group.
    """
    both, names = _both_scales(points, fine, coarse)
    fine_names = [f"_f_{n}" for n in names]
    sizes = group_sizes(both, fine_names)
    _, heavy, count = heavy_groups(sizes, fine_names, max(split_rows, threshold))
    counted = Window.partitionBy(*fine_names)
    if heavy is None:
        sized = both.withColumn("_n_fine", F.count(F.lit(1)).over(counted))
    else:
        ordinary, large = split_heavy(both, fine_names, heavy, count)
        sized = ordinary.withColumn("_n_fine", F.count(F.lit(1)).over(counted)).unionByName(
            large.withColumn("_n_fine", F.lit(threshold).cast("long"))
        )
    key = _scale_key(fine, coarse, threshold, names)
    keyed = sized.select(*points.columns, *key)
    return keyed, [F.col("lvl"), *[F.col(n) for n in names]]
