"""Many places, or many time windows, asked at once.

Both sides are boxes in one or two dimensions. A box is put on a ladder of grids
whose cell doubles from level to level, at the level where a cell is as large as the
box, so it touches two cells per dimension at most. Two boxes can only meet in a
cell of the coarser of their levels: that is an equality join, with no pair outside
a shared cell. A pair that shares several cells is kept in the one that holds the
low corner of the overlap, so nothing has to be made distinct afterwards.

The join has two phases. Pairs are found from keys and ranges alone, and written. Then the arrays of
the patches in these pairs are fetched once. The scans of both phases are pruned by a few hulls that
together cover all that is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.operators.grouping import HEAVY_LIMIT, SPLIT_ROWS
from lidarlake.operators.patch import explode_patches, patch_keys
from lidarlake.operators.totals import Discs, Totals, shape_totals
from lidarlake.session import stage

# Cell edges run from 2^-20 to 2^62.
_LOWEST, _HIGHEST = -20, 62
_EDGE = 2.0**61
# Largest number of rows (ids and box corners only) sent to every executor.
BROADCAST_ROWS = 200_000

# Quantiles in all that the areas are merged by for the scan of the patches. In each dimension areas far
# from most others, by so many quartile distances, are kept apart from them.
HULLS = 16
_FAR = (1e1, 1e3, 1e6)

Sides = Sequence[tuple[str, str]]
Boxes = list[list[tuple[float, float]]]


def _on_grid(value: Column) -> Column:
    """The value moved to the grids' edge if it lies beyond, as infinities do."""
    return F.least(F.greatest(value, F.lit(-_EDGE)), F.lit(_EDGE))


def _level(sides: Sides) -> Column:
    extents = [_on_grid(F.col(hi)) - _on_grid(F.col(lo)) for lo, hi in sides]
    extent = extents[0] if len(extents) == 1 else F.greatest(*extents)
    exact = F.ceil(F.log2(extent)).cast("int")
    floor_ = F.lit(_LOWEST)
    level = F.when(extent > F.lit(2.0**_LOWEST), exact).otherwise(floor_)
    return F.least(F.greatest(level, floor_), F.lit(_HIGHEST))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(_on_grid(value) / F.pow(F.lit(2.0), level)).cast("long")


def _on_ladder(df: DataFrame, sides: Sides, own: str, others: Sequence[int]) -> DataFrame:
    """One row per level and cell where ``df``'s boxes can meet boxes of ``others``."""
    coarser = F.filter(F.array(*[F.lit(level) for level in others]), lambda v: v > F.col(own))
    # At its own level a box meets those that are no larger.
    meets_smaller = F.lit(min(others)) <= F.col(own)
    levels = F.when(meets_smaller, F.concat(F.array(own), coarser)).otherwise(coarser)
    cells = F.explode(F.flatten(F.transform(levels, lambda level: _cells(level, sides))))
    names = ["_level", *[f"_c{i}" for i in range(len(sides))]]
    placed = df.select("*", cells.alias("_at"))
    return placed.select(*df.columns, *[F.col(f"_at.{n}").alias(n) for n in names])


def _cells(level: Column, sides: Sides) -> Column:
    """The cells of one level that a box touches, as an array of structs."""
    first, *more = [
        F.sequence(_cell(F.col(lo), level), _cell(F.col(hi), level)) for lo, hi in sides
    ]
    if not more:
        return F.transform(first, lambda a: F.struct(level.alias("_level"), a.alias("_c0")))

    def row(a: Column) -> Column:
        return F.transform(
            more[0],
            lambda b: F.struct(level.alias("_level"), a.alias("_c0"), b.alias("_c1")),
        )

    return F.flatten(F.transform(first, row))


def box_join(
    patches: DataFrame,
    patch_sides: Sides,
    areas: DataFrame,
    area_sides: Sides,
    broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Pairs of a patch and an area whose closed boxes meet; all columns of both.

    ``areas`` should carry ids and numbers only. They are broadcast while their
    counted rows stay under ``broadcast_rows``, else both sides are shuffled by cell.
    """
    left = _proper(patches, patch_sides).withColumn("_lp", _level(patch_sides))
    right = _proper(areas, area_sides).withColumn("_la", _level(area_sides))
    # At most 83 levels exist, so these lists are short.
    per_level = right.groupBy("_la").agg(F.count(F.lit(1)).alias("count")).collect()
    in_right = [r["_la"] for r in per_level]
    in_left = [r[0] for r in left.select("_lp").distinct().collect()] if per_level else []
    joined_columns = [*patches.columns, *areas.columns]
    if not in_left or not in_right:
        # No cells to share: the same columns and no rows.
        keyed = left.withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(1))
        return keyed[0].join(keyed[1], "_k").select(*joined_columns)
    left_cells = _on_ladder(left, patch_sides, "_lp", in_right)
    right_cells = _on_ladder(right, area_sides, "_la", in_left)
    on = ["_level", *[f"_c{i}" for i in range(len(area_sides))]]
    most = sum(r["count"] for r in per_level) * (1 + len(in_left)) * 2 ** len(area_sides)
    if most <= broadcast_rows:
        pairs = left_cells.join(F.broadcast(right_cells), on)
    else:
        pairs = blocked_join(left_cells, right_cells, on, split_rows)
    keep = F.col("_level") == F.greatest("_lp", "_la")
    for i, ((p_lo, p_hi), (a_lo, a_hi)) in enumerate(zip(patch_sides, area_sides, strict=True)):
        keep = keep & (F.col(p_lo) <= F.col(a_hi)) & (F.col(p_hi) >= F.col(a_lo))
        keep = keep & (F.col(f"_c{i}") == _cell(F.greatest(p_lo, a_lo), F.col("_level")))
    return pairs.where(keep).select(*joined_columns)


def _proper(df: DataFrame, sides: Sides) -> DataFrame:
    """Boxes with all ends known and in order; others meet nothing."""
    for lo, hi in sides:
        ordered = F.col(lo) <= F.col(hi)
        # NaN is equal to itself here, and above every number.
        df = df.where(ordered & ~F.isnan(F.col(hi).cast("double")))
    return df


def blocked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Inner equality join where a key may be heavy on either side.

    Rows of a heavy key are cut into blocks on both sides and every pair of blocks
    meets once, in its own task: a left row is repeated per right block and the
    other way round. The block of a row depends on its content alone, so a task
    that runs again makes the same rows.
    """
    heavy, count = _heavy_keys(left, right, on, split_rows)
    if not count:
        # Spark can't see how an explode has grown a side, and might broadcast it.
        return left.join(right.hint("merge"), list(on))
    named = [F.col(f"_h_{c}") == F.col(c) for c in on]
    match = named[0]
    for test in named[1:]:
        match = match & test

    def cut(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        plain = [f.name for f in df.schema if f.dataType.typeName() != "array"]
        listed = F.broadcast(heavy) if count <= HEAVY_LIMIT else heavy.hint("merge")
        marked = df.join(listed, match, "left")
        own = F.pmod(F.xxhash64(*plain), F.coalesce(f"_{mine}s", F.lit(1)))
        other = F.sequence(F.lit(0).cast("long"), F.coalesce(f"_{theirs}s", F.lit(1)) - 1)
        return (
            marked.withColumn(f"_{mine}block", own)
            .withColumn(f"_{theirs}block", F.explode(other))
            .drop(*heavy.columns)
        )

    blocks = ["_lblock", "_rblock"]
    return cut(left, "l", "r").join(cut(right, "r", "l").hint("merge"), [*on, *blocks]).drop(*blocks)


def _heavy_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str], split_rows: int
) -> tuple[DataFrame, int]:
    """Keys above ``split_rows`` on a side with the number of blocks of each side; their count."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))

    both = sizes(left, "_ln").join(sizes(right, "_rn"), list(on))
    size = F.greatest("_ln", "_rn")
    blocks = [
        F.ceil(F.col(f"_{side}n") / F.lit(split_rows)).cast("long").alias(f"_{side}s")
        for side in "lr"
    ]
    over = both.where(size > split_rows)
    heavy = stage(over.select(*[F.col(c).alias(f"_h_{c}") for c in on], *blocks), "heavy-keys")
    return heavy, heavy.count()


def hulls(areas: DataFrame, sides: Sides, most: int = HULLS) -> Boxes:
    """A few boxes, one list of ends per side, that together cover the boxes of ``areas``.

    Areas are gathered by where their middle lies among the quantiles of all, outliers and the
    largest apart from the rest, so that these don't swell every hull: twice ``most`` boxes, and more only
    for outliers, whose classes are few too. In one dimension, boxes that overlap are merged.
    """
    proper = _proper(areas, sides)
    middles = [(_on_grid(F.col(lo)) + _on_grid(F.col(hi))) / 2 for lo, hi in sides]
    extents = [_on_grid(F.col(hi)) - _on_grid(F.col(lo)) for lo, hi in sides]
    bins = max(2, math.floor(most ** (1 / len(sides))))
    steps = [0.25, 0.75, *[i / bins for i in range(1, bins)]]
    asked = [F.percentile_approx(m, steps).alias(f"m{i}") for i, m in enumerate(middles)]
    asked += [F.percentile_approx(e, 0.9).alias(f"e{i}") for i, e in enumerate(extents)]
    known = proper.agg(*asked).first()
    place = []
    for i, (middle, extent) in enumerate(zip(middles, extents)):
        low, high, *cuts = known[f"m{i}"] or [0.0, 0.0, 0.0]
        away = [max(high - low, 1e-9 * (1 + abs(low) + abs(high))) * f for f in _FAR]
        cuts = sorted({*cuts, *[low - a for a in away], *[high + a for a in away]})
        place.append(sum(((middle > c).cast("int") for c in cuts), F.lit(0)).alias(f"b{i}"))
        place.append((extent > F.lit(known[f"e{i}"])).alias(f"l{i}"))
    large = F.lit(False)
    for i in range(len(sides)):
        large = large | F.col(f"l{i}")
    ends = [f(c).cast("double").alias(c) for lo, hi in sides for f, c in ((F.min, lo), (F.max, hi))]
    placed = proper.select(*[c for side in sides for c in side], *place).withColumn("large", large)
    rows = placed.groupBy(*[f"b{i}" for i in range(len(sides))], "large").agg(*ends).collect()
    boxes = sorted([(r[lo], r[hi]) for lo, hi in sides] for r in rows)
    if len(sides) > 1:
        return boxes
    merged: Boxes = []
    for ((lo, hi),) in boxes:
        if merged and lo <= merged[-1][0][1]:
            merged[-1] = [(merged[-1][0][0], max(hi, merged[-1][0][1]))]
        else:
            merged.append([(lo, hi)])
    return merged


def in_hulls(boxes: Boxes, patch_sides: Sides) -> Column:
    """Patches whose box meets one of the hulls: comparisons that reach the Parquet scan."""
    test = F.lit(False)
    for box in boxes:
        meets = F.lit(True)
        for (p_lo, p_hi), (lo, hi) in zip(patch_sides, box, strict=True):
            meets = meets & (F.col(p_lo) <= F.lit(hi)) & (F.col(p_hi) >= F.lit(lo))
        test = test | meets
    return test


def _asked_points(
    patches: DataFrame,
    patch_sides: Sides,
    areas: DataFrame,
    area_sides: Sides,
    dims: Sequence[str],
    keep: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Points of the patches whose box meets an area's, one row per pair, with the area's columns."""
    asked = [c for c in areas.columns if c not in {e for side in area_sides for e in side}]
    # Equal areas are looked for once and told as often as they were asked for.
    areas = areas.groupBy(*areas.columns).agg(F.count(F.lit(1)).alias("_times"))
    near = patches.where(in_hulls(hulls(areas, area_sides), patch_sides))
    names = patch_keys(patches)
    ends = [c for side in patch_sides for c in side]
    narrow = near.select(*dict.fromkeys([*names, *ends]))
    pairs = box_join(narrow, patch_sides, areas, area_sides, broadcast_rows, split_rows)
    # Patches added to a table one by one may share a key; each then gets the areas of all.
    linked = pairs.select(*[F.col(n).alias(f"_k_{n}") for n in names], *asked, "_times").distinct()
    links = stage(linked, "area-pairs")
    count = links.count()
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    wanted = near.select(*dict.fromkeys([*names, *keep, *dims]))
    fetched = wanted.join(F.broadcast(links) if count <= broadcast_rows else links.hint("merge"), same)
    repeated = fetched.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return explode_patches(repeated, dims, [*asked, *keep])


def _window_totals(
    patches: DataFrame,
    spans: DataFrame,
    totals: Totals,
    broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """``_id``, ``n`` and the totals of the points in each window; windows without points have no row."""
    sides, ends = [("t_min", "t_max")], [("_t0", "_t1")]
    spans = spans.groupBy(*spans.columns).agg(F.count(F.lit(1)).alias("_times"))
    near = patches.where(in_hulls(hulls(spans, ends), sides))
    dims = list(dict.fromkeys(["gps_time", *[d for _, d in totals.values()]]))
    ends_of = {"min": F.array_min, "max": F.array_max}
    # A time that is missing or NaN is in no range of its patch, so such a patch is never taken whole.
    unsure = F.exists("gps_time", lambda t: t.isNull() | F.isnan(t))
    sums = {f"_s_{name}": ends_of[kind](dim) for name, (kind, dim) in totals.items()}
    summed = near.select("t_min", "t_max", F.size("gps_time").cast("long").alias("n"), unsure.alias("_unsure"),
                         *[c.alias(n) for n, c in sums.items()], *dims)
    # Told apart by a number of their own: a table may hold patches of one key.
    known = stage(summed.withColumn("_patch", F.monotonically_increasing_id()), "window-patches")
    narrow = known.drop(*dims)
    pairs = box_join(narrow, sides, spans, ends, broadcast_rows, split_rows)
    # The join knows closed windows; these are open at the end, and may be empty.
    pairs = pairs.where((F.col("t_min") < F.col("_hi")) & (F.col("_lo") < F.col("_hi")))
    whole = ~F.col("_unsure") & (F.col("t_min") >= F.col("_lo")) & (F.col("t_max") < F.col("_hi"))
    sorted_out = pairs.withColumn("_whole", whole)
    merge = {"min": F.min, "max": F.max}
    merged = [merge[kind](f"_s_{name}").alias(f"_s_{name}") for name, (kind, _) in totals.items()]
    taken = sorted_out.where("_whole").groupBy("_id").agg(F.sum(F.col("n") * F.col("_times")).alias("n"), *merged)
    cut = stage(sorted_out.where("NOT _whole").select("_patch", "_id", "_lo", "_hi", "_times"), "window-cuts")
    few = cut.count() <= broadcast_rows
    opened = known.select("_patch", *dims).join(F.broadcast(cut) if few else cut.hint("merge"), "_patch")
    points = explode_patches(opened, dims, ["_id", "_lo", "_hi", "_times"])
    inside = points.where((F.col("gps_time") >= F.col("_lo")) & (F.col("gps_time") < F.col("_hi")))
    of_points = [merge[kind](dim).alias(f"_s_{name}") for name, (kind, dim) in totals.items()]
    counted = inside.groupBy("_id").agg(F.sum("_times").alias("n"), *of_points)
    both = taken.unionByName(counted).groupBy("_id").agg(F.sum("n").alias("n"), *merged)
    return both.select("_id", "n", *[F.col(f"_s_{name}").alias(name) for name in totals])


def _check_totals(totals: Totals, dims: Sequence[str], keep: Sequence[str]) -> None:
    if keep or not {d for _, d in totals.values()} <= set(dims):
        raise ValueError("totals are of dims, and keep nothing else")


def _disc_totals(
    patches: DataFrame,
    patch_sides: Sides,
    discs: DataFrame,
    ends: Sides,
    totals: Totals,
    broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """``_id``, ``n`` and the totals of the points in each disc; discs without points have no row."""
    near = patches.where(in_hulls(hulls(discs, ends), patch_sides))
    proper = _proper(discs, ends).groupBy("_id", "_cx", "_cy", "_r").agg(F.count(F.lit(1)).alias("_times"))
    shapes = proper.select("_id", "_times", F.array("_cx", "_cy", "_r").alias("_shape"))
    return shape_totals(near, shapes, Discs, totals, split_rows)


def area_points(
    patches: DataFrame,
    areas: DataFrame,
    dims: Sequence[str],
    keep: Sequence[str] = (),
    area_id: str = "area_id",
    totals: Totals | None = None,
    **limits,
) -> DataFrame:
    """Points within each disc of ``areas(area_id, cx, cy, r)``: one row per pair.

    With ``totals``, one row per area that holds points: ``n`` and the smallest or largest value of some dimensions of
    ``dims``, as with ``window_points``. Areas are then never broadcast, and no pair of an area and a point is made.
    """
    cx, cy, r = F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("r").cast("double")
    reach = r + F.lit(1e-9) * (F.abs(cx) + F.abs(cy) + r)
    discs = areas.where(r >= 0).select(
        F.col(area_id).alias("_id"),
        cx.alias("_cx"),
        cy.alias("_cy"),
        r.alias("_r"),
        (cx - reach).alias("_x0"),
        (cx + reach).alias("_x1"),
        (cy - reach).alias("_y0"),
        (cy + reach).alias("_y1"),
    )
    needed = list(dict.fromkeys([*dims, "x", "y"]))
    patch_sides = [("x_min", "x_max"), ("y_min", "y_max")]
    ends = [("_x0", "_x1"), ("_y0", "_y1")]
    if totals is not None:
        _check_totals(totals, dims, keep)
        found = _disc_totals(patches, patch_sides, discs, ends, totals, **limits)
        return found.withColumnRenamed("_id", area_id)
    points = _asked_points(patches, patch_sides, discs, ends, needed, keep, **limits)
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    inside = dx * dx + dy * dy <= F.col("_r") * F.col("_r")
    return points.where(inside).select(F.col("_id").alias(area_id), *keep, *dims)


def window_points(
    patches: DataFrame,
    windows: DataFrame,
    dims: Sequence[str],
    keep: Sequence[str] = (),
    window_id: str = "win_id",
    totals: Totals | None = None,
    **limits,
) -> DataFrame:
    """Points in each time window ``[lo, hi)`` of ``windows(win_id, lo, hi)``: one row per pair.

    With ``totals``, one row per window that holds points: ``n`` and the smallest or largest value of some
    dimensions of ``dims``, by the name of their column, as ``{"x_max": ("max", "x")}``. Each patch is then summed up
    once, and a window that holds it whole takes these sums; only patches that an end of the window cuts are opened.
    """
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    spans = windows.select(
        F.col(window_id).alias("_id"), lo.alias("_lo"), hi.alias("_hi"), lo.alias("_t0"), hi.alias("_t1")
    )
    needed = list(dict.fromkeys([*dims, "gps_time"]))
    if totals is not None:
        _check_totals(totals, dims, keep)
        return _window_totals(patches, spans, totals, **limits).withColumnRenamed("_id", window_id)
    points = _asked_points(patches, [("t_min", "t_max")], spans, [("_t0", "_t1")], needed, keep, **limits)
    inside = (F.col("gps_time") >= F.col("_lo")) & (F.col("gps_time") < F.col("_hi"))
    return points.where(inside).select(F.col("_id").alias(window_id), *keep, *dims)
