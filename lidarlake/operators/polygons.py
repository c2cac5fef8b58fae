"""Points within polygons, many at once: concave ones, and ones with holes.

A polygon is its rings; a point belongs to it by the even-odd rule, and the edge belongs to it.
Pairs of a patch and a polygon are found from ranges alone. A pair is then classed by the polygon's
edges: if none meets the box of the patch, the patch is inside or outside as a whole; outside
means that its arrays are never fetched, inside that its points go untested. Only points of the
patches that are cut are tested, and only against the edges beside or right of the box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.operators.joins import BROADCAST_ROWS, SPLIT_ROWS, _check_totals, box_join, hulls, in_hulls
from lidarlake.operators.patch import patch_keys
from lidarlake.operators.totals import Polygons, Totals, shape_totals
from lidarlake.session import stage

#: Edges of the largest polygon: they travel with it as one array.
MOST_EDGES = 100_000

_SIDES = [("x_min", "x_max"), ("y_min", "y_max")]
_BOX = [("_x0", "_x1"), ("_y0", "_y1")]


def polygon_row(spark: SparkSession, rings: Sequence[Sequence[tuple[float, float]]], poly_id: int = 0) -> DataFrame:
    """One polygon as a table ``poly_id, rings``."""
    kind = "poly_id int, rings array<array<struct<x: double, y: double>>>"
    return spark.createDataFrame([(poly_id, [[(float(x), float(y)) for x, y in ring] for ring in rings])], kind)


def _edges(rings: Column) -> Column:
    """Every ring's edges, the last vertex joined to the first."""

    def ring_edges(ring: Column) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring, after, lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))
        )

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), ring_edges))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to the right crosses the edge; each edge holds its lower end only."""
    at = F.try_divide((e.x2 - e.x1) * (y - e.y1), e.y2 - e.y1) + e.x1
    return ((e.y1 > y) != (e.y2 > y)) & (x < at)


def _touches(e: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on the edge."""
    level = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) == 0
    within = (x >= F.least(e.x1, e.x2)) & (x <= F.greatest(e.x1, e.x2))
    return level & within & (y >= F.least(e.y1, e.y2)) & (y <= F.greatest(e.y1, e.y2))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1


def polygon_points(
    patches: DataFrame,
    polygons: DataFrame,
    dims: Sequence[str],
    keep: Sequence[str] = (),
    poly_id: str = "poly_id",
    broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
    totals: Totals | None = None,
) -> DataFrame:
    """Points within each polygon of ``polygons(poly_id, rings)``: one row per pair.

    ``rings`` is ``array<array<struct<x, y>>>``: outer edges and holes alike, in any order and sense,
    closed without repeating a vertex. A point inside an odd number of rings, or on an edge, belongs. A
    polygon without edges, or with a vertex that is missing or not finite, holds nothing; polygons given
    twice are answered twice.

    With ``totals``, one row per polygon that holds points: ``n`` and the smallest or largest value of some dimensions
    of ``dims``, by the name of their column, as ``{"t_max": ("max", "gps_time")}``. No pair of a polygon and a point
    is then made, and points are tested only beside edges.
    """
    edges = _edges("rings")
    shape = polygons.groupBy(F.col(poly_id).alias("_id"), F.col("rings")).agg(F.count(F.lit(1)).alias("_times"))
    shape = shape.select("_id", "_times", edges.alias("_edges")).where(F.size("_edges") > 0)
    ends = F.flatten(F.transform("_edges", lambda e: F.array(e.x1, e.y1)))
    whole = ~F.exists(ends, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    shape = shape.where(F.coalesce(whole, F.lit(False))).withColumn("_nr", F.xxhash64("_id", "_edges"))
    # Compared here once, and then read by its number.
    shape = stage(shape, "polygons")
    large = shape.where(F.size("_edges") > MOST_EDGES).select("_id").first()
    if large:
        raise ValueError(f"polygon {large[0]} has more than {MOST_EDGES} edges; cut it into several")
    box = shape.select(
        "_nr",
        F.array_min(F.transform("_edges", lambda e: e.x1)).alias("_x0"),
        F.array_max(F.transform("_edges", lambda e: e.x1)).alias("_x1"),
        F.array_min(F.transform("_edges", lambda e: e.y1)).alias("_y0"),
        F.array_max(F.transform("_edges", lambda e: e.y1)).alias("_y1"),
    )
    near = patches.where(in_hulls(hulls(box, _BOX), _SIDES))
    if totals is not None:
        _check_totals(totals, dims, keep)
        flat = F.flatten(F.transform("_edges", lambda e: F.array(e.x1, e.y1, e.x2, e.y2)))
        shapes = shape.select("_id", "_times", flat.alias("_shape"))
        return shape_totals(near, shapes, Polygons, totals, split_rows).withColumnRenamed("_id", poly_id)
    names = patch_keys(patches)
    narrow = near.select(*dict.fromkeys([*names, *[c for side in _SIDES for c in side]]))
    pairs = box_join(narrow, _SIDES, box, _BOX, broadcast_rows, split_rows).drop(*[c for side in _BOX for c in side])
    known = pairs.join(shape, "_nr")
    # Beside the box, or right of it: what a ray from within it may meet.
    beside = F.filter(
        "_edges",
        lambda e: (F.greatest(e.y1, e.y2) >= F.col("y_min"))
        & (F.least(e.y1, e.y2) <= F.col("y_max"))
        & (F.greatest(e.x1, e.x2) >= F.col("x_min")),
    )
    cut = F.exists("_band", lambda e: F.least(e.x1, e.x2) <= F.col("x_max"))
    classed = known.withColumn("_band", beside).withColumn("_cut", cut)
    classed = classed.where(F.col("_cut") | _odd(F.col("_band"), F.col("x_min"), F.col("y_min")))
    # A table may hold patches of one key: these are told apart by their boxes.
    mine = list(dict.fromkeys([*names, *[c for side in _SIDES for c in side]]))
    asked = [F.col(n).alias(f"_k_{n}") for n in mine]
    linked = classed.select(*asked, "_id", "_times", F.when(F.col("_cut"), F.col("_band")).alias("_band"), "_nr")
    links = stage(linked.dropDuplicates([*[f"_k_{n}" for n in mine], "_nr"]), "polygon-pairs")
    same = F.lit(True)
    for name in mine:
        same = same & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    needed = list(dict.fromkeys([*dims, "x", "y"]))
    wanted = near.select(*dict.fromkeys([*mine, *keep, *needed]))
    few = links.count() <= broadcast_rows // 10  # these rows carry edges
    fetched = wanted.join(F.broadcast(links) if few else links.hint("merge"), same)
    points = F.arrays_zip(*needed)
    inside = F.filter(
        points,
        lambda p: _odd(F.col("_band"), p.x, p.y) | F.exists("_band", lambda e: _touches(e, p.x, p.y)),
    )
    kept = F.when(F.col("_band").isNull(), points).otherwise(inside).alias("_points")
    rows = fetched.select("_id", *keep, kept, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_time"))
    return rows.select(F.col("_id").alias(poly_id), *keep, F.inline("_points")).select(poly_id, *keep, *dims)


def retrieve_polygon(
    patches: DataFrame,
    rings: Sequence[Sequence[tuple[float, float]]],
    dims: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Points within one polygon, its edge included."""
    found = polygon_points(patches, polygon_row(patches.sparkSession, rings), dims, keep, poly_id="poly_id")
    return found.select(*keep, *dims)
