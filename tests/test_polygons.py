"""Polygons and scales, against plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.functions import keys
from lidarlake.operators import grouping, joins, patch, polygons, totals

TYPE = "gps_time double, x double, y double, z double, echo int"
U_SHAPE = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]
RING_OF_TWO = [[(-5, -5), (5, -5), (5, 5), (-5, 5)], [(-2, -2), (-2, 2), (2, 2), (2, -2)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]]):
            on_line = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0
            if on_line and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    rows = [(float(i), rng.uniform(-8, 9), rng.uniform(-8, 9), 0.0, i % 3) for i in range(1500)]
    # Points on corners and edges, and on lines through corners.
    rows += [(2000.0 + 100 * i + j, float(i), float(j), 0.0, 1) for i in range(-6, 8) for j in range(-6, 8)]
    return rows


@pytest.fixture(scope="module")
def cloud(spark, rows):
    return spark.createDataFrame(rows, TYPE).repartition(4)


@pytest.mark.parametrize("size", [0.5, 3, 100])
@pytest.mark.parametrize("rings", [[U_SHAPE], RING_OF_TWO, [[(0, 0), (5, 5), (0, 5)]], [[(1.5, 1.5), (3, 3)]]])
def test_retrieve_polygon(cloud, rows, rings, size):
    patches = grouping.build_patches(cloud, keys.cell(size))
    got = polygons.retrieve_polygon(patches, rings, dims=["gps_time", "echo"])
    expected = [(r[0], r[4]) for r in rows if inside(rings, r[1], r[2])]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "split_rows": 20}])
def test_many_polygons(spark, cloud, rows, limits):
    rng = random.Random(22)
    shapes = [(i, [[(rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 2))]) for i in range(40)]
    shapes += [(90, [U_SHAPE]), (90, [U_SHAPE]), (None, [U_SHAPE]), (91, []), (92, [[]]), (93, [[(50, 50), (60, 50), (60, 60)]])]
    odd = [(94, None), (95, [[(0.0, None), (1.0, 1.0)]]), (96, [[(0.0, float("nan")), (1.0, 1.0)]]), (97, [[(0.0, float("inf")), (1.0, 1.0)]])]
    given = [(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in shapes] + odd
    table = spark.createDataFrame(given, "poly_id int, rings array<array<struct<x: double, y: double>>>")
    # Two builds in one table: patches share keys, and some share their boxes too.
    half = grouping.build_patches(cloud.where("echo = 1"), keys.cell(2))
    patches = half.unionByName(grouping.build_patches(cloud.where("echo <> 1"), keys.cell(2))).unionByName(half)
    got = polygons.polygon_points(patches, table, ["gps_time"], keep=["cx"], **limits).select("poly_id", "gps_time").collect()
    all_ = rows + [r for r in rows if r[4] == 1]
    expected = [(i, r[0]) for i, rings in shapes for r in all_ if inside(rings, r[1], r[2])]
    assert Counter(map(tuple, got)) == Counter(expected)


def test_whole_patches_are_not_tested_and_far_ones_not_fetched(spark, cloud, monkeypatch):
    links = []
    real = polygons.stage
    monkeypatch.setattr(polygons, "stage", lambda df, label: links.append(real(df, label)) or links[-1])
    patches = grouping.build_patches(cloud, keys.cell(1))
    polygons.retrieve_polygon(patches, [[(-4, -4), (4.2, -4), (4.2, 4), (-4, 4)]], ["x"]).count()
    pairs = links[-1].select("_k_cx", "_k_cy", F.col("_band").isNull().alias("whole")).collect()
    assert sum(p.whole for p in pairs) > 20
    assert all(abs(p._k_cx) < 4 and abs(p._k_cy) < 4 for p in pairs if p.whole)
    assert all(abs(p._k_cx) <= 5 and abs(p._k_cy) <= 5 for p in pairs)


def test_polygons_of_too_many_edges(spark, cloud, monkeypatch):
    monkeypatch.setattr(polygons, "MOST_EDGES", 5)
    with pytest.raises(ValueError, match="edges"):
        polygons.retrieve_polygon(grouping.build_patches(cloud, keys.cell(1)), [U_SHAPE], ["x"])


# Scales


def rounded(v, s):
    return s * (int(abs(v) / s + 0.5)) * (1 if v >= 0 else -1) + 0.0


@pytest.mark.parametrize("sizes", [(0.5, 1, 4), (1, 8), (2,), (0.25, 0.5, 1, 2, 4, 8)])
def test_any_number_of_scales(cloud, rows, sizes):
    built = grouping.multiscale_patches(cloud, [keys.cell(s) for s in sizes], 4, max_points=16, pcid=5)
    assert built.columns[:3] == ["pcid", "lvl", "cx"]
    expected, rest = {}, rows
    for lvl, s in enumerate(sizes):
        groups = defaultdict(list)
        for r in rest:
            groups[tuple(rounded(v, s) for v in r[1:4])].append(r[0])
        rest = []
        for cell, members in groups.items():
            if len(members) >= 4 or lvl == len(sizes) - 1:
                expected[(lvl, *cell)] = sorted(members)
            else:
                rest += [r for r in rows if r[0] in set(members)]
    got = defaultdict(list)
    for r in patch.explode_patches(built, ["gps_time"], ["lvl", "cx", "cy", "cz"]).collect():
        got[(r.lvl, r.cx, r.cy, r.cz)].append(r.gps_time)
    assert {k: sorted(v) for k, v in got.items()} == expected
    assert built.agg(F.max("n")).first()[0] <= 16


def test_scales_move_all_points_once(cloud, monkeypatch, capsys):
    plans = []
    real = grouping.stage

    def seen(df, label):
        if label.startswith("scale"):
            capsys.readouterr()
            df.explain()
            plans.append(capsys.readouterr().out)
        return real(df, label)

    monkeypatch.setattr(grouping, "stage", seen)
    whole = grouping.multiscale_patches(cloud.coalesce(1), [keys.cell(1), keys.cell(4), keys.cell(16)], 3)
    assert len(plans) == 2
    assert "RoundRobin" in plans[0] and "RoundRobin" not in plans[1]  # the fixture's own repartition
    whole.explain()
    assert "RoundRobin" not in capsys.readouterr().out  # all further steps read the patches of the first
    with pytest.raises(ValueError):
        grouping.multiscale_patches(cloud, [keys.cell(1), keys.cell(4)], 100, max_points=10)


# Totals


def odd_cloud(spark):
    rng = random.Random(31)
    nan, inf = float("nan"), float("inf")
    rows = [(rng.choice([rng.uniform(0, 900), nan, None]), rng.uniform(-8, 9), rng.uniform(-8, 9), rng.randint(0, 5)) for _ in range(1500)]
    rows += [(float(i + j), float(i), j / 2, 1) for i in range(-6, 8) for j in range(-12, 16) for _ in range(1 + (i == j))]
    rows += [(None, 3.0, 2.5, 9)] * 300 + [(nan, -3.0, 2.5, None)] * 3  # one place is heavy
    rows += [(1.0, nan, 2.0, 1), (1.0, 2.0, None, 1), (1.0, inf, 2.0, 1), (1.0, 2.0, -inf, 1), (-inf, -0.0, 0.0, 1)]
    cloud = spark.createDataFrame(rows, "gps_time double, x double, y double, z int").repartition(4)
    patches = grouping.build_patches(cloud, keys.cell(2), stats=("gps_time", "x", "y"))
    return patches.unionByName(patches.where("cx = 2"))  # patches that share a key


WANTED = {"most": ("max", "gps_time"), "first": ("min", "gps_time"), "y_min": ("min", "y"), "z_max": ("max", "z")}


def of_pairs(found, name):
    merge = {"min": F.min, "max": F.max}
    asked = [merge[kind](dim).alias(c) for c, (kind, dim) in WANTED.items()]
    return found.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *asked)


def small_tiles(monkeypatch, module):
    """Tiles and leaves of few points, and blocks of few shapes; the staged tables by name."""
    for name, value in {"LEAF": 3, "SHAPES": 7, "BLOCK_EDGES": 5}.items():
        monkeypatch.setattr(totals, name, value)
    staged, real_stage, real = {}, totals.stage, totals.shape_totals
    monkeypatch.setattr(totals, "stage", lambda df, label: staged.setdefault(label, real_stage(df, label)))
    monkeypatch.setattr(module, "shape_totals", lambda *a: real(*a, tile_bits=4))
    return staged


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "split_rows": 5}])
@pytest.mark.parametrize("small", [False, True])
def test_polygon_totals_equal_those_of_the_pairs(spark, limits, small, monkeypatch):
    rng = random.Random(32)
    patches = odd_cloud(spark)
    shapes = [(i, [[(rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 2))]) for i in range(40)]
    shapes += [(50 + i, [[(i + 0.0, -4.0), (i + 3.0, -1.0), (i + 3.0, 4.0), (i + 0.5, 4.0)], [(i + 1.0, 0.0), (i + 2.0, 0.0), (i + 2.0, 1.0)]]) for i in range(-8, 8)]
    shapes += [(90, [U_SHAPE]), (90, [U_SHAPE]), (90, RING_OF_TWO), (None, [U_SHAPE]), (91, []), (93, [[(50, 50), (60, 50), (60, 60)]])]
    shapes += [(94, [[(3, 2.5)]]), (95, [[(-9, 9.5), (9, -9.5)]]), (96, [[(-99, -99), (99, -99), (99, 99), (-99, 99)]]), (97, [[(-1e300, 0), (1e300, 1), (5, 1e300)]])]
    given = [(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in shapes]
    table = spark.createDataFrame(given, "poly_id int, rings array<array<struct<x: double, y: double>>>")
    dims = ["gps_time", "y", "z"]
    expected = of_pairs(polygons.polygon_points(patches, table, dims), "poly_id")
    staged = small_tiles(monkeypatch, polygons) if small else {}
    got = polygons.polygon_points(patches, table, dims, totals=WANTED, **limits)
    assert got.dtypes == expected.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    if small:
        assert staged["tile-cuts"].agg(F.max("_cuts")).first()[0] > 1
        # Few of all pairs of polygons and tiles are opened.
        assert staged["shape-tiles"].where("_slab is not null").count() < 0.4 * len(given) * staged["tile-sums"].count()


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "split_rows": 5}])
@pytest.mark.parametrize("small", [False, True])
def test_area_totals_equal_those_of_the_pairs(spark, limits, small, monkeypatch):
    rng = random.Random(33)
    nan, inf = float("nan"), float("inf")
    patches = odd_cloud(spark)
    discs = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.1, 1, 4.5])) for i in range(60)]
    discs += [(60 + i, float(i % 5), i / 2, i / 4) for i in range(12)] + [(72, 3.0, 2.5, 0.0), (72, 3.0, 2.5, 0.0), (72, 1.0, 1.0, 1.5)]
    discs += [(100 + i, 3.0, 2.5, 0.5 + i / 50) for i in range(60)]
    discs += [(80, 0.0, 0.0, 99.0), (81, 0.0, 0.0, inf), (82, nan, 0.0, 1.0), (83, 0.0, 0.0, nan), (84, None, 1.0, 1.0), (85, 0.0, 0.0, -1.0), (None, 1.0, 1.0, 2.0)]
    table = spark.createDataFrame([(i, *map(lambda v: v if v is None else float(v), d)) for i, *d in discs], "area_id int, cx double, cy double, r double")
    dims = ["gps_time", "y", "z"]
    expected = of_pairs(joins.area_points(patches, table, dims), "area_id")
    staged = small_tiles(monkeypatch, joins) if small else {}
    got = joins.area_points(patches, table, dims, totals=WANTED, **limits)
    assert got.dtypes == expected.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    if small:
        assert staged["tile-cuts"].agg(F.max("_cuts")).first()[0] > 1


@pytest.mark.parametrize("pairs", [7, 1 << 18])
def test_trees_find_what_single_tests_find(pairs, monkeypatch):
    monkeypatch.setattr(totals, "PAIRS", pairs)
    rng = np.random.default_rng(34)
    x, y = rng.integers(-20, 20, 700) / 4.0, np.append(rng.normal(0, 3, 400), rng.integers(-9, 9, 300) / 2.0)
    n, codes = rng.integers(1, 4, 700), [rng.integers(-99, 99, 700), rng.integers(-99, 99, 700)]
    rings = [rng.normal(0, 3, (rng.integers(2, 9), 2)) if i % 2 else rng.integers(-8, 8, (5, 2)) / 2.0 for i in range(40)]
    rings += [np.array([(a, -3.0), (a + 1, -3.0), (a + 1, 4.0), (a, 4.0)]) for a in range(-3, 3)]  # along rows of points
    edges = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings]
    discs = np.column_stack([rng.normal(0, 4, (40, 2)), rng.integers(0, 9, 40) / 2.0])
    tree = totals._Tree((x, x, y, y), n, ["max", "min"], codes, 4)
    of_polygons = totals.Polygons(np.concatenate(edges).ravel(), np.array([e.size for e in edges]))
    of_discs = totals.Discs(discs.ravel(), np.full(40, 3))
    held = [[i for i in range(700) if inside([r.tolist()], x[i], y[i])] for r in rings]
    near = [np.flatnonzero((x - cx) ** 2 + (y - cy) ** 2 <= r * r) for cx, cy, r in discs]
    for shapes, found in ((of_polygons, held), (of_discs, near)):
        with np.errstate(all="ignore"):
            count, best = tree.totals(shapes)
        assert count.tolist() == [n[f].sum() for f in found]
        assert [b for b, c in zip(best[0], count) if c] == [codes[0][f].max() for f in found if len(f)]
        assert [b for b, c in zip(best[1], count) if c] == [codes[1][f].min() for f in found if len(f)]


def test_totals_of_nothing(spark):
    patches = odd_cloud(spark)
    table = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 500.0, 0.0, 1.0)], "area_id int, cx double, cy double, r double")
    wanted = {"t_max": ("max", "gps_time")}
    assert joins.area_points(patches, table.where("area_id > 2"), ["gps_time"], totals=wanted).count() == 0
    assert joins.area_points(patches, table.where("area_id = 2"), ["gps_time"], totals=wanted).count() == 0
    assert joins.area_points(patches.where("n < 0"), table, ["gps_time"], totals=wanted).count() == 0
    assert joins.area_points(patches, table, [], totals={}).columns == ["area_id", "n"]
    with pytest.raises(ValueError, match="totals"):
        joins.area_points(patches, table, ["x"], totals=wanted)
    with pytest.raises(ValueError, match="no sum"):
        joins.area_points(patches, table, ["x"], totals={"s": ("sum", "x")})
