"""Two-phase retrieval, layout, ids and joins."""

import random

import pytest
from pyspark.sql import functions as F

from lidarlake.functions import keys, sql
from lidarlake.functions.zorder import morton
from lidarlake.operators import grouping, joins, layout, patch, perpatch, report
from lidarlake.operators.retrieve import Ball, Box, Disc, Span, candidates, retrieve

DIMS = ["gps_time", "x", "y", "z", "echo"]
TYPE = "gps_time double, x double, y double, z double, echo int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [
        (
            round(rng.uniform(0, 50), 2),
            round(rng.gauss(0, 8), 2),
            round(rng.gauss(0, 8), 2),
            round(rng.uniform(0, 4), 2),
            rng.randint(1, 5),
        )
        for _ in range(2000)
    ]


@pytest.fixture(scope="module")
def cloud(spark, rows):
    return spark.createDataFrame(rows, TYPE)


@pytest.fixture(scope="module")
def cubes(spark, cloud, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cubes") / "table")
    built = grouping.build_patches(cloud, keys.cubic_metre(), pcid=2, max_points=8)
    layout.write_patches(layout.cluster_by_space(built, files=4), path)
    return layout.read_patches(spark, path)


TESTS = {
    "disc": (Disc(1.0, 2.0, 3.5), lambda p: (p[1] - 1) ** 2 + (p[2] - 2) ** 2 <= 3.5**2),
    "ball": (
        Ball(1.0, 2.0, 2.0, 2.0),
        lambda p: (p[1] - 1) ** 2 + (p[2] - 2) ** 2 + (p[3] - 2) ** 2 <= 4,
    ),
    "box": (Box(-2.0, 3.0, 0.0, 1.5), lambda p: -2 <= p[1] <= 3 and 0 <= p[2] <= 1.5),
    "time": (Span("gps_time", 10.0, 20.0), lambda p: 10 <= p[0] < 20),
    "open": (Span("z", lo=3.0, bounds="()"), lambda p: p[3] > 3),
    "echo": (Span("echo", 2, 4, "(]"), lambda p: 2 < p[4] <= 4),
}


@pytest.mark.parametrize("name", TESTS)
def test_retrieval_equals_plain_filter(cubes, rows, name):
    criterion, test = TESTS[name]
    found = [tuple(r) for r in retrieve(cubes, criterion, dims=DIMS).collect()]
    assert sorted(found) == sorted(filter(test, rows))


def test_conjunction(cubes, rows):
    found = retrieve(cubes, *[c for c, _ in TESTS.values() if c.dims != ["z"]], dims=["x", "y"])
    wanted = [p[1:3] for p in rows if all(t(p) for n, (_, t) in TESTS.items() if n != "open")]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_patch_precision_holds_point_precision(cubes):
    disc = TESTS["disc"][0]
    exact = retrieve(cubes, disc, dims=DIMS)
    whole = retrieve(cubes, disc, dims=DIMS, precision="patch")
    assert exact.exceptAll(whole).count() == 0
    assert whole.count() == candidates(cubes, disc).agg(F.sum("n")).first()[0]


def test_bounds_hit_exactly(spark):
    patches = spark.createDataFrame([(1, 10.0, 20.0)], "n long, t_min double, t_max double")

    def hit(*span):
        return candidates(patches, Span("gps_time", *span)).count() == 1

    assert hit(20.0, 30.0) and not hit(20.0, 30.0, "()")
    assert not hit(5.0, 10.0) and hit(5.0, 10.0, "[]")
    assert hit(None, 10.0, "[]") and hit(20.0, None) and hit(None, None)
    assert not hit(15.0, 15.0) and hit(15.0, 15.0, "[]")
    with pytest.raises(ValueError):
        Span("x", 2.0, 1.0)
    with pytest.raises(ValueError):
        Span("x", 1.0, 2.0, "<>")


def test_disc_touching_a_corner(spark):
    made = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0, 1), (0.0, 3.0, 0.0, 0.0, 1)], TYPE)
    corner = grouping.build_patches(made, [F.lit(1).alias("k")])
    disc = Disc(6.0, 8.0, 5.0)
    assert candidates(corner, disc).count() == 1
    assert retrieve(corner, disc, dims=["x"]).count() == 0


def test_nan_lies_in_no_range(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 0.0, 0.0, 1), (2.0, 1.0, 0.0, 0.0, 1)], TYPE)
    built = grouping.build_patches(df, [F.lit(1).alias("k")])
    assert retrieve(built, Span("x", lo=0.0), dims=["x"]).count() == 1
    assert retrieve(built, Disc(0.0, 0.0, 5.0), dims=["x"]).count() == 1


def test_ranges_reach_the_scan_and_arrays_are_pruned(cubes, capsys):
    retrieve(cubes, Disc(0.0, 0.0, 1.0), Span("gps_time", 1.0, 2.0), dims=["z"]).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    for column in ("x_min", "x_max", "y_min", "y_max", "t_min", "t_max"):
        assert f"Than({column}" in pushed or f"ThanOrEqual({column}" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "echo" not in read and "Exchange" not in plan


def test_layouts_keep_rows_and_order_files(spark, cubes):
    by_time = layout.cluster_by_range(cubes, files=4)
    assert sorted(by_time.collect()) == sorted(cubes.collect())
    spans = (
        by_time.groupBy(F.spark_partition_id())
        .agg(F.min("t_min").alias("lo"), F.max("t_min").alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert len(spans) == 4
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("how", [layout.cluster_by_space, layout.cluster_by_range])
def test_layouts_move_arrays_once(cubes, cloud, capsys, how):
    how(cubes, files=3).explain()
    plan = capsys.readouterr().out
    # The other exchanges are broadcasts of the stretches.
    assert plan.count("- Exchange ") == 1 and "rangepartitioning" not in plan
    assert sorted(how(cubes, files=3).collect()) == sorted(cubes.collect())


def test_manifest_prunes_files(spark, cubes, rows, tmp_path):
    path = str(tmp_path / "a table")
    layout.write_patches(layout.cluster_by_space(cubes, files=8), path)
    disc, late = Disc(1.0, 2.0, 1.5), Span("gps_time", 48.0, 49.0)
    assert len(layout.read_where(spark, path, disc).inputFiles()) == 8  # no manifest yet
    manifest = layout.write_manifest(spark, path)
    assert manifest.agg(F.sum("n")).first()[0] == len(rows) and manifest.count() == 8
    expected = sorted(retrieve(cubes, disc, late, dims=["x", "y"]).collect())
    few = layout.read_where(spark, path, disc, late)
    assert few.columns == cubes.columns and 0 < len(few.inputFiles()) < 6
    assert sorted(retrieve(few, disc, late, dims=["x", "y"]).collect()) == expected
    assert layout.read_where(spark, path, Disc(1e6, 0.0, 1.0)).count() == 0
    assert layout.read_where(spark, path, Span("echo", 1, 2)).count() == cubes.count()
    # What is added later is read as well, until the manifest is written again.
    layout.write_patches(cubes.where("x_min > 900"), path, "append")
    layout.write_patches(cubes, path, "append")
    twice = retrieve(layout.read_where(spark, path, disc, late), disc, late, dims=["x", "y"]).collect()
    assert sorted(twice) == sorted(2 * expected)
    layout.write_manifest(spark, path)
    twice = retrieve(layout.read_where(spark, path, disc, late), disc, late, dims=["x", "y"]).collect()
    assert sorted(twice) == sorted(2 * expected)


def test_manifest_of_a_tiled_table(spark, cubes, tmp_path):
    path = str(tmp_path / "tiled")
    layout.write_patches(cubes, path, tiles={"x": 4, "y": 4})
    layout.write_manifest(spark, path)
    box = Box(-2.0, 3.0, 0.0, 1.5)
    got = layout.read_where(spark, path, box)
    assert len(got.inputFiles()) < len(layout.read_patches(spark, path).inputFiles())
    assert sorted(retrieve(got, box, dims=["x"]).collect()) == sorted(retrieve(cubes, box, dims=["x"]).collect())


def test_tiles_have_few_files(spark, cubes, tmp_path):
    path = str(tmp_path / "tiled")
    layout.write_patches(cubes.repartition(16), path, tiles={"x": 8, "y": 8})
    files = layout.read_patches(spark, path).select(F.input_file_name().alias("f")).distinct().count()
    tiles = layout.read_patches(spark, path).select("x_tile_8_lo", "x_tile_8_hi", "y_tile_8_lo", "y_tile_8_hi").distinct().count()
    assert files <= 2 * tiles


def test_morton(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (-1.0, -1.0)], "x double, y double")
    numbers = [r.z for r in df.select(morton(F.col("x"), F.col("y"), 1.0).alias("z")).collect()]
    assert [n - numbers[0] for n in numbers[:4]] == [0, 1, 2, 3]
    assert numbers[4] < numbers[0]


def test_append_and_overwrite(spark, cloud, tmp_path):
    path = str(tmp_path / "t")
    built = grouping.build_patches(cloud, keys.snap_grid(10, 10), pcid=2)
    layout.write_patches(built, path)
    layout.write_patches(built, path, "append")
    assert layout.read_patches(spark, path).agg(F.sum("n")).first()[0] == 2 * cloud.count()
    other = built.withColumn("pcid", F.lit(3))
    with pytest.raises(ValueError, match="pcid"):
        layout.write_patches(other, path, "append")
    layout.write_patches(other, path, "overwrite")
    assert layout.read_patches(spark, path).select("pcid").distinct().collect()[0].pcid == 3


def test_edit_in_place(cubes):
    edited = patch.edit_in_place(cubes, "z", lambda v: v * 2)
    again = patch.explode_patches(edited, ["z"]).agg(F.min("z"), F.max("z")).first()
    assert edited.agg(F.min("z_min"), F.max("z_max")).first() == again
    echo = patch.edit_in_place(cubes, "echo", lambda v: v + 1)
    assert echo.select(F.sum(F.aggregate("echo", F.lit(0), lambda a, v: a + v))).first()[0] > 0


def test_position_of_points(cubes):
    placed = patch.explode_patches(cubes, ["gps_time"], ["cx", "cy", "cz", "chunk"], position="i")
    row = placed.where("i = 0").count()
    assert row == cubes.count()


def discs(spark, count, radius):
    rng = random.Random(11)
    rows = [(i, rng.gauss(0, 6), rng.gauss(0, 6), radius * rng.random() ** 4) for i in range(count)]
    return rows, spark.createDataFrame(rows, "area_id int, cx double, cy double, r double")


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "split_rows": 40}])
def test_area_join_equals_loop(spark, cubes, rows, limits):
    areas, table = discs(spark, 60, 20.0)
    found = joins.area_points(cubes, table, ["gps_time", "x", "y"], **limits)
    expected = [
        (i, p[0], p[1], p[2])
        for i, cx, cy, r in areas
        for p in rows
        if (p[1] - cx) * (p[1] - cx) + (p[2] - cy) * (p[2] - cy) <= r * r
    ]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "split_rows": 5}])
def test_window_join_equals_loop(spark, cloud, rows, limits):
    weeks = grouping.build_patches(cloud, keys.time_bin(2000), max_points=16)
    rng = random.Random(5)
    spans = [(i, s := rng.uniform(-5, 55), s + 30 * rng.random() ** 3) for i in range(40)]
    spans += [(90, 7.0, 7.0), (91, 9.0, 8.0), (92, None, 3.0), (93, 60.0, 70.0)]
    table = spark.createDataFrame(spans, "win_id int, lo double, hi double")
    found = joins.window_points(weeks, table, ["gps_time", "x"], **limits)
    expected = [
        (i, p[0], p[1]) for i, lo, hi in spans if lo is not None for p in rows if lo <= p[0] < hi
    ]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_joins_without_match(spark, cubes):
    nothing = spark.createDataFrame([], "area_id int, cx double, cy double, r double")
    assert joins.area_points(cubes, nothing, ["x"]).count() == 0
    far = spark.createDataFrame([(1, 1e6, 1e6, 1.0)], nothing.schema)
    assert joins.area_points(cubes, far, ["x"]).count() == 0


def test_joins_have_no_nested_loop(spark, cubes, capsys):
    _, table = discs(spark, 10, 5.0)
    joins.area_points(cubes, table, ["x"], broadcast_rows=0).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_are_joined_without_arrays(spark, cubes, capsys, monkeypatch):
    """Up to the pairs, the scan reads keys and ranges; then one scan fetches arrays, pruned by hulls."""
    plans = []
    real = joins.stage

    def seen(df, label):
        if label == "area-pairs":
            capsys.readouterr()
            df.explain()
            plans.append(capsys.readouterr().out)
        return real(df, label)

    monkeypatch.setattr(joins, "stage", seen)
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    _, table = discs(spark, 60, 2.0)
    for rows in (200_000, 0):
        points = joins.area_points(cubes, table, ["echo"], broadcast_rows=rows)
        assert len(plans) == 1 and "array<" not in plans.pop()
        points.explain()
        plan = capsys.readouterr().out
        assert plan.count("array<int>") == 1
        pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
        assert "x_min" in pushed and "Or(" in pushed
        assert ("Exchange hashpartitioning" in plan) == (rows == 0)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_hulls_cover_all_areas_and_are_few(spark):
    rng = random.Random(8)
    rows = [(x := rng.gauss(0, 5), x + rng.random(), y := rng.gauss(0, 5), y + rng.random()) for _ in range(500)]
    rows += [(1e9, 1e9 + 1, 0.0, 1.0), (-1e3, 1e3, -1e3, 1e3), (float("-inf"), 0.0, 0.0, 1.0)]
    frame = spark.createDataFrame(rows + [(None, 1.0, 0.0, 1.0), (2.0, 1.0, 0.0, 1.0)], "x0 double, x1 double, y0 double, y1 double")
    boxes = joins.hulls(frame, [("x0", "x1"), ("y0", "y1")])
    assert 1 < len(boxes) <= 2 * joins.HULLS + 3
    for x0, x1, y0, y1 in rows:
        assert any(a <= x0 and x1 <= b and c <= y0 and y1 <= d for (a, b), (c, d) in boxes)
    # The outliers leave the others' hulls small.
    assert sum(b - a < 30 and d - c < 30 for (a, b), (c, d) in boxes) >= len(boxes) / 3
    spans = joins.hulls(frame.where("x1 - x0 < 2"), [("x0", "x1")])
    assert all(a[0][1] < b[0][0] for a, b in zip(spans, spans[1:])) and len(spans) >= 2
    assert joins.hulls(frame.where("false"), [("x0", "x1")]) == []


def test_equal_areas_and_patches_of_one_key(spark, cloud, rows):
    """Areas asked for twice are answered twice; patches that share a key are told apart by their points."""
    parts = [grouping.build_patches(cloud.where(f"echo % 2 = {i}"), keys.cell(4)) for i in (0, 1)]
    twice = parts[0].unionByName(parts[1])
    areas = spark.createDataFrame([(1, 0.0, 0.0, 3.0)] * 2 + [(2, 0.0, 0.0, 3.0), (3, 1.0, 1.0, -1.0), (None, 5.0, 5.0, 2.0)], "area_id int, cx double, cy double, r double")
    got = sorted(map(str, map(tuple, joins.area_points(twice, areas, ["gps_time", "x"]).collect())))
    near = [(p[0], p[1]) for p in rows if p[1] ** 2 + p[2] ** 2 <= 9]
    far = [(p[0], p[1]) for p in rows if (p[1] - 5) ** 2 + (p[2] - 5) ** 2 <= 4]
    assert got == sorted(map(str, [(i, *p) for i in (1, 1, 2) for p in near] + [(None, *p) for p in far]))


def test_blocked_join_on_heavy_keys(spark):
    left = spark.createDataFrame([(i % 3 and 1 or i, i) for i in range(300)], "k int, a int")
    right = spark.createDataFrame([(i % 2 and 1 or i, i) for i in range(100)], "k int, b int")
    expected = left.join(right, "k")
    for split_rows in (1000, 20):
        found = joins.blocked_join(left, right, ["k"], split_rows)
        assert sorted(found.select("k", "a", "b").collect()) == sorted(expected.collect())


def test_reports(spark, cubes, rows):
    sizes = {r.n: r.patches for r in report.patch_sizes(cubes).collect()}
    assert sum(n * c for n, c in sizes.items()) == len(rows)
    profile = report.patch_size_profile(cubes, 2).first()
    assert profile.nearly_empty == sizes.get(1, 0) and profile.largest == max(sizes)
    doubled = spark.createDataFrame(rows, TYPE).unionByName(spark.createDataFrame(rows[:10], TYPE))
    assert report.duplicate_points(doubled).agg(F.sum("n")).first()[0] >= 20
    assert report.without_duplicates(doubled).count() == len(set(rows))
    pruned = layout.pruning_report(cubes, TESTS["disc"][0]).first()
    assert pruned.points_returned == sum(map(TESTS["disc"][1], rows))
    assert pruned.points_returned <= pruned.points_read < len(rows)


def test_function_per_patch(cubes, rows):
    def highest(key, points):
        top = points.sort_values("z").tail(1)
        return top.assign(cx=key["cx"], chunk=key["chunk"])[["cx", "chunk", "z"]]

    tops = perpatch.apply_per_patch(cubes, highest, "cx double, chunk long, z double", ["z"])
    assert sorted(r.z for r in tops.collect()) == sorted(
        r.z_max for r in cubes.select("z_max").collect()
    )


def test_retrieval_in_sql(spark, cubes, rows, capsys):
    sql.register(spark)
    cubes.createOrReplaceTempView("cubes")
    inside = spark.sql(
        """SELECT p.gps_time, p.x, p.y, p.z
           FROM cubes LATERAL VIEW inline(arrays_zip(gps_time, x, y, z)) p AS gps_time, x, y, z
           WHERE range_overlaps(t_min, t_max, 10, 20) AND box_near(x_min, y_min, x_max, y_max, 1, 2, 3.5)
             AND in_range(p.gps_time, 10, 20) AND point_near(p.x, p.y, 1, 2, 3.5)"""
    )
    wanted = [p[:4] for p in rows if TESTS["disc"][1](p) and TESTS["time"][1](p)]
    assert sorted(map(tuple, inside.collect())) == sorted(wanted)
    inside.explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters"))
    for column in ("t_min", "t_max", "x_min", "x_max", "y_min", "y_max"):
        assert f"({column}," in pushed


def test_key_may_not_hide_a_column(cloud):
    with pytest.raises(ValueError, match="name of its own"):
        grouping.group_stats(cloud, [F.round("x").alias("x")])


def test_tiled_table(spark, cubes, rows, tmp_path, capsys):
    path = str(tmp_path / "tiled")
    layout.write_patches(cubes, path, tiles={"x": 7.5, "gps_time": 20})
    tiled = layout.read_patches(spark, path)
    assert tiled.agg(F.sum("n")).first()[0] == len(rows)
    for criterion, test in TESTS.values():
        found = [tuple(r) for r in retrieve(tiled, criterion, dims=DIMS).collect()]
        assert sorted(found) == sorted(filter(test, rows))
    retrieve(tiled, *[TESTS[n][0] for n in ("disc", "time")], dims=DIMS).explain("formatted")
    plan = capsys.readouterr().out
    folders = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "x_tile_7p5_lo" in folders and "x_tile_7p5_hi" in folders and "t_tile_20_lo" in folders


def test_points_at_infinity(spark):
    inf = float("inf")
    rows = [(1.0, inf, 0.0, 0.0, 1), (2.0, 1.0, 1.0, 0.0, 2), (-inf, -inf, inf, 0.0, 3)]
    rows += [(3.0, -1e300, 2.0, 0.0, 4), (4.0, 0.5, 0.5, 0.0, 5)]
    df = spark.createDataFrame(rows, TYPE)
    whole = grouping.build_patches(df, [F.lit(1).alias("k")])
    places = "VALUES (1, 0D, 0D, 2D), (2, 1D, 1D, 1e-7D), (3, 0D, 0D, 1e100D) AS t(area_id, cx, cy, r)"
    areas = spark.sql(f"SELECT * FROM {places}")
    found = joins.area_points(whole, areas, ["echo"])
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 5), (2, 2), (3, 2), (3, 5)]
    spans = spark.sql("SELECT * FROM VALUES (1, 2D, double('inf')), (2, 4D, 5D) AS t(win_id, lo, hi)")
    kept = joins.window_points(whole, spans, ["echo"])
    assert sorted(map(tuple, kept.collect())) == [(1, 2), (1, 4), (1, 5), (2, 5)]
    laid = grouping.build_patches(df, keys.cubic_metre(), place=keys.along_curve())
    assert laid.agg(F.sum("n")).first()[0] == len(rows)
    assert layout.cluster_by_space(laid).count() == laid.count()
    timed = grouping.build_patches(df, keys.period(10), place=keys.along_time())
    assert timed.agg(F.sum("n")).first()[0] == len(rows)


def test_layout_keeps_points_without_a_place(spark):
    nan = float("nan")
    rows = [(nan, nan, 1.0, 0.0, 1), (None, None, None, 0.0, 2), (-5.0, -3.0, -4.0, 0.0, 3)]
    df = spark.createDataFrame(rows, TYPE)
    for key, place in ((keys.cubic_metre(), keys.along_curve()), (keys.period(1), keys.along_time())):
        built = grouping.build_patches(df, key, place=place)
        assert sorted(r.echo[0] for r in built.collect()) == [1, 2, 3]


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "split_rows": 5}])
def test_window_totals_equal_those_of_the_pairs(spark, limits, monkeypatch):
    """Patches wholly in a window are not opened for it; the totals are those of the pairs."""
    rng = random.Random(6)
    nan = float("nan")
    rows = [(float(rng.randint(0, 400)), rng.uniform(-5, 5)) for _ in range(4000)]
    rows += [(3.0, nan), (7.0, None), (nan, 99.0), (None, 98.0), (200.0, -0.0)]
    cloud = spark.createDataFrame(rows, "gps_time double, x double")
    weeks = grouping.build_patches(cloud, keys.time_bin(50_000), max_points=16, stats=("gps_time",))
    weeks = weeks.unionByName(weeks.where("tbin < 3"))  # patches that share a key
    spans = [(i, s := rng.uniform(-50, 450), s + rng.choice([0.5, 20, 300])) for i in range(40)]
    spans += [(50 + i, float(10 * i), float(10 * i + 50 * (i % 3))) for i in range(20)]
    spans += [(90, 7.0, 7.0), (91, 9.0, 8.0), (92, None, 3.0), (93, 900.0, 970.0), (94, 0.0, float("inf")), (95, 0.0, nan)]
    spans += [(50, 100.0, 200.0), (50, 100.0, 200.0), (None, 20.0, 90.0)]
    table = spark.createDataFrame(spans, "win_id int, lo double, hi double")
    staged, real = {}, joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, label: staged.setdefault(label, real(df, label)))
    pairs = joins.window_points(weeks, table, ["gps_time", "x"])
    expected = pairs.groupBy("win_id").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most"), F.min("x").alias("least"))
    expected = sorted(map(str, expected.collect()))
    met = sum(r["_times"] for r in staged.pop("area-pairs").collect())
    wanted = {"most": ("max", "x"), "least": ("min", "x")}
    got = joins.window_points(weeks, table, ["gps_time", "x"], totals=wanted, **limits)
    assert sorted(map(str, got.collect())) == expected
    assert 0 < staged["window-cuts"].count() < met / 3
