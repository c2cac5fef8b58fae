"""Grouping, capping and skew, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lidarlake.functions import keys
from lidarlake.operators import grouping, patch
from lidarlake.operators.ids import row_ids, sorted_runs

DIMS = ["gps_time", "x", "y", "z", "echo"]
TYPE = "gps_time double, x double, y double, z double, echo int"


def half_away(v):
    return math.copysign(math.floor(abs(v) + 0.5), v) + 0.0


def skewed_rows(count=3000, seed=7):
    """A third in one cube, a third of those copies of one point, the rest spread."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        if i % 9 == 0:
            rows.append((5.0, 10.2, 10.3, 0.1, 1))
        elif i % 3 == 0:
            rows.append((rng.uniform(0, 9), rng.uniform(9.6, 10.4), 10.0, 0.0, rng.randint(1, 4)))
        else:
            rows.append(
                (
                    rng.uniform(0, 9),
                    rng.uniform(-20, 20),
                    rng.uniform(-3, 3),
                    rng.uniform(0, 2),
                    rng.randint(1, 4),
                )
            )
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed_rows()


@pytest.fixture(scope="module")
def cloud(spark, rows):
    return spark.createDataFrame(rows, TYPE).repartition(5)


def cubes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(half_away(v) for v in r[1:4])].append(r)
    return groups


def expected_chunks(rows, cap):
    chunks = {}
    for cube, members in cubes(rows).items():
        members.sort()
        for start in range(0, len(members), cap):
            chunks[(*cube, start // cap)] = members[start : start + cap]
    return chunks


@pytest.mark.parametrize("split_rows", [1_000_000, 200, 50])
@pytest.mark.parametrize("max_points", [4096, 64])
def test_patches_equal_plain_python(cloud, rows, max_points, split_rows):
    built = grouping.build_patches(
        cloud, keys.cubic_metre(), max_points=max_points, split_rows=split_rows
    )
    found = {
        (r.cx, r.cy, r.cz, r.chunk): list(zip(r.gps_time, r.x, r.y, r.z, r.echo, strict=True))
        for r in built.collect()
    }
    assert found == expected_chunks(rows, max_points)


def test_heavy_groups_spread_over_tasks(cloud, rows):
    """Copies of one point, more than a run may hold, do not end up in one run."""
    copies = cloud.where((F.col("x") == 10.2) & (F.col("gps_time") == 5.0))
    runs = sorted_runs(copies, ["x", "gps_time"], 4, distinct_order=False)
    sizes = [r["count"] for r in runs.groupBy("_run").count().collect()]
    assert sum(sizes) == sum(r == (5.0, 10.2, 10.3, 0.1, 1) for r in rows)
    assert len(sizes) == 4 and max(sizes) < sum(sizes) / 2


def test_stats_equal_stats_of_exploded_points(cloud):
    built = grouping.build_patches(cloud, keys.cubic_metre(), max_points=64, split_rows=100)
    again = patch.explode_patches(built, DIMS, ["cx", "cy", "cz", "chunk"])
    again = again.groupBy("cx", "cy", "cz", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(d).alias(f"{patch.stat_prefix(d)}_{e}")
            for d in patch.STAT_DIMS
            for e, f in (("min", F.min), ("max", F.max))
        ],
    )
    stored = built.select(*again.columns)
    assert sorted(stored.collect()) == sorted(again.collect())


CRITERIA = {
    "cube": keys.cubic_metre,
    "half": lambda: keys.cell(0.5),
    "snap": lambda: keys.snap_grid(5, 4),
    "time": lambda: keys.time_bin(100),
    "echo": lambda: keys.attribute("echo"),
    "own": lambda: [(F.col("echo") % 2).alias("odd"), F.floor("x").alias("west")],
}


@pytest.mark.parametrize("name", CRITERIA)
def test_every_criterion_keeps_every_point(cloud, rows, name):
    built = grouping.build_patches(cloud, CRITERIA[name](), max_points=100, split_rows=300)
    points = patch.explode_patches(built, DIMS).collect()
    assert Counter(map(tuple, points)) == Counter(rows)
    assert built.agg(F.max("n")).first()[0] <= 100


def test_regroup_equals_grouping_directly(cloud):
    first = grouping.build_patches(cloud, keys.cubic_metre())
    second = grouping.regroup(first, keys.time_bin(1000))
    direct = grouping.build_patches(cloud, keys.time_bin(1000))
    assert sorted(second.collect()) == sorted(direct.collect())


def test_attribute_key_survives_regrouping(cloud, rows):
    by_echo = grouping.build_patches(cloud, keys.attribute("echo", "echo"))
    back = grouping.regroup(by_echo, keys.cubic_metre(), keep=["echo"])
    points = patch.explode_patches(back, DIMS).collect()
    assert Counter(map(tuple, points)) == Counter(rows)


def test_result_does_not_depend_on_partitioning(cloud):
    one = grouping.build_patches(cloud.coalesce(1), keys.cubic_metre(), max_points=50)
    many = grouping.build_patches(cloud.repartition(13), keys.cubic_metre(), max_points=50)
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize("split_rows", [1_000_000, 100])
def test_multiscale(cloud, rows, split_rows):
    fine = cubes(rows)
    expected = defaultdict(list)
    for cube, members in fine.items():
        for r in members:
            if len(members) >= 5:
                expected[(0, *cube)].append(r)
            else:
                expected[(1, *[5 * half_away(v / 5) for v in r[1:4]])].append(r)
    scales = keys.cubic_metre(), keys.cell(5)
    stats = grouping.multiscale_stats(cloud, *scales, 5)
    assert {(r.lvl, r.cx, r.cy, r.cz): r.n for r in stats.collect()} == {
        k: len(v) for k, v in expected.items()
    }
    keyed, key = grouping.multiscale_points(cloud, *scales, 5, split_rows=split_rows)
    built = grouping.build_patches(keyed, key, split_rows=split_rows)
    assert {(r.lvl, r.cx, r.cy, r.cz): (r.n, r.t_min, r.x_max) for r in built.collect()} == {
        k: (len(v), min(v)[0], max(p[1] for p in v)) for k, v in expected.items()
    }


def test_ties_and_signs(spark):
    values = [0.5, -0.5, 1.5, -1.5, 2.5, -2.5, 0.4, -0.4, 0.25, 0.75, 0.49999999999999994]
    values += [4503599627370497.0, 1e300, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ours = keys.snapped(F.col("x"), 1).alias("a")
    theirs = F.round("x").alias("b")
    for r in df.select("x", ours, theirs).collect():
        assert r.a == r.b, r.x
        assert math.copysign(1, r.a) == 1 or r.a != 0
    assert df.where("x in (0.4, -0.4)").groupBy(ours).count().count() == 1
    half = df.where("x in (0.25, 0.75)").select(keys.snapped(F.col("x"), 0.5).alias("h"))
    assert [r.h for r in half.collect()] == [0.5, 1.0]


def test_nan_and_null(spark):
    nan = float("nan")
    rows = [(1.0, 0.0, 0.0, nan, 1), (2.0, 0.1, 0.1, nan, 2), (3.0, 0.2, nan, 5.0, None)]
    df = spark.createDataFrame(rows, TYPE)
    built = grouping.build_patches(df, keys.cell(1, ["x"], ["cx"])).first()
    assert (built.n, built.z_min, built.z_max, built.y_max) == (3, 5.0, 5.0, 0.1)
    alone = grouping.build_patches(df.where("gps_time < 3"), keys.cell(1, ["x"], ["cx"])).first()
    assert alone.z_min is None and alone.n == 2
    # NaN keys form a group, and so do null keys.
    assert grouping.group_stats(df, keys.cubic_metre()).count() == 2
    assert grouping.group_stats(df, keys.attribute("echo")).count() == 3
    capped = grouping.build_patches(df, keys.attribute("echo"), max_points=1, split_rows=1)
    assert capped.agg(F.sum("n")).first()[0] == 3


def test_heavy_group_with_nan_and_null_keys(spark):
    nan = float("nan")
    rows = [(float(i), nan if i % 2 else None, 0.0, 0.0, i) for i in range(200)]
    df = spark.createDataFrame(rows, TYPE)
    built = grouping.build_patches(df, keys.cubic_metre(), max_points=30, split_rows=40)
    assert built.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()[:] == (200, 30, 8)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], TYPE)
    assert grouping.build_patches(empty, keys.cubic_metre()).count() == 0
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5)], TYPE)
    built = grouping.build_patches(one, keys.cubic_metre(), pcid=3).first()
    assert (built.pcid, built.chunk, built.n, built.x, built.t_min) == (3, 0, 1, [2.0], 1.0)
    with pytest.raises(ValueError):
        grouping.build_patches(one, keys.cubic_metre(), max_points=0)


def test_row_ids_follow_the_order(cloud, rows):
    numbered = row_ids(cloud, DIMS, runs=7, distinct_order=False)
    found = [tuple(r)[:5] for r in sorted(numbered.collect(), key=lambda r: r.gid)]
    assert found == sorted(rows)
    assert sorted(r.gid for r in numbered.select("gid").collect()) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("split_rows", [1_000_000, 50])
@pytest.mark.parametrize("max_points", [4096, 64])
def test_laid_out_patches_are_the_same(cloud, max_points, split_rows):
    limits = {"max_points": max_points, "split_rows": split_rows}
    plain = grouping.build_patches(cloud, keys.cubic_metre(), **limits)
    laid = grouping.build_patches(cloud, keys.cubic_metre(), place=keys.along_curve(), **limits)
    assert sorted(laid.collect()) == sorted(plain.collect())


def test_laid_out_partitions_do_not_overlap(cloud):
    laid = grouping.build_patches(cloud, keys.period(1), place=keys.along_time(), max_points=64)
    spans = laid.groupBy(F.spark_partition_id()).agg(F.min("tbin"), F.max("tbin")).collect()
    ends = sorted((r[1], r[2]) for r in spans)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("place", [None, keys.along_curve])
@pytest.mark.parametrize("max_points", [4096, 64])
def test_building_shuffles_points_once(cloud, capsys, max_points, place):
    where = place and place()
    grouping.build_patches(
        cloud.coalesce(1), keys.cubic_metre(), max_points=max_points, place=where
    ).explain()
    plan = capsys.readouterr().out
    # The fixture's own repartition is one more.
    assert plan.count("- Exchange ") == 2


def test_stretches_refine_heavy_cells(spark, monkeypatch):
    """A place with most weight in one coarse cell is still cut evenly, in order, cell by cell."""
    monkeypatch.setattr(grouping, "PLACE_CELLS", 200)
    rng = random.Random(12)
    at = [rng.randrange(1 << 40) for _ in range(3000)] + [(7 << 30) + rng.randrange(1 << 12) for _ in range(6000)]
    at += [(7 << 30) + 99] * 3000 + [-1] * 200
    df = spark.createDataFrame([(a, 1, i) for i, a in enumerate(at)], "_at long, _n long, i long").repartition(3)
    stretches = grouping.Stretches(df.select("_at", "_n"), 24)
    assert len(stretches.levels) > 2
    sent = stretches.send(df, F.col("i")).select("_at", F.spark_partition_id().alias("p")).collect()
    assert sorted(r._at for r in sent) == sorted(at)
    sizes = Counter(r.p for r in sent)
    share = len(at) / 24
    assert len(sizes) >= 22 and max(sizes.values()) < 2 * share
    # Tasks follow each other along the place; they share nothing but the one heavy spot.
    ends = sorted((min(r._at for r in sent if r.p == p), max(r._at for r in sent if r.p == p)) for p in sizes)
    overlaps = [(a, b) for a, b in zip(ends, ends[1:]) if a[1] >= b[0]]
    assert all(a[1] == b[0] == (7 << 30) + 99 or b[0] == (7 << 30) + 99 for a, b in overlaps)


def test_nothing_to_lay_out(spark):
    none = spark.createDataFrame([], "_at long, _n long")
    assert grouping.Stretches(none).send(none, F.lit(0)).collect() == []


def test_runs_are_not_more_than_tasks(spark):
    """A run is a task: a small limit on many rows must not make one per few rows."""
    assert grouping.run_count(100, 40, 8) == 3
    assert grouping.run_count(3_600_000, 20, 8) == 8
    assert grouping.run_count(36_000_000, 200, 8) == 37  # of a million rows at most
    assert grouping.run_count(36_000_000, 2_000_000, 8) == 19


def test_many_heavy_groups_in_few_runs(spark, monkeypatch):
    made = []
    real = grouping.sorted_runs
    monkeypatch.setattr(grouping, "sorted_runs", lambda df, order, runs, **more: made.append(runs) or real(df, order, runs, **more))
    df = spark.range(4000).selectExpr("id % 40 AS echo", "double(id % 7) AS gps_time", "double(id) AS x")
    capped, _ = grouping.capped_points(df, keys.attribute("echo", "echo"), 10, split_rows=20)
    found = {(r.echo, r.chunk): r.xs for r in capped.groupBy("echo", "chunk").agg(F.collect_set("x").alias("xs")).collect()}
    for echo in range(40):
        members = sorted(((i % 7, float(i)) for i in range(echo, 4000, 40)))
        for chunk in range(10):
            assert set(found[(echo, chunk)]) == {x for _, x in members[10 * chunk : 10 * chunk + 10]}
    assert made == [8]
