"""Streamed time patches, whatever order points come in."""

import random

import pytest

from lidarlake.functions import keys
from lidarlake.operators import grouping, patch
from lidarlake.sources.files import children, read_text, rename_into
from lidarlake.streaming import time_patches as tp

TYPE = "gps_time double, x double, y double, z double, echo int"
SMALL = {"max_points": 10}


@pytest.fixture()
def stream(spark, tmp_path):
    """Write one batch of rows, load what has arrived, compare with grouping all at once."""
    landing, table = f"{tmp_path}/landing", f"{tmp_path}/table"
    sent = []

    def arrive(rows):
        spark.createDataFrame(rows, TYPE).coalesce(1).write.mode("append").parquet(landing)
        sent.extend(rows)

    def load(log="log"):
        arriving = spark.readStream.schema(TYPE).option("maxFilesPerTrigger", 1).parquet(landing)
        tp.time_patches(arriving, 1000, table, f"{tmp_path}/{log}", once=True, pcid=3, **SMALL).awaitTermination()

    def check(times=1):
        plain = grouping.build_patches(spark.createDataFrame(sent * times, TYPE), keys.time_bin(1000), pcid=3, **SMALL)
        got = tp.read_time_patches(spark, table, **SMALL)
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        stats = grouping.group_stats(spark.createDataFrame(sent * times, TYPE), keys.time_bin(1000))
        summed = tp.bin_stats(tp.read_parts(spark, table)).drop("pcid")
        assert sorted(map(str, summed.collect())) == sorted(map(str, stats.select(summed.columns).collect()))

    return arrive, load, check, table


def cloud(rng, count, lo, hi):
    return [(round(rng.uniform(lo, hi), 2), rng.random(), 0.0, None, rng.randint(1, 3)) for _ in range(count)]


def test_late_and_disordered_points_and_an_open_bin(spark, stream):
    arrive, load, check, table = stream
    rng = random.Random(2)
    arrive(cloud(rng, 300, 5, 20))
    arrive(cloud(rng, 200, 19.6, 40))
    load()
    check()
    arrive(cloud(rng, 100, 0, 40))  # late everywhere
    arrive([(7.0, 1.0, 1.0, 1.0, 1)] * 30 + [(None, 1.0, 1.0, 1.0, 1), (float("nan"), 1.0, 1.0, 1.0, 1)])
    arrive([(1e7, 0.0, 0.0, 0.0, 1)])  # one far ahead closes nothing
    arrive([(3.3, 0.0, 0.0, 0.0, 1)])
    load()
    load()
    check()
    parts = tp.read_parts(spark, table)
    assert parts.groupBy("tbin", "chunk").count().where("count > 1").count() > 10


def test_compaction(spark, stream):
    arrive, load, check, table = stream
    rng = random.Random(3)
    for lo in (0, 5):
        arrive(cloud(rng, 200, lo, lo + 8))
    load()
    before = tp.read_time_patches(spark, table, **SMALL)
    assert tp.compact(spark, table, **SMALL) == 1
    check()
    whole = tp.read_parts(spark, table)
    assert "whole" in whole.inputFiles()[0] and tp.merge_parts(whole, **SMALL) is whole
    arrive(cloud(rng, 100, 3, 15))
    load()
    check()
    assert tp.compact(spark, table, **SMALL) == 2
    load("another")  # a second stream brings every file again
    check(2)
    assert before.count() > 0  # a reader of the first parts still has its files


def test_merging_moves_only_open_bins(spark, stream, capsys):
    arrive, load, _, table = stream
    rng = random.Random(4)
    arrive(cloud(rng, 100, 0, 10))
    arrive(cloud(rng, 100, 9, 20))
    load()
    parts = tp.read_parts(spark, table)
    whole = tp.merge_parts(parts, **SMALL)
    untouched = parts.groupBy("tbin").count().where("count = 1").count()
    assert untouched > 5
    capsys.readouterr()
    whole.explain()
    plan = capsys.readouterr().out
    # What stays is neither shuffled nor sorted: scan, join, project up to the union.
    stays = plan.split("Union")[1].split("LeftAnti")[0]
    assert "Exchange" not in stays and "Sort" not in stays


def test_unfinished_batches_and_rival_compactions(spark, stream, tmp_path):
    arrive, load, check, table = stream
    with pytest.raises(ValueError):
        tp.read_parts(spark, table)
    arrive(cloud(random.Random(5), 50, 0, 5))
    load()
    load_id = children(spark, f"{table}/parts")[0]
    # A batch that is being written has no mark of success yet.
    tp.read_parts(spark, table).write.parquet(f"{table}/parts/{load_id}/batch_id=77")
    (tmp_path / "table" / "parts" / load_id / "batch_id=77" / "_SUCCESS").unlink()
    check()
    rename_into(spark, "x", f"{table}/note")
    with pytest.raises(FileExistsError):
        rename_into(spark, "y", f"{table}/note")
    assert read_text(spark, f"{table}/note") == "x"
    assert [n for n in children(spark, table) if n.startswith(".")] == []


def test_exploded_parts_hold_every_point(spark, stream):
    arrive, load, _, table = stream
    rows = cloud(random.Random(6), 80, 0, 3)
    arrive(rows)
    load()
    got = patch.explode_patches(tp.read_parts(spark, table), ["gps_time", "x", "y", "z", "echo"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
