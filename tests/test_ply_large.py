"""PLY lists by index, writing in all encodings, and headers that disagree."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lidarlake.operators import grouping
from lidarlake.functions import keys
from lidarlake.sources import ply, registry, schemas

LISTS = "id int, xs array<double>, k smallint, tags array<tinyint>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    ply.register(spark)


def list_rows(count, seed=1):
    rng = random.Random(seed)
    return [
        (i, [rng.random() for _ in range(rng.choice((0, 1, 3, 40)))], i % 300, [rng.randint(-128, 127) for _ in range(i % 5)])
        for i in range(count)
    ]


@pytest.mark.parametrize("encoding", ["binary_little_endian", "binary_big_endian", "ascii"])
def test_lists_written_and_read_back(spark, tmp_path, encoding):
    rows = list_rows(500)
    frame = spark.createDataFrame(rows, LISTS).repartition(3)
    path = f"{tmp_path}/lists"
    frame.write.format("ply").option("element", "strip").option("encoding", encoding).option("maxRecordsPerFile", 100).mode("append").save(path)
    got = spark.read.format("ply").option("element", "strip").load(path)
    assert sorted(map(tuple, got.select("id", "xs", "k", "tags").collect())) == sorted(rows)
    some = spark.read.format("ply").option("element", "strip").schema("tags array<tinyint>").load(path)
    assert sorted(r.tags for r in some.collect()) == sorted(r[3] for r in rows)
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([(1, 2.0)], "a int, b float").write.format("ply").option("encoding", encoding).mode("append").save(empty)
    assert spark.read.format("ply").load(empty).collect() == [(1, 2.0)]
    with pytest.raises(Exception, match="missing value"):
        spark.createDataFrame([(1, None)], "a int, b array<int>").write.format("ply").mode("append").save(empty)
    with pytest.raises(Exception, match="encoding"):
        frame.write.format("ply").option("encoding", "utf").mode("append").save(empty)


def test_an_index_splits_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "_BLOCK_BYTES", 700)  # records across blocks
    rows = list_rows(1000)
    path = str(tmp_path / "one")
    frame = spark.createDataFrame(rows, LISTS).coalesce(1)
    frame.write.format("ply").option("element", "strip").option("encoding", "binary_big_endian").mode("append").save(path)
    index = ply.record_index(spark, path, "strip", every=30)
    notes = index.orderBy("record").collect()
    assert len(notes) >= 30 and sum(r.records for r in notes) == 1000
    assert all(a.end == b.byte and a.record + a.records == b.record for a, b in zip(notes, notes[1:]))
    index.write.parquet(str(tmp_path / "index"))
    got = ply.read_indexed(spark.read.parquet(str(tmp_path / "index")), LISTS, "strip")
    assert got.rdd.getNumPartitions() == len(notes)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    named = ply.read_indexed(index, "id int, source_file string", "strip").select("source_file").distinct().collect()
    assert len(named) == 1 and named[0][0].endswith(".ply")
    # A file that has changed since is refused.
    file = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".ply"))
    data = bytearray(open(file, "rb").read())
    at = data.index(b"end_header\n") + 15
    data[at : at + 4] = struct.pack(">i", 9999)
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="indexed"):
        got.collect()


def test_an_index_of_a_cut_file(spark, tmp_path):
    path = str(tmp_path / "cut")
    spark.createDataFrame(list_rows(200), LISTS).coalesce(1).write.format("ply").mode("append").save(path)
    file = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".ply"))
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-7])
    for read in (lambda: ply.record_index(spark, path).collect(), lambda: spark.read.format("ply").load(path).collect()):
        with pytest.raises(Exception, match="file ends before all values"):
            read()


def test_lines_are_counted_in_ranges(spark, tmp_path):
    path = tmp_path / "lines"
    rows = [(i, i / 7) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b double")
    frame.repartition(2).write.format("ply").option("encoding", "ascii").mode("append").save(str(path))
    assert ply.check_lines(spark, str(path), split_bytes=1000).collect() == []
    got = ply.read_lines(spark, str(path), split_bytes=1000)
    assert got.rdd.getNumPartitions() > 20 and sorted(map(tuple, got.collect())) == rows
    file = sorted(p for p in path.iterdir() if p.suffix == ".ply")[0]
    whole = file.read_bytes()
    cut = whole[: whole.rindex(b"\n", 0, len(whole) - 1) + 1]
    for broken, lines in ((cut, -1), (whole + b"5 6.0\n", 1), (whole + b"\n \n", 0), (whole.rstrip(b"\n"), 0)):
        file.write_bytes(broken)
        for size in (100, 777, 10**9):
            wrong = ply.check_lines(spark, str(path), split_bytes=size).collect()
            assert [(r.lines - r.expected) for r in wrong] == ([lines] if lines else [])
    file.write_bytes(cut)
    with pytest.raises(ply.PlyError, match="the header says"):
        ply.read_lines(spark, str(path), split_bytes=500)


def make(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.format("ply").mode("append").save(path)


def test_headers_that_disagree(spark, tmp_path):
    path = str(tmp_path / "mixed")
    make(spark, path, [(1 / 3, 5, 2.5, 1)], "x double, n tinyint, f float, only int")
    make(spark, path, [(0.1, 70_000, 7)], "x float, n int, f smallint")
    make(spark, path, [(0.1, 300, 7)], "x float, n smallint, f int")
    told = {r.property: r for r in ply.property_types(spark, path).collect()}
    assert {p: r.spark_type for p, r in told.items()} == {"x": "double", "n": "int", "f": "double", "only": "int"}
    assert told["only"].missing == 2 and told["only"].files == 1 and told["x"].missing == 0
    assert all(r.conflict for r in told.values())
    assert told["x"].stored_types == ["float32", "float64"]
    read = spark.read.format("ply").schema(ply.common_schema(spark, path)).option("missing", "null").load(path)
    got = sorted(read.select("x", "n", "f", "only").collect())
    single = struct.unpack("f", struct.pack("f", 0.1))[0]
    assert sorted(map(tuple, got)) == sorted([(1 / 3, 5, 2.5, 1), (single, 70_000, 7.0, None), (single, 300, 7.0, None)])
    with pytest.raises(Exception, match="no property only"):
        spark.read.format("ply").schema("only int").load(path).collect()


def test_digits_are_not_lost_unasked(spark, tmp_path):
    path = str(tmp_path / "wide")
    make(spark, path, [(1 / 3, 1)], "x double, n int")
    with pytest.raises(Exception, match="lose digits"):
        spark.read.format("ply").schema("x float").load(path).collect()
    assert spark.read.format("ply").schema("x float").option("narrow", "true").load(path).first().x == pytest.approx(1 / 3)
    assert spark.read.format("ply").schema("n int").load(path).first().n == 1


def test_a_list_beside_a_number(spark, tmp_path):
    path = str(tmp_path / "torn")
    make(spark, path, [([1],)], "v array<int>")
    make(spark, path, [(1,)], "v int")
    told = ply.property_types(spark, path).first()
    assert told.is_list and told.spark_type is None and told.conflict
    with pytest.raises(ply.PlyError, match="v"):
        ply.common_schema(spark, path)
    lists = str(tmp_path / "lists")
    make(spark, lists, [([1],)], "v array<int>")
    make(spark, lists, [([0.5],)], "v array<float>")
    assert ply.common_schema(spark, lists).simpleString() == "struct<v:array<double>>"


def test_conformance_with_all_schemas(spark):
    known = [schemas.DEMO, schemas.RIEGL, schemas.VELODYNE]
    dims = registry.dims_table(registry.formats_table(spark, known))
    rows = [(1.0, 70_000, 300, float("nan")), (2.0, 5, -1, 1e39), (None, None, 255, -2.0)]
    cloud = spark.createDataFrame(rows, "X double, echo_range long, FIBER int, z double")
    got = {(r.pcid, r.name): r for r in registry.conformance(cloud, dims).collect()}
    assert len(got) == 41 and all(r.description for r in got.values())
    # One column answers for several schemas, each with its own range.
    assert (got[3, "echo_range"].out_of_range, got[3, "echo_range"].nulls) == (1, 1)
    assert got[2, "echo_range"].out_of_range == 0
    assert got[3, "fiber"].out_of_range == 2 and got[3, "fiber"].nans == 0
    assert (got[2, "z"].out_of_range, got[2, "z"].nans) == (1, 1) and got[3, "z"].out_of_range == 0
    assert got[1, "X"].present and got[1, "X"].nulls == 1
    assert not got[2, "theta"].present and got[2, "theta"].out_of_range is None
    assert {n for (p, n), r in got.items() if not r.size_fits and p == 2} == {"x", "y", "z", "x_origin", "y_origin", "z_origin"}
    nothing = registry.conformance(cloud.select(F.lit(1).alias("other")), dims)
    assert nothing.where("present").count() == 0 and nothing.count() == 41
    assert registry.conformance(cloud.where("false"), dims).where("present").agg(F.sum("out_of_range")).first()[0] == 0


def test_written_clouds_of_all_encodings_group_alike(spark, tmp_path):
    rng = random.Random(3)
    cloud = spark.createDataFrame([(rng.uniform(0, 9), rng.uniform(-3, 3), 1.0, 2.0) for _ in range(400)], "gps_time double, x double, y double, z double")
    plain = sorted(map(str, grouping.group_stats(cloud, keys.cubic_metre()).collect()))
    for encoding in ("ascii", "binary_big_endian"):
        path = f"{tmp_path}/{encoding}"
        cloud.write.format("ply").option("encoding", encoding).mode("append").save(path)
        back = spark.read.format("ply").option("splitLines", "true").option("splitBytes", "2000").load(path)
        assert sorted(map(str, grouping.group_stats(back, keys.cubic_metre()).collect())) == plain
