"""PLY and text files, schemas, streams."""

import os
import struct
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lidarlake.functions import keys
from lidarlake.functions.text import c_number
from lidarlake.functions.times import epoch_seconds
from lidarlake.operators import grouping, layout, patch
from lidarlake.operators import points as pt
from lidarlake.sources import ply, registry, schemas, text
from lidarlake.streaming.load import load_patches
from lidarlake.streaming.time_patches import time_bins

NAN, INF = float("nan"), float("inf")

# Name and kind of each property of the 22-value point, in file order.
WIDE = [
    ("GPS_time", "f8"),
    ("x_sensor", "f4"),
    ("y_sensor", "f4"),
    ("z_sensor", "f4"),
    ("x_origin_sensor", "f4"),
    ("y_origin_sensor", "f4"),
    ("z_origin_sensor", "f4"),
    ("x", "f4"),
    ("y", "f4"),
    ("z", "f4"),
    ("x_origin", "f4"),
    ("y_origin", "f4"),
    ("z_origin", "f4"),
    ("range", "f4"),
    ("theta", "f4"),
    ("phi", "f4"),
    ("num_echo", "u1"),
    ("nb_of_echo", "u1"),
    ("amplitude", "f4"),
    ("reflectance", "f4"),
    ("deviation", "f4"),
    ("background_radiation", "f4"),
]
NAMES = {"f8": "float64", "f4": "float32", "u1": "uint8", "u2": "uint16", "i4": "int32"}


def header(form, elements, end="\n", notes=()):
    lines = ["ply", f"format {form} 1.0", *notes]
    for name, count, properties in elements:
        lines += [f"element {name} {count}", *[f"property {p}" for p in properties]]
    return (end.join([*lines, "end_header"]) + end).encode()


def wide_points(count):
    rng = np.random.default_rng(1)
    data = np.zeros(count, [(n, k) for n, k in WIDE])
    for name, kind in WIDE:
        data[name] = rng.integers(0, 200, count) if kind == "u1" else rng.normal(0, 100, count)
    data["background_radiation"] = np.nan
    return data


def write(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as out:
        out.write(content)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    ply.register(spark)


def wide_file(folder, form, count=10_000):
    data = wide_points(count)
    properties = [f"{NAMES[k]} {n}" for n, k in WIDE]
    head = header(form, [("vertex", count, properties)])
    if form == "ascii":
        lines = [
            " ".join(repr(v.item()) if v.dtype.kind == "u" else f"{v:.17g}" for v in row)
            for row in data
        ]
        body = "\n".join(lines).encode() + b"\n"
    else:
        order = "<" if "little" in form else ">"
        body = data.astype(data.dtype.newbyteorder(order)).tobytes()
    write(folder, "points.ply", head + body)
    return data


@pytest.mark.parametrize("form", ["binary_little_endian", "binary_big_endian", "ascii"])
def test_all_encodings(spark, tmp_path, form):
    data = wide_file(tmp_path, form)
    reader = spark.read.format("ply").option("splitBytes", 100_000)
    df = reader.load(str(tmp_path))
    assert df.columns == [n for n, _ in WIDE]
    size = os.path.getsize(tmp_path / "points.ply")
    assert df.rdd.getNumPartitions() == -(-size // 100_000) > 1
    got = df.toPandas().sort_values("GPS_time")
    want = np.sort(data, order="GPS_time")
    for name, _ in WIDE:
        np.testing.assert_array_equal(got[name].to_numpy(), want[name])


@pytest.mark.parametrize("split", [1000, 77_777, 10_000_000])
def test_ascii_in_ranges(spark, tmp_path, split):
    data = wide_file(tmp_path, "ascii", 2000)
    reader = spark.read.format("ply").option("splitLines", "true").option("splitBytes", split)
    got = reader.load(str(tmp_path)).toPandas().sort_values("GPS_time")
    want = np.sort(data, order="GPS_time")
    for name, _ in WIDE:
        np.testing.assert_array_equal(got[name].to_numpy(), want[name])


def test_ascii_in_ranges_checks_lines(spark, tmp_path):
    head = header("ascii", [("vertex", 2, ["int x", "int y"])])
    write(tmp_path, "odd.ply", head + b"1 2 3\n4 5\n")
    reader = spark.read.format("ply").option("splitLines", "true").schema("x int")
    with pytest.raises(Exception, match="odd.ply"):
        reader.load(str(tmp_path)).collect()
    write(tmp_path / "b", "list.ply", list_file("ascii"))
    with pytest.raises(Exception, match="single element"):
        reader.load(str(tmp_path / "b")).collect()


def test_all_type_names(spark, tmp_path):
    names = "int8 uint8 int16 uint16 int32 uint32 float32 float64".split()
    names += "char uchar short ushort int uint float double".split()
    codes = "bBhHiIfd" * 2
    row = [-128, 255, -32768, 65535, -(2**31), 2**32 - 1, 0.5, -0.25] * 2
    head = header("binary_little_endian", [("vertex", 1, [f"{n} p{i}" for i, n in enumerate(names)])])
    write(tmp_path, "types.ply", head + struct.pack("<" + codes, *row))
    df = spark.read.format("ply").load(str(tmp_path / "types.ply"))
    assert list(df.first()) == row
    kinds = "tinyint smallint smallint int int bigint float double".split()
    assert [k for _, k in df.dtypes] == kinds * 2


LISTS = header(
    "{}",
    [
        ("vertex", 3, ["float x", "uchar e"]),
        ("face", 2, ["uint8 flag", "list uint8 int32 vertex_indices", "float64 w"]),
        ("edge", 2, ["int a", "int b"]),
    ],
).decode()


def list_file(form):
    if form == "ascii":
        body = b"1 1\n2 2 3\n3\n7 3 0 1 2 0.5 8 0 1.5\n1 2 3 4\n"
    else:
        body = struct.pack("<fBfBfB", 1, 1, 2, 2, 3, 3)
        body += struct.pack("<BB3id", 7, 3, 0, 1, 2, 0.5) + struct.pack("<BBd", 8, 0, 1.5)
        body += struct.pack("<4i", 1, 2, 3, 4)
    return LISTS.format(form).encode() + body


@pytest.mark.parametrize("form", ["binary_little_endian", "ascii"])
def test_lists_and_several_elements(spark, tmp_path, form):
    write(tmp_path, "list.ply", list_file(form))
    reader = spark.read.format("ply").option("splitBytes", 40)

    def rows(element):
        return [tuple(r) for r in reader.option("element", element).load(str(tmp_path)).collect()]

    assert rows("vertex") == [(1.0, 1), (2.0, 2), (3.0, 3)]
    assert rows("face") == [(7, [0, 1, 2], 0.5), (8, [], 1.5)]
    assert rows("edge") == [(1, 2), (3, 4)]
    only = reader.option("element", "face").schema("vertex_indices array<long>")
    assert [r[0] for r in only.load(str(tmp_path)).collect()] == [[0, 1, 2], []]


def test_selected_attributes_and_source(spark, tmp_path):
    data = wide_file(tmp_path, "binary_little_endian", 100)
    df = (
        spark.read.format("ply")
        .schema("num_echo int, GPS_time double, source_file string")
        .load(str(tmp_path))
    )
    got = df.toPandas()
    np.testing.assert_array_equal(got["num_echo"], data["num_echo"])
    assert got["source_file"].unique()[0].endswith("points.ply")
    with pytest.raises(Exception, match="no property nothing"):
        spark.read.format("ply").schema("nothing int").load(str(tmp_path)).collect()


def test_line_ends_and_comments(spark, tmp_path):
    notes = ["comment made by hand", "obj_info scanner 7"]
    body = struct.pack("<ff", 10.0, 13.0)
    elements = [("vertex", 2, ["float32 x"])]
    write(tmp_path, "crlf.ply", header("binary_little_endian", elements, "\r\n", notes) + body)
    inside = header("binary_little_endian", elements).replace(
        b"property", b"comment between\nproperty"
    )
    write(tmp_path, "lf.ply", inside + body)
    df = spark.read.format("ply").load(str(tmp_path))
    assert sorted(r.x for r in df.collect()) == [10.0, 10.0, 13.0, 13.0]
    heads = {r.path.rsplit("/", 1)[1]: r for r in ply.ply_headers(spark, str(tmp_path)).collect()}
    assert heads["crlf.ply"].comments == ["made by hand"]
    assert heads["crlf.ply"].obj_infos == ["scanner 7"]
    assert heads["lf.ply"].comments == ["between"]
    assert (heads["lf.ply"].instances, heads["lf.ply"].type) == (2, "float32")


def test_headers_of_all_elements(spark, tmp_path):
    write(tmp_path, "list.ply", list_file("ascii"))
    rows = ply.ply_headers(spark, str(tmp_path)).orderBy("element_position", "property_position")
    got = [(r.element, r.instances, r.property, r.type, r.length_type) for r in rows.collect()]
    assert got[2:5] == [
        ("face", 2, "flag", "uint8", None),
        ("face", 2, "vertex_indices", "int32", "uint8"),
        ("face", 2, "w", "float64", None),
    ]
    assert len(got) == 7


def test_empty_element_and_empty_folder(spark, tmp_path):
    write(tmp_path / "a", "empty.ply", header("binary_little_endian", [("vertex", 0, ["int x"])]))
    df = spark.read.format("ply").load(str(tmp_path / "a"))
    assert df.count() == 0 and df.dtypes == [("x", "int")]
    os.makedirs(tmp_path / "none")
    assert spark.read.format("ply").schema("x int").load(str(tmp_path / "none")).count() == 0


BROKEN = {
    "bad_magic": b"plx\n",
    "bad_version": header("ascii", [("vertex", 1, ["int x"])]).replace(b"1.0", b"2.0") + b"1",
    "bad_type": header("ascii", [("vertex", 1, ["int128 x"])]) + b"1",
    "no_end": b"ply\nformat ascii 1.0\nelement vertex 1\n",
    "short": header("binary_little_endian", [("vertex", 9, ["int x"])]) + b"\0" * 35,
    "short_text": header("ascii", [("vertex", 3, ["int x"])]) + b"1 2\n",
    "not_whole": header("ascii", [("vertex", 2, ["int x"])]) + b"1 2.5\n",
    "too_large": header("ascii", [("vertex", 2, ["uint8 x"])]) + b"1 256\n",
    "infinite": header("ascii", [("vertex", 2, ["float32 x"])]) + b"1 inf\n",
    "a_word": header("ascii", [("vertex", 2, ["float32 x"])]) + b"1 one\n",
}


def test_small_files_share_tasks(spark, tmp_path):
    head = header("binary_little_endian", [("vertex", 1, ["int x"])])
    for i in range(30):
        write(tmp_path, f"{i}.ply", head + struct.pack("<i", i))
    df = spark.read.format("ply").option("splitBytes", 10 << 20).load(str(tmp_path))
    assert df.rdd.getNumPartitions() <= 4
    assert sorted(r.x for r in df.collect()) == list(range(30))


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files_are_named(spark, tmp_path, name):
    write(tmp_path, f"{name}.ply", BROKEN[name])
    with pytest.raises(Exception, match=f"{name}.ply"):
        spark.read.format("ply").schema("x double").load(str(tmp_path)).collect()


def test_permissive_keeps_positions(spark, tmp_path):
    body = b"1 2.5 inf\n300 -nan 3\n"
    write(tmp_path, "a.ply", header("ascii", [("vertex", 2, ["uint8 a", "float b", "float c"])]) + body)
    df = spark.read.format("ply").option("mode", "PERMISSIVE").load(str(tmp_path))
    first, second = df.collect()
    assert tuple(first) == (1, 2.5, None)
    assert second.a is None and np.isnan(second.b) and second.c == 3.0


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select(
        F.col("id").cast("int").alias("i"),
        (F.col("id") / 7).alias("d"),
        F.when(F.col("id") % 2 == 0, (F.col("id") / 3).cast("float")).alias("f"),
    )
    df.repartition(3).write.format("ply").option("maxRecordsPerFile", 100).mode("append").save(path)
    files = [f for f in os.listdir(path) if f.endswith(".ply")]
    assert len(files) >= 10 and all(not f.endswith(".tmp") for f in os.listdir(path))
    back = spark.read.format("ply").load(path)
    missing = F.coalesce("f", F.lit(NAN).cast("float")).alias("f")
    assert sorted(back.select("i", "d").collect()) == sorted(df.select("i", "d").collect())
    assert back.where(F.isnan("f")).count() == df.select(missing).where(F.isnan("f")).count() == 500
    df.limit(10).write.format("ply").mode("overwrite").save(path)
    assert spark.read.format("ply").load(path).count() == 10
    with pytest.raises(Exception, match="no PLY type"):
        spark.range(1).write.format("ply").mode("append").save(path)


def test_shards(spark, tmp_path):
    for name in "cbade":
        write(tmp_path, f"{name}.ply", b"")
    names = [os.path.basename(p) for p in ply.shard_files(str(tmp_path), 2, 0)]
    assert names == ["a.ply", "c.ply", "e.ply"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate("cbadeabc")], "source_file string, i int")
    kept = ply.shard_rows(df, 2, 1)
    assert sorted(r.source_file for r in kept.collect()) == ["b", "b", "d"]


ASCII_HEAD = b"ply\nformat ascii 1.0\nelement vertex %d\nproperty int v\nend_header\n"


@pytest.mark.parametrize("lines", ["true", "false"])
def test_a_cut_ascii_file_is_refused(spark, tmp_path, lines):
    write(tmp_path, "a.ply", ASCII_HEAD % 100 + b"".join(b"%d\n" % i for i in range(40)))
    read = spark.read.format("ply").option("splitLines", lines).option("splitBytes", "64").load(str(tmp_path))
    with pytest.raises(Exception, match="header says|file ends"):
        read.collect()


def test_lines_are_counted_over_all_ranges(spark, tmp_path):
    write(tmp_path, "a.ply", ASCII_HEAD % 100 + b"".join(b"%d\n" % i for i in range(100)) + b"\n")
    read = spark.read.format("ply").option("splitLines", "true").option("splitBytes", "64").load(str(tmp_path))
    assert sorted(r.v for r in read.collect()) == list(range(100))


def test_underscored_numbers_are_refused(spark, tmp_path):
    write(tmp_path, "a.ply", ASCII_HEAD % 1 + b"1_0\n")
    with pytest.raises(Exception, match="1_0"):
        spark.read.format("ply").load(str(tmp_path)).collect()


def test_paths(spark, tmp_path):
    for i, name in enumerate(["a.ply", "sub/b.ply", "sub/deep/c.ply", "sub2/d.ply", "sub2/e.txt"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / os.path.dirname(name), os.path.basename(name), ASCII_HEAD % 1 + b"%d\n" % i)
    read = lambda *p: sorted(r.v for r in spark.read.format("ply").schema("v int").load([f"{tmp_path}/{x}" for x in p] if len(p) > 1 else f"{tmp_path}/{p[0]}").collect())
    assert read("") == [0, 1, 2, 3]
    assert read("sub") == [1, 2]
    assert read("sub*") == [1, 2, 3]
    assert read("sub*/?.ply") == [1, 3]
    assert read("a.ply", "sub2") == [0, 3]
    assert read("none*") == []
    with pytest.raises(Exception, match="no such file"):
        read("missing")


def test_point_text(spark, tmp_path):
    columns = [("t", "double"), ("e", "short"), ("r", "float")]
    lines = "54160.625 1 nan\n0.1 2 -nan\n1e-7 3 0.25\n5 4 \n"
    write(tmp_path / "in", "riegl.txt", lines.encode())
    df = text.read_points_text(spark, str(tmp_path / "in"), columns)
    got = df.orderBy("e").collect()
    assert [r.t for r in got] == [54160.625, 0.1, 1e-7, 5.0]
    assert np.isnan(got[0].r) and np.isnan(got[1].r) and got[2].r == 0.25 and got[3].r is None
    text.write_points_text(df, str(tmp_path / "out"))
    back = text.read_points_text(spark, str(tmp_path / "out"), columns).orderBy("e").collect()
    assert repr(back) == repr(got)


def test_bad_point_text(spark, tmp_path):
    columns = [("t", "double"), ("e", "int")]
    write(tmp_path, "a.txt", b"1.5 2\n1.5 two\n1.5\n1 2 3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_points_text(spark, str(tmp_path), columns).collect()
    kept = text.read_points_text(spark, str(tmp_path), columns, "PERMISSIVE").collect()
    assert len(kept) == 4 and kept[0]._corrupt_record is None
    assert [r._corrupt_record for r in kept[1:]] == ["1.5 two", "1.5", "1 2 3"]


def test_c_numbers(spark):
    values = [0.1, 1 / 3, 1e20, -2.5e-7, 123456789.123, NAN, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (8, 16):
        got = [r[0] for r in df.select(c_number(F.col("v"), digits)).collect()]
        assert got == [None if v is None else f"%.{digits}g" % v for v in values]
    line = text.point_lines(df.limit(1).select("v", F.col("v").cast("float").alias("f")), "c")
    assert line.first().value == "0.1 0.1" and len(values) == 8


def test_registry(spark):
    known = [schemas.DEMO, schemas.RIEGL, schemas.VELODYNE]
    dims = registry.dims_table(registry.formats_table(spark, known)).cache()
    counts = {r.pcid: r["count"] for r in dims.groupBy("pcid").count().collect()}
    assert counts == {1: 4, 2: 22, 3: 15}
    for schema in known:
        assert registry.point_schema(dims, schema.pcid) == schema
    odd = registry.size_mismatches(dims).where("pcid = 2").orderBy("position").collect()
    assert [r.name for r in odd] == ["x", "y", "z", "x_origin", "y_origin", "z_origin"]


def test_registry_document_by_hand(spark):
    document = """<?xml version="1.0" encoding="UTF-8"?>
      <pc:PointCloudSchema xmlns:pc="http://pointcloud.org/schemas/PC/1.1">
        <!-- a remark -->
        <pc:dimension><pc:position>1</pc:position><pc:size>2</pc:size>
          <pc:description>two
             lines</pc:description><pc:name>Intensity</pc:name>
          <pc:interpretation>UnsignedInteger </pc:interpretation></pc:dimension>
        <pc:metadata><Metadata name="compression">dimensional</Metadata></pc:metadata>
      </pc:PointCloudSchema>"""
    formats = spark.createDataFrame([(9, 0, "own", document)], "pcid int, srid int, name string, schema string")
    row = registry.dims_table(formats).first()
    assert (row.name, row.interpretation, row.scale, row.offset, row.compression) == (
        "Intensity",
        "UnsignedInteger",
        1.0,
        0.0,
        "dimensional",
    )
    own = registry.point_schema(registry.dims_table(formats), 9)
    assert pt.type_bounds(own) == {"Intensity": (0, 65535)}


def test_make_point_and_text(spark):
    values = F.array(*[F.lit(v) for v in (-127.258, 45.258, 124.157, 4.0)])
    df = spark.range(1).select(pt.make_point(schemas.DEMO, values).alias("p"))
    assert df.select(pt.get_attribute("p", "INTENSITY")).first()[0] == 4.0
    shown = df.select(patch.point_text("p")).first()[0]
    assert shown == '{"X":-127.258,"Y":45.258,"Z":124.157,"Intensity":4.0}'
    xyz = df.select("p.*").toDF("x", "y", "z", "i")
    assert xyz.select(patch.point_wkt()).first()[0] == "POINT Z (-127.258 45.258 124.157)"


def test_quantise_and_shift(spark):
    df = spark.createDataFrame([(1.2345, 2.0005, NAN)], "x double, y double, z double")
    stepped = pt.quantise_points(df, schemas.VELODYNE).first()
    assert stepped.x == pytest.approx(1.234, abs=1e-3) and np.isnan(stepped.z)
    moved = pt.georeference_points(df, schemas.VELODYNE).first()
    assert (moved.x, moved.y) == (649000 + 1.2345, 6840000 + 2.0005)


def test_validation(spark):
    rows = [(1, 1.0), (300, NAN), (-1, INF), (None, -INF), (255, None)]
    df = spark.createDataFrame(rows, "fiber int, x double").withColumn("x", F.col("x").cast("float"))
    limits = {"fiber": (0, 255), "x": (-3.4028234663852886e38, 3.4028234663852886e38)}
    got = {r.dim: tuple(r)[1:] for r in pt.validate(df, limits).collect()}
    assert got == {"fiber": (2, 0, 1), "x": (2, 1, 1)}
    good, bad = pt.split_valid(df, limits)
    assert (good.count(), bad.count()) == (2, 3)
    assert pt.require_valid(good, limits).count() == 2
    with pytest.raises(Exception, match="out of range"):
        pt.require_valid(df, limits).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_epoch_seconds_in_any_zone(spark, zone):
    times = ["2024-03-10 02:30:00.123456", "1969-12-31 23:59:59.5", "1950-07-01 12:00:00.25", "1900-01-01 00:00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in times], "t string")
        got = [r[0] for r in df.select(epoch_seconds(F.col("t").cast("timestamp_ntz"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wall = [datetime.fromisoformat(t).replace(tzinfo=timezone.utc) for t in times]
    assert got == [pytest.approx(w.timestamp(), abs=1e-7) for w in wall]


def test_attach_by_position(spark):
    df = spark.createDataFrame([(1.5, 7)], "range double, n int")
    named = pt.attach_schema(df, [("echo_range", "float"), ("fiber", "smallint")])
    assert named.dtypes == [("echo_range", "float"), ("fiber", "smallint")]
    with pytest.raises(ValueError):
        pt.attach_schema(df, [("a", "int")])


def test_ply_to_patches(spark, tmp_path):
    """The whole way in: files, schema, patches, points."""
    data = wide_file(tmp_path / "in", "binary_little_endian", 3000)
    files = spark.read.format("ply").load(str(tmp_path / "in"))
    points = pt.attach_schema(files, schemas.RIEGL_COLUMNS)
    built = grouping.build_patches(points, keys.cell(50), pcid=2)
    layout.write_patches(layout.cluster_by_space(built, 50.0), str(tmp_path / "out"))
    table = layout.read_patches(spark, str(tmp_path / "out"))
    back = patch.explode_patches(table).toPandas().sort_values("gps_time")
    want = np.sort(data, order="GPS_time")
    for (name, _), (column, _) in zip(WIDE, schemas.RIEGL_COLUMNS, strict=True):
        np.testing.assert_array_equal(back[column].to_numpy().astype("f8"), want[name].astype("f8"))


def test_stream_equals_batch(spark, tmp_path):
    columns = [("gps_time", "double"), ("x", "double"), ("y", "double"), ("z", "double")]
    landing, table, log = (str(tmp_path / n) for n in ("landing", "table", "log"))
    total = []

    def arrive(name, shift):
        rows = [(i + shift, i % 5 + 0.25, 0.0, 1.0) for i in range(100)]
        total.extend(rows)
        write(landing, name, "\n".join(" ".join(map(str, r)) for r in rows).encode() + b"\n")

    def load():
        arriving = text.read_points_text_stream(spark, landing, columns, files_per_batch=1)
        load_patches(arriving, keys.cubic_metre(), table, log, once=True).awaitTermination()

    arrive("a.txt", 0)
    arrive("b.txt", 1000)
    load()
    arrive("c.txt", 2000)
    load()
    load()
    stored = layout.read_patches(spark, table)
    assert stored.select("batch_id").distinct().count() == 3
    got = patch.explode_patches(stored, [n for n, _ in columns]).collect()
    assert sorted(map(tuple, got)) == sorted(total)


def test_stream_of_time_bins(spark, tmp_path):
    rows = [(i * 0.033, float(i)) for i in range(1000)] + [(1e6, 0.0)]
    points = spark.createDataFrame(rows, "gps_time double, x double")
    points.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    bins = time_bins(arriving, 100, "1 second", stats=("x",))
    query = (
        bins.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = grouping.group_stats(points.where("gps_time < 1e6"), keys.time_bin(100), stats=("x",))
    got = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_mixed_files_hold_fibers_beyond_16_bits(spark, tmp_path):
    """The maker of 16-bit files keeps points with larger numbers too, and both queries still agree with the cloud."""
    from lidarlake.plans import catalogue

    rows = [
        (fiber, n, float(n + 1), 1000.0 * n, 0.05, 0.01 * n, "A", "F", datetime(1998, 1, 1 + n))
        for fiber in (0, 7, 32767, 32768, 59_999, 2_000_000)
        for n in (1, 2, 3, 4)
    ]
    kind = (
        "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    )
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    read = catalogue.ply_mixed_read(spark, str(tmp_path)).select("fiber", "num_echo", "x", "echo_range").collect()
    assert sorted(map(str, read)) == sorted(
        str(Row(fiber=r[0], num_echo=r[1], x=r[2], echo_range=r[5] if r[1] % 2 else None)) for r in rows
    )
    told = {r.property: r for r in catalogue.ply_property_types(spark, str(tmp_path)).collect()}
    assert (told["fiber"].stored, told["fiber"].spark_type) == ("int16,int32", "int")
    assert told["echo_range"].lacking and not told["fiber"].lacking


def test_sink_is_bounded_by_bytes(tmp_path, monkeypatch):
    """A batch of long lists is laid out in small pieces, and files end by bytes as well as by records."""
    from pyspark.sql import types as T

    from lidarlake.sources import ply_sink

    monkeypatch.setattr(ply_sink, "_PIECE_BYTES", 4000)
    monkeypatch.setattr(ply_sink, "_FILE_BYTES", 20_000)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    lists = [[float(i)] * (2000 if i == 7 else i % 50) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], names=["n", "x"])
    sink = ply_sink.PlySink(str(tmp_path), schema, False, {"element": "patch"})
    pieces, real = [], sink._records
    monkeypatch.setattr(sink, "_records", lambda piece: pieces.append((piece.num_rows, len(out := real(piece)))) or out)
    sink.commit([sink.write(iter([batch.slice(0, 100), batch.slice(100)]))])
    assert all(size <= 4000 or rows == 1 for rows, size in pieces) and sum(rows for rows, _ in pieces) == 300
    assert len(list(tmp_path.glob("*.ply"))) > 3
    reader = ply.PlyReader(str(tmp_path), schema, {"element": "patch"})
    read = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted((r["n"], r["x"]) for r in read) == list(enumerate(lists))
