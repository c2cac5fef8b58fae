"""The registry of point schemas: XML documents in, one row per dimension out."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.operators.points import judgement, type_bounds
from lidarlake.sources.schemas import Dimension, PointSchema

# The namespace and element names of a schema document.
NAMESPACE = "http://pointcloud.org/schemas/PC/1.1"
_DIMENSION_TYPE = (
    "struct<`pc:position`: int, `pc:size`: int, `pc:description`: string, `pc:name`: string, "
    "`pc:interpretation`: string, `pc:scale`: double, `pc:offset`: double>"
)
_METADATA_TYPE = "struct<Metadata: array<struct<_VALUE: string, _name: string>>>"
_DOCUMENT_TYPE = f"`pc:dimension` array<{_DIMENSION_TYPE}>, `pc:metadata` {_METADATA_TYPE}"


def schema_document(schema: PointSchema) -> str:
    """The XML document that declares a point schema."""

    def field(name: str, value: object) -> str:
        return f"<pc:{name}>{escape(str(value))}</pc:{name}>"

    dimensions = "".join(
        "<pc:dimension>"
        + field("position", d.position)
        + field("size", d.size)
        + field("description", d.description)
        + field("name", d.name)
        + field("interpretation", d.interpretation)
        + field("scale", d.scale)
        + field("offset", d.offset)
        + "</pc:dimension>"
        for d in schema.dimensions
    )
    metadata = f'<Metadata name="compression">{escape(schema.compression)}</Metadata>'
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><pc:PointCloudSchema xmlns:pc="{NAMESPACE}">'
        f"{dimensions}<pc:metadata>{metadata}</pc:metadata></pc:PointCloudSchema>"
    )


def formats_table(spark: SparkSession, schemas: Iterable[PointSchema]) -> DataFrame:
    """``formats(pcid, srid, name, schema)`` with one document per point schema."""
    rows = [(s.pcid, s.srid, s.name, schema_document(s)) for s in schemas]
    return spark.createDataFrame(rows, "pcid int, srid int, name string, schema string")


def dims_table(formats: DataFrame) -> DataFrame:
    """One row per dimension of each document; a missing scale is 1, an offset 0."""
    parsed = formats.select(
        "pcid", "srid", "name", F.from_xml("schema", _DOCUMENT_TYPE, {"mode": "FAILFAST"}).alias("doc")
    )
    named = F.filter(F.col("doc.`pc:metadata`.Metadata"), lambda m: m["_name"] == "compression")
    rows = parsed.select(
        "pcid",
        "srid",
        F.col("name").alias("schema_name"),
        F.trim(F.get(named, F.lit(0))["_VALUE"]).alias("compression"),
        F.explode("doc.`pc:dimension`").alias("d"),
    )
    return rows.select(
        "pcid",
        "srid",
        "schema_name",
        "compression",
        F.col("d.`pc:position`").alias("position"),
        F.col("d.`pc:size`").alias("size"),
        F.trim("d.`pc:name`").alias("name"),
        F.trim("d.`pc:interpretation`").alias("interpretation"),
        F.coalesce("d.`pc:scale`", F.lit(1.0)).alias("scale"),
        F.coalesce("d.`pc:offset`", F.lit(0.0)).alias("offset"),
        F.trim("d.`pc:description`").alias("description"),
    )


def point_schema(dims: DataFrame, pcid: int) -> PointSchema:
    """One schema of the table, for building expressions: a row per dimension."""
    rows = dims.where(F.col("pcid") == pcid).orderBy("position").collect()
    if not rows:
        raise ValueError(f"no point schema {pcid}")
    dimensions = tuple(
        Dimension(r.position, r.size, r.name, r.interpretation, r.scale, r.offset, r.description or "")
        for r in rows
    )
    first = rows[0]
    return PointSchema(pcid, first.schema_name, dimensions, first.srid, first.compression)


def size_mismatches(dims: DataFrame) -> DataFrame:
    """Dimensions whose size does not fit their interpretation; the latter is used."""
    needed = F.when(F.col("interpretation") == "double", 8).when(
        F.col("interpretation") == "float", 4
    )
    return dims.where(F.col("size") != needed).withColumn("expected_size", needed)


def conformance(points: DataFrame, dims: DataFrame) -> DataFrame:
    """How a cloud fits every registered schema at once: all rows of ``dims``, judged.

    ``present`` says whether the cloud has a column of that name, in any case. Then ``out_of_range``, ``nans`` and ``nulls`` count
    its values against the interpretation, all in one pass over the cloud, and are null otherwise. ``size_fits``
    tells whether the size in bytes is that of the interpretation; the latter decides.
    """
    listed = dims.orderBy("pcid", "position").collect()
    columns = {c.lower(): c for c in points.columns}
    tests = []
    for pcid in sorted({r.pcid for r in listed}):
        bounds = type_bounds(point_schema(dims, pcid))
        tests += [(pcid, d, columns[d.lower()], b) for d, b in bounds.items() if d.lower() in columns]
    # Equal tests of several schemas are made once.
    asked = {(column, bound): f"t{i}" for i, (column, bound) in enumerate(dict.fromkeys((c, b) for _, _, c, b in tests))}
    judged = [judgement(points, column, *bound).alias(name) for (column, bound), name in asked.items()]
    kind = "pcid int, name string, out_of_range long, nans long, nulls long"
    found = []
    if tests:
        row = points.agg(*judged).first()
        found = [(pcid, d, *row[asked[column, bound]]) for pcid, d, column, bound in tests]
    fit = dims.sparkSession.createDataFrame(found, kind)
    wrong = size_mismatches(dims).select("pcid", "name", F.lit(False).alias("_fits"))
    rows = dims.join(F.broadcast(fit), ["pcid", "name"], "left").join(wrong, ["pcid", "name"], "left")
    return rows.withColumn("present", F.col("nulls").isNotNull()).withColumn(
        "size_fits", F.coalesce("_fits", F.lit(True))
    ).drop("_fits")
