"""The same queries as SQL over the given tables, for checking."""

from __future__ import annotations

from lidarlake.operators.grouping import MAX_POINTS
from lidarlake.plans.views import HOLE, OUTLINE
from lidarlake.sources.schemas import DEMO, RIEGL, VELODYNE

# A patch is a (group, chunk): chunks number the points of a group in their order.
_POINT_ORDER = "gps_time, x, y, z, num_echo, fiber, echo_range, source_file"


def _chunk(partition: str, size: int = MAX_POINTS) -> str:
    ranked = f"row_number() OVER (PARTITION BY {partition} ORDER BY {_POINT_ORDER})"
    return f"({ranked} - 1) // {size}"


_COMMON = f"""
WITH pts AS (
  SELECT epoch_us(l_shipdate)/1e6 AS gps_time, l_quantity AS x, l_extendedprice/10000 AS y,
         l_discount*10 AS z, l_linenumber AS num_echo, l_suppkey AS fiber, l_tax AS echo_range,
         l_returnflag || l_linestatus AS source_file
  FROM lineitem),
cubed AS (
  SELECT *, round(x) AS cx, round(y) AS cy, round(z) AS cz,
         {_chunk("round(x), round(y), round(z)")} AS chunk FROM pts),
vox AS (
  SELECT cx, cy, cz, chunk, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max,
         min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
         min(z) AS z_min, max(z) AS z_max, min(num_echo) AS e_min, max(num_echo) AS e_max
  FROM cubed GROUP BY ALL),
weekly AS (
  SELECT *, round(gps_time/604800) AS tbin, {_chunk("round(gps_time/604800)")} AS chunk FROM pts),
wk AS (
  SELECT tbin, chunk, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max,
         min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max
  FROM weekly GROUP BY ALL),
ev AS (
  SELECT event_id, epoch_us(ts)/1e6 AS gps_time, value AS x, user_id::DOUBLE AS y,
         (event_id % 100)::DOUBLE/10 AS z FROM events)
"""

_FILE_POINTS = "gps_time, x, y, z, num_echo, fiber::INTEGER AS fiber, echo_range"
_NEAR = """greatest(x_min-25, 0, 25-x_max) * greatest(x_min-25, 0, 25-x_max)
         + greatest(y_min-5, 0, 5-y_max) * greatest(y_min-5, 0, 5-y_max) <= 4"""
_IN_DISC = "(x-25)*(x-25) + (y-5)*(y-5) <= 4"
_IN_WEEK = "gps_time >= 915148800 AND gps_time < 915753600"
_WEEK_OVERLAP = "t_min < 915753600 AND t_max >= 915148800"
_IN_1998 = "gps_time >= 883612800 AND gps_time < 915148800"


def _text(number: str) -> str:
    return f"{number}::DECIMAL(38,6)::VARCHAR"


_BOX_TEXT = " || ',' || ".join(
    f"{_text(x)} || ' ' || {_text(y)}"
    for x, y in [
        ("x_min", "y_min"),
        ("x_min", "y_max"),
        ("x_max", "y_max"),
        ("x_max", "y_min"),
        ("x_min", "y_min"),
    ]
)

_HEADERS = " UNION ALL ".join(
    f"SELECT 'vertex' AS element, '{name}' AS property, {i} AS property_position, "
    f"'{kind}' AS type, count(*) AS points FROM pts"
    for i, (name, kind) in enumerate(
        [
            ("gps_time", "float64"),
            ("x", "float64"),
            ("y", "float64"),
            ("z", "float64"),
            ("num_echo", "int32"),
            ("fiber", "int32"),
            ("echo_range", "float64"),
        ],
        start=1,
    )
)



def _registry() -> str:
    """Every registered dimension; a range for those that the cloud has."""
    columns = {"gps_time", "x", "y", "z", "num_echo", "fiber", "echo_range", "source_file"}
    rows = []
    for schema in (DEMO, RIEGL, VELODYNE):
        for d in schema.dimensions:
            size = {"double": 8, "float": 4}.get(d.interpretation, d.size)
            bits = 8 * d.size
            if d.interpretation in ("double", "float"):
                most = "1.7976931348623157e308" if size == 8 else "3.4028234663852886e38"
                lo, hi = f"-{most}", most
            else:
                low, high = (0, 2**bits - 1) if d.interpretation.lower().startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
                lo, hi = low * d.scale + d.offset, high * d.scale + d.offset
            dim = d.name.lower()
            there = dim in columns
            outside = f"count(*) FILTER ({dim} < {lo}::DOUBLE OR {dim} > {hi}::DOUBLE)" if there else "NULL::BIGINT"
            rows.append(
                f"SELECT {schema.pcid} AS pcid, '{schema.name}' AS schema_name, {d.position} AS position, {d.size} AS size, '{d.name}' AS name, "
                f"'{d.interpretation}' AS interpretation, {d.scale}::DOUBLE AS scale, {d.offset}::DOUBLE AS \"offset\", "
                f"'{d.description.replace(chr(39), chr(39) * 2)}' AS description, {outside} AS out_of_range, "
                f"{0 if there else 'NULL'}::BIGINT AS nans, {f'count(*) FILTER ({dim} IS NULL)' if there else 'NULL::BIGINT'} AS nulls, "
                f"{there} AS present, {size == d.size} AS size_fits{' FROM pts' if there else ''}"
            )
    return " UNION ALL ".join(rows)


_MULTI = """(SELECT *, count(*) OVER (PARTITION BY round(x), round(y), round(z)) AS n1 FROM ev)"""
_MULTI_KEY = """if(n1>=2, round(x), 5*round(x/5)) AS cx, if(n1>=2, round(y), 5*round(y/5)) AS cy,
         if(n1>=2, round(z), 5*round(z/5)) AS cz"""

_AREA_JOIN = """
      SELECT area_id, count(*) AS n, max(gps_time) AS t_max
      FROM (SELECT p_partkey AS area_id, p_size::DOUBLE AS cx, p_partkey % 1000 / 100.0::DOUBLE AS cy,
                   CASE WHEN p_partkey % 400 = 0 THEN 3.0::DOUBLE ELSE p_partkey % 7 / 50.0::DOUBLE END AS r FROM part) a
      JOIN pts p ON p.x BETWEEN cx - r - 1 AND cx + r + 1
        AND (p.x-cx)*(p.x-cx) + (p.y-cy)*(p.y-cy) <= r*r
      GROUP BY 1"""

# Crossings of the ray to the right, and points on an edge.
_CROSSES = "((y1 > y) <> (y2 > y) AND x < (x2-x1)*(y-y1)/(y2-y1) + x1)"
_TOUCHES = """((x2-x1)*(y-y1) - (y2-y1)*(x-x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
       AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"""


def _edge_rows(rings: list) -> str:
    """The edges of rings as rows of a VALUES list."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in edges)


_FIELD = [
    [(5.0, 0.5), (30.0, 0.5), (30.0, 8.0), (20.0, 3.0), (5.0, 8.0)],
    [(8.0, 1.0), (12.0, 1.0), (12.0, 3.0), (8.0, 3.0)],
]

_POLYGON_JOIN = f"""
      SELECT poly_id, count(*) AS n, max(gps_time) AS t_max, min(y) AS y_min
      FROM (
        SELECT poly_id, p.r, any_value(p.gps_time) AS gps_time, any_value(p.y) AS y
        FROM (SELECT s_suppkey AS poly_id, px, py, size, px + a*size AS x1, py + b*size AS y1, px + c*size AS x2, py + d*size AS y2
              FROM (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS px, s_suppkey % 21 / 2.0::DOUBLE AS py,
                           (1 + s_suppkey % 5) / 4.0::DOUBLE AS size FROM supplier),
                   (VALUES {_edge_rows([OUTLINE, HOLE])}) e(a, b, c, d)) g
        JOIN (SELECT row_number() OVER () AS r, gps_time, x, y FROM pts) p
          ON p.x BETWEEN px - size AND px + size AND p.y BETWEEN py - size AND py + size
        GROUP BY poly_id, p.r
        HAVING count(*) FILTER ({_CROSSES.replace(" y)", " p.y)").replace("x <", "p.x <").replace("(y-", "(p.y-")}) % 2 = 1
            OR bool_or({_TOUCHES.replace("(y-", "(p.y-").replace("(x-", "(p.x-").replace("AND x ", "AND p.x ").replace("AND y ", "AND p.y ")}))
      GROUP BY 1"""

_SCALES = """
      SELECT lvl, s*round(x/s) AS cx, s*round(y/s) AS cy, s*round(z/s) AS cz, 0::BIGINT AS chunk, count(*) AS n,
             min(gps_time) AS t_min, max(gps_time) AS t_max, min(y) AS y_min, max(y) AS y_max
      FROM (SELECT *, CASE WHEN n1 >= 5 THEN 0 WHEN n2 >= 5 THEN 1 ELSE 2 END AS lvl,
                   CASE WHEN n1 >= 5 THEN 0.25::DOUBLE WHEN n2 >= 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS s
            FROM (SELECT *, count(*) OVER (PARTITION BY n1 >= 5, round(x/0.5::DOUBLE), round(y/0.5::DOUBLE),
                                           round(z/0.5::DOUBLE)) AS n2
                  FROM (SELECT *, count(*) OVER (PARTITION BY round(x/0.25::DOUBLE), round(y/0.25::DOUBLE),
                                                 round(z/0.25::DOUBLE)) AS n1 FROM pts)))
      GROUP BY ALL"""

_WINDOW_JOIN = """
      SELECT win_id, count(*) AS n, max(x) AS x_max
      FROM (SELECT c_custkey AS win_id, lo, lo + 86400 * if(c_custkey % 100 = 0, 700, c_custkey % 5) AS hi
            FROM (SELECT c_custkey, 788918400 + c_custkey % 500 * 432000 AS lo FROM customer)) w
      JOIN pts p ON p.gps_time >= w.lo AND p.gps_time < w.hi GROUP BY 1"""

_QUERIES = {
    "ply_read": f"SELECT {_FILE_POINTS} FROM pts",
    "ply_selective_read": "SELECT num_echo, gps_time FROM pts",
    "ply_ascii_read": f"SELECT {_FILE_POINTS} FROM pts",
    "ply_big_endian_read": f"SELECT {_FILE_POINTS} FROM pts",
    "ply_list_read": """
      SELECT cx, cy, cz, (count(*) OVER (PARTITION BY cx, cy, cz, chunk))::INT AS n, gps_time, x, num_echo FROM cubed""",
    "ply_list_stream_read": "SELECT x, num_echo FROM pts",
    "ply_mixed_read": """
      SELECT gps_time, x, num_echo, fiber::INT AS fiber, CASE WHEN num_echo % 2 = 1 THEN echo_range END AS echo_range
      FROM pts""",
    "ply_property_types": """
      SELECT property, position, stored, spark_type, property = 'echo_range' AS lacking,
             property NOT IN ('gps_time', 'num_echo') AS conflict
      FROM (VALUES ('gps_time', 1, 'float64', 'double'), ('x', 2, 'float32,float64', 'double'), ('num_echo', 3, 'int32', 'int'),
                   ('fiber', 4, 'int16,int32', 'int'), ('echo_range', 5, 'float64', 'double')) v(property, position, stored, spark_type)
      WHERE EXISTS (SELECT 1 FROM pts)""",
    "text_points_c": """
      SELECT gps_time, printf('%.16g', x)::DOUBLE AS x, printf('%.16g', y)::DOUBLE AS y, printf('%.16g', z)::DOUBLE AS z,
             num_echo FROM pts""",
    "ply_headers": _HEADERS,
    "text_points": f"SELECT {_FILE_POINTS} FROM pts",
    "attach_schema": """
      SELECT gps_time, x, y, z, echo_range AS range_m, num_echo::SMALLINT AS echo FROM pts""",
    "shard_selection": """
      SELECT source_file, count(*) AS n FROM pts WHERE source_file IN (
        SELECT source_file FROM (
          SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS f
          FROM (SELECT DISTINCT source_file FROM pts)) WHERE f % 2 = 1)
      GROUP BY 1""",
    "shards_with_nulls": """
      SELECT nullif(source_file, 'RF') AS source_file, count(*) AS n FROM pts GROUP BY 1""",
    "schema_registry": _registry(),
    "load_shards": """
      SELECT source_file, round(x) AS cx, round(y) AS cy, round(z) AS cz, count(*) AS n,
             min(gps_time) AS t_min, max(gps_time) AS t_max FROM pts GROUP BY 1, 2, 3, 4""",
    "viewer_export": f"""
      SELECT row_number() OVER (ORDER BY cx, cy, cz, chunk) AS gid,
             'POLYGON((' || {_BOX_TEXT} || '))' AS geom FROM vox""",
    "make_point": """
      SELECT x AS "X", y AS "Y", z AS "Z", num_echo::DOUBLE AS "Intensity" FROM pts""",
    "get_attribute": "SELECT gps_time, fiber FROM pts",
    "explode_patches": "SELECT gps_time, x, y, z, num_echo, fiber FROM pts",
    "patch_minmax": """
      SELECT cx, cy, cz, chunk, t_min AS time_lo, t_max AS time_hi, e_min AS echo_lo,
             e_max AS echo_hi FROM vox""",
    "patch_range": """
      SELECT cx, cy, cz, chunk, t_min AS lo, t_max AS hi, true AS lo_inc, true AS hi_inc FROM vox""",
    "patch_box": "SELECT cx, cy, cz, chunk, x_min, y_min, x_max, y_max FROM vox",
    "point_wkt": f"""
      SELECT gps_time, fiber,
             'POINT Z (' || {_text("x")} || ' ' || {_text("y")} || ' ' || {_text("z")} || ')' AS geom
      FROM pts""",
    "patch_text": "SELECT gps_time, x, y, z, num_echo FROM pts",
    "quantise": """
      SELECT num_echo, fiber, gps_time, 649000 + 0.01*round((x-649000)/0.01) AS xq FROM pts""",
    "georeference": "SELECT gps_time, x + 649000 AS x_abs, y + 6840000 AS y_abs FROM pts",
    "validate_types": """
      SELECT 'fiber' AS dim, count(*) FILTER (fiber > 64 OR fiber < 0) AS out_of_range, 0::BIGINT AS nans,
             count(*) FILTER (fiber IS NULL) AS nulls FROM pts
      UNION ALL
      SELECT 'num_echo', count(*) FILTER (num_echo > 127 OR num_echo < -128), 0,
             count(*) FILTER (num_echo IS NULL) FROM pts""",
    "row_ids": """
      SELECT row_number() OVER (ORDER BY cx, cy, cz, chunk) AS gid, cx, cy, cz, chunk FROM vox""",
    "edit_points": """
      SELECT round(x) AS cx, round(y) AS cy, round(z+10) AS cz, count(*) AS n
      FROM pts GROUP BY 1, 2, 3""",
    "edit_in_place": "SELECT tbin, chunk, n, z_min + 10 AS z_min, z_max + 10 AS z_max FROM wk",
    "edit_in_place_tiled": """
      SELECT x + 100 AS x, y FROM pts WHERE x + 100 BETWEEN 110 AND 112""",
    "near_candidates": f"SELECT cx, cy, cz, chunk, n FROM vox WHERE {_NEAR}",
    "range_candidates": f"SELECT tbin, chunk, n FROM wk WHERE {_WEEK_OVERLAP}",
    "range_points_bounds": """
      SELECT '[)' AS bounds, count(*) AS n FROM pts WHERE x >= 10 AND x < 12
      UNION ALL SELECT '[]', count(*) FROM pts WHERE x >= 10 AND x <= 12
      UNION ALL SELECT '(]', count(*) FROM pts WHERE x > 10 AND x <= 12
      UNION ALL SELECT '()', count(*) FROM pts WHERE x > 10 AND x < 12""",
    "retrieve_time": f"SELECT gps_time, x, y, z FROM pts WHERE {_IN_WEEK}",
    "retrieve_disc_patch": f"""
      SELECT p.gps_time, p.x, p.y, p.z FROM cubed p JOIN vox v USING (cx, cy, cz, chunk)
      WHERE {_NEAR}""",
    "retrieve_disc_point": f"SELECT gps_time, x, y, z FROM pts WHERE {_IN_DISC}",
    "retrieve_ball": """
      SELECT gps_time, x, y, z FROM pts
      WHERE (x-25)*(x-25) + (y-5)*(y-5) + (z-0.5)*(z-0.5) <= 4""",
    "retrieve_box": """
      SELECT gps_time, x, y, z FROM pts WHERE x BETWEEN 10 AND 12 AND y BETWEEN 1 AND 2""",
    "retrieve_tiled": """
      SELECT gps_time, x, y, z FROM pts WHERE x BETWEEN 10 AND 12 AND y BETWEEN 1 AND 2""",
    "retrieve_space_time": f"""
      SELECT gps_time, x, y, z FROM pts
      WHERE {_IN_DISC} AND {_IN_1998} AND num_echo BETWEEN 2 AND 4""",
    "retrieve_time_space": f"""
      SELECT gps_time, x, y, z FROM pts
      WHERE {_IN_DISC} AND {_IN_1998} AND num_echo BETWEEN 2 AND 4""",
    "retrieve_sql": f"SELECT gps_time, x, y, z FROM pts WHERE {_IN_DISC} AND {_IN_1998}",
    "limit_patches": "SELECT cx, cy, cz, chunk, n FROM vox ORDER BY cx, cy, cz, chunk LIMIT 10",
    "build_patch_stats": """
      SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, count(*) AS n,
             min(gps_time) AS t_min, max(gps_time) AS t_max, min(x) AS x_min, max(x) AS x_max,
             min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max
      FROM pts GROUP BY 1, 2, 3""",
    "group_m3": """
      SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, count(*) AS n
      FROM pts GROUP BY 1, 2, 3""",
    "group_cell_half": """
      SELECT 0.5*round(2*x) AS cx, 0.5*round(2*y) AS cy, 0.5*round(2*z) AS cz, count(*) AS n
      FROM pts GROUP BY 1, 2, 3""",
    "group_snap_grid": """
      SELECT 5*round(x/5) AS cx, 4*round(y/4) AS cy, count(*) AS n FROM pts GROUP BY 1, 2""",
    "group_time_bin": """
      SELECT round(1000*gps_time/100) AS tbin, count(*) AS n FROM ev GROUP BY 1""",
    "group_attribute": """
      SELECT num_echo, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max
      FROM pts GROUP BY 1""",
    "group_multiscale": f"""
      SELECT if(n1>=2, 1, 5) AS lvl, {_MULTI_KEY}, count(*) AS n FROM {_MULTI}
      GROUP BY 1, 2, 3, 4""",
    "multiscale_patches": f"""
      SELECT if(n1>=2, 1, 5) AS side, {_MULTI_KEY}, event_id, gps_time FROM {_MULTI}""",
    "group_by_file": """
      SELECT source_file, round(x) AS cx, round(y) AS cy, round(z) AS cz, count(*) AS n
      FROM pts GROUP BY 1, 2, 3, 4""",
    "group_capped": f"""
      SELECT cx, cy, cz, chunk, count(*) AS n, min(gps_time) AS t_min
      FROM (SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, gps_time,
                   {_chunk("round(x), round(y), round(z)", 20)} AS chunk FROM pts)
      GROUP BY 1, 2, 3, 4""",
    "group_capped_split": f"""
      SELECT cx, cy, cz, chunk, count(*) AS n, min(gps_time) AS t_min
      FROM (SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, gps_time,
                   {_chunk("round(x), round(y), round(z)", 20)} AS chunk FROM pts)
      GROUP BY 1, 2, 3, 4""",
    "heavy_patches": "SELECT tbin, chunk, n, t_min, t_max, x_min, x_max FROM wk",
    "import_ply": "SELECT cx, cy, cz, chunk, n, t_min, t_max, x_min, x_max FROM vox",
    "retrieve_with_ids": f"""
      SELECT row_number() OVER (ORDER BY gps_time, x, y, z) AS gid, gps_time, x, y, z
      FROM pts WHERE {_IN_WEEK}""",
    "regroup": "SELECT tbin, chunk, n, t_min, t_max, x_min, x_max FROM wk",
    "user_criterion": """
      SELECT num_echo % 2 AS parity, floor(echo_range*100/2) AS bin, count(*) AS n
      FROM pts GROUP BY 1, 2""",
    "patch_sizes": "SELECT n, count(*) AS patches FROM vox GROUP BY 1",
    "patch_size_profile": """
      SELECT count(*) AS patches, count(*) FILTER (n < 50) AS nearly_empty,
             count(*) FILTER (n < 50) / count(*) AS nearly_empty_share,
             quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50,
             quantile_cont(n, 0.75) AS p75, max(n) AS largest FROM vox""",
    "patch_summary": """
      SELECT count(*) AS patches, sum(n)::BIGINT AS points, min(x_min) AS x_min,
             max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max, min(z_min) AS z_min,
             max(z_max) AS z_max, min(t_min) AS t_min, max(t_max) AS t_max FROM vox""",
    "duplicate_points": """
      SELECT gps_time, x, y, z, num_echo, fiber, echo_range, source_file, 2 * count(*) AS n
      FROM pts GROUP BY ALL""",
    "distinct_points": """
      SELECT DISTINCT gps_time, x, y, z, num_echo, fiber, echo_range, source_file FROM pts""",
    "pruning_report": f"""
      SELECT (SELECT count(*) FROM wk WHERE {_WEEK_OVERLAP}) AS patches_read,
             (SELECT sum(n)::BIGINT FROM wk WHERE {_WEEK_OVERLAP}) AS points_read,
             (SELECT count(*) FROM pts WHERE {_IN_WEEK}) AS points_returned""",
    "pruning_report_disc": f"""
      SELECT (SELECT count(*) FROM vox WHERE {_NEAR}) AS patches_read,
             (SELECT sum(n)::BIGINT FROM vox WHERE {_NEAR}) AS points_read,
             (SELECT count(*) FROM pts WHERE {_IN_DISC}) AS points_returned""",
    "cluster_spatial": f"""
      SELECT cx, cy, chunk, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min,
             max(y) AS y_max
      FROM (SELECT round(x) AS cx, round(y) AS cy, x, y,
                   {_chunk("round(x), round(y)").replace(_POINT_ORDER, "gps_time, x, y, z")} AS chunk
            FROM pts) GROUP BY 1, 2, 3""",
    "cluster_time": f"""
      SELECT tbin, chunk, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max
      FROM (SELECT round(gps_time/86400) AS tbin, gps_time,
                   {_chunk("round(gps_time/86400)")} AS chunk FROM pts) GROUP BY 1, 2""",
    "area_join": _AREA_JOIN,
    "area_join_shuffled": _AREA_JOIN,
    "polygon_join": _POLYGON_JOIN,
    "multiscale_levels": _SCALES,
    "retrieve_manifest": f"SELECT gps_time, x, y, z FROM pts WHERE {_IN_DISC}",
    "retrieve_polygon": f"""
      SELECT gps_time, x, y FROM (SELECT row_number() OVER () AS r, * FROM pts),
             (VALUES {_edge_rows(_FIELD)}) e(x1, y1, x2, y2)
      GROUP BY r, gps_time, x, y
      HAVING count(*) FILTER ({_CROSSES}) % 2 = 1 OR bool_or({_TOUCHES})""",
    "time_window_join": _WINDOW_JOIN,
    "time_window_join_shuffled": _WINDOW_JOIN,
    "stream_load": """
      SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, count(*) AS n,
             min(gps_time) AS t_min, max(gps_time) AS t_max FROM pts GROUP BY 1, 2, 3""",
    "stream_load_twice": """
      SELECT round(x) AS cx, round(y) AS cy, round(z) AS cz, 2 * count(*) AS n
      FROM pts GROUP BY 1, 2, 3""",
    "stream_time_patches": """
      SELECT tbin, chunk, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max,
             min(x) AS x_min, max(x) AS x_max
      FROM (SELECT *, round(1000*gps_time/3600000) AS tbin,
                   (row_number() OVER (PARTITION BY round(1000*gps_time/3600000)
                                       ORDER BY gps_time, x, y, z, event_id) - 1) // 8 AS chunk FROM ev)
      GROUP BY 1, 2""",
    "stream_time_patches_compacted": """
      SELECT round(1000*gps_time/3600000) AS tbin, event_id, gps_time FROM ev, range(2)""",
    "stream_bin_stats": """
      SELECT round(1000*gps_time/3600000) AS tbin, count(*) AS n, min(gps_time) AS t_min,
             max(gps_time) AS t_max, min(y) AS y_min, max(y) AS y_max FROM ev GROUP BY 1""",
    "per_patch_udf": """
      SELECT tbin, chunk, max(z) - min(z) AS height, count(*) AS points FROM weekly GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: _COMMON + body for name, body in _QUERIES.items()}
