"""Point schemas as data: what each dimension is called and how it is stored."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dimension:
    """One attribute of a point; the real value is ``raw * scale + offset``."""

    position: int
    size: int
    name: str
    interpretation: str
    scale: float = 1.0
    offset: float = 0.0
    description: str = ""


@dataclass(frozen=True)
class PointSchema:
    """The dimensions of one kind of point, in storage order."""

    pcid: int
    name: str
    dimensions: tuple[Dimension, ...]
    srid: int = 0
    compression: str = "dimensional"


def _schema(pcid: int, name: str, rows: list[tuple]) -> PointSchema:
    dims = tuple(Dimension(i, *row) for i, row in enumerate(rows, start=1))
    return PointSchema(pcid, name, dims)


# Size in bytes, name, interpretation, scale, offset of each dimension. Descriptions are our own.
DEMO = _schema(
    1,
    "demo",
    [
        (4, "X", "int32_t", 0.01, 0, "east, in steps"),
        (4, "Y", "int32_t", 0.01, 0, "north, in steps"),
        (4, "Z", "int32_t", 0.01, 0, "height, in steps"),
        (2, "Intensity", "uint16_t", 1, 0, "strength of the echo"),
    ],
)

RIEGL = _schema(
    2,
    "riegl",
    [
        (8, "GPS_time", "double", 0.000001, 0, "seconds of acquisition"),
        (4, "x_sensor", "float", 0.001, 0, "along the sensor's first axis"),
        (4, "y_sensor", "float", 0.001, 0, "along the sensor's second axis"),
        (4, "z_sensor", "float", 0.001, 0, "along the sensor's third axis"),
        (4, "x_origin_sensor", "float", 0.00001, 0, "laser's origin, sensor's first axis"),
        (4, "y_origin_sensor", "float", 0.00001, 0, "laser's origin, sensor's second axis"),
        (4, "z_origin_sensor", "float", 0.00001, 0, "laser's origin, sensor's third axis"),
        (5, "x", "double", 0.001, 649000, "east, in the world's frame"),
        (5, "y", "double", 0.001, 6840000, "north, in the world's frame"),
        (5, "z", "float", 0.001, 0, "height, in the world's frame"),
        (5, "x_origin", "float", 0.0001, 649000, "laser's origin, east"),
        (5, "y_origin", "float", 0.0001, 6840000, "laser's origin, north"),
        (5, "z_origin", "float", 0.0001, 0, "laser's origin, height"),
        (4, "echo_range", "float", 0.001, 0, "distance from the laser"),
        (4, "theta", "float", 0.0001, 0, "first angle of the beam"),
        (4, "phi", "float", 0.000001, 0, "second angle of the beam"),
        (1, "num_echo", "int", 1, 0, "which echo of its pulse"),
        (1, "nb_of_echo", "int", 1, 0, "echoes of the pulse"),
        (4, "amplitude", "float", 0.0001, 0, "height of the echo's peak"),
        (4, "reflectance", "float", 0.0001, 0, "amplitude, corrected for distance"),
        (2, "deviation", "int", 1, 0, "how far the echo's shape is from the pulse's"),
        (1, "background_radiation", "int", 1, 0, "light without the laser"),
    ],
)

VELODYNE = _schema(
    3,
    "velodyne",
    [
        (8, "gps_time", "double", 0.00000001, 0, "seconds of acquisition"),
        (2, "echo_range", "UnsignedInteger", 1, 0, "distance from the laser"),
        (1, "intensity", "UnsignedInteger", 1, 0, "strength of the echo"),
        (2, "theta", "UnsignedInteger", 1, 0, "first angle of the beam"),
        (2, "block_id", "UnsignedInteger", 1, 0, "block of lasers"),
        (1, "fiber", "UnsignedInteger", 1, 0, "laser within its block"),
        (4, "x_laser", "float", 0.001, 0, "along the laser's first axis"),
        (4, "y_laser", "float", 0.001, 0, "along the laser's second axis"),
        (4, "z_laser", "float", 0.001, 0, "along the laser's third axis"),
        (5, "x", "double", 0.001, 649000, "east, in the world's frame"),
        (5, "y", "double", 0.001, 6840000, "north, in the world's frame"),
        (5, "z", "double", 0.001, 0, "height, in the world's frame"),
        (5, "x_centre_laser", "double", 0.001, 649000, "laser's centre, east"),
        (5, "y_centre_laser", "double", 0.001, 6840000, "laser's centre, north"),
        (5, "z_centre_laser", "double", 0.001, 0, "laser's centre, height"),
    ],
)

# Column and Spark type of each file column, in file order.
RIEGL_COLUMNS = [
    ("gps_time", "double"),
    ("x_sensor", "float"),
    ("y_sensor", "float"),
    ("z_sensor", "float"),
    ("x_origin_sensor", "float"),
    ("y_origin_sensor", "float"),
    ("z_origin_sensor", "float"),
    ("x", "double"),
    ("y", "double"),
    ("z", "float"),
    ("x_origin", "double"),
    ("y_origin", "double"),
    ("z_origin", "float"),
    ("echo_range", "float"),
    ("theta", "float"),
    ("phi", "float"),
    ("num_echo", "short"),
    ("nb_of_echo", "short"),
    ("amplitude", "float"),
    ("reflectance", "float"),
    ("deviation", "float"),
    ("background_radiation", "float"),
]

VELODYNE_COLUMNS = [
    ("gps_time", "double"),
    ("echo_range", "int"),
    ("intensity", "short"),
    ("theta", "int"),
    ("block_id", "int"),
    ("fiber", "short"),
    ("x_laser", "double"),
    ("y_laser", "double"),
    ("z_laser", "double"),
    ("x", "double"),
    ("y", "double"),
    ("z", "double"),
    ("x_centre_laser", "double"),
    ("y_centre_laser", "double"),
    ("z_centre_laser", "double"),
]
