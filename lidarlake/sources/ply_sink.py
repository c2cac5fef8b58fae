"""Writing points as PLY files, many at a time: binary in either byte order, or ASCII, with or without lists.

Every task writes whole files of a bounded number of points, under names that no
reader looks at; the driver gives them their final names when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from lidarlake.sources.files import file_system

# The PLY type and numpy kind that hold a Spark type without loss.
_SCALARS = {
    "tinyint": ("int8", "i1"),
    "smallint": ("int16", "i2"),
    "int": ("int32", "i4"),
    "float": ("float32", "f4"),
    "double": ("float64", "f8"),
}
# Records of one file are held until they are counted, and are laid out a piece at a time: both are bounded by
# bytes too, as records with lists may be of any size.
_FILE_BYTES = 64 * 1024 * 1024
_PIECE_BYTES = 2 * 1024 * 1024
_FORMATS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": "="}


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


class PlySink(DataSourceArrowWriter):
    """Options: ``element`` (vertex), ``encoding`` (binary_little_endian) and ``maxRecordsPerFile`` (1,000,000).

    An array becomes a list property with an int32 length. ASCII has one instance per line.
    """

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, options: dict):
        scalar = lambda f: f.dataType.simpleString().removeprefix("array<").removesuffix(">")
        odd = [f.name for f in schema if scalar(f) not in _SCALARS]
        if odd:
            raise ValueError(f"no PLY type for column {', '.join(odd)}")
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.element = options.get("element", "vertex")
        limit = options.get("maxrecordsperfile", options.get("maxRecordsPerFile", 1_000_000))
        self.limit = int(limit)
        self.form = options.get("encoding", "binary_little_endian")
        if self.form not in _FORMATS:
            raise ValueError(f"no PLY encoding {self.form}")
        self.kinds = [(f.name, _FORMATS[self.form] + _SCALARS[scalar(f)][1]) for f in schema]
        self.lists = {f.name for f in schema if isinstance(f.dataType, T.ArrayType)}
        self.properties = [
            (f"list int32 {_SCALARS[scalar(f)][0]}" if f.name in self.lists else _SCALARS[scalar(f)][0], f.name) for f in schema
        ]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        fs, inner = file_system(self.path)
        fs.create_dir(inner, recursive=True)
        names, held, rows, size = [], [], 0, 0
        for batch in iterator:
            start = 0
            while start < batch.num_rows:
                piece = self._piece(batch, start, self.limit - rows)
                held.append(self._records(piece))
                rows += piece.num_rows
                size += len(held[-1])
                start += piece.num_rows
                if rows == self.limit or size >= _FILE_BYTES:
                    names.append(self._file(fs, inner, held, rows))
                    held, rows, size = [], 0, 0
        if rows:
            names.append(self._file(fs, inner, held, rows))
        return WrittenFiles(names)

    def _piece(self, batch: pa.RecordBatch, start: int, most: int) -> pa.RecordBatch:
        """At most ``most`` records from ``start`` on, whose lists take no more than _PIECE_BYTES, or a single one."""
        most = min(most, batch.num_rows - start)
        width = np.zeros(most, np.int64)
        for name, kind in self.kinds:
            itemsize = np.dtype(kind).itemsize
            if name in self.lists:
                width += 4 + itemsize * np.diff(batch.column(name).slice(start, most).offsets.to_numpy())
            else:
                width += itemsize
        return batch.slice(start, max(1, int(np.searchsorted(np.cumsum(width), _PIECE_BYTES, side="right"))))

    def _records(self, batch: pa.RecordBatch) -> bytes:
        columns = {}
        for name, kind in self.kinds:
            column = batch.column(name)
            values = column.flatten() if name in self.lists else column
            if column.null_count and (name in self.lists or kind[1] != "f") or values.null_count and kind[1] != "f":
                raise ValueError(f"PLY cannot hold a missing value of {name}")
            sizes = np.diff(column.offsets.to_numpy()) if name in self.lists else None
            columns[name] = (values.to_numpy(zero_copy_only=False).astype(kind), sizes)
        return _text(columns, batch.num_rows) if self.form == "ascii" else _binary(columns, batch.num_rows, _FORMATS[self.form])

    def _file(self, fs, inner: str, held: list[bytes], rows: int) -> str:
        name = f"part-{uuid.uuid4().hex}.ply"
        header = ["ply", f"format {self.form} 1.0", f"element {self.element} {rows}"]
        header += [f"property {ply} {name}" for ply, name in self.properties]
        header.append("end_header")
        with fs.open_output_stream(f"{inner}/.{name}.tmp") as out:
            out.write(("\n".join(header) + "\n").encode())
            for records in held:
                out.write(records)
        return name

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        fs, inner = file_system(self.path)
        if self.overwrite:
            for info in fs.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True)):
                if info.base_name.endswith(".ply"):
                    fs.delete_file(info.path)
        for name in self._names(messages):
            fs.move(f"{inner}/.{name}.tmp", f"{inner}/{name}")

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        fs, inner = file_system(self.path)
        for name in self._names(messages):
            fs.delete_file(f"{inner}/.{name}.tmp")

    @staticmethod
    def _names(messages: list[WrittenFiles | None]) -> list[str]:
        return [name for message in messages if message for name in message.names]


def _binary(columns: dict, rows: int, order: str) -> bytes:
    """Records one after another, copied column by column to where each value belongs."""
    width = np.zeros(rows, np.int64)
    for values, sizes in columns.values():
        width += values.itemsize if sizes is None else 4 + sizes * values.itemsize
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)

    def put(places: np.ndarray, values: np.ndarray) -> None:
        if len(values):
            out[places[:, None] + np.arange(values.itemsize)] = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)

    for values, sizes in columns.values():
        if sizes is None:
            put(at, values)
            at = at + values.itemsize
            continue
        put(at, sizes.astype(f"{order}i4"))
        at = at + 4
        before = np.cumsum(sizes) - sizes
        put(np.repeat(at - before * values.itemsize, sizes) + np.arange(len(values)) * values.itemsize, values)
        at = at + sizes * values.itemsize
    return out.tobytes()


def _text(columns: dict, rows: int) -> bytes:
    """A line per record: the shortest decimals that read back to the same numbers."""
    words = []
    for values, sizes in columns.values():
        told = [str(v) for v in values] if values.dtype.kind == "f" else list(map(str, values.tolist()))
        if sizes is not None:
            ends = np.cumsum(sizes).tolist()
            told = [" ".join([str(n), *told[end - n : end]]) for n, end in zip(sizes.tolist(), ends)]
        words.append(told)
    return ("\n".join(map(" ".join, zip(*words))) + "\n").encode() if rows else b""
