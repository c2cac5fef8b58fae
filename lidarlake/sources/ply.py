"""PLY point files as a Spark data source, and an inventory of their headers.

``spark.read.format("ply").load(path)`` reads a file, a folder of ``*.ply`` or a glob.
The driver only lists names and sizes; each task opens its own file, reads the header
and decodes its byte range in bulk. Elements with records of fixed length are cut into
as many ranges as their size asks for. ASCII bodies and elements with list properties
have no fixed record length: one task streams through such a file, block by block.
For large files with lists, ``record_index`` notes where records begin, and ``read_indexed``
decodes them in as many tasks as there are notes. ``property_types`` compares the headers of all files.
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lidarlake.operators.ids import row_ids
from lidarlake.operators.joins import BROADCAST_ROWS
from lidarlake.sources.files import file_system
from lidarlake.sources.ply_sink import PlySink

# Scalar type names, each with its numpy kind and Spark type. Spark has
# no unsigned types, so those go one step up.
_TYPES = {
    "int8": ("i1", T.ByteType()),
    "uint8": ("u1", T.ShortType()),
    "int16": ("i2", T.ShortType()),
    "uint16": ("u2", T.IntegerType()),
    "int32": ("i4", T.IntegerType()),
    "uint32": ("u4", T.LongType()),
    "float32": ("f4", T.FloatType()),
    "float64": ("f8", T.DoubleType()),
    "char": ("i1", T.ByteType()),
    "uchar": ("u1", T.ShortType()),
    "short": ("i2", T.ShortType()),
    "ushort": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()),
    "uint": ("u4", T.LongType()),
    "float": ("f4", T.FloatType()),
    "double": ("f8", T.DoubleType()),
}
_ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": "="}

_HEADER_STEP = 64 * 1024
_HEADER_LIMIT = 64 * 1024 * 1024
_BLOCK_BYTES = 8 * 1024 * 1024
_LINE_STEP = 4096
# Opening a file is as dear as reading so many bytes.
_OPEN_BYTES = 1024 * 1024
_BATCH_ROWS = 64 * 1024

_INT_WORD = r"[+-]?\d+"
_FLOAT_WORD = r"[+-]?(nan|inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)"


class PlyError(ValueError):
    """A file that is not what it claims to be; the message names it."""


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    length_type: str | None = None

    @property
    def is_list(self) -> bool:
        return self.length_type is not None

    @property
    def spark_type(self) -> T.DataType:
        scalar = _TYPES[self.type][1]
        return T.ArrayType(scalar) if self.is_list else scalar


@dataclass(frozen=True)
class Element:
    name: str
    count: int
    properties: tuple[Property, ...]

    @property
    def is_fixed(self) -> bool:
        return not any(p.is_list for p in self.properties)

    def record(self, order: str) -> np.dtype:
        return np.dtype([(p.name, order + _TYPES[p.type][0]) for p in self.properties])


@dataclass(frozen=True)
class Header:
    path: str
    format: str
    elements: tuple[Element, ...]
    comments: tuple[str, ...]
    obj_infos: tuple[str, ...]
    length: int

    @property
    def is_ascii(self) -> bool:
        return self.format == "ascii"

    @property
    def order(self) -> str:
        return _ORDERS[self.format]

    def element(self, name: str) -> Element:
        for element in self.elements:
            if element.name == name:
                return element
        raise PlyError(f"{self.path}: no element {name}")

    def before(self, name: str) -> list[Element]:
        names = [e.name for e in self.elements]
        return list(self.elements[: names.index(name)])

    def fixed_offset(self, name: str) -> int | None:
        """Where the element's records start, if that can be told from the header."""
        earlier = self.before(name)
        if self.is_ascii or not self.element(name).is_fixed:
            return None
        if not all(e.is_fixed for e in earlier):
            return None
        return self.length + sum(e.count * e.record(self.order).itemsize for e in earlier)


def _list_files(path: str | Sequence[str]) -> list[tuple[str, int]]:
    """Names and sizes of the files meant by a path, or by several, sorted by name.

    A file stands for itself, a folder for all ``*.ply`` files below it, and a pattern for
    what it matches, folders included. A path that is not there is an error; a pattern
    without a match and an empty folder are not.
    """
    if not isinstance(path, str):
        return sorted({f for p in path for f in _list_files(p)})
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    root, shown, wanted = inner.rstrip("/"), path.rstrip("/"), None
    if info.type == pyarrow.fs.FileType.NotFound:
        levels = root.split("/")
        plain = next((i for i, level in enumerate(levels) if re.search(r"[*?\[]", level)), None)
        if plain is None:
            raise PlyError(f"{path}: no such file or folder")
        wanted = levels[plain:]
        root, shown = "/".join(levels[:plain]), "/".join(shown.split("/")[: plain - len(levels)])
    found = []
    for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True, recursive=True)):
        below = f.path[len(root) :].strip("/").split("/")
        if f.type != pyarrow.fs.FileType.File:
            continue
        if wanted:
            # A pattern names a file, or a folder that the file is below.
            if len(below) < len(wanted) or not all(map(fnmatch.fnmatch, below, wanted)):
                continue
            if len(below) == len(wanted):
                found.append((f"{shown}/{'/'.join(below)}", f.size))
                continue
        if fnmatch.fnmatch(below[-1], "*.ply"):
            found.append((f"{shown}/{'/'.join(below)}", f.size))
    return sorted(found)


def _open(path: str) -> pa.NativeFile:
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def read_header(path: str, file: pa.NativeFile) -> Header:
    """Read as much of the file as the header takes, and no more."""
    head = b""
    while True:
        more = file.read_at(_HEADER_STEP, len(head))
        head += more
        end = re.search(rb"(?:^|\s)end_header(?=\s|$)", head)
        if end and (end.end() + 2 <= len(head) or len(more) < _HEADER_STEP):
            break
        if not head.startswith(b"ply") or len(more) < _HEADER_STEP or len(head) > _HEADER_LIMIT:
            _parse_header(path, head, len(head))
            raise PlyError(f"{path}: header has no end_header")
    # After \r\n line ends one more byte belongs to the header.
    ending = 2 if head[3:5] == b"\r\n" else 1
    return _parse_header(path, head[: end.end()], end.end() + ending)


def _parse_header(path: str, head: bytes, length: int) -> Header:
    if head[:3] != b"ply" or not head[3:4].isspace():
        raise PlyError(f"{path}: wrong magic, expected ply")
    lines = re.split(r"\r\n|\r|\n", head.decode("latin-1"))
    comments, obj_infos, elements, form = [], [], [], None
    for line in lines[1:]:
        keyword, _, rest = line.strip().partition(" ")
        words = rest.split()
        if keyword == "comment":
            comments.append(rest.strip())
        elif keyword == "obj_info":
            obj_infos.append(rest.strip())
        elif keyword == "format" and form is None:
            if len(words) != 2 or words[0] not in _ORDERS or words[1] != "1.0":
                raise PlyError(f"{path}: unknown format {rest}")
            form = words[0]
        elif keyword == "element" and form:
            if len(words) != 2 or not words[1].isdigit():
                raise PlyError(f"{path}: bad element {rest}")
            elements.append((words[0], int(words[1]), []))
        elif keyword == "property" and elements:
            elements[-1][2].append(_property(path, words))
        elif keyword == "end_header" and form:
            break
        elif keyword:
            raise PlyError(f"{path}: unexpected {line.strip()!r} in header")
    done = tuple(Element(name, count, tuple(props)) for name, count, props in elements)
    return Header(path, form or "", done, tuple(comments), tuple(obj_infos), length)


def _property(path: str, words: list[str]) -> Property:
    is_list = len(words) == 4 and words[0] == "list"
    types = words[1:3] if is_list else words[:1]
    if len(words) != (4 if is_list else 2) or any(t not in _TYPES for t in types):
        raise PlyError(f"{path}: unknown property {' '.join(words)}")
    return Property(words[-1], types[-1], types[0] if is_list else None)


@dataclass
class FileRange:
    """The records whose first byte lies in [start, end) of a file."""

    path: str
    size: int
    start: int
    end: int


@dataclass
class FileRanges(InputPartition):
    """What one task reads: a piece of a large file, or several small files."""

    ranges: list[FileRange]


class PlyDataSource(DataSource):
    """Options: ``element`` (vertex), ``splitBytes``, ``sourceFile`` (false), ``mode``.

    ``mode`` rules ASCII values that do not fit their type: FAILFAST stops,
    PERMISSIVE reads null and goes on with the next value. A file that stores float64 where the schema has
    float32 stops, as digits would be lost, unless ``narrow`` is true; a file without a property
    stops unless ``missing`` is "null". With ``splitLines`` an ASCII
    body is cut into ranges as well: say so for files that hold one element without
    lists and one instance per line. The last range of a file counts its lines, and stops if
    they are not as many as the header says; ``counted`` says that ``check_lines`` has done so. ``load`` takes several paths, patterns, and
    folders with folders below.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _path(self) -> str | list[str]:
        path = json.loads(self.options.get("paths", "null")) or self.options.get("path")
        if not path:
            raise PlyError("ply source needs a path")
        return path

    def schema(self) -> T.StructType:
        files = _list_files(self._path())
        if not files:
            raise PlyError(f"{self._path()}: no ply file to take a schema from; give one")
        with _open(files[0][0]) as file:
            header = read_header(files[0][0], file)
        element = header.element(self.options.get("element", "vertex"))
        fields = [T.StructField(p.name, p.spark_type) for p in element.properties]
        if self.options.get("sourceFile", "false").lower() == "true":
            fields.append(T.StructField("source_file", T.StringType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PlyReader(self._path(), schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> PlySink:
        return PlySink(self.options["path"], schema, overwrite, dict(self.options))


class PlyReader(DataSourceReader):
    """Reads the properties that the schema names, and no others."""

    def __init__(self, path: str | list[str], schema: T.StructType, options: dict):
        self.path = path
        self.element = options.get("element", "vertex")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.split_lines = options.get("splitlines", options.get("splitLines", "false")).lower() == "true"
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.counted = options.get("counted", "false").lower() == "true"
        self.fill = options.get("missing", "error").lower() == "null"
        self.narrow = options.get("narrow", "false").lower() == "true"
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[FileRanges]:
        groups, room = [], 0
        for path, size in _list_files(self.path):
            for start in range(0, max(size, 1), self.split_bytes):
                end = min(start + self.split_bytes, size)
                cost = end - start + _OPEN_BYTES
                if cost > room:
                    groups.append(FileRanges([]))
                    room = self.split_bytes
                groups[-1].ranges.append(FileRange(path, size, start, end))
                room -= cost
        return groups

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        # Without files Spark calls this once, for no partition.
        for part in partition.ranges if partition else []:
            yield from self._read(part)

    def _read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as file:
            header = read_header(part.path, file)
            element = header.element(self.element)
            known = {p.name for p in element.properties} | {"source_file"}
            missing = [n for n in self.arrow.names if n not in known]
            if missing and not self.fill:
                raise PlyError(f"{part.path}: no property {', '.join(missing)}")
            for p in element.properties:
                if p.name in self.arrow.names and _TYPES[p.type][0] == "f8" and not self.narrow:
                    field = self.arrow.field(p.name).type
                    if pa.types.is_float32(field.value_type if p.is_list and pa.types.is_list(field) else field):
                        raise PlyError(f"{part.path}: {p.name} is stored as float64 and would lose digits; see property_types")
            offset = header.fixed_offset(self.element)
            if offset is not None:
                yield from self._fixed(part, file, header, element, offset)
            elif self.split_lines and header.is_ascii:
                yield from self._lines(part, file, header, element)
            elif part.start == 0:
                reader = _ascii_columns if header.is_ascii else _variable_columns
                wanted = set(self.arrow.names)
                for columns in reader(file, header, element, wanted, self.permissive):
                    yield self._batch(columns, part.path)

    def _fixed(self, part, file, header, element, offset) -> Iterator[pa.RecordBatch]:
        record = element.record(header.order)
        if part.start == 0 and offset + element.count * record.itemsize > part.size:
            raise PlyError(f"{part.path}: file ends inside element {element.name}")

        def first_at(byte: int) -> int:
            return min(max(-(-(byte - offset) // record.itemsize), 0), element.count)

        last = element.count if part.end >= part.size else first_at(part.end)
        row = first_at(part.start)
        while row < last:
            rows = min(_BATCH_ROWS, last - row)
            raw = file.read_at(rows * record.itemsize, offset + row * record.itemsize)
            if len(raw) < rows * record.itemsize:
                raise PlyError(f"{part.path}: file ends inside element {element.name}")
            values = np.frombuffer(raw, dtype=record)
            yield self._batch({n: values[n] for n in record.names if n in self.arrow.names}, part.path)
            row += rows

    def _lines(self, part, file, header, element) -> Iterator[pa.RecordBatch]:
        if len(header.elements) > 1 or not element.is_fixed:
            raise PlyError(f"{part.path}: splitLines needs a single element without lists")
        width = len(element.properties)
        for text in _line_blocks(file, max(part.start, header.length), part.end, header.length):
            words = text.split()
            lines = sum(1 for line in text.split(b"\n") if line.strip())
            if len(words) != lines * width:
                raise PlyError(f"{part.path}: a line does not hold {width} values")
            columns = {
                p.name: _ascii_numbers(part.path, p, p.type, words[i::width], self.permissive)
                for i, p in enumerate(element.properties)
                if p.name in self.arrow.names
            }
            if words:
                yield self._batch(columns, part.path)
        if part.end >= part.size and not self.counted:
            lines = _count_lines(file, header.length, part.size)
            if lines != element.count:
                raise PlyError(f"{part.path}: {lines} lines of {element.name}, the header says {element.count}")

    def _batch(self, columns: dict, path: str) -> pa.RecordBatch:
        rows = len(next(iter(columns.values()))) if columns else 0
        arrays = []
        for field in self.arrow:
            if field.name not in columns and field.name != "source_file":
                arrays.append(pa.nulls(rows, field.type))
            elif field.name not in columns:
                arrays.append(pa.array([path] * rows, type=field.type))
            elif isinstance(columns[field.name], pa.Array):
                arrays.append(columns[field.name].cast(field.type))
            else:
                values = columns[field.name]
                native = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("=")))
                arrays.append(pa.array(native).cast(field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


def _after_line(file: pa.NativeFile, at: int) -> int:
    """Where the next line begins, from ``at`` on; the end of the file if none does."""
    while True:
        block = file.read_at(_LINE_STEP, at)
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
        if len(block) < _LINE_STEP:
            return at


def _line_blocks(file: pa.NativeFile, start: int, end: int, body: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), in blocks of whole lines."""
    at = start if start == body else _after_line(file, start - 1)
    last = _after_line(file, end - 1)
    held = b""
    while at < last:
        block = file.read_at(min(_BLOCK_BYTES, last - at), at)
        if not block:
            return
        at += len(block)
        held += block
        cut = len(held) if at >= last else held.rfind(b"\n") + 1
        if cut:
            yield held[:cut]
        held = held[cut:]


def _count_lines(file: pa.NativeFile, body: int, size: int) -> int:
    """Lines of the body that are not blank."""
    blocks = _line_blocks(file, body, size, body)
    return sum(sum(1 for line in block.split(b"\n") if line.strip()) for block in blocks)


class _Bytes:
    """A file read forward in blocks; ``held`` begins at byte ``offset``."""

    def __init__(self, file: pa.NativeFile, start: int, path: str):
        file.seek(start)
        self._file, self.path = file, path
        self.held, self.offset = b"", start

    def more(self) -> None:
        block = self._file.read(_BLOCK_BYTES)
        if not block:
            raise PlyError(f"{self.path}: file ends before all values")
        self.held += block

    def drop(self, size: int) -> None:
        self.held = self.held[size:]
        self.offset += size


def _kinds(header: Header, element: Element) -> list[tuple[Property, np.dtype, np.dtype | None]]:
    """Each property with the numpy kinds of its values and of its list length."""
    kind = lambda name: np.dtype(header.order + _TYPES[name][0])
    return [(p, kind(p.type), kind(p.length_type) if p.is_list else None) for p in element.properties]


def _walk(held: bytes, rows: int, header: Header, element: Element) -> tuple[list[int], int]:
    """Where each of at most ``rows`` whole records begins, and where the last ends. Only list lengths are read."""
    steps, skip = [], 0
    for _, kind, length in _kinds(header, element):
        if length is None:
            skip += kind.itemsize
        else:
            unpack = struct.Struct((">" if header.order == ">" else "<") + length.char).unpack_from
            steps.append((skip, unpack, length.itemsize, kind.itemsize))
            skip = 0
    starts, at, end = [], 0, len(held)
    for _ in range(rows):
        here = at
        for before, unpack, size, item in steps:
            at += before
            if at + size > end:
                return starts, here
            at += size + max(int(unpack(held, at)[0]), 0) * item
        at += skip
        if at > end:
            return starts, here
        starts.append(here)
    return starts, at


def _gather(held: bytes, starts: list[int], header: Header, element: Element, wanted: set) -> dict:
    """The wanted columns of the records at ``starts``, by bulk copies."""
    raw = np.frombuffer(held, np.uint8)
    at = np.array(starts, np.int64)
    columns = {}

    def values(places: np.ndarray, kind: np.dtype) -> np.ndarray:
        found = raw[places[:, None] + np.arange(kind.itemsize)]
        return np.ascontiguousarray(found).view(kind)[:, 0] if len(places) else np.empty(0, kind)

    for p, kind, length in _kinds(header, element):
        if length is None:
            if p.name in wanted:
                columns[p.name] = values(at, kind)
            at = at + kind.itemsize
            continue
        sizes = np.maximum(values(at, length).astype(np.int64), 0)
        at = at + length.itemsize
        if p.name in wanted:
            ends = np.cumsum(np.append(0, sizes))
            places = np.repeat(at - ends[:-1] * kind.itemsize, sizes) + np.arange(ends[-1]) * kind.itemsize
            flat = values(places, kind).astype(kind.newbyteorder("="))
            columns[p.name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        at = at + sizes * kind.itemsize
    return columns


def _variable_columns(file, header, element, wanted, permissive) -> Iterator[dict]:
    """Batches of a binary element that has lists, or comes after one that has."""
    data = _Bytes(file, header.length, header.path)
    for earlier in header.before(element.name):
        for _ in _stretches(data, header, earlier):
            pass
    for starts in _stretches(data, header, element):
        columns = _gather(data.held, starts, header, element, wanted)
        if columns:
            yield columns


def _stretches(data: _Bytes, header: Header, element: Element, rows: int = _BATCH_ROWS) -> Iterator[list[int]]:
    """The records of an element in stretches of about ``rows``, as places in ``data.held``."""
    done = 0
    while done < element.count:
        starts, used = _walk(data.held, min(rows, element.count - done), header, element)
        if len(starts) < min(rows, element.count - done) and len(data.held) < 4 * _BLOCK_BYTES or not starts:
            data.more()
            continue
        yield starts
        data.drop(used)
        done += len(starts)


class _Words:
    """The blank-separated words of a body, read forward in blocks."""

    def __init__(self, file: pa.NativeFile, start: int, path: str):
        file.seek(start)
        self._file, self._path = file, path
        self._words: list[bytes] = []
        self._at, self._tail, self._ended = 0, b"", False

    def _fill(self, count: int) -> None:
        while len(self._words) - self._at < count and not self._ended:
            block = self._file.read(_BLOCK_BYTES)
            self._ended = not block
            text = self._tail + block
            blank = max(text.rfind(c) for c in (b" ", b"\n", b"\r", b"\t"))
            cut = len(text) if self._ended else blank + 1
            self._tail = text[cut:]
            self._words = self._words[self._at :] + text[:cut].split()
            self._at = 0

    def take(self, count: int) -> list[bytes]:
        self._fill(count)
        if len(self._words) - self._at < count:
            raise PlyError(f"{self._path}: file ends before all values")
        self._at += count
        return self._words[self._at - count : self._at]


def _ascii_columns(file, header, element, wanted, permissive) -> Iterator[dict]:
    words = _Words(file, header.length, header.path)
    for earlier in header.before(element.name):
        for _ in _ascii_records(words, header, earlier, set(), permissive):
            pass
    yield from _ascii_records(words, header, element, wanted, permissive)


def _ascii_records(words, header, element, wanted, permissive) -> Iterator[dict]:
    done = 0
    while done < element.count:
        rows = min(_BATCH_ROWS, element.count - done)
        columns = {}
        if element.is_fixed:
            width = len(element.properties)
            table = words.take(rows * width)
            for i, p in enumerate(element.properties):
                if p.name in wanted:
                    columns[p.name] = _ascii_numbers(header.path, p, p.type, table[i::width], permissive)
        else:
            cells = {p.name: [] for p in element.properties}
            for _ in range(rows):
                for p in element.properties:
                    if p.is_list:
                        size = int(words.take(1)[0])
                        cells[p.name].append(words.take(max(size, 0)))
                    else:
                        cells[p.name].append(words.take(1)[0])
            for p in element.properties:
                if p.name not in wanted:
                    continue
                if not p.is_list:
                    columns[p.name] = _ascii_numbers(header.path, p, p.type, cells[p.name], permissive)
                    continue
                ends = np.cumsum([0, *[len(c) for c in cells[p.name]]])
                flat = [w for c in cells[p.name] for w in c]
                values = _ascii_numbers(header.path, p, p.type, flat, permissive)
                columns[p.name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        done += rows
        if columns:
            yield columns


def _ascii_numbers(path: str, p: Property, kind: str, words: list[bytes], permissive: bool) -> pa.Array:
    """Words as numbers of a type; a word that is none, or does not fit, is bad."""
    dtype = np.dtype(_TYPES[kind][0])
    is_float = dtype.kind == "f"
    try:
        if b"_" in b"".join(words):  # numpy would read 1_0 as 10
            raise ValueError
        numbers = np.array(words, dtype="S").astype("f8" if is_float else "i8") if words else np.empty(0)
        unread = np.zeros(len(words), bool)
    except (ValueError, OverflowError):
        texts = pd.Series([w.decode("latin-1") for w in words]).str.lower()
        pattern = _FLOAT_WORD if is_float else _INT_WORD
        unread = ~texts.str.fullmatch(pattern).to_numpy(bool)
        numbers = texts.mask(unread, "0").astype("f8").to_numpy()
    if is_float:
        bad = unread | (np.abs(numbers) > float(np.finfo(dtype).max))
    else:
        limits = np.iinfo(dtype)
        bad = unread | (numbers < limits.min) | (numbers > limits.max)
    if bad.any() and not permissive:
        word = words[int(np.argmax(bad))].decode("latin-1")
        raise PlyError(f"{path}: {word} is no {kind} for property {p.name}")
    safe = np.where(bad, 0, numbers).astype(dtype)
    return pa.array(safe, mask=bad)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("ply")`` known to the session."""
    spark.dataSource.register(PlyDataSource)


_HEADER_TYPE = (
    "path string, format string, element string, element_position int, instances long, "
    "property string, property_position int, type string, length_type string, "
    "comments array<string>, obj_infos array<string>"
)


def ply_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per (file, element, property) of all files under ``path``.

    Spark lists the files and tasks read the heads only; contents stay unread. An
    element without properties has one row with a null property.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path")
    )

    def inventory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _HEADER_TYPE.split(", ")]
        for batch in batches:
            rows = []
            for name in batch["path"]:
                with _open(name) as file:
                    header = read_header(name, file)
                notes = (list(header.comments), list(header.obj_infos))
                for e_at, e in enumerate(header.elements, start=1):
                    for p_at, p in enumerate(e.properties or (None,), start=1):
                        described = (p.name, p_at, p.type, p.length_type) if p else (None,) * 4
                        rows.append((name, header.format, e.name, e_at, e.count, *described, *notes))
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(inventory, _HEADER_TYPE)


def property_types(spark: SparkSession, path: str, element: str = "vertex") -> DataFrame:
    """What all headers under ``path`` say of each property of an element, and the type that holds them all.

    ``property, position, is_list, files, missing, stored_types, spark_type, conflict``: ``missing`` counts the files
    whose element lacks it; ``spark_type`` is the least type that every stored value fits without loss,
    null where some files have a list and others a number. ``conflict`` says that files differ.
    Headers are read in tasks.
    """
    heads = ply_headers(spark, path).where((F.col("element") == element) & F.col("property").isNotNull())
    # Whole numbers need 1, 2, 4 or 8 bytes as Spark types; a float32 holds those of 2 bytes, a float64 of 4.
    bytes_ = {"ByteType": 1, "ShortType": 2, "IntegerType": 4, "LongType": 8}
    size, is_float = F.lit(0), F.lit(False)
    for name, (kind, spark_type) in _TYPES.items():
        here = F.col("type") == name
        size = F.when(here, bytes_.get(type(spark_type).__name__, int(kind[1:]))).otherwise(size)
        is_float = F.when(here, kind[0] == "f").otherwise(is_float)
    found = heads.withColumn("_size", size).withColumn("_float", is_float).groupBy("property").agg(
        F.min("property_position").alias("position"),
        F.bool_or(F.col("length_type").isNotNull()).alias("is_list"),
        F.bool_and(F.col("length_type").isNotNull()).alias("_lists"),
        F.count_distinct("path").alias("files"),
        F.array_sort(F.collect_set("type")).alias("stored_types"),
        F.max(F.when(F.col("_float"), F.col("_size")).otherwise(0)).alias("_float"),
        F.max(F.when(~F.col("_float"), F.col("_size")).otherwise(0)).alias("_int"),
        F.count_distinct("_size", "_float").alias("_kinds"),
    )
    all_ = heads.agg(F.count_distinct("path").alias("all"), F.lit(1).alias("_one"))
    whole = F.when(F.col("_int") == 1, "tinyint").when(F.col("_int") == 2, "smallint").when(F.col("_int") == 4, "int")
    scalar = F.when(F.col("_float") == 0, whole.otherwise("bigint")).when(
        (F.col("_float") == 4) & (F.col("_int") <= 2), "float"
    ).otherwise("double")
    kind = F.when(~F.col("is_list"), scalar).when(F.col("_lists"), F.concat(F.lit("array<"), scalar, F.lit(">")))
    missing = F.col("all") - F.col("files")
    return found.withColumn("_one", F.lit(1)).join(F.broadcast(all_), "_one").select(
        "property", "position", "is_list", "files", missing.alias("missing"), "stored_types", kind.alias("spark_type"),
        (kind.isNull() | (F.col("_kinds") > 1) | (missing > 0)).alias("conflict"),
    )


def common_schema(spark: SparkSession, path: str, element: str = "vertex") -> T.StructType:
    """The schema by which all files under ``path`` can be read without loss, with option ``missing="null"``."""
    rows = property_types(spark, path, element).orderBy("position", "property").collect()
    torn = [r.property for r in rows if r.spark_type is None]
    if torn:
        raise PlyError(f"{path}: a list in some files and a number in others: {', '.join(torn)}")
    return T.StructType([T.StructField(r.property, T._parse_datatype_string(r.spark_type)) for r in rows])


_INDEX_TYPE = "path string, record long, byte long, end long, records int"


def record_index(spark: SparkSession, path: str, element: str = "vertex", every: int = 100_000) -> DataFrame:
    """Where records begin in binary files with lists: one row per stretch of about ``every`` records.

    A first pass, one task per file, that reads list lengths and decodes nothing. Store the result beside the files; with
    it any number of later reads are split over tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _INDEX_TYPE.split(", ")]
        for batch in batches:
            for name in batch["path"]:
                rows, done = [], 0
                with _open(name) as file:
                    header = read_header(name, file)
                    if header.is_ascii:
                        raise PlyError(f"{name}: an index is for binary files")
                    data = _Bytes(file, header.length, name)
                    for earlier in header.before(element):
                        for _ in _stretches(data, header, earlier):
                            pass
                    kind = header.element(element)
                    for starts in _stretches(data, header, kind, every):
                        used = _walk(data.held[starts[-1] :], 1, header, kind)[1]
                        rows.append((name, done, data.offset, data.offset + starts[-1] + used, len(starts)))
                        done += len(starts)
                yield pd.DataFrame(rows, columns=names)

    # A file to a task: the files are not read by Spark, so their sizes tell it nothing.
    return files.repartition(max(1, files.count())).mapInPandas(walk, _INDEX_TYPE)


def read_indexed(index: DataFrame, schema: T.StructType | str, element: str = "vertex") -> DataFrame:
    """The records that an index names, each stretch decoded on its own wherever Spark puts its row."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PlyReader("", schema, {"element": element})
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    header = read_header(row["path"], file)
                    held = file.read_at(row["end"] - row["byte"], row["byte"])
                kind = header.element(element)
                starts, used = _walk(held, row["records"], header, kind)
                if len(starts) < row["records"] or used != len(held):
                    raise PlyError(f"{row['path']}: not the file that was indexed")
                yield reader._batch(_gather(held, starts, header, kind, set(wanted.names)), row["path"])

    stretches = max(1, index.count())
    return index.repartition(stretches, "path", "byte").mapInArrow(decode, schema)


def check_lines(spark: SparkSession, path: str | Sequence[str], element: str = "vertex", split_bytes: int = 64 << 20) -> DataFrame:
    """``path, lines, expected`` of the ASCII files whose lines are not as many as their header says.

    Each range of a file is counted in a task of its own and the counts are added up, so no task reads a
    whole file. Files that pass can be loaded with ``splitLines`` and ``counted``.
    """
    pieces = [
        (name, start, min(start + split_bytes, size), size)
        for name, size in _list_files(path)
        for start in range(0, max(size, 1), split_bytes)
    ]
    ranges = spark.createDataFrame(pieces, "path string, start long, end long, size long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in batch.to_pylist():
                with _open(part["path"]) as file:
                    header = read_header(part["path"], file)
                    if not header.is_ascii:
                        continue
                    lines = 0
                    if part["end"] > header.length:
                        start = max(part["start"], header.length)
                        for block in _line_blocks(file, start, part["end"], header.length):
                            lines += sum(1 for line in block.split(b"\n") if line.strip())
                rows.append((part["path"], lines, header.element(element).count))
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "lines", "expected"])

    counted = ranges.repartition(max(1, len(pieces)), "path", "start").mapInArrow(count, "path string, lines long, expected long")
    summed = counted.groupBy("path").agg(F.sum("lines").alias("lines"), F.max("expected").alias("expected"))
    return summed.where("lines <> expected")


def read_lines(spark: SparkSession, path: str | Sequence[str], element: str = "vertex", split_bytes: int = 64 << 20) -> DataFrame:
    """ASCII files of one element and one instance per line, in ranges: counted first, then read, each byte twice."""
    wrong = check_lines(spark, path, element, split_bytes).first()
    if wrong:
        raise PlyError(f"{wrong.path}: {wrong.lines} lines of {element}, the header says {wrong.expected}")
    reader = spark.read.format("ply").option("element", element).option("splitLines", "true").option("counted", "true")
    return reader.option("splitBytes", str(split_bytes)).load(path)


def shard_files(path: str, shards: int, shard: int) -> list[str]:
    """The files whose place in the sorted list leaves ``shard`` modulo ``shards``."""
    return [name for i, (name, _) in enumerate(_list_files(path)) if i % shards == shard]


def shard_rows(points: DataFrame, shards: int, shard: int, source: str = "source_file") -> DataFrame:
    """Points of the files that belong to one of ``shards`` equal shares of the list."""
    listed = row_ids(points.select(source).distinct(), [source], name="_f")
    chosen = listed.where((F.col("_f") - 1) % shards == shard).select(F.col(source).alias("_source"))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    # Points without a source are a file like any other.
    return points.join(chosen, F.col(source).eqNullSafe(F.col("_source")), "left_semi")
