"""What several operators share: words, hashes, splits, linked components.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, which is just what
``bytes.split()`` cuts at, so texts are handled as UTF-8 bytes and never decoded.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidarlake.session import stage

#: Text of one split: what one Python call holds at a time.
SPLIT_BYTES = 8 << 20
_PART_BYTES = 24 << 20
#: Text whose words a Python call holds at a time.
PIECE_BYTES = 1 << 20
_CACHED_WORDS = 400_000
_HELD_EDGES = 1_000_000

# An odd base of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """Word to 64-bit hash, remembering a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """The text column as bytes; a missing text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [t or b"" for t in column.to_pylist()]


def pieces(table: pa.Table, name: str = "text") -> Iterator[pa.Table]:
    """A table cut into runs of rows with about PIECE_BYTES of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(table[name]), 0).to_numpy()
    lo = size = 0
    for hi, n in enumerate(sizes.tolist()):
        if size and size + n > PIECE_BYTES:
            yield table.slice(lo, hi - lo)
            lo, size = hi, 0
        size += n
    if lo < table.num_rows:
        yield table.slice(lo)


def release() -> None:
    """Give free memory back to the system. Python workers live on after a task, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back when it is done."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release()

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class Rolling:
    """Hashes of every run of k words, for any k, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up = np.full(n + 1, _BASE, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.down = np.full(n + 1, _INVERSE, np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(hashes * up[:n], out=self.sums[1:])

    def runs(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each position, or from the positions ``at``."""
        if at is None:
            n = max(0, len(self.sums) - k)
            return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n] + np.uint64(k))
        return mix((self.sums[at + k] - self.sums[at]) * self.down[at] + np.uint64(k))


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def splits(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` dealt into splits of about SPLIT_BYTES of text: ``split, text, rest``.

    ``rest`` is a struct of the columns asked for. A query that uses the result
    several times shuffles the texts once, as Spark reuses the exchange.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, math.ceil(size / SPLIT_BYTES))
    parts = max(1, math.ceil(size / _PART_BYTES))
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("int").alias("split"),
        "text",
        F.struct(*carried).alias("rest"),
    ).repartition(parts, "split")


def repeated(counts: DataFrame, value: str) -> DataFrame:
    """Of ``split, value, n`` rows those whose value counts twice or more over all splits.

    A value has one row per split at most, so that a value that fills the corpus
    is still a small group.
    """
    total = F.sum("n").over(Window.partitionBy(value))
    return counts.withColumn("_total", total).where("_total > 1").select("split", value)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut rows that come sorted by ``keys`` into one table per key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over small whole numbers; the least member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least node of each component.

    At most _HELD_EDGES are looked at together, so memory is bounded.
    """

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
            forest.join(x, y)
        roots = np.array([forest.root(x) for x in range(len(nodes))], np.int64)
        far = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[roots[far]])], names=["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= _HELD_EDGES:
            yield stars(held)
            held, count = [], 0
    if count:
        yield stars(held)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` of an undirected graph ``a, b`` (longs): the least node is the name.

    Stars are turned to smaller centres until every edge joins a node to its
    component's least node. Each round is one written table, so a lost executor costs
    no more than a round, and no task holds the neighbours of a node.
    Nodes without an edge to another node are not in the result.
    """
    kind = "a long, b long"
    # Stars of each partition, and again where the edges of a node have met: most nodes are then
    # left with one edge.
    met = edges.where("a <> b").mapInArrow(_stars, kind).repartition("a").mapInArrow(_stars, kind)
    here = stage(met.distinct(), label)
    while True:
        both = here.unionByName(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Every neighbour, and the node itself, moves to the least node seen from here.
        moved = (
            both.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = stage(moved.repartition("a").mapInArrow(_stars, kind).distinct(), label)
        # Done when each node has one edge and no centre has an edge of its own.
        once = after.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
        centres = after.select(F.col("b").alias("a")).distinct()
        open_ = once.where("n > 1").select("a").unionByName(once.join(centres, "a", "left_semi").select("a"))
        if not open_.take(1):
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        here = after
