"""Totals of the points in many shapes at once, without a row for each pair.

Points of one place are one row with their count. These rows are laid out in tiles of bounded size: slabs of x, each
cut along y. A small table tells every tile's box and totals; each shape walks down a tree over it. Tiles wholly in
a shape give it their totals, tiles outside are left, and only tiles that the shape's edge cuts get to know it. There a
tree over the tile's points goes on in the same way, so that single points are tested along the edge alone.

Whether a box is wholly inside or outside is decided so that every point in it would be told the same by the test of
single points, to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.operators.patch import explode_patches
from lidarlake.session import stage

#: Column of a total to ("min" or "max", dimension).
Totals = Mapping[str, tuple[str, str]]

# Places in a tile are two to this power, more only beyond so many tiles: their boxes go to every task.
TILE_BITS = 16
MOST_TILES = 100_000
MOST_SLABS = 64
# Places of a tree's leaf, pairs of an edge or shape with a box or point that are looked at in one go, and
# shapes of a batch.
LEAF = 32
PAIRS = 1 << 18
SHAPES = 2_000
# Shapes of a block of a tile, counted by edges; more if the tile has more places.
BLOCK_EDGES = 20_000
# Nearer than this share of its figures, an edge counts as cutting a box.
_SLACK = 1e-9

_MOST = np.int64(2**63 - 1)
_WORST = {"max": np.int64(-(2**63)), "min": _MOST}
_MERGE = {"max": np.maximum, "min": np.minimum}
_NAN = np.float64("nan").view(np.int64) & _MOST
_KINDS = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def _codes(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Whole numbers in the order of the values, as Spark has it: NaN above all. What is missing loses."""
    missing = column.is_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_null().to_numpy()
    values = np.array(column.fill_null(0.0), np.float64) + 0.0
    bits = np.where(np.isnan(values), _NAN, values.view(np.int64))
    return np.where(missing, _WORST[kind], bits ^ ((bits >> 63) & _MOST))


def _decoded(codes: np.ndarray, kind: str) -> pa.Array:
    bits = codes ^ ((codes >> 63) & _MOST)
    return pa.array(bits.view(np.float64), pa.float64(), mask=codes == _WORST[kind])


class Pairs(NamedTuple):
    """Pairs of a shape and a node of a tree; for polygons, how many edges each still has, and which."""

    shape: np.ndarray
    node: np.ndarray
    sizes: np.ndarray | None
    edges: np.ndarray | None

    def where(self, keep: np.ndarray) -> Pairs:
        if self.sizes is None:
            return Pairs(self.shape[keep], self.node[keep], None, None)
        return Pairs(self.shape[keep], self.node[keep], self.sizes[keep], self.edges[np.repeat(keep, self.sizes)])

    def children(self) -> Pairs:
        node = np.concatenate([2 * self.node, 2 * self.node + 1])
        twice = [None if a is None else np.concatenate([a, a]) for a in (self.shape, self.sizes, self.edges)]
        return Pairs(twice[0], node, twice[1], twice[2])

    def weight(self) -> int:
        return len(self.shape) + (0 if self.edges is None else len(self.edges))

    def halves(self) -> list[Pairs]:
        first = np.arange(len(self.shape)) < len(self.shape) // 2
        return [self.where(first), self.where(~first)]


OUT, WHOLE, CUT = 0, 1, 2


class Discs:
    """Discs with their edge: ``cx, cy, r`` of each."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.count = len(lengths)
        self.cx, self.cy, self.r = flat.reshape(-1, 3).T

    def start(self) -> Pairs:
        return Pairs(np.arange(self.count), np.zeros(self.count, np.int64), None, None)

    def classed(self, pairs: Pairs, box: Sequence[np.ndarray]) -> tuple[np.ndarray, Pairs]:
        """Where each pair's box lies. Differences, squares and sums are rounded in order, so corners speak for all."""
        x0, x1, y0, y1 = box
        cx, cy, r = self.cx[pairs.shape], self.cy[pairs.shape], self.r[pairs.shape]
        left, right, low, high = x0 - cx, x1 - cx, y0 - cy, y1 - cy
        dx, dy = np.maximum(np.maximum(left, -right), 0), np.maximum(np.maximum(low, -high), 0)
        far_x, far_y = np.maximum(abs(left), abs(right)), np.maximum(abs(low), abs(high))
        whole = far_x * far_x + far_y * far_y <= r * r
        out = dx * dx + dy * dy > r * r
        return np.where(out, OUT, np.where(whole, WHOLE, CUT)), pairs

    def inside(self, pairs: Pairs, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shape = pairs.shape[owner]
        dx, dy, r = x - self.cx[shape], y - self.cy[shape], self.r[shape]
        return dx * dx + dy * dy <= r * r

    def told(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        rows = np.stack([self.cx, self.cy, self.r], axis=1)[pairs.shape]
        return rows.ravel(), np.full(len(rows), 3)


class Polygons:
    """Polygons by the even-odd rule with their edge: ``x1, y1, x2, y2`` of every edge."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.count = len(lengths)
        self.sizes = lengths // 4
        self.x1, self.y1, self.x2, self.y2 = (np.ascontiguousarray(c) for c in flat.reshape(-1, 4).T)
        slack = _SLACK * (abs(self.x1) + abs(self.x2))
        self.left, self.right = np.minimum(self.x1, self.x2) - slack, np.maximum(self.x1, self.x2) + slack
        self.low, self.high = np.minimum(self.y1, self.y2), np.maximum(self.y1, self.y2)

    def start(self) -> Pairs:
        return Pairs(np.arange(self.count), np.zeros(self.count, np.int64), self.sizes, np.arange(len(self.x1)))

    def _crosses(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        # NaN is above all numbers in Spark.
        return ((y1 > y) != (y2 > y)) & ((x < at) | np.isnan(at))

    def _touches(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        level = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0
        within = (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2))
        return level & within & (y >= self.low[e]) & (y <= self.high[e])

    def classed(self, pairs: Pairs, box: Sequence[np.ndarray]) -> tuple[np.ndarray, Pairs]:
        """Where each pair's box lies, and the edges beside or right of it, which alone matter within it."""
        owner = np.repeat(np.arange(len(pairs.shape)), pairs.sizes)
        x0, x1, y0, y1 = box
        e = pairs.edges
        beside = (self.high[e] >= y0[owner]) & (self.low[e] <= y1[owner]) & (self.right[e] >= x0[owner])
        e, owner = e[beside], owner[beside]
        pairs = Pairs(pairs.shape, pairs.node, np.bincount(owner, minlength=len(pairs.shape)), e)
        x0, x1, y0, y1 = x0[owner], x1[owner], y0[owner], y1[owner]
        meets = self.left[e] <= x1
        # The line of such an edge may still pass the box by.
        dx, dy = self.x2[e] - self.x1[e], self.y2[e] - self.y1[e]
        a, b = dx * (y0 - self.y1[e]), dx * (y1 - self.y1[e])
        c, d = dy * (x0 - self.x1[e]), dy * (x1 - self.x1[e])
        least, most = np.minimum(a, b) - np.maximum(c, d), np.maximum(a, b) - np.minimum(c, d)
        sizes = np.maximum(abs(a), abs(b)) + np.maximum(abs(c), abs(d)) + abs(dy * self.x1[e])
        meets &= ~((least > _SLACK * sizes) | (most < -_SLACK * sizes))
        cut = np.bincount(owner[meets], minlength=len(pairs.shape)) > 0
        # An upright or level edge may hold all of a box without width: its points lie on the edge.
        upright = (dx == 0) & (x0 == x1) & (x0 == self.x1[e]) & (self.low[e] <= y0) & (self.high[e] >= y1)
        flat = (dy == 0) & (y0 == y1) & (y0 == self.y1[e])
        flat &= (np.minimum(self.x1[e], self.x2[e]) <= x0) & (np.maximum(self.x1[e], self.x2[e]) >= x1)
        on = np.bincount(owner[upright | flat], minlength=len(pairs.shape)) > 0
        odd = np.bincount(owner[self._crosses(e, x0, y0)], minlength=len(pairs.shape)) % 2 == 1
        return np.where(on, WHOLE, np.where(cut, CUT, np.where(odd, WHOLE, OUT))), pairs

    def inside(self, pairs: Pairs, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = np.zeros(len(owner), bool)
        starts = np.cumsum(pairs.sizes) - pairs.sizes
        ends = np.cumsum(pairs.sizes[owner])
        lo = 0
        while lo < len(owner):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + 4 * PAIRS, side="right")))
            mine, own = pairs.sizes[owner[lo:hi]], owner[lo:hi]
            point = np.repeat(np.arange(hi - lo), mine)
            nth = np.arange(len(point)) - np.repeat(np.cumsum(mine) - mine, mine)
            e = pairs.edges[starts[own][point] + nth]
            px, py = x[lo:hi][point], y[lo:hi][point]
            odd = np.bincount(point[self._crosses(e, px, py)], minlength=hi - lo) % 2 == 1
            found[lo:hi] = odd | (np.bincount(point[self._touches(e, px, py)], minlength=hi - lo) > 0)
            lo = hi
        return found

    def told(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        e = pairs.edges
        return np.stack([self.x1[e], self.y1[e], self.x2[e], self.y2[e]], axis=1).ravel(), 4 * pairs.sizes


class _Tree:
    """Boxes halved along their longer side, level by level, with the totals of each half.

    All nodes of a level have the same number of boxes: empty ones, which are in nothing and count nothing, fill up.
    """

    def __init__(self, box: Sequence[np.ndarray], n: np.ndarray, kinds: Sequence[str], codes: Sequence[np.ndarray], leaf: int):
        rows = len(n)
        depth = max(0, math.ceil(math.log2(rows / leaf))) if rows else 0
        self.leaf = max(1, -(-rows // 2**depth))
        more = self.leaf * 2**depth - rows
        empty = (math.inf, -math.inf, math.inf, -math.inf)
        self.box = [np.append(b, np.full(more, v)) for b, v in zip(box, empty)]
        self.kinds = kinds
        order = np.arange(rows + more)
        for level in range(depth):
            x0, x1, y0, y1 = (b[order].reshape(2**level, -1) for b in self.box)
            wide = x1.max(1) - x0.min(1) >= y1.max(1) - y0.min(1)
            by = np.argsort(np.where(wide[:, None], x0, y0), axis=1, kind="stable")
            order = np.take_along_axis(order.reshape(2**level, -1), by, axis=1).ravel()
        self.order = order
        self.box = [b[order] for b in self.box]
        self.n = np.append(n, np.zeros(more, np.int64))[order]
        self.codes = [np.append(c, np.full(more, _WORST[k]))[order] for k, c in zip(kinds, codes)]
        self.levels = []
        for level in range(depth + 1):
            x0, x1, y0, y1 = (b.reshape(2**level, -1) for b in self.box)
            best = [_MERGE[k].reduce(c.reshape(2**level, -1), axis=1) for k, c in zip(kinds, self.codes)]
            self.levels.append(
                ((x0.min(1), x1.max(1), y0.min(1), y1.max(1)), self.n.reshape(2**level, -1).sum(1), best)
            )

    def totals(self, shapes, cut: Callable[[Pairs], None] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Count and best codes of each shape. Pairs with leaves that are cut go to ``cut``, if given, and else
        their points are tested."""
        count = np.zeros(shapes.count, np.int64)
        best = [np.full(shapes.count, _WORST[k]) for k in self.kinds]

        def add(shape, at, n, codes):
            np.add.at(count, shape, n[at])
            for kind, total, code in zip(self.kinds, best, codes):
                _MERGE[kind].at(total, shape, code[at])

        todo = [(0, shapes.start())]
        while todo:
            level, pairs = todo.pop()
            if not len(pairs.shape):
                continue
            if pairs.weight() > PAIRS and len(pairs.shape) > 1:
                todo += [(level, half) for half in pairs.halves()]
                continue
            box, n, codes = self.levels[level]
            where, pairs = shapes.classed(pairs, [b[pairs.node] for b in box])
            whole = where == WHOLE
            add(pairs.shape[whole], pairs.node[whole], n, codes)
            pairs = pairs.where(where == CUT)
            if level + 1 < len(self.levels):
                todo.append((level + 1, pairs.children()))
            elif cut is not None:
                cut(pairs)
            else:
                step = max(1, PAIRS // self.leaf)
                for lo in range(0, len(pairs.shape), step):
                    owner = np.repeat(np.arange(lo, min(lo + step, len(pairs.shape))), self.leaf)
                    at = pairs.node[owner] * self.leaf + np.tile(np.arange(self.leaf), len(owner) // self.leaf)
                    found = shapes.inside(pairs, owner, self.box[0][at], self.box[2][at])
                    add(pairs.shape[owner[found]], at[found], self.n, self.codes)
        return count, best


def _of_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and how many each list has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, pa.float64()))


def _walk(kind, known, names: Sequence[str], merges: Sequence[str]):
    """Shapes told by the tiles that they hold, and told to the tiles that they cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, n, codes, slab, block = known.value
        with np.errstate(all="ignore"):
            tree = _Tree(box, n, merges, codes, 1)
            for batch in (b.slice(lo, SHAPES) for b in batches for lo in range(0, b.num_rows, SHAPES)):
                cuts: list[Pairs] = []
                shapes = kind(*_of_lists(batch["_shape"]))
                count, best = tree.totals(shapes, cuts.append)
                held = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].take(pa.array(held)) for c in ("_id", "_times")],
                        *[pa.nulls(len(held), t) for t in (pa.list_(pa.float64()), pa.int32(), pa.int64())],
                        pa.array(count[held]),
                        *[_decoded(b[held], k) for k, b in zip(merges, best)],
                    ],
                    names=["_id", "_times", "_shape", "_slab", "_block", "n", *names],
                )
                for pairs in cuts:
                    tile = tree.order[pairs.node]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch[c].take(pa.array(pairs.shape)) for c in ("_id", "_times")],
                            _lists(*shapes.told(pairs)),
                            pa.array(slab[tile], pa.int32()),
                            pa.array(block[tile], pa.int64()),
                            *[pa.nulls(len(tile), t) for t in (pa.int64(), *[pa.float64()] * len(names))],
                        ],
                        names=["_id", "_times", "_shape", "_slab", "_block", "n", *names],
                    )

    return run


def _in_tile(kind, names: Sequence[str], merges: Sequence[str]):
    """Totals of the points of one tile in each of the shapes that cut it."""

    def run(places: pa.Table, asked: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            x, y = (places[c].to_numpy() for c in ("_x", "_y"))
            codes = [_codes(places[c], k) for c, k in zip(names, merges)] if asked.num_rows else []
            count, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
            best = [np.zeros(0, np.int64) for _ in merges]
            if asked.num_rows and places.num_rows:
                tree = _Tree((x, x, y, y), places["n"].to_numpy(), merges, codes, LEAF)
                count, best = tree.totals(kind(*_of_lists(asked["_shape"])))
                held = np.flatnonzero(count)
        return pa.Table.from_arrays(
            [
                *[asked[c].take(pa.array(held)) for c in ("_id", "_times")],
                pa.array(count[held]),
                *[_decoded(b[held], k) for k, b in zip(merges, best)],
            ],
            names=["_id", "_times", "n", *names],
        )

    return run


def _tiles(points: DataFrame, sums: list, tile_bits: int) -> DataFrame:
    """One row per place, ``_x, _y, n`` and the totals, with the tile it is in: ``_slab, _block``."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sure = points.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    places = sure.groupBy(x.alias("_x"), y.alias("_y")).agg(F.count(F.lit(1)).alias("n"), *sums)
    places = stage(places, "places")
    rows = places.count()
    bits = max(tile_bits, math.ceil(math.log2(max(1, rows / MOST_TILES))))
    slabs = min(MOST_SLABS, math.ceil(math.sqrt(rows / 2**bits)))
    cuts = []
    if slabs > 1:
        cuts = places.agg(F.percentile_approx("_x", [i / slabs for i in range(1, slabs)])).first()[0]
    slab = sum(((F.col("_x") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    order = ["_slab", "_y", "_x"]
    laid = places.withColumn("_slab", slab).repartitionByRange(*order).sortWithinPartitions(*order)
    # Rows of a partition are numbered in their order from a multiple of 2^33.
    return stage(laid.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), bits)), "tiles")


def shape_totals(
    patches: DataFrame, shapes: DataFrame, kind: type, totals: Totals, split_rows: int, tile_bits: int = TILE_BITS
) -> DataFrame:
    """``_id``, ``n`` and the totals of the points in each of ``shapes(_id, _times, _shape)``; none without points.

    ``_shape`` holds the numbers that ``kind`` knows a shape by. A tile that more than ``split_rows`` shapes cut is
    given to several tasks, each with a block of the shapes, but no block has fewer edges than the tile has
    places: what is repeated stays below what there is.
    """
    spark = patches.sparkSession
    fields = {f.name: f.dataType.elementType for f in patches.schema if isinstance(f.dataType, T.ArrayType)}
    for merge, dim in totals.values():
        if merge not in _MERGE or not isinstance(fields[dim], _KINDS):
            raise ValueError(f"no {merge} of {dim}: only min and max of floating-point numbers and integers up to 32 bits")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merges = [merge for merge, _ in totals.values()]
    names = [f"_s{i}" for i in range(len(merges))]
    ends = {"min": F.min, "max": F.max}
    points = explode_patches(patches, list(dict.fromkeys(["x", "y", *[d for _, d in totals.values()]])))
    sums = [ends[m](F.col(d).cast("double")).alias(s) for s, (m, d) in zip(names, totals.values())]
    merged = [ends[m](s).alias(s) for s, m in zip(names, merges)]
    tiles = _tiles(points, sums, tile_bits)
    box = [f(c).alias(f"_{i}") for i, (f, c) in enumerate([(F.min, "_x"), (F.max, "_x"), (F.min, "_y"), (F.max, "_y")])]
    rows = F.count(F.lit(1)).alias("_rows")
    summed = stage(tiles.groupBy("_slab", "_block").agg(*box, rows, F.sum("n").alias("n"), *merged), "tile-sums")
    told = summed.toArrow()
    known = spark.sparkContext.broadcast(
        (
            [told[f"_{i}"].to_numpy() for i in range(4)],
            told["n"].to_numpy(),
            [_codes(told[s], m) for s, m in zip(names, merges)],
            told["_slab"].to_numpy(),
            told["_block"].to_numpy(),
        )
    )
    of_id = f"`_id` {shapes.schema['_id'].dataType.simpleString()}, _times long"
    found = f"n long, {', '.join(f'{s} double' for s in names)}" if names else "n long"
    walked = stage(
        shapes.select("_id", "_times", "_shape")
        .repartition(parts, F.xxhash64("_shape"))
        .mapInArrow(_walk(kind, known, names, merges), f"{of_id}, _shape array<double>, _slab int, _block long, {found}"),
        "shape-tiles",
    )
    cuts = walked.where("_slab is not null").select("_id", "_times", "_shape", "_slab", "_block")
    tile = ["_slab", "_block"]
    edges = cuts.groupBy(*tile).agg(F.sum(F.ceil(F.size("_shape") / 4)).alias("_edges"))
    most = F.greatest(F.lit(min(split_rows, BLOCK_EDGES)), F.col("_rows"))
    cut = edges.join(summed.select(*tile, "_rows"), tile).select(*tile, F.ceil(F.col("_edges") / most).cast("int").alias("_cuts"))
    # No more rows than tiles.
    cut = F.broadcast(stage(cut, "tile-cuts"))
    every = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    places = tiles.join(cut, tile).withColumn("_cut", every).drop("_cuts")
    dealt = F.pmod(F.xxhash64("_id", "_shape"), F.col("_cuts")).cast("int")
    asked = cuts.join(cut, tile).withColumn("_cut", dealt).drop("_cuts")
    group = [*tile, "_cut"]
    opened = (
        places.repartition(parts, *group)
        .groupBy(*group)
        .cogroup(asked.repartition(parts, *group).groupBy(*group))
        .applyInArrow(_in_tile(kind, names, merges), f"{of_id}, {found}")
    )
    taken = walked.where("_slab is null").select(*opened.columns)
    both = taken.unionByName(opened).groupBy("_id").agg(F.sum(F.col("n") * F.col("_times")).alias("n"), *merged)
    of_dims = [F.col(s).cast(fields[d]).alias(name) for s, (name, (_, d)) in zip(names, totals.items())]
    return both.select("_id", "n", *of_dims)
