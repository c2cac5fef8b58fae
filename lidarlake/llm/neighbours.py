"""Largest inner products by stable projections and kd-trees.

Vectors get one more component, so that all have the same norm and the largest inner product
is the least distance. PLACES Gaussian projections of a pair at distance d lie at a
distance whose square is d squared times a chi-square variable. Each block of
vectors is a kd-tree over its projections. For a query the tree's leaves are opened by the distance of their
boxes, and their vectors verified exactly by their own projected distance, the nearest first, until
a vector as near as the k-th best would project as far as the next one with a chance of MISS at most.
MISS is thus the share of neighbours at the k-th distance that may be missed in a block; nearer ones are
missed less.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 32
MISS = 0.06
LEAF = 64
#: Vectors, and share of a block's, that are verified before the test is made again.
STEP = 64
STEPS = 32
#: Vectors of a tree, and queries that visit it in one call.
BLOCK = 8192
QUERIES = 4096


def chi_square_point(miss: float, places: int = PLACES) -> float:
    """Where a chi-square variable of an even number of degrees is exceeded with chance ``miss``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        half = x / 2
        beyond = math.exp(-half) * sum(half**i / math.factorial(i) for i in range(places // 2))
        low, high = (x, high) if beyond > miss else (low, x)
    return high


class Tree:
    """A kd-tree over rows of points: leaves as stretches of ``order`` with their boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        cuts, low, high = [], [], []
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            own = points[self.order[lo:hi]]
            least, most = own.min(0), own.max(0)
            wide = int(np.argmax(most - least))
            if hi - lo <= LEAF or most[wide] == least[wide]:
                cuts.append((lo, hi))
                low.append(least)
                high.append(most)
                continue
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, wide], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.cuts = np.array(cuts)
        self.low, self.high = np.array(low), np.array(high)

    def apart(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of the point to each leaf's box."""
        off = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (off * off).sum(1)


def _projections(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, PLACES))


class Block:
    """Vectors, all different, with a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, norm2: float):
        size = vectors.shape[1]
        self.norm2 = norm2
        self.axes = _projections(size + 1)
        last = np.sqrt(np.maximum(0, norm2 - (vectors * vectors).sum(1)))
        points = np.column_stack([vectors, last]) @ self.axes
        self.tree = Tree(points)
        self.order = self.tree.order
        self.vectors = np.ascontiguousarray(vectors[self.order])
        self.points = np.ascontiguousarray(points[self.order])
        self.squares = (self.points * self.points).sum(1)

    def near(self, question: np.ndarray, k: int, point: float) -> tuple[np.ndarray, int]:
        """Rows that may be among the k + 1 largest products found, and how many were verified."""
        where = question @ self.axes[: len(question)]
        base = self.norm2 + float(question @ question)
        apart = self.tree.apart(where)
        leaves = np.argsort(apart, kind="stable")
        told = np.full(len(self.vectors), -np.inf)
        projected = self.squares - 2 * (self.points @ where) + float(where @ where)
        rows, away = np.empty(0, np.int64), np.empty(0)  # of opened leaves, not verified yet, nearest first
        opened, step, verified, best, done = 0, max(4, len(leaves) // 4), 0, np.empty(0), False
        stride = max(STEP, len(self.vectors) // STEPS)
        while not done and (opened < len(leaves) or len(rows)):
            if opened < len(leaves):
                more = np.concatenate([np.arange(*self.tree.cuts[i]) for i in leaves[opened : opened + step]])
                rows = np.append(rows, more)
                rows = rows[np.argsort(projected[rows], kind="stable")]
                away = projected[rows]
                opened += step
                step *= 2
            # Nearer than any leaf that is still closed.
            sure = np.searchsorted(away, apart[leaves[opened]], "right") if opened < len(leaves) else len(rows)
            at = 0
            while at < sure:
                # Squared distance of the k-th best, of which the query itself may be one.
                if len(best) > k and away[at] >= point * max(0.0, base - 2 * best[0]):
                    done = True
                    break
                now = rows[at : min(at + stride, sure)]
                told[now] = self.vectors[now] @ question
                verified += len(now)
                at += len(now)
                best = np.append(best, told[now])
                if len(best) > k + 1:
                    best = np.partition(best, len(best) - k - 1)[len(best) - k - 1 :]
            rows, away = rows[at:], away[at:]
        worst = best.min() if len(best) > k else -np.inf
        slack = 1e-9 * (1 + abs(worst)) if worst > -np.inf else 0.0
        return np.flatnonzero((told > -np.inf) & (told >= worst - slack)), verified


def _search(k: int, norm2: float):
    point = chi_square_point(MISS)
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["vec_id"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return ids, flat.reshape(len(ids), -1).astype(np.float64)

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return empty
        ids, vectors = rows_of(index)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        # Equal vectors are one point; of their ids only the k + 1 least can ever be told.
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        by = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by], np.arange(len(first) + 1))
        members = [np.unique(ids[by[a:b]])[: k + 1] for a, b in zip(starts, starts[1:])]
        block = Block(vectors[first], norm2)
        members = [members[i] for i in block.order]
        asked, questions = rows_of(queries)
        out_q, out_v, out_s = [], [], []
        for own, question in zip(asked.tolist(), questions):
            rows, _ = block.near(question, k, point)
            exact = (block.vectors[rows] * question).sum(1)  # in one order of summing, whatever the block
            found = sorted((-s, v) for r, s in zip(rows.tolist(), exact.tolist()) for v in members[r].tolist() if v != own)[:k]
            out_q += [own] * len(found)
            out_v += [v for _, v in found]
            out_s += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of rows that can be compared: no null or non-finite part, not zero."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & ~odd & some
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products found for each query.

    Every usable row is a candidate except those with the query's own vec_id. Equal scores go to
    the smaller vec_id; rows that repeat count once. Vectors of another length than the
    query's are not compared with it. A vec_id that asks with several vectors gets the best
    answers to any of them. Other columns are ignored. Blocks of BLOCK vectors meet
    blocks of QUERIES queries, each pair in a call of its own.
    """
    vectors, queries = usable(vectors), usable(queries).distinct()
    size = F.size("embedding").alias("dim")
    norms = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, norm2 = vectors.agg(F.count(F.lit(1)), F.max(norms)).first()
    asked = queries.count()
    blocks, parts = max(1, math.ceil((n or 0) / BLOCK)), max(1, math.ceil(asked / QUERIES))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    deal = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    left = vectors.select("*", size, deal(blocks).alias("block"), every(parts).alias("part"))
    right = queries.select("*", size, deal(parts).alias("part"), every(blocks).alias("block"))
    keys = ["dim", "block", "part"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(_search(k, float(norm2 or 0.0)), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
