"""Vector code compression: one short code for each part of a vector.

Components become whole numbers and a vector is cut into equal consecutive parts. The
distinct parts of each position, with their counts, form a lexicographic trie: a table
sorted by position and components. It is walked depth first. A node adds the distances of its
component to what its parent had accumulated for every entry of the codebook, so parts with a common
beginning share that work; a leaf takes the least entry and adds its count and
its components, weighted, to that entry's sums. A subtree of few leaves is walked a
depth at a time, as arrays.

A part that fills the table is one leaf. Sums are whole numbers, so the result doesn't depend on
how the table is cut into tasks. Only codebooks (entries times dimensions) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Steps of a component's unit.
SCALE = 256
#: Leaves of a subtree that is walked as arrays: bounds the memory to LEAVES * ENTRIES distances.
LEAVES = 8192


def nearest(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of ``book``, and its squared distance, of each of the sorted, distinct parts."""
    entry = np.zeros(len(leaves), np.int64)
    distance = np.zeros(len(leaves), np.int64)
    # A node: its leaves lo to hi, its depth, the distances accumulated on the way to it.
    todo = [(0, len(leaves), 0, np.zeros(len(book), np.int64))] if len(leaves) else []
    while todo:
        lo, hi, depth, summed = todo.pop()
        if hi - lo <= LEAVES or depth == leaves.shape[1]:
            entry[lo:hi], distance[lo:hi] = _subtree(leaves[lo:hi], book, depth, summed)
            continue
        column = leaves[lo:hi, depth]
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), hi - lo]
        for a, b in reversed(list(zip(cuts, cuts[1:]))):
            todo.append((lo + a, lo + b, depth + 1, summed + (column[a] - book[:, depth]) ** 2))
    return entry, distance


def _subtree(leaves: np.ndarray, book: np.ndarray, depth: int, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same below one node, all nodes of a depth at once."""
    nodes = summed[None, :]
    parent = np.zeros(len(leaves), np.int64)
    opens = np.zeros(len(leaves), bool)
    opens[0] = True
    for d in range(depth, leaves.shape[1]):
        opens[1:] |= leaves[1:, d] != leaves[:-1, d]
        first = np.flatnonzero(opens)
        values, at = np.unique(leaves[first, d], return_inverse=True)
        steps = (values[:, None] - book[None, :, d]) ** 2
        nodes = nodes[parent[first]] + steps[at]
        parent = np.cumsum(opens) - 1
    nodes = nodes[parent]
    entry = nodes.argmin(1)  # ties: the lower index
    return entry, nodes[np.arange(len(leaves)), entry]


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, parts and counts of each stretch of one position."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        values = batch.column(1).flatten().to_numpy().reshape(-1, width)
        counts = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield int(part[lo]), values[lo:hi], counts[lo:hi]


def _limit(width: int) -> int:
    """Largest component: no squared distance of whole vectors leaves 62 bits."""
    return 1 << ((62 - max(1, width).bit_length()) // 2 - 1)


def quantised(column: Column, width: int) -> Column:
    """``floor(SCALE * x)`` of each component, kept within what distances can hold."""
    most = float(_limit(width))
    return F.transform(
        column.cast("array<double>"),
        lambda x: F.floor(F.least(F.greatest(x * float(SCALE), F.lit(-most)), F.lit(most))).cast("long"),
    )


def _finite(column: Column) -> Column:
    bad = F.exists(column.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~bad


def train(kept: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part of the vectors ``vec_id, v`` (whole numbers, all of one length)."""
    # The first vectors: by id, a missing id last, equal ids by their components.
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].to_pylist()
    start = np.array(first, np.int64)
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", i * width + 1, width))
    leaves = kept.select(F.posexplode(cut).alias("part", "values")).groupBy("part", "values").agg(F.count(F.lit(1)).alias("n"))
    trie = stage(
        leaves.repartitionByRange("part", "values").sortWithinPartitions("part", "values"), "code-parts"
    )
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, entries, width + 1), np.int64)
            for part, values, counts in _runs(batches, width):
                entry, _ = nearest(values, now[part])
                np.add.at(total[part], entry, np.column_stack([values, np.ones_like(counts)]) * counts[:, None])
            part, entry = np.nonzero(total[:, :, width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
                names=["part", "entry", "sums"],
            )

        told = trie.mapInArrow(sums, "part int, entry int, sums array<long>")
        # Whole sums may need more than 64 bits.
        added = told.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width + 1)])
        books = [b.copy() for b in now]
        for row in added.collect():
            books[row.part][row.entry] = [int(row[2 + i]) // int(row[2 + width]) for i in range(width)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def _encoder(books: list[np.ndarray], width: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            vectors = batch.column(1).flatten().to_numpy().reshape(rows, -1)
            codes = np.zeros((rows, len(books)), np.uint8)
            error = np.zeros(rows, np.int64)
            for p, book in enumerate(books):
                own = vectors[:, p * width : (p + 1) * width]
                order = np.lexsort(own.T[::-1])
                ranked = own[order]
                opens = np.append(True, (ranked[1:] != ranked[:-1]).any(1))
                entry, distance = nearest(ranked[opens], book)
                leaf = np.empty(rows, np.int64)
                leaf[order] = np.cumsum(opens) - 1
                codes[:, p] = entry[leaf]
                error += distance[leaf]
            hexed, step = codes.tobytes().hex(), 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hexed[i : i + step] for i in range(0, len(hexed), step)], pa.string()), pa.array(error)],
                names=["rest", "code", "error"],
            )

    return encode


def compress(
    vectors: DataFrame,
    column: str = "embedding",
    carried: Sequence[str] = ("vec_id",),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``rest, code, error`` of each vector, ``rest`` holding the carried columns, and the codebooks.

    Codebooks start as the parts of the ``entries`` vectors of smallest ``vec_id``, follow the means of
    their parts, rounded down, for some rounds, and unused entries stay. ``code`` has two
    hexadecimal digits for each part, ``error`` is the squared distance to what the code stands for.

    Vectors that are null or hold a null or non-finite component are left out, as are those of another
    length than the first one whose length is a multiple of ``parts``: they have no such parts.
    Components beyond half a million (at 64 dimensions) count as that. With fewer vectors than
    entries, codebooks are shorter. Rows that repeat stay, each for itself; rows of equal id are told
    apart by their components where codebooks start, a missing id comes last there. An empty table
    gives no rows and no codebooks. Columns not carried are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    rest = F.struct(*[F.col(c) for c in carried]).alias("rest")
    kind = T.StructType([T.StructField("rest", vectors.select(rest).schema["rest"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    whole = vectors.where(_finite(F.col(column))).withColumn("_size", F.size(column))
    fits = whole.where((F.col("_size") > 0) & (F.col("_size") % parts == 0))
    order = F.struct(F.col("vec_id").isNull(), "vec_id", F.col(column).cast("array<double>"))
    width = fits.agg(F.min_by("_size", order)).first()[0]
    if not width:
        return vectors.sparkSession.createDataFrame([], kind), []
    same = fits.where(F.col("_size") == width)
    kept = same.select("vec_id", quantised(F.col(column), width).alias("v"), rest)
    books = train(kept.select("vec_id", "v"), parts, entries, rounds)
    return kept.select("rest", "v").mapInArrow(_encoder(books, width // parts), kind), books
