"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Each shingle flips one bit of a
sketch, so the Hamming distance of two sketches is never above the size of the
symmetric difference of the sets. Two sets that link differ in D shingles at most, D
following from their sizes; of D + 1 slices of a sketch at least one is then equal.
Documents meet on equal slices within a size band and are verified on the real sets.

The slices that many documents share say little, so each set leaves out its most frequent ones,
as many as there are slices beyond what pigeonhole asks for at its own size; the rarest slice of a pair is
then left out by neither.

Equal sets are one class from the start. Classes that share a slice form clusters,
found as components of a chain through each slice's classes, so a slice that all
documents share costs one row per class. Whole sketches then split a cluster: two classes of a size
band whose sketches are not too far apart stay together. What is left is verified on the sets. Both steps
compare blocks of bounded size, and only a spanning star leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import (
    Rolling,
    WordHashes,
    components,
    mix,
    released,
    signed,
    sorted_groups,
    texts_of,
    within,
)
from lidarlake.session import stage

#: Width of a size band: sizes from one bound up to this many times it.
BAND = 1.5
#: Places of a sketch for each shingle of the band's largest set. Only odd places are ever held, so their number
#: costs nothing, and with this many unrelated sets do not get equal slices by chance.
BITS = 1 << 32
#: Slices beyond those that pigeonhole asks for, as a share of these; see ``slices``.
SPARE = 0.25
#: Keys known as frequent at most, the most frequent ones. Any number gives the same links.
FREQUENT = 1_000_000
_RANK = 0x3F
#: Classes, and bytes of text, of a cluster's block; pairs of blocks are compared in one call.
BLOCK = 10_000
BLOCK_BYTES = 32 << 20


def shingle_set(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than k give one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.of(words)
    return np.unique(Rolling(values).runs(min(k, len(words))))


def _bounds(band: int) -> tuple[int, int]:
    """Least and largest size of a band."""
    return ceil(BAND**band), ceil(BAND ** (band + 1)) - 1


def _band(size: int) -> int:
    band = max(0, int(np.log(size) / np.log(BAND)))
    while _bounds(band)[0] > size:
        band -= 1
    while _bounds(band)[1] < size:
        band += 1
    return band


def _layout(band: int, num: int, den: int) -> tuple[int, int]:
    """Slices of a sketch for pairs whose smaller set is in ``band``, and the spare ones of these.

    Largest sizes of a pair are hi and hi * den / num. Their union u and intersection
    i have i >= u * num / den, so u - i <= (hi + hi * den / num) * (den - num) /
    (den + num), and one slice more than the spare ones is equal.
    """
    hi = _bounds(band)[1]
    apart = floor((hi + floor(hi * den / num)) * (den - num) / (den + num))
    spare = ceil(apart * SPARE)
    return apart + 1 + spare, spare


def _spare(size: int, band: int, num: int, den: int) -> int:
    """Slices that a set of this size may leave out of those for pairs whose smaller set is in ``band``.

    The set's own size, not the band's largest, tells how far apart its pairs are: as the smaller of two its
    partner has size * den / num shingles at most, as the larger it has a partner of the band. Two
    linked sets share all but that many slices, which is more than either of them leaves out.
    """
    hi = _bounds(band)[1]
    both = size + floor(size * den / num) if size <= hi else size + hi
    return _layout(band, num, den)[0] - 1 - floor(both * (den - num) / (den + num))


def slices(shingles: np.ndarray, band: int, num: int, den: int) -> np.ndarray:
    """The keys of a set's slices; the low bits of a key tell how many bits are odd."""
    parts, _ = _layout(band, num, den)
    width = max(1, BITS * max(_bounds(band)[1], 8) // parts)
    place = (shingles % np.uint64(width * parts)).astype(np.int64)
    odd, count = np.unique(place, return_counts=True)
    odd = odd[count % 2 == 1]
    # A slice's key: the sum of scrambled places of its set bits, its number and band.
    of = odd // width
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, of, mix(odd.astype(np.uint64) + np.uint64(1)))
    numbers = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)
    keys = mix(sums + mix(numbers + np.uint64(1 << 60)))
    bits = np.minimum(np.bincount(of, minlength=parts), _RANK).astype(np.uint64)
    return (keys & ~np.uint64(_RANK)) | bits


def parity(shingles: np.ndarray, band: int) -> bytes:
    """The whole sketch for pairs whose smaller set is in ``band``: a bit or two a shingle."""
    bits = 64 * ceil(1.5 * _bounds(band)[1] / 64)
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _spread(forest: np.ndarray, x: int, near: np.ndarray) -> None:
    """Give all labels met at ``near`` and ``x`` the least of them."""
    met = np.unique(np.append(forest[near], forest[x]))
    if len(met) > 1:
        forest[np.isin(forest, met)] = met[0]


def _refine(num: int, den: int):
    """Classes of a cluster and band whose sketches allow a link, as stars; links are not lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cluster", "band", "i", "j"]):
            if group.num_rows < 2:
                continue
            nodes, sizes = group["node"].to_numpy(), group["n_shingles"].to_numpy()
            block, lower = group["block"].to_numpy(), group["lower"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            raw = b"".join(group["sketch"].to_pylist())
            sketches = np.frombuffer(raw, np.uint64).reshape(len(nodes), -1)
            label = np.arange(len(nodes))
            cols = np.flatnonzero(block == j)
            for x in np.flatnonzero(block == i).tolist():
                y = cols[cols > x] if i == j else cols
                both = sizes[y] + sizes[x]
                # Sizes alone rule most pairs out. A class that lent itself to the band below meets
                # only that band's own classes here.
                fits = (np.minimum(sizes[y], sizes[x]) * den >= np.maximum(sizes[y], sizes[x]) * num) & (label[y] != label[x])
                if lower[x]:
                    fits &= lower[y] == 0
                y, both = y[fits], both[fits]
                if not len(y):
                    continue
                apart = np.bitwise_count(sketches[y] ^ sketches[x]).sum(1, dtype=np.int64)
                near = y[apart * (den + num) <= both * (den - num)]
                if len(near):
                    _spread(label, x, near)
            # The same class may stand in two rows, its own and the one lent to the band below.
            far = np.flatnonzero(nodes != nodes[label])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that a batch holds more than once, with their counts."""
    for batch in batches:
        keys, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        many = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(counts[many])], names=["key", "n"])


def _choose(frequent, num: int, den: int):
    """Leave out each set's spare slices: those without odd bits, then the most frequent.

    That order is the same for all sets. Two sets that link share more slices than either leaves out, so
    the first of these in the order is left out by neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        # A set has hundreds of keys: few sets at a time.
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            often = np.zeros(len(flat), np.int64)
            hit = within(flat, known)
            often[hit] = counts[np.searchsorted(known, flat[hit])]
            rank = (often << 6) + (_RANK - (flat & _RANK)) + (((flat & _RANK) == 0).astype(np.int64) << 48)
            keep = np.ones(len(flat), bool)
            for size, lo, hi in zip(sizes.tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist()):
                band, at = _band(size), lo
                while at < hi:  # the slices of the own band, then those of the band below
                    parts, _ = _layout(band, num, den)
                    spare = _spare(size, band, num, den)
                    if spare:
                        worst = np.lexsort((flat[at : at + parts], rank[at : at + parts]))[-spare:]
                        keep[at + worst] = False
                    at += parts
                    band -= 1
            owner = np.repeat(nodes, np.diff(np.append(0, ends)))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(owner[keep])], names=["key", "node"])

    return run


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, nodes, keys, whole, below = [], [], [], [], []
            texts = texts_of(batch)
            seen: set[int] = set()
            for text in texts:
                shingles = shingle_set(text.lower().split(), hashes, k)
                size = len(shingles)
                sizes.append(size)
                if not size:
                    for column in (nodes, keys, whole, below):
                        column.append(None)
                    continue
                node = xxhash.xxh3_64_intdigest(shingles.tobytes())
                nodes.append(node - (1 << 64) if node >> 63 else node)
                if node in seen:  # one row with keys is enough
                    for column in (keys, whole, below):
                        column.append(None)
                    continue
                seen.add(node)
                band = _band(size)
                own = [slices(shingles, band, num, den)]
                whole.append(parity(shingles, band))
                below.append(None)
                # As the larger set of a pair whose smaller set is in the band below.
                if band and size * num <= _bounds(band - 1)[1] * den:
                    own.append(slices(shingles, band - 1, num, den))
                    below[-1] = parity(shingles, band - 1)
                keys.append(signed(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(whole, pa.binary()),
                    pa.array(below, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "n_bytes", "keys", "whole", "below"],
            )

    return run


_SKETCHED = (
    "doc_id long, n_shingles long, node long, n_bytes long, keys array<long>, whole binary, below binary"
)
_CHAIN = "a long, b long, part int, first_key long, first_node long, last_key long, last_node long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between neighbours of one key in a sorted partition, and the partition's ends."""
    from pyspark import TaskContext

    first = last = None
    part = TaskContext.get().partitionId()
    fields = ["a", "b", "part", "first_key", "first_node", "last_key", "last_node"]

    def rows(a, b, ends):
        n = len(a) + len(ends)
        pad = [None] * len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*a.tolist(), *[None] * len(ends)], pa.int64()),
                pa.array([*b.tolist(), *[None] * len(ends)], pa.int64()),
                pa.array([*pad, *[part] * len(ends)], pa.int32()),
                *[pa.array([*pad, *[e[i] for e in ends]], pa.int64()) for i in range(4)],
            ],
            names=fields,
        ) if n else None

    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        else:
            first = (int(key[0]), int(node[0]))
        same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
        last = (int(key[-1]), int(node[-1]))
        if len(same):
            yield rows(node[same], node[same + 1], [])
    if first is not None:
        yield rows(np.empty(0, np.int64), np.empty(0, np.int64), [(*first, *last)])


def _verify(k: int, num: int, den: int):
    """A spanning star of the links of one pair of blocks.

    Sketches rule pairs out; of the others, those whose ends are not linked yet are compared.
    """

    def sketch(sets: list[np.ndarray], bits: int) -> np.ndarray:
        odd = np.array([np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 for s in sets])
        return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common * den >= (len(a) + len(b) - common) * num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in sorted_groups(batches, ["cluster", "i", "j"]):
            nodes = group["node"].to_numpy()
            # A doc_id that comes with several texts brings rows of other classes along.
            sets, mine, seen = [], [], set()
            for row, text in enumerate(texts_of(group.combine_chunks())):
                shingles = shingle_set(text.lower().split(), hashes, k)
                digest = np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)
                if digest == nodes[row] and digest not in seen:
                    seen.add(digest)
                    sets.append(shingles)
                    mine.append(row)
            if len(sets) < 2:
                continue
            nodes = nodes[mine]
            block = group["block"].to_numpy()[mine]
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            sizes = np.array([len(s) for s in sets], np.int64)
            sketches = sketch(sets, 64 * min(64, max(4, int(sizes.max()) // 16)))
            label = np.arange(len(sets))
            cols = np.flatnonzero(block == j)
            for x in np.flatnonzero(block == i).tolist():
                y = cols[cols > x] if i == j else cols
                apart = np.bitwise_count(sketches[y] ^ sketches[x]).sum(1, dtype=np.int64)
                both = sizes[y] + sizes[x]
                near = (apart * (den + num) <= both * (den - num)) & (label[y] != label[x])
                for other in y[near].tolist():
                    if label[other] != label[x] and linked(sets[x], sets[other]):
                        least, most = sorted((label[x], label[other]))
                        label[label == most] = least
            far = np.flatnonzero(label != np.arange(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])

    return run


def _with_centres(found: DataFrame) -> DataFrame:
    """``node, cluster`` of all nodes of components, their centres included."""
    centres = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(centres).withColumnRenamed("component", "cluster")


def _block_pairs(rows: DataFrame, keys: list[str], blocks) -> DataFrame:
    """Rows of a group dealt into blocks by node, once for each pair ``i, j`` their block is in.

    ``blocks`` is the number of a group's blocks, as an aggregate of its rows or a table.
    """
    if not isinstance(blocks, DataFrame):
        blocks = rows.groupBy(*keys).agg(blocks.cast("int").alias("blocks"))
    return (
        rows.join(blocks, keys)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of documents linked at Jaccard num/den.

    Texts are lower-cased in A-Z and cut at blanks. ``component_id`` is the least
    doc_id reachable by links. A text without words (or null) has no shingles and is linked with nothing:
    its component is its own doc_id. Rows that repeat are documents like any other. Rows
    without doc_id take part in links and lend no name; a component of such rows alone
    has a null name. Other columns are ignored. Sets are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stage(
        docs.mapInArrow(released(_sketch(k, num, den)), _SKETCHED),
        "jaccard-sketches",
    )
    frequent = (
        sketched.where("keys is not null")
        .select("keys")
        .mapInArrow(released(_frequent), "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key")
        .limit(FREQUENT)
        .toArrow()
        .sort_by("key")
    )
    listed = docs.sparkSession.sparkContext.broadcast((frequent["key"].to_numpy(), frequent["n"].to_numpy()))
    chained = stage(
        # A class that several batches hold comes several times, which the chain passes over: fewer rows than
        # a shuffle of all lists of keys would move.
        sketched.where("keys is not null")
        .select("node", "n_shingles", "keys")
        .mapInArrow(released(_choose(listed, num, den)), "key long, node long")
        .repartitionByRange("key", "node")
        .sortWithinPartitions("key", "node")
        .mapInArrow(_chain, _CHAIN),
        "jaccard-chain",
    )
    before = Window.orderBy("part")  # one row per partition
    seams = (
        chained.where("part is not null")
        .select(
            F.lag("last_key").over(before).alias("key"),
            F.lag("last_node").over(before).alias("a"),
            F.col("first_key"),
            F.col("first_node").alias("b"),
        )
        .where("key = first_key")
        .select("a", "b")
    )
    clusters = components(chained.where("a is not null").select("a", "b").unionByName(seams), "jaccard-clusters")
    clusters = _with_centres(clusters)
    shown = sketched.where("whole is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("whole").alias("whole"), F.first("below", True).alias("below")
    )
    # The band of a sketch is told by its length.
    shown = clusters.join(shown, "node")
    lent = shown.where("below is not null").select("cluster", "node", "n_shingles", F.col("below").alias("sketch"), F.lit(1).alias("lower"))
    laid = shown.select("cluster", "node", "n_shingles", F.col("whole").alias("sketch"), F.lit(0).alias("lower")).unionByName(lent)
    laid = stage(laid.withColumn("band", F.octet_length("sketch")), "jaccard-laid")
    close = (
        _block_pairs(laid, ["cluster", "band"], F.ceil(F.count(F.lit(1)) / BLOCK))
        .select("cluster", "band", "i", "j", "block", "node", "n_shingles", "lower", "sketch")
        .repartition("cluster", "band", "i", "j")
        .sortWithinPartitions("cluster", "band", "i", "j")
        .mapInArrow(released(_refine(num, den)), "a long, b long")
    )
    members = _with_centres(components(close, "jaccard-close"))
    known = sketched.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_bytes").alias("n_bytes")
    )
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES))
    placed = members.join(known, "node")
    texts = docs.join(placed.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc"))).select(
        "cluster", "node", "n_bytes", "text"
    )
    sized = placed.groupBy("cluster").agg(many.cast("int").alias("blocks"))
    pairs = (
        _block_pairs(texts, ["cluster"], sized)
        .select("cluster", "i", "j", "block", "node", "text")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
    )
    linked = stage(pairs.mapInArrow(released(_verify(k, num, den)), "a long, b long"), "jaccard-links")
    found = components(linked, "jaccard-components")
    found = _with_centres(found).withColumnRenamed("cluster", "component")
    named = known.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(names, "component").select(F.col("node").alias("_node"), "component_id")
    slim = sketched.select("doc_id", "n_shingles", "node")
    return slim.join(of_class, slim["node"] == of_class["_node"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
