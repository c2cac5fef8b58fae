"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of a text's words, each word followed by a blank and the text by an
end; so the tree gives any text a probability, words never seen included. A context is
up to DEPTH bytes. It becomes a state of the tree if it is frequent enough and if its
next-symbol distribution diverges from that of its longest shorter state: the likelihood gained
over all its occurrences must pay for the state. A state's distribution is
smoothed with that of the shorter state (Witten and Bell), down to the uniform one, and a
symbol is scored by the longest state that ends where it begins.

Every run of DEPTH + 1 bytes of the training texts is counted in a shuffle; states and their
tests are joins on these counts. The tree itself is bounded: a state needs the
share LEAST_SHARE of all symbols, so each depth has 1 / LEAST_SHARE states at most.

The base that the score is compared with needs each word's count over the whole corpus.
Documents are dealt into splits; each split tells its words once and gets back the counts that
others add to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import pieces, release, signed, splits, texts_of, within
from lidarlake.session import stage

#: Bytes of the longest context; with the next symbol a run must fit in 63 bits.
DEPTH = 6
#: Share and number of all symbols that a state must have been seen with.
LEAST_SHARE = 1e-6
LEAST_COUNT = 8
#: Bits of likelihood that a state must gain for each distinct symbol that follows it.
GAIN = 6.0
#: Texts are counted, and scored, in pieces of about so many bytes.
_PIECE = 512 << 10
_SCORED = 256 << 10
_NONE = np.uint64(2**64 - 1)
_PAD = b"\x00" * DEPTH
#: Odd factors of the hashed tables, and the bits of the one that remembers runs.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_MET_BITS = 19
_MASKS = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(DEPTH + 1)]


def symbols(words: list[bytes]) -> bytes:
    """A text as the tree sees it. NUL stands before every text and counts as 0x01 inside."""
    body = b" ".join(words)
    return _PAD + (body + b" \n" if words else b"\n").replace(b"\x00", b"\x01")


def runs(data: bytes) -> np.ndarray:
    """The run of DEPTH + 1 bytes that ends at each byte from DEPTH on, as a number."""
    padded = b"\x00" + data
    n = max(0, len(data) - DEPTH)
    view = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)) if n else np.empty(0, ">u8")
    return view.astype(np.uint64) & _MASKS[DEPTH]


def _slots(keys: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    return (keys * factor >> shift).view(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0

    def put(pieces: list[bytes]) -> None:
        nonlocal parts, held
        codes = runs(b"".join(pieces))
        codes = np.sort(codes[(codes & np.uint64(0xFF)) != 0])
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        parts.append((codes[starts], np.diff(np.append(starts, len(codes)))))
        held += len(starts)
        if held > 1_500_000:
            parts = [_merge(parts)]
            held = 0

    for batch in batches:
        pieces, size = [], 0
        for text in texts_of(batch):
            pieces.append(symbols(text.lower().split()))
            size += len(pieces[-1])
            if size >= _PIECE:
                put(pieces)
                pieces, size = [], 0
        if pieces:
            put(pieces)
    if parts:
        codes, counts = _merge(parts)
        for lo in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(codes[lo : lo + 100_000])), pa.array(counts[lo : lo + 100_000].astype(np.int64))],
                names=["run", "n"],
            )


class Lookup:
    """Numbers to values. Three hashed tables, and a sorted one for what fits in none.

    What is not in its empty slot is in no later table either.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for factor in _FACTORS:  # each table goes by other bits
            bits = max(4, int(2 * len(keys)).bit_length())
            shift = np.uint64(64 - bits)
            slot = _slots(keys, factor, shift)
            at = np.full(1 << bits, _NONE)
            held = np.zeros(1 << bits, np.float32)
            at[slot] = keys
            won = at[slot] == keys
            held[slot[won]] = values[won]
            self.tables.append((factor, shift, at, held))
            keys, values = keys[~won], values[~won]
        order = np.argsort(keys)
        self.rest, self.left = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the values of those."""
        # Most keys are settled by the first table, in passes over whole arrays.
        factor, shift, at, held = self.tables[0]
        slot = _slots(keys, factor, shift)
        there = at.take(slot)
        known = there == keys
        values = held.take(slot)
        values[~known] = 0
        todo = np.flatnonzero(~known & (there != _NONE))
        own = keys[todo]
        for factor, shift, at, held in self.tables[1:]:
            slot = _slots(own, factor, shift)
            there = at.take(slot)
            hit = there == own
            values[todo[hit]] = held[slot[hit]]
            known[todo[hit]] = True
            on = np.flatnonzero(~hit & (there != _NONE))
            todo, own = todo[on], own[on]
        if len(self.rest):
            hit = within(own, self.rest)
            values[todo[hit]] = self.left[np.searchsorted(self.rest, own[hit])]
            known[todo[hit]] = True
        return known, values


class Tree:
    """States with their next symbols, and the answers to frequent runs.

    ``told``: per depth, log10 probability of a run's last symbol where the context is a
    state and was followed by it. ``back``: per depth, log10 of what a state leaves to the
    shorter one for all other symbols.
    """

    def __init__(self, told: list, back: list):
        self.told, self.back = told, back
        self.frequent = (np.empty(0, np.uint64), np.empty(0, np.float32))
        self.told_at: list[Lookup] = []

    def ready(self) -> None:
        """Lookups in place of the arrays."""
        if not self.told_at:
            self.told_at = [Lookup(*t) for t in self.told]
            self.back_at = [Lookup(*b) for b in self.back]
            self.frequent_at = Lookup(*self.frequent)
            # Runs walked lately, one a slot: a rare run of one text is often in its neighbours too.
            self.met = np.full(1 << _MET_BITS, _NONE), np.zeros(1 << _MET_BITS)
            self.told = self.back = self.frequent = ()

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last symbol from the longest state before it."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        for k in range(DEPTH, -1, -1):
            own = codes[todo] & _MASKS[k]
            known, value = self.told_at[k].find(own)
            out[todo[known]] += value[known]
            todo, own = todo[~known], own[~known]
            state, value = self.back_at[k].find(own >> np.uint64(8))
            out[todo[state]] += value[state]
        out[todo] -= math.log10(256)
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        known, values = self.frequent_at.find(codes)
        out = values.astype(np.float64)
        keys, met = self.met
        todo = np.flatnonzero(~known)
        own, shift = codes[todo], np.uint64(64 - _MET_BITS)
        slot = _slots(own, _FACTORS[0], shift)
        hit = keys.take(slot) == own
        out[todo[hit]] = met[slot[hit]]
        rare, back = np.unique(own[~hit], return_inverse=True)
        walked = self.walk(rare)
        out[todo[~hit]] = walked[back]
        slot = _slots(rare, _FACTORS[0], shift)
        keys[slot], met[slot] = rare, walked  # of several runs with one slot, the last in both
        return out

    def of_texts(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text, given as its words."""
        out = np.zeros(len(texts))
        lo = 0
        while lo < len(texts):
            pieces, size, hi = [], 0, lo
            while hi < len(texts) and (not pieces or size < _SCORED):
                pieces.append(symbols(texts[hi]))
                size += len(pieces[-1])
                hi += 1
            codes = runs(b"".join(pieces))
            values = np.zeros(len(codes))
            real = (codes & np.uint64(0xFF)) != 0
            values[real] = self.scores(codes[real])
            starts = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
            out[lo:hi] = np.add.reduceat(values, starts)
            lo = hi
        return out


def _ready(shared) -> Tree:
    """The tree, ready: once in a Python worker, which keeps a broadcast for as long as its tasks use it."""
    tree = shared.value
    tree.ready()
    return tree


def grow(docs: DataFrame) -> Tree:
    """The tree of the given texts. An empty table gives the uniform distribution."""
    spark = docs.sparkSession
    counted = stage(
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_count_runs, "run long, n long")
        .groupBy("run")
        .agg(F.sum("n").alias("n")),
        "suffix-runs",
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, LEAST_SHARE * total)
    # A depth's runs are counted from those of the next one, which are fewer than all.
    levels = [counted]
    for k in range(DEPTH - 1, -1, -1):
        run = F.col("run").bitwiseAND(F.lit(int(_MASKS[k])))
        levels.insert(0, stage(levels[0].groupBy(run.alias("run")).agg(F.sum("n").alias("n")), f"suffix-runs{k}"))
    told, back = [], []
    # p: log10 probability of the last symbol of each run at the depth before.
    before = None
    for k in range(DEPTH + 1):
        state = Window.partitionBy("state")
        level = (
            levels[k]
            .withColumn("state", F.shiftright("run", 8))
            .withColumn("seen", F.sum("n").over(state))
            .withColumn("kinds", F.count(F.lit(1)).over(state))
        )
        if before is None:
            level = level.withColumn("shorter", F.lit(-math.log10(256)))
        else:
            # A shorter context was seen as often at least, so its runs are all there.
            level = level.where(F.col("seen") >= least).join(
                before, F.col("run").bitwiseAND(F.lit(int(_MASKS[k - 1]))) == F.col("before")
            )
        smooth = F.log10((F.col("n") + F.col("kinds") * F.pow(F.lit(10.0), "shorter")) / (F.col("seen") + F.col("kinds")))
        gain = F.sum(F.col("n") * (F.col("p") - F.col("shorter"))).over(state) / math.log10(2)
        level = level.withColumn("p", smooth).withColumn(
            "kept", (gain >= GAIN * F.col("kinds")) if k else F.lit(True)
        )
        level = stage(
            level.select("run", "state", "seen", "kinds", "kept", F.when(F.col("kept"), F.col("p")).otherwise(F.col("shorter")).alias("p")),
            f"suffix-depth{k}",
        )
        kept = level.where("kept")
        rows = kept.select("run", "p").toArrow()
        told.append((rows["run"].to_numpy().astype(np.int64).view(np.uint64), rows["p"].to_numpy().astype(np.float32)))
        rest = F.log10(F.col("kinds") / (F.col("seen") + F.col("kinds")))
        rows = kept.groupBy("state").agg(F.first(rest).alias("rest")).toArrow()
        back.append((rows["state"].to_numpy().astype(np.int64).view(np.uint64), rows["rest"].to_numpy().astype(np.float32)))
        before = level.select(F.col("run").alias("before"), F.col("p").alias("shorter"))
    tree = Tree(told, back)
    shared = spark.sparkContext.broadcast(tree)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            values = _ready(shared).walk(codes.view(np.uint64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["run", "p"])

    rows = counted.where(F.col("n") >= least).select("run").mapInArrow(answer, "run long, p float").toArrow()
    full = Tree(told, back)
    full.frequent = (rows["run"].to_numpy().astype(np.int64).view(np.uint64), rows["p"].to_numpy().astype(np.float32))
    return full


class _Numbers(dict):
    """Word to its number, in the order words are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Vocabulary:
    """A split's texts as numbers of words, and how often each kind is in training texts.

    Words are held for one piece at a time, which is also ``seen`` by a function.
    """

    def __init__(self, table: pa.Table, train: list[bool], seen: Callable[[list[list[bytes]]], None] | None = None):
        release()  # of the split before
        self.number = _Numbers()
        self.texts: list[np.ndarray] = []
        self.counts = np.zeros(0, np.int64)
        for piece in pieces(table):
            words = [t.lower().split() for t in texts_of(piece)]
            numbers = [np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)) for w in words]
            known = [n for n, t in zip(numbers, train[len(self.texts) :]) if t]
            counts = np.bincount(np.concatenate(known or [np.empty(0, np.int32)]), minlength=len(self.number))
            counts[: len(self.counts)] += self.counts
            self.counts = counts
            self.texts += numbers
            if seen:
                seen(words)

    def hashes(self) -> np.ndarray:
        return signed(np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number)))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all texts under a tree, and under single words, learnt from those not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are the
    words, lower-cased in A-Z, and one end. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V +
    1))) over the tokens, c being a token's count among the N training tokens of V kinds.
    ``score`` is the tree's log10 probability of the text. A null or empty text is an end
    alone. Rows that repeat are documents like any other; other columns are ignored. Words are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    tree = spark.sparkContext.broadcast(grow(docs.where("not held_out")))
    source = splits(docs, "doc_id", "held_out")

    def trained(table: pa.Table) -> list[bool]:
        return [not r["held_out"] for r in table["rest"].to_pylist()]

    def tell(table: pa.Table) -> pa.Table:
        own = _Vocabulary(table, trained(table))
        hashes = own.hashes()
        split = np.full(len(hashes), table["split"][0].as_py(), np.int32)
        return pa.table({"split": pa.array(split), "word": pa.array(hashes), "n": pa.array(own.counts)})

    def weigh(table: pa.Table, known: pa.Table) -> pa.Table:
        scores = []
        own = _Vocabulary(table, trained(table), lambda words: scores.append(_ready(tree).of_texts(words)))
        hashes, counts = own.hashes(), own.counts
        mine = counts > 0  # words whose kind this split counts
        trains = int(counts.sum())
        if known.num_rows:
            told = known["word"].to_numpy()
            order = np.argsort(told)
            told = told[order]
            hit = within(hashes, told)
            at = np.searchsorted(told, hashes[hit])
            mine[hit] = known["own"].to_numpy(zero_copy_only=False)[order][at]
            counts[hit] = known["total"].to_numpy()[order][at]
        logs = np.log10(counts + 0.1)
        rows = table.num_rows
        first = np.zeros(rows, np.int64)
        kinds, words = first.copy(), first.copy()
        kinds[0], words[0] = int(mine.sum()), trains
        return pa.table(
            {
                "rest": table["rest"],
                "n_tokens": pa.array([len(at) + 1 for at in own.texts], pa.int64()),
                "heard": pa.array([int(np.count_nonzero(counts[at])) for at in own.texts], pa.int64()),
                "logs": pa.array([float(logs[at].sum()) for at in own.texts], pa.float64()),
                "score": pa.array(np.concatenate(scores)),
                "kinds": pa.array(kinds),
                "words": pa.array(words),
            }
        )

    over = Window.partitionBy("word")
    counts = (
        source.groupBy("split")
        .applyInArrow(tell, "split int, word long, n long")
        .withColumn("total", F.sum("n").over(over))
        .withColumn("owner", F.max(F.when(F.col("n") > 0, F.col("split"))).over(over))
        .where("total <> n")  # else the split knows it all
        .select("split", "word", "total", (F.col("split") == F.col("owner")).alias("own"))
    )
    schema = source.select("rest").schema
    for name, kind in (("n_tokens", "long"), ("heard", "long"), ("logs", "double"), ("score", "double"), ("kinds", "long"), ("words", "long")):
        schema = schema.add(name, kind)
    weighed = stage(
        source.groupBy("split").cogroup(counts.groupBy("split")).applyInArrow(weigh, schema), "suffix-weighed"
    )
    kinds, words, ends = weighed.agg(
        F.sum("kinds"), F.sum("words"), F.count(F.when(~F.col("rest.held_out"), 1))
    ).first()
    kinds, words = (kinds or 0) + (ends > 0), (words or 0) + ends
    return weighed.select(
        F.col("rest.doc_id").alias("doc_id"),
        F.col("rest.held_out").alias("held_out"),
        "n_tokens",
        (F.col("heard") + int(ends > 0)).alias("n_known"),
        F.lit(words).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 0.1) - F.col("n_tokens") * math.log10(words + 0.1 * (kinds + 1))).alias("base_score"),
        "score",
    )
