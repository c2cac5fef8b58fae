"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of the runs of ANCHOR words inside a window, the one with
the least hash. Equal windows have equal anchors, so documents are joined on anchors that
occur twice or more. An occurrence is extended both ways to every window whose anchor it
is; two occurrences agree on a window just when the digests of the extended windows
agree, so a passage with n copies costs n rows and never a pair. Agreeing
windows next to each other make up the maximal repeats, whose words go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarlake.llm.common import Rolling, WordHashes, pieces, release, repeated, signed, splits, texts_of, within

#: Words of an anchor. Shorter anchors are fewer, but more of them repeat by chance.
ANCHOR = 8
# Places fill 40 bits, which no split exceeds; the hash keeps the rest, and equal ones are told apart by place.
_PLACE = np.uint64((1 << 40) - 1)


class _Windows:
    """The windows of some texts, laid end to end. Windows and their seeds do not depend on the texts beside their own."""

    def __init__(self, texts: list[bytes], window: int, hashes: WordHashes):
        self.texts = texts
        words = [hashes.of(t.split()) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        flat = np.concatenate(words or [np.empty(0, np.uint64)])
        del words
        self.rolling = Rolling(flat)
        self.window = window
        n = max(0, len(flat) - window + 1)
        anchor = min(ANCHOR, window)
        # The last word of a window must belong to the document of its first.
        fits = np.zeros(len(flat) + 1, np.int32)
        whole = lengths >= window
        np.add.at(fits, self.starts[whole], 1)
        np.add.at(fits, self.ends[whole] - window + 1, -1)
        self.at = np.flatnonzero(np.cumsum(fits[:-1])[:n])
        grams = self.rolling.runs(anchor)
        # Least hash, then the rightmost place: the order depends on the window's words only.
        place = np.arange(len(grams), dtype=np.uint64)
        ranked = (grams & ~_PLACE) | (_PLACE - (place & _PLACE))
        span = window - anchor + 1
        reach = 1
        while reach * 2 <= span:
            ranked = np.minimum(ranked[: max(0, len(ranked) - reach)], ranked[reach:])
            reach *= 2
        if reach < span:
            ranked = np.minimum(ranked[: max(0, len(ranked) - (span - reach))], ranked[span - reach :])
        seed = (_PLACE - (ranked[self.at] & _PLACE)).astype(np.int64)
        self.seed = seed
        self.grams = grams

    def anchors(self) -> np.ndarray:
        """The hash of each anchor occurrence."""
        return signed(self.grams[np.unique(self.seed)])

    def extended(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is one of the given, sorted ones."""
        return self.at[within(signed(self.grams[self.seed]), anchors)]

    def digests(self, at: np.ndarray) -> np.ndarray:
        return signed(self.rolling.runs(self.window, at))


def _windows(table: pa.Table, window: int) -> Iterator[_Windows]:
    """The windows of a split, piece by piece: only texts, numbers told and one piece's words are held."""
    release()  # of the split before
    hashes = WordHashes()
    for piece in pieces(table):
        yield _Windows(texts_of(piece), window, hashes)
    hashes.clear()
    release()  # the worker may wait for long


def _counted(split: int, values: list[np.ndarray]) -> pa.Table:
    values, counts = np.unique(np.concatenate(values or [np.empty(0, np.int64)]), return_counts=True)
    return pa.table(
        {"split": pa.array(np.full(len(values), split, np.int32)), "value": pa.array(values), "n": pa.array(counts)}
    )


def _number(table: pa.Table) -> int:
    return table["split"][0].as_py()


_COUNTED = "split int, value long, n long"


def remove_repeats(
    docs: DataFrame, window: int = 35, carried: Sequence[str] = ("doc_id",), whole: bool = False
) -> DataFrame:
    """Documents without the words that a window repeated anywhere covers.

    Returns the ``carried`` columns, then ``n_words, n_removed, kept``, where ``kept`` is the
    words left, joined by one space; with ``whole``, a text that loses nothing comes back as it
    was. Windows are judged on the input; every
    occurrence goes, the first one too, and two overlapping windows of one document count
    as two. A null text has no words; texts shorter than the window stay, as do empty
    tables. Rows that repeat are documents like any other, so both lose their windows.
    Columns not carried are ignored. Windows are told apart by 64-bit digests.
    """
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                         *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    source = splits(source, *[f"c{i}" for i in range(len(carried))])
    rest = source.schema["rest"].dataType

    def seeds(table: pa.Table) -> pa.Table:
        return _counted(_number(table), [own.anchors() for own in _windows(table, window)])

    def extend(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        if not texts.num_rows or not anchors.num_rows:
            return _counted(0, [])
        known = np.sort(anchors["value"].to_numpy())
        return _counted(_number(texts), [own.digests(own.extended(known)) for own in _windows(texts, window)])

    def cut(texts: pa.Table, digests: pa.Table) -> pa.Table:
        known = np.sort(digests["value"].to_numpy()) if digests.num_rows else np.empty(0, np.int64)
        counts, removed, kept = [], [], []
        for own in _windows(texts, window):
            found = own.at[within(own.digests(own.at), known)]
            edge = np.zeros(len(own.rolling.sums) + window, np.int32)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + window, -1)
            gone = np.cumsum(edge) > 0
            left = []
            for text, lo, hi in zip(own.texts, own.starts.tolist(), own.ends.tolist()):
                away = gone[lo:hi]
                n = int(np.count_nonzero(away))
                if n or not whole:
                    words = text.split()
                    text = b" ".join([w for w, x in zip(words, away.tolist()) if not x] if n else words)
                counts.append(hi - lo)
                removed.append(n)
                left.append(text)
            kept.append(pa.array(left, pa.binary()).cast(pa.string()))
        return pa.table(
            {
                "rest": texts["rest"],
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.chunked_array(kept, pa.string()),
            }
        )

    anchors = repeated(source.groupBy("split").applyInArrow(seeds, _COUNTED), "value")
    windows = repeated(
        source.groupBy("split").cogroup(anchors.groupBy("split")).applyInArrow(extend, _COUNTED), "value"
    )
    out = T.StructType(
        [
            T.StructField("rest", rest),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    done = source.groupBy("split").cogroup(windows.groupBy("split")).applyInArrow(cut, out)
    return done.select(
        *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carried)], "n_words", "n_removed", "kept"
    )
