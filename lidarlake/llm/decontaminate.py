"""Benchmark decontamination by exact pieces.

An item of n words with up to e edits allowed is cut into e + 1 pieces. An edit touches one
piece at most, so wherever the item stands with up to e edits, one of its pieces stands
unedited: no place is missed, whatever the item's length. Pieces are looked up by the hash of
the run of words at every word of every document; where one is met, the words around are
counted against the item's, and then the item is aligned with that place exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import Rolling, WordHashes, mix

#: Words of a piece that are looked up; of a longer piece, its first ones.
LONGEST = 8
#: Items that one pass over the documents carries along.
ITEMS = 20_000
_WORD = re.compile(r"\w+")
_CHUNK = 1 << 16
#: Places that are looked at together.
_PLACES = 1 << 14


def normal_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits: case, punctuation and decoration don't count."""
    return _WORD.findall(text.lower()) if text else []


def best_alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the region: distance, start, end."""

    def last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        steps = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64)
        for i, word in enumerate(x, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != word))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = last_row(item, region)
    end = int(row.argmin())
    back = last_row(item[::-1], region[:end][::-1])
    distance = int(row[end])
    start = end - int(np.flatnonzero(back == distance)[0]) if (back == distance).any() else 0
    return distance, start, end


class _Items:
    """One block of items with the hashes of all their pieces."""

    def __init__(self, ids: list, texts: list[str | None], share: float):
        hashes = WordHashes()
        self.ids, self.words = [], []
        for number, text in zip(ids, texts):
            words = hashes.of(normal_words(text))
            if len(words):
                self.ids.append(number)
                self.words.append(words)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.most = np.array([math.floor(share * len(w)) for w in self.words], np.int64)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            rolling = Rolling(words)
            many = int(self.most[i]) + 1
            for piece in range(many):
                lo, hi = piece * len(words) // many, (piece + 1) * len(words) // many
                size = min(hi - lo, LONGEST)
                pieces.setdefault(size, []).append((int(rolling.runs(size, np.array([lo]))[0]), i, lo))
        self.pieces = []
        for size, rows in sorted(pieces.items()):
            rows.sort()
            keys, item, offset = zip(*rows)
            self.pieces.append((size, np.array(keys, np.uint64), np.array(item), np.array(offset)))

    def ready(self) -> None:
        """Bit tables: which run hashes, and which words of which item, may be there."""
        self.seen = []
        for _, keys, _, _ in self.pieces:
            seen = np.zeros(1 << 22, bool)
            seen[keys >> np.uint64(42)] = True
            self.seen.append(seen)
        bits = max(10, int(16 * self.lengths.sum()).bit_length())
        self.shift = np.uint64(64 - bits)
        self.salt = mix(np.arange(1, len(self.words) + 1, dtype=np.uint64))
        self.member = np.zeros(1 << bits, bool)
        for salt, words in zip(self.salt, self.words):
            self.member[mix(words ^ salt) >> self.shift] = True

    def places(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, texts and the places where the items would start, wherever a piece stands."""
        rolling = Rolling(words)
        for (size, keys, item, offset), seen in zip(self.pieces, self.seen):
            mine = rolling.runs(size)
            at = np.flatnonzero(seen[mine >> np.uint64(42)])
            doc = np.searchsorted(ends, at, "right")
            at, doc = at[at + size <= ends[doc]], doc[at + size <= ends[doc]]
            lo = np.searchsorted(keys, mine[at], "left")
            many = np.searchsorted(keys, mine[at], "right") - lo
            met = many > 0
            at, doc, lo, upto = at[met], doc[met], lo[met], np.cumsum(many[met])
            # The places in order, so many at a time.
            for first in range(0, int(upto[-1]) if len(upto) else 0, _PLACES):
                place = np.arange(first, min(first + _PLACES, int(upto[-1])))
                run = np.searchsorted(upto, place, "right")
                row = lo[run] + place - np.where(run > 0, upto[run - 1], 0)
                yield item[row], doc[run], at[run] - offset[row]

    def likely(self, words: np.ndarray, found: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places with enough words of the item around; none where the item stands is left out."""
        lengths = hi - lo
        ends = np.cumsum(lengths)
        of = np.repeat(np.arange(len(found)), lengths)
        word = words[np.arange(int(ends[-1])) - (ends - lengths)[of] + lo[of]]
        hit = self.member[mix(word ^ self.salt[found][of]) >> self.shift]
        return np.bincount(of[hit], minlength=len(found)) >= (self.lengths - self.most)[found]


def _search(items: _Items):
    def chunk(ids: list, texts: list[np.ndarray]) -> list[tuple]:
        ends = np.cumsum([len(t) for t in texts])
        flat = np.concatenate(texts)
        out: dict[tuple[int, int], tuple] = {}
        tried = set()
        for found, doc, starts in items.places(flat, ends):
            # Starts as near as the edits allowed share one region.
            near = starts // (items.most[found] + 1)
            order = np.lexsort((near, doc, found))
            found, doc, starts, near = found[order], doc[order], starts[order], near[order]
            new = np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1]) | (near[1:] != near[:-1]))
            found, doc, starts, near = found[new], doc[new], starts[new], near[new]
            spare = 2 * items.most[found] + 1
            lo = np.maximum(np.where(doc > 0, ends[doc - 1], 0), starts - spare)
            hi = np.minimum(ends[doc], starts + items.lengths[found] + spare)
            may = items.likely(flat, found, lo, hi)
            for i, d, place, low, high in zip(*(x[may].tolist() for x in (found, doc, near, lo, hi))):
                if (i, d, place) in tried:
                    continue
                tried.add((i, d, place))
                region, most = flat[low:high], int(items.most[i])
                # Words of the item that the region lacks must be edited away.
                if np.count_nonzero(~np.isin(items.words[i], region)) > most:
                    continue
                distance, begin, end = best_alignment(items.words[i], region)
                if distance <= most and (distance, low + begin) < out.get((d, i), (1 << 30,))[:2]:
                    out[d, i] = (distance, low + begin, low + end)
        return [
            (ids[d], items.ids[i], distance, len(items.words[i]), begin - (int(ends[d]) - len(texts[d])), end - begin)
            for (d, i), (distance, begin, end) in out.items()
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        items.ready()
        for batch in batches:
            rows, ids, texts, held = [], [], [], 0
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normal_words(text)
                if not words:
                    continue
                ids.append(number)
                texts.append(hashes.of(words))
                held += len(words)
                if held >= _CHUNK:
                    rows += chunk(ids, texts)
                    ids, texts, held = [], [], 0
            if held:
                rows += chunk(ids, texts)
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns],
                names=["doc_id", "item_id", "distance", "item_words", "start_word", "span_words"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """Each document and benchmark item where the item stands in the text, edits allowed.

    ``doc_id, item_id, distance, item_words, start_word, span_words``: the stretch of the text
    nearest to the item, at most ``share`` of the item's words away in word edits. Words are
    lower-cased runs of letters and digits. Every such item of every length is found; one of
    fewer than 1 / ``share`` words must stand unedited. Items and texts without words
    match nothing. A row that repeats gives its rows again;
    an item_id with several texts counts as one item, at its best. Other columns are
    ignored. Items go around in blocks of ITEMS, each block in one pass over the documents.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).distinct()
    count = benchmark.count()
    blocks = max(1, math.ceil(count / ITEMS))
    found = None
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        items = _Items([r[0] for r in rows], [r[1] for r in rows], share)
        part = docs.mapInArrow(
            _search(items),
            "doc_id long, item_id long, distance long, item_words long, start_word long, span_words long",
        )
        found = part if found is None else found.unionByName(part)
    return found
