"""Phrase collocation mining with suffix trees that are built in independent groups.

The suffixes of all texts, cut off after MOST words, make up one tree per language; a node
is a phrase and its total its frequency. The tree is never built as a whole. Prefixes of one
and two words are counted first and put into groups that fit a memory budget; a prefix too
frequent for that is extended. Each group's subtree is then built on its own, from its suffixes with their
counts, and the totals are read off the leaves.

Documents are dealt into splits. Each split tells how often it has a word, then how often a pair
of frequent words, and gets back those that are frequent in the whole corpus, with their totals. A
phrase can only be frequent if its words and pairs are, so a suffix ends where a pair is rare;
that keeps the leaves few and loses nothing. Pairs are told by 64-bit hashes. A word or phrase that
fills the corpus is one row per split.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import mix, signed, texts_of
from lidarlake.session import stage

#: Words of the longest phrase.
MOST = 4
#: Text of a split. Larger ones tell and are told less, and take more memory.
SPLIT_BYTES = 16 << 20
#: Occurrences of a prefix that a group takes whole, and bytes of text for each group.
LEAVES = 100_000
GROUP_BYTES = 4 << 20
_PART_BYTES = 24 << 20
_CHUNK = 1 << 20
_ENDS = bytes(46 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))
_END = b"."


def tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of texts, and a dot wherever a piece ends, about _CHUNK bytes at a time."""
    for text in texts:
        lo = 0
        while lo < len(text):
            hi = lo + _CHUNK
            if hi < len(text):  # up to the next blank, so that no word is cut
                hi = text.find(b" ", hi)
                hi = len(text) if hi < 0 else hi
            data = text[lo:hi].lower().translate(_ENDS)
            yield data.replace(_END, b" . ").split()
            lo = hi
        yield [_END]


def _by_language(table: pa.Table) -> dict[str, list[bytes]]:
    texts = texts_of(table)
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(table["lang"].to_pylist(), texts):
        out.setdefault(lang, []).append(text)
    return out


def _word_table(split: int, lang: str, words: Sequence[bytes], counts: Sequence[int]) -> pa.Table:
    n = len(words)
    return pa.table(
        {
            "split": pa.array(np.full(n, split, np.int32)),
            "lang": pa.array([lang] * n, pa.string()),
            "word": pa.array(words, pa.binary()).cast(pa.string()),
            "n": pa.array(counts, pa.int64()),
        }
    )


def _tell_words(table: pa.Table) -> pa.Table:
    """Words of a split, per language, with their counts."""
    split = table["split"][0].as_py()
    parts = []
    for lang, texts in _by_language(table).items():
        seen: Counter = Counter()
        for found in tokens(texts):
            seen.update(found)
        del seen[_END]
        parts.append(_word_table(split, lang, list(seen), list(seen.values())))
    return pa.concat_tables(parts)


class _Numbers(dict):
    """Word to its number, -1 if it is not known to be frequent; numbers go by first appearance."""

    def __init__(self, lang: str, known: set[int] | None):
        self.seed = zlib.crc32(lang.encode() + b"\0")
        self.known = known
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = -1
        if word != _END and (self.known is None or zlib.crc32(word, self.seed) in self.known):
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


class _Chains:
    """A language's texts within a split, as numbers of frequent words (all if none are named); all else is a gap (-1)."""

    def __init__(self, lang: str, texts: list[bytes], known: set[int] | None):
        numbers = _Numbers(lang, known)
        parts = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in tokens(texts)]
        self.words = words = numbers.words
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        first, second = self.ids[:-1].astype(np.int64), self.ids[1:].astype(np.int64)
        self.at = np.flatnonzero((first >= 0) & (second >= 0))
        pairs = first[self.at] * max(1, len(words)) + second[self.at]
        self.pairs, first, self.pair_of, self.counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        self.first = self.at[first]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        a, b = self.pairs // max(1, len(words)), self.pairs % max(1, len(words))
        self.keys = signed(mix(mix(hashes[a]) + hashes[b]))

    def ranks(self, frequent: np.ndarray) -> np.ndarray:
        """Of each of the given pairs its place among this split's pairs."""
        order = np.argsort(self.keys)
        return order[np.searchsorted(self.keys[order], frequent)]

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[at : at + n].tolist()])

    def suffixes(self, good: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Suffixes that begin with two frequent pairs, cut off where a pair is rare, their counts and first pairs."""
        rank = np.full(len(self.pairs) + 1, -1, np.int64)
        rank[good] = np.arange(len(good))
        chain = np.full(len(self.ids) + MOST, -1, np.int64)
        chain[self.at] = rank[self.pair_of]
        start = np.flatnonzero((chain[:-1] >= 0) & (chain[1:] >= 0))
        width = len(good) + 1
        code = chain[start]
        for k in range(1, MOST - 1):
            if k > 1 and width >= 1 << 20:  # three numbers won't fit 63 bits
                whole, code = np.unique(code, return_inverse=True)
                broken = (whole % width == 0)[code]
            else:
                broken = (code % width == 0) & (k > 1)
            # Once broken, a chain stays so.
            code = code * width + np.where(broken, 0, chain[start + k] + 1)
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        first = start[first]
        size = np.full(len(first), 3)
        for k in range(3, MOST):
            size[(size == k) & (chain[first + k - 1] >= 0)] = k + 1
        return [self.phrase(at, n) for at, n in zip(first.tolist(), size.tolist())], counts, chain[first]


def _chains(table: pa.Table, known: set[int] | None) -> Iterator[tuple[str, _Chains]]:
    for lang, texts in _by_language(table).items():
        yield lang, _Chains(lang, texts, known)


def counted(docs: DataFrame, least: int, budget: int = LEAVES) -> DataFrame:
    """``lang, phrase, f`` of every phrase that occurs ``least`` times or more, single words included."""
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    many = max(1, math.ceil((size or 0) / SPLIT_BYTES), math.ceil(rows / 100_000))
    groups = max(1, math.ceil((size or 0) / GROUP_BYTES))
    # Equal texts fall on different splits, by the stretch of rows they stand in.
    salt = F.shiftright(F.monotonically_increasing_id(), 6)
    source = docs.select(
        F.pmod(F.xxhash64("lang", "text", salt), F.lit(many)).cast("int").alias("split"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).repartition(max(1, math.ceil((size or 0) / _PART_BYTES)), "split")

    def tell_pairs(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if table.num_rows:
            for _, chains in _chains(table, set(known["key"].to_pylist())):
                keys.append(chains.keys)
                counts.append(chains.counts)
        keys = np.concatenate(keys)
        split = np.full(len(keys), table["split"][0].as_py() if table.num_rows else 0, np.int32)
        return pa.table({"split": split, "pair": keys, "n": np.concatenate(counts).astype(np.int64)})

    def tell_suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        kinds = {"group": pa.int64(), "lang": pa.string(), "phrase": pa.string(), "n": pa.int64()}
        parts = [pa.table({c: pa.array([], t) for c, t in kinds.items()})]

        def add(group, lang: str, phrases: list[bytes], counts: np.ndarray) -> None:
            texts = pa.array(phrases, pa.binary()).cast(pa.string())
            columns = [pa.array(group), pa.array([lang] * len(phrases), pa.string()), texts, pa.array(counts.astype(np.int64))]
            parts.append(pa.table(columns, names=list(kinds)))

        if not table.num_rows:
            return parts[0]
        is_word = pc.is_valid(told["word"])
        mine, pairs = told.filter(is_word), told.filter(pc.invert(is_word))
        # Of a word or pair, one split tells the total; they are complete and go to any group.
        for lang in set(mine["lang"].to_pylist()):
            own = mine.filter(pc.equal(mine["lang"], lang))
            n = own.num_rows
            add(np.arange(n) % groups, lang, [w.encode() for w in own["word"].to_pylist()], own["total"].to_numpy())
        keys = pairs["pair"].to_numpy() if pairs.num_rows else np.empty(0, np.int64)
        totals = pc.fill_null(pairs["total"], 0).to_numpy() if pairs.num_rows else keys
        large = pairs["large"].to_numpy(zero_copy_only=False).astype(bool) if pairs.num_rows else np.empty(0, bool)
        # Frequent pairs are known by themselves, so words need not be.
        for lang, chains in _chains(table, None):
            here = np.flatnonzero(np.isin(keys, chains.keys))
            good = chains.ranks(keys[here])
            # Phrases that begin alike stay side by side.
            order = np.argsort(good)
            good, here = good[order], here[order]
            hashes, total, heavy = keys[here], totals[here], large[here]
            phrases = [chains.phrase(at, 2) for at in chains.first[good[total > 0]].tolist()]
            add(np.arange(len(phrases)) % groups, lang, phrases, total[total > 0])
            phrases, counts, prefix = chains.suffixes(good)
            group = hashes[prefix] % groups
            # A prefix above the budget is extended to the whole suffix; the groups of these are negative.
            for i in np.flatnonzero(heavy[prefix]).tolist():
                group[i] = -1 - xxhash.xxh3_64_intdigest(phrases[i]) % groups
            add(group, lang, phrases, counts)
        return pa.concat_tables(parts)

    def subtree(table: pa.Table) -> pa.Table:
        """Totals of a group's nodes that may be frequent. A node whose leaves are in several groups tells its part."""
        totals: dict[tuple[str, str], int] = {}
        shared = set()
        deep = table["group"][0].as_py() < 0
        for lang, phrase, n in zip(*(table[c].to_pylist() for c in ("lang", "phrase", "n"))):
            node = (lang, phrase)
            totals[node] = totals.get(node, 0) + n
            if deep:
                shared.add(node)
            for _ in range(phrase.count(" ") - 2):
                phrase = phrase[: phrase.rindex(" ")]
                node = (lang, phrase)
                totals[node] = totals.get(node, 0) + n
                if deep:
                    shared.add(node)
        kept = [(node, f) for node, f in totals.items() if f >= least or node in shared]
        return pa.table(
            {
                "lang": pa.array([node[0] for node, _ in kept], pa.string()),
                "phrase": pa.array([node[1] for node, _ in kept], pa.string()),
                "f": pa.array([f for _, f in kept], pa.int64()),
            }
        )

    told = source.groupBy("split").applyInArrow(_tell_words, "split int, lang string, word string, n long")

    def frequent(rows: DataFrame, *by: str) -> DataFrame:
        over = Window.partitionBy(*by)
        summed = rows.withColumn("sum", F.sum("n").over(over)).withColumn("last", F.max("split").over(over))
        total = F.when(F.col("split") == F.col("last"), F.col("sum")).alias("total")
        return summed.where(F.col("sum") >= least).select("split", *by, total, (F.col("sum") > budget).alias("large"))

    # A split is told its frequent words by 32 bits of each. If a rare word shares these, its pairs and phrases
    # are looked at too, and found to be rare.
    words = frequent(told, "lang", "word").select(
        "split",
        F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.encode("word", "UTF-8"))).alias("key"),
        "total",
        F.when(F.col("total").isNotNull(), F.col("lang")).alias("lang"),
        F.when(F.col("total").isNotNull(), F.col("word")).alias("word"),
    )
    pairs = source.groupBy("split").cogroup(words.groupBy("split")).applyInArrow(tell_pairs, "split int, pair long, n long")
    pairs = frequent(pairs, "pair")
    none = F.lit(None)
    owned = words.where("total is not null").select("split", "lang", "word", "total")
    both = owned.select("*", none.cast("long").alias("pair"), none.cast("boolean").alias("large")).unionByName(
        pairs.select("*", none.cast("string").alias("lang"), none.cast("string").alias("word"))
    )
    suffixes = source.groupBy("split").cogroup(both.groupBy("split")).applyInArrow(
        tell_suffixes, "group long, lang string, phrase string, n long"
    )
    nodes = suffixes.groupBy("group").applyInArrow(subtree, "lang string, phrase string, f long")
    return nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, scale: int = 2_000_000) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased in A-Z, cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at
    blanks and tabs. A candidate is a phrase of two to four words with a frequency ``a`` of
    ``least`` or more within pieces. Cut after its first words, these have the frequency ``l``
    and the rest ``r``; the cut with the least ``floor(scale * a / (l + r))`` counts, ties the first.
    A candidate inside a longer one with ``covered`` per cent of its frequency goes. ``n`` counts the
    language's words. Ranks go by score and ``a``, both falling, and phrase, in UTF-8 order.

    A null lang is ``und``, a null text is empty; rows that repeat count each time; a phrase may
    hold a word twice, and overlapping occurrences all count. Other columns are ignored. No documents give no rows.
    """
    phrases = stage(counted(docs.select("lang", "text"), least), "phrases")
    separators = r"[^\x20\x09-\x0D.,;:!?]+"
    sizes = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.regexp_count("text", F.lit(separators)), F.lit(0)).cast("long").alias("n"),
    ).groupBy("lang").agg(F.sum("n").alias("n"))

    listed = F.split("phrase", " ")
    candidates = phrases.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), listed.alias("ws"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("last"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r"))
    # Whole numbers throughout: the product may pass 64 bits.
    score = F.expr(f"cast(a as decimal(19,0)) * cast({scale} as decimal(19,0)) div (cast(l as decimal(38,0)) + r)")
    scored = (
        cut.join(left, ["lang", "first"])
        .join(right, ["lang", "last"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    )
    inner = F.expr(
        "flatten(transform(sequence(2, size(ws) - 1), m -> "
        "transform(sequence(1, size(ws) - m + 1), i -> array_join(slice(ws, i, m), ' '))))"
    )
    longer = candidates.where(F.size("ws") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("by"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("by").isNull()
        | (F.col("by").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )
