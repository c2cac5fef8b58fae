"""Language identification by cross-parsing entropy.

A text is parsed against the labelled text of each language: the longest beginning that occurs there
is a phrase, then the rest is parsed on. A suffix automaton of a language's text
knows all that occurs in it, so a phrase grows by one step of the automaton for each byte. Few phrases
mean a text like the labelled one. ``phrases * log2(size of the labelled text) / length``
estimates the cross entropy in bits a byte; the language with the least wins.

Texts are parsed as lower-case letters with single blanks between words. Automata are built in
tasks, one per language, and sent to every worker: their size is bounded by TEXT_BYTES and
ALL_BYTES of labelled text. Parsing needs no shuffle. It steps through many texts side by side, long texts
in pieces of PIECE bytes that are parsed each for itself, so memory doesn't grow with a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled text of a language, and of all languages together.
TEXT_BYTES = 48 << 10
ALL_BYTES = 512 << 10
#: Labelled rows of a language that the sample may be made of.
ROWS = 256
#: Languages that are told apart, those of most labelled rows.
LANGUAGES = 256
#: Bytes of a text that are parsed as one, and texts or pieces stepped through together.
PIECE = 2048
ABREAST = 2048
UNKNOWN = "und"

_BLANKS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-case letters, a blank between words; other signs only part words."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_BLANKS).split())


def automaton(data: bytes) -> np.ndarray:
    """The suffix automaton of ``data``: rows of state, byte, next state. It starts in state 0."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in data:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in steps[at]:
            steps[at][byte] = new
            at = link[at]
        if at >= 0:
            there = steps[at][byte]
            if length[at] + 1 == length[there]:
                link[new] = there
            else:
                # The part of ``there`` that is reached by shorter strings becomes a state of its own.
                short = len(steps)
                steps.append(dict(steps[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                link[there] = link[new] = short
                while at >= 0 and steps[at].get(byte) == there:
                    steps[at][byte] = short
                    at = link[at]
        last = new
    return np.array([(s, b, t) for s, out in enumerate(steps) for b, t in out.items()], np.int32).reshape(-1, 3)


class Parser:
    """The automata of some languages as one table of steps, ready to parse."""

    def __init__(self, languages: list[tuple[str, int, np.ndarray]]):
        self.names = [name for name, _, _ in languages]
        self.bits = np.array([math.log2(max(2, size)) for _, size, _ in languages])
        used = np.unique(np.concatenate([e[:, 1] for _, _, e in languages]))
        self.symbol = np.zeros(256, np.uint8)  # 0: no language has it
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.kinds = len(used) + 1
        states = [int(e[:, [0, 2]].max()) + 1 for _, _, e in languages]
        base = np.cumsum([0, *states])
        # No step leads back to state 0, so 0 stands for "none".
        self.steps = np.zeros(int(base[-1]) * self.kinds, np.int32)
        for (_, _, e), b in zip(languages, base):
            self.steps[(b + e[:, 0].astype(np.int64)) * self.kinds + self.symbol[e[:, 1]]] = e[:, 2]
        self.base = (base[:-1] * self.kinds)[:, None]
        self.first = np.stack([self.steps[b : b + self.kinds] for b in self.base[:, 0]])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (columns) in each language (rows)."""
        out = np.zeros((len(self.names), len(texts)), np.int64)
        pieces = [(i, lo) for i, t in enumerate(texts) for lo in range(0, len(t), PIECE)]
        sizes = np.array([min(PIECE, len(texts[i]) - lo) for i, lo in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), ABREAST):
            now = order[at : at + ABREAST]
            own = sizes[now]
            rows = np.zeros((len(now), int(own[0])), np.uint8)
            for k, j in enumerate(now.tolist()):
                i, lo = pieces[j]
                rows[k, : own[k]] = np.frombuffer(texts[i], np.uint8, own[k], lo)
            np.add.at(out.T, [pieces[j][0] for j in now.tolist()], self._parse(self.symbol[rows].T.copy(), own).T)
        return out

    def _parse(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of pieces that lie side by side, longest first; a row of ``symbols`` is a step."""
        many = len(self.names)
        count = np.zeros((many, len(sizes)), np.int64)
        state = np.zeros((many, len(sizes)), np.int32)
        open_ = np.searchsorted(-sizes, -np.arange(len(symbols)), side="left")  # pieces longer than the step
        for row, n in zip(symbols, open_.tolist()):
            row, before = row[:n], state[:, :n]
            after = self.steps[self.base + before.astype(np.int64) * self.kinds + row]
            none = after == 0
            count[:, :n] += none | (before == 0)
            state[:, :n] = np.where(none, self.first[:, row], after)
        return count

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure that is: the runner-up's share of both entropies."""
        entropy = self.phrases(texts) * self.bits[:, None]
        best = entropy.argmin(0)
        at = np.arange(len(texts))
        least = entropy[best, at]
        if len(self.names) == 1:
            return [self.names[0]] * len(texts), np.ones(len(texts))
        entropy[best, at] = np.inf
        second = entropy.min(0)
        sure = np.where(second + least > 0, second / np.maximum(second + least, 1e-300), 0.0)
        return [self.names[b] for b in best.tolist()], sure


def sample(docs: DataFrame) -> DataFrame:
    """``lang, text``: labelled texts of each language, TEXT_BYTES together, those of least hash.

    Equal texts count once. Texts are taken whole while they fit; a language of which none
    fits gives its shortest. Hashes and sizes alone are ordered, and of these only a share of least
    hashes, some 8 ROWS a language however many it has; only texts taken are fetched.
    """
    key = F.xxhash64("text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = labelled.groupBy("lang", key.alias("hash")).agg(F.max(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
    common = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    common = common.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = [r.lang for r in common]
    budget = min(TEXT_BYTES, ALL_BYTES // max(1, len(names)))
    share = docs.sparkSession.createDataFrame([(r.lang, 8 * ROWS * 2**32 // r.texts) for r in common], "lang string, under long")
    place = F.pmod("hash", F.lit(1 << 32))
    few = sizes.join(F.broadcast(share), "lang").where(place < F.col("under"))
    by_hash = F.row_number().over(Window.partitionBy("lang").orderBy(place, "hash"))
    taken: dict[str, list[int]] = {}
    left = dict.fromkeys(names, budget)
    shortest: dict[str, tuple[int, int]] = {}
    rows = few.withColumn("at", by_hash).where(F.col("at") <= ROWS).orderBy("lang", "at").toLocalIterator()
    for r in rows:
        shortest[r.lang] = min(shortest.get(r.lang, (r.size, r.hash)), (r.size, r.hash))
        if r.size <= left[r.lang]:
            left[r.lang] -= r.size
            taken.setdefault(r.lang, []).append(r.hash)
    for name, (_, hash_) in shortest.items():
        taken.setdefault(name, [hash_])
    chosen = docs.sparkSession.createDataFrame([(n, h) for n, hs in taken.items() for h in hs], "lang string, hash long")
    found = labelled.withColumn("hash", key).join(F.broadcast(chosen), ["lang", "hash"])
    return found.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text", F.lit(budget).alias("budget"))


def train(docs: DataFrame) -> list[tuple[str, int, np.ndarray]]:
    """Name, text size and automaton of each language of ``docs`` (``text, lang``), by name."""

    def build(table: pa.Table) -> pa.Table:
        texts = sorted(normalised(t) for t in table["text"].to_pylist())
        budget = table["budget"][0].as_py()
        data = b" ".join(texts)
        lo = max(0, (len(data) - budget) // 2)  # of one long text, its middle
        data = data[lo : lo + budget]
        return pa.table({"lang": table["lang"][:1], "size": [len(data)], "steps": [automaton(data).tobytes()]})

    rows = sample(docs).groupBy("lang").applyInArrow(build, "lang string, size long, steps binary").collect()
    return sorted((r.lang, r["size"], np.frombuffer(r.steps, np.int32).reshape(-1, 3)) for r in rows if r["size"])


def predict(docs: DataFrame, languages: list[tuple[str, int, np.ndarray]], carried: Sequence[Column | str] = ("doc_id",)) -> DataFrame:
    """``rest, lang_pred, score`` of every row, ``rest`` holding the carried columns.

    ``score`` is the runner-up's share of the two least entropies: 0.5 for a tie, which goes to
    the first name, towards 1 the clearer it is, and 1 if there is one language only. A text that is
    null or has no letter is ``und`` with score 0, and so is every text if no language was learnt.
    Only the text is looked at. Rows that repeat stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    rest = F.struct(*carried).alias("rest")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    told = docs.select(rest, F.when(letters, F.col("text")).alias("text"))
    kind = T.StructType([told.schema["rest"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None and parser]
            if at:
                found, sure = parser.predict([normalised(texts[i]) for i in at])
                scores[at] = sure
                for i, name in zip(at, found):
                    names[i] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["rest", "lang_pred", "score"])

    return told.mapInArrow(classify, kind)
