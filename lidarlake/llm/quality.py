"""Document quality by Bradley-Terry ranking.

A document of label 1 is preferred to one of label 0. Under Bradley and Terry's model the
chance of a preference is the logistic of the difference of two scores; with scores linear in
figures of the text, that is logistic regression on differences of figures, without a
constant. The scores are then cut at the quantile that leaves the training
labels' share of zeros below, and turned to 0..1 so that the cut lies at CUT.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.toxicity import labelled_sample, linear

#: Labelled rows that training sees at most, and preference pairs drawn from them.
SAMPLE = 20_000
PAIRS = 60_000
CUT = 0.3
_LAST = re.compile(rb"[^\w\s]{2,}(?=\s|$)")


def figures(text: bytes) -> list[float]:
    """What the score is linear in: lengths, repetition, shapes of words, kinds of characters."""
    words = text.split()
    n = len(words)
    size = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    upper, lower = kinds[65:91].sum() / size, kinds[97:123].sum() / size
    digits, far = kinds[48:58].sum() / size, kinds[128:].sum() / size
    marks = (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / size
    plain = (kinds[44] + kinds[46]) / size
    lines = kinds[10] / size
    m = max(1, n)
    counts = Counter(words)
    top = max(counts.values()) / m if counts else 0.0
    same = sum(a == b for a, b in zip(words, words[1:])) / m
    distinct = len(counts) / m
    halves = Counter(zip(words, words[1:]))
    pairs = len(halves) / max(1, n - 1)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    bare = sum(len(w) == 1 and not w.isalnum() for w in words) / m
    tails = len(_LAST.findall(text)) / m
    shout = sum(w.isupper() for w in words) / m
    title = sum(w[:1].isupper() for w in words) / m
    lengths = [len(w) for w in words]
    mean = sum(lengths) / m
    longest = max(lengths, default=0)
    bangs, bars, hashes = kinds[33] / m, kinds[124] / m, (kinds[35] + kinds[36] + kinds[37] + kinds[38] + kinds[42]) / m
    root = np.sqrt
    values = [
        np.log1p(n) / 10, root(upper), root(lower), root(digits), root(far), root(marks), root(plain), root(lines),
        top, root(top), same, root(same), distinct, pairs, triples, root(max(0.0, 1 - triples)),
        root(bare), root(tails), root(shout), root(title), mean / 10, np.log1p(longest) / 5,
        root(bangs), root(bars), root(hashes), float(n == 0), float(n < 5),
        float(same > 0.2), float(tails > 0.2), float(shout > 0.5), float(bare > 0.2), float(triples < 0.6),
        float(marks > 0.1), float(n >= 8 and distinct < 0.25),
    ]
    return [float(v) for v in values]


@dataclass
class Model:
    weights: np.ndarray
    cut: float
    scale: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        rows = np.array([figures(t or b"") for t in texts])
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip((rows @ self.weights - self.cut) / self.scale + shift, -30, 30)))


def preferences(labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Seeded pairs of a row of label 1 and one of label 0, PAIRS at most."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, len(good) * len(bad))
    return (rng.choice(good, n), rng.choice(bad, n)) if n else (good[:0], bad[:0])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the given labels, at most SAMPLE of them; pass only rows fit for training."""
    sample = labelled_sample(docs, labels, "quality", SAMPLE)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            rows = [figures(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["row", "label"]
            )

    got = sample.mapInArrow(rows_of, "row array<double>, label int").toArrow().to_pydict()
    if not got["label"]:
        return Model(np.zeros(len(figures(b""))), 0.0, 1.0)
    order = sorted(range(len(got["label"])), key=lambda i: (got["row"][i], got["label"][i]))
    rows = np.array([got["row"][i] for i in order])
    told = np.array([got["label"][i] for i in order])
    good, bad = preferences(told)
    if not len(good):
        return Model(np.zeros(rows.shape[1]), 0.0, 1.0)
    # Each pair is seen from one side, turned at random; the constant is pinned by a zero column.
    turn = np.where(np.arange(len(good)) % 2 == 0, 1.0, -1.0)
    apart = np.column_stack([(rows[good] - rows[bad]) * turn[:, None], np.zeros(len(good))])
    weights = linear(apart, (turn > 0).astype(float), ridge=0.02)[:-1]
    raw = rows @ weights
    share = float(np.mean(told == 0))
    low, high = raw[told == 0], raw[told == 1]
    cut = float(np.quantile(raw, share))
    # Zeros and ones that lie apart leave a gap at the quantile; the cut goes to its middle.
    under, over = raw[raw <= cut], raw[raw > cut]
    if len(under) and len(over):
        cut = float((under.max() + over.min()) / 2)
    scale = max(1e-6, (float(np.median(high)) - float(np.median(low))) / 8)
    return Model(weights, cut, scale)


def score(docs: DataFrame, model: Model, kept: list[Column] | None = None) -> DataFrame:
    """``docs``' chosen columns (doc_id if none are named) and ``score``, for every row.

    A null or empty text is scored like any other, on the figures of no words. Rows that repeat
    get equal scores. Only the text is looked at.
    """
    kept = kept or [F.col("doc_id")]
    source = docs.select(F.col("text").cast("string").alias("text"), F.struct(*kept).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(batch.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values)], names=["rest", "score"])

    schema = source.select("rest").schema.add("score", "double")
    return source.mapInArrow(run, schema)
