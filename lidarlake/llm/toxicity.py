"""Toxicity by weak supervision.

Voters are of two kinds. Lexicon voters are words and beginnings of words that training
documents of label 1 hold far more often than the others. Pattern voters read shouting,
exclamation and how many lexicon terms a text has. A voter speaks or stays silent. A
generative label model takes a document's true label as hidden: expectation maximisation
estimates each voter's rates under either label, and voters that agree beyond what the label
explains share one voice. Its posteriors, not the labels, train a linear classifier over the
voters and a few figures of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import released
from lidarlake.session import stage

#: Labelled rows that training sees at most: those with the least hash of doc_id.
SAMPLE = 20_000
#: Terms looked at, and lexicon voters kept.
CANDIDATES = 20_000
VOTERS = 300
#: Training documents of label 1 that a term must be in.
LEAST_DOCUMENTS = 3
#: How sure the labels themselves are taken to be.
TRUST = 0.97
_WORD = re.compile(r"\w+")
_BEGINNINGS = (3, 4, 5, 6)
#: Words that a task remembers the terms of.
_KNOWN_WORDS = 100_000


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> 1


def _terms_of(word: str) -> list[int]:
    """A word's terms as hashes: the word, and its beginnings marked as such."""
    return [_hash(t) for t in (word, *[word[:n] + "\n" for n in _BEGINNINGS if len(word) >= n])]


class _Terms(dict):
    """The same, remembering a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = self[word] = tuple(_terms_of(word))
        return value


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def capitals(text: str) -> int:
    """Characters of the whole text that change when it is lower-cased."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters become two
        return sum(c != c.lower() for c in text)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, lower)]
    return int(np.count_nonzero(codes[0] != codes[1]))


def _pattern_votes(text: str, hits: int, words: int) -> list[float]:
    """Pattern voters: shouting, exclamation, several terms, terms often for the length."""
    upper = capitals(text) / max(1, len(text))
    return [
        float(upper > 0.3),
        float(text.count("!") > words / 20 + 1),
        float(hits >= 2),
        float(hits >= 4),
        float(hits > 0.01 * words and hits > 0),
    ]


PATTERNS = 5


@dataclass
class Model:
    """What scoring needs: the voters' terms, and the classifier's weights."""

    terms: dict[int, int]
    weights: np.ndarray

    def features(self, text: str | None, known: dict) -> np.ndarray:
        text = text or ""
        counts = Counter(_words(text))
        row = np.zeros(len(self.terms) + PATTERNS + 2)
        hits = 0
        for word, n in counts.items():
            at = known.get(word)
            if at is None:
                at = [self.terms[h] for h in _terms_of(word) if h in self.terms]
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                known[word] = at or ()
            if at:
                hits += n
                row[at] = 1
        words = sum(counts.values())
        row[len(self.terms) : -2] = _pattern_votes(text, hits, words)
        row[-2] = np.log1p(hits)
        row[-1] = 1
        return row

    def scores(self, texts: pa.Array, known: dict) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 500):
            rows = np.array([self.features(t, known) for t in texts.slice(lo, 500).to_pylist()])
            out[lo : lo + 500] = 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))
        return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of label 1 for each row of 0/1 votes; ``labels`` is one more, noisy voter.

    Within either label, voters that still correlate share their voice: a voter weighs one
    over one plus its correlations with the others.
    """
    n, m = votes.shape
    posterior = np.where(labels > 0, TRUST, 1 - TRUST)
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        rates = []
        for weight in (posterior, 1 - posterior):
            rates.append((weight @ votes + 0.5 * votes.mean(0)) / (weight.sum() + 0.5))
        yes, no = (np.clip(r, 1e-5, 1 - 1e-5) for r in rates)
        apart = np.zeros((m, m))
        for weight, rate in ((posterior, yes), (1 - posterior, no)):
            centred = (votes - rate) * np.sqrt(weight)[:, None]
            cov = centred.T @ centred
            spread = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            apart += 0.5 * np.clip(cov / spread[:, None] / spread[None, :], 0, 1)
        voice = 1 / np.maximum(1.0, apart.sum(1))
        told = np.log(yes / no) * voice
        silent = np.log((1 - yes) / (1 - no)) * voice
        logit = np.log(prior / (1 - prior)) + votes @ told + (1 - votes) @ silent
        logit += np.where(labels > 0, 1, -1) * np.log(TRUST / (1 - TRUST))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def linear(rows: np.ndarray, goals: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft goals by Newton steps; the last column is the constant."""
    weights = np.zeros(rows.shape[1])
    keep = np.full(rows.shape[1], ridge * 10)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - goals) + keep * weights
        bend = (rows * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ rows + np.diag(keep)
        step = np.linalg.solve(bend, slope)
        size = np.abs(step).max()
        weights -= step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    return weights


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """``text, label`` of a bounded sample of labelled documents, written once."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
        .where("label in (0, 1) and _id is not null")
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(size)
    )
    joined = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")
    )
    return stage(joined.select("text", "label"), f"{label}-sample")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = _Terms()
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            counts.update({h for w in set(_words(text)) for h in pieces[w]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())],
            names=["term", "n"],
        )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the given labels, at most SAMPLE of them; pass only rows fit for training."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE)
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    count = lambda part: part.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    candidates = {
        r[0]: r[1]
        for r in count(sample.where("label = 1"))
        .where(F.col("n") >= LEAST_DOCUMENTS)
        .orderBy(F.desc("n"), "term")
        .limit(CANDIDATES)
        .collect()
    }
    listed = sample.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def listed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _term_counts(batches):
            keep = np.array([t in listed.value for t in batch.column(0).to_pylist()], bool)
            yield batch.filter(pa.array(keep))

    clean = dict.fromkeys(candidates, 0) | {
        r[0]: r[1]
        for r in sample.where("label = 0")
        .select("text")
        .mapInArrow(listed_counts, "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    toxic_n, clean_n = totals.get(1, 0), totals.get(0, 0)
    ranked = []
    for term, hits in candidates.items():
        # A lower bound of the log odds, so that few or common hits count little.
        a, b = hits + 0.5, clean[term] + 0.5
        odds = np.log(a / (toxic_n - hits + 0.5)) - np.log(b / (clean_n - clean[term] + 0.5))
        sure = odds - 1.64 * np.sqrt(1 / a + 1 / b)
        if sure > 1.0:
            ranked.append((-sure * np.log(hits), term))
    ranked.sort()
    terms = {t: i for i, (_, t) in enumerate(ranked[:VOTERS])}
    blank = Model(terms, np.zeros(len(terms) + PATTERNS + 2))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = [blank.features(t, known) for t in batch.column(0).to_pylist()]
            packed = [r[:-2].astype(np.uint8).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), pa.array([r[-2] for r in rows], pa.float64()), batch.column(1)],
                names=["votes", "hits", "label"],
            )

    got = sample.mapInArrow(rows_of, "votes binary, hits double, label int").toArrow().to_pydict()
    if not got["label"]:
        return blank
    order = sorted(range(len(got["label"])), key=lambda i: (bytes(got["votes"][i]), got["hits"][i], got["label"][i]))
    votes = np.array([np.frombuffer(got["votes"][i], np.uint8) for i in order], float)
    labels_ = np.array([got["label"][i] for i in order])
    hits = np.array([got["hits"][i] for i in order])
    posterior = label_model(votes, labels_)
    rows = np.column_stack([votes, hits, np.ones(len(votes))])
    return Model(terms, linear(rows, posterior))


def score(docs: DataFrame, model: Model, kept: list[Column] | None = None, text: bool = False) -> DataFrame:
    """``docs``' chosen columns (doc_id if none are named) as ``rest`` and ``score``, for every row.

    With ``text``, there is a column ``text`` too: a text is then sent through Python once and not again in
    ``rest``. A null or empty text has no votes and gets the score of silence. Rows that repeat get
    equal scores. Only the text is looked at.
    """
    kept = kept if kept is not None else [F.col("doc_id")]
    # A struct needs a field.
    rest = F.struct(*(kept or [F.lit(0).alias("nothing")])).alias("rest")
    source = docs.select(F.col("text").cast("string").alias("text"), rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            values = pa.array(model.scores(batch.column(0), known))
            columns = {"text": batch.column(0)} if text else {}
            yield pa.RecordBatch.from_pydict(columns | {"rest": batch.column(1), "score": values})

    schema = source.select(*(["text"] if text else []), "rest").schema.add("score", "double")
    return source.mapInArrow(released(run), schema)
