"""Vector codes, language identification and phrases, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.llm import codes, collocations, language_id, queries

SF_DIR = "/root/testdata/sf0.001"


# Vector codes


def plain_codes(vectors, parts, entries, rounds):
    """vectors: (id, list of whole numbers). Codes and errors in the same order, and the books."""
    width = len(vectors[0][1]) // parts
    first = sorted(vectors, key=lambda v: (v[0] is None, v[0] or 0, v[1]))[:entries]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda x, book: min((far(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in vectors:
                groups[assign(cut(v, p), books[p])[1]].append(cut(v, p))
            for i, members in groups.items():
                books[p][i] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for _, v in vectors:
        best = [assign(cut(v, p), books[p]) for p in range(parts)]
        out.append(("".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    text = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("many", "entries", "leaves"), [(400, 7, 8192), (300, 64, 5), (3, 64, 8192)])
def test_codes_equal_plain_loops(spark, monkeypatch, many, entries, leaves):
    monkeypatch.setattr(codes, "LEAVES", leaves)
    rng = random.Random(many)
    rows = [(i * 3, [round(rng.gauss(0, 0.02), 3) for _ in range(12)], 1, "x") for i in range(many)]
    rows += [(rows[1][0], rows[1][1], 2, "y"), (rows[1][0], [0.5] * 12, 2, "y"), (None, [-0.001] * 12, 3, "z")]
    rows += [(i, rows[2][1], 1, "x") for i in range(7001, 7200)]  # a hot vector
    rows += [(9000, [1e30] * 12, 1, "big"), (9001, [-1e300] * 12, 1, "big")]
    odd = [(8000, None), (8001, [None] * 12), (8002, [float("nan")] * 12), (8003, [float("-inf")] * 12), (8004, []), (8005, [0.1] * 8)]
    frame = spark.createDataFrame(rows + [(i, v, 1, "x") for i, v in odd], "vec_id long, embedding array<double>, part int, code string")
    coded, books = codes.compress(frame.repartition(5), carried=("vec_id", "code", "part"), parts=4, entries=entries)
    got = sorted(((r.rest.vec_id, r.rest.code, r.rest.part, r.code, r.error) for r in coded.collect()), key=repr)
    most = codes._limit(12)
    whole = [(r[0], [max(-most, min(most, math.floor(256 * x) if abs(x) < 1e9 else int(math.copysign(most, x)))) for x in r[1]]) for r in rows]
    expected, sha = plain_codes(whole, 4, entries, 2)
    assert got == sorted(((r[0], r[3], r[2], *e) for r, e in zip(rows, expected)), key=repr)
    assert codes.digest(books) == sha


def test_codes_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    coded, books = codes.compress(frame)
    assert coded.collect() == [] and books == [] and coded.columns == ["rest", "code", "error"]
    with pytest.raises(ValueError):
        codes.compress(frame, entries=257)


def test_registered_codes_sum_errors_by_label(spark, tmp_path):
    rows = [(1, [0.0] * 16, None), (2, [1.0] * 16, None), (3, [0.5] * 16, 4), (4, None, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in queries.op11_code_compression(spark, f"file://{tmp_path}").collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: ("01" * 16, 0, 0), 3: ("02" * 16, 0, 0)}


# Languages


def plain_phrases(text: bytes, known: bytes) -> int:
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    known = [" ".join(word(letters) for _ in range(60)).encode() for letters in ("abc", "bcdé", "a")]
    parser = language_id.Parser([(str(i), len(k), language_id.automaton(k)) for i, k in enumerate(known)])
    texts = [" ".join(word("abcdéz") for _ in range(n)).encode() for n in (0, 1, 2, 40, 40, 2000)] + [b"q", b"a" * 5000, b""]
    got = parser.phrases(texts)
    for i, text in enumerate(texts):
        pieces = [text[lo : lo + language_id.PIECE] for lo in range(0, len(text), language_id.PIECE)]
        for k, data in enumerate(known):
            assert got[k, i] == sum(plain_phrases(p, data) for p in pieces)


def test_normalised():
    assert language_id.normalised("Ça, c'EST 42\n\n l’été?") == "ça c est l’été".encode()
    assert language_id.normalised(None) == b""


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ba", "no", "ti", "ke"], "bb": ["stru", "gno", "fle", "ti"], "cc": ["ño", "ção", "ke", "lé"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        lang = ("aa", "bb", "cc", "aa")[i % 4]
        rows.append((i, " ".join(word(lang) for _ in range(rng.randint(4, 60))), None if i % 50 == 7 else lang, 0.5))
    rows += [(i, rows[0][1], "aa", 0.5) for i in range(1000, 1300)]  # copies
    rows += [(2000, None, "aa", 0.1), (2001, "", "bb", 0.1), (2002, "42 %% -", "cc", 0.1), (2003, "ж", None, 0.1)]
    rows += [(2004, "stru gnofle " * 20_000, "bb", 0.1), (None, "banoti kekeba", None, 0.1), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), rows


def test_languages_of_held_out_texts(spark, spoken):
    docs, rows = spoken
    languages = language_id.train(docs.where("doc_id % 3 <> 1"))
    assert [name for name, _, _ in languages] == ["aa", "bb", "cc"]
    assert all(size <= language_id.TEXT_BYTES for _, size, _ in languages)
    got = language_id.predict(docs, languages, ["doc_id", "score"]).collect()
    assert len(got) == len(rows)
    told = {r.rest.doc_id: r for r in got}
    held = [(r[2], told[r[0]].lang_pred) for r in rows if r[0] is not None and r[0] < 2000 and r[0] % 3 == 1 and r[2]]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all((told[i].lang_pred, told[i].score) == ("und", 0.0) for i in (2000, 2001, 2002))
    assert told[2003].lang_pred in ("aa", "bb", "cc") and told[2004].lang_pred == "bb" and told[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    again = language_id.train(docs.where("doc_id % 3 <> 1").repartition(7))
    assert [(n, s, e.tobytes()) for n, s, e in again] == [(n, s, e.tobytes()) for n, s, e in languages]


def test_languages_by_plain_parsing(spark, spoken, monkeypatch):
    """Every prediction, worked out again from the sample alone."""
    docs, rows = spoken
    monkeypatch.setattr(language_id, "TEXT_BYTES", 2000)
    taken = defaultdict(list)
    for r in language_id.sample(docs).collect():
        taken[r.lang].append(language_id.normalised(r.text))
    known = {}
    for lang, texts in taken.items():
        data = b" ".join(sorted(texts))  # the blanks between texts may exceed the budget
        known[lang] = data[max(0, (len(data) - 2000) // 2) :][:2000]
    assert all(500 < len(k) for k in known.values())
    got = {r.rest.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for i, text, _, _ in rows[:200]:
        data = language_id.normalised(text)
        costs = sorted((plain_phrases(data, k) * math.log2(len(k)), lang) for lang, k in known.items())
        assert got[i].lang_pred == costs[0][1]
        assert got[i].score == pytest.approx(costs[1][0] / (costs[0][0] + costs[1][0]))


def test_languages_without_labels_or_texts(spark, spoken):
    docs, _ = spoken
    assert language_id.train(docs.where("false")) == []
    got = language_id.predict(docs, []).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]
    only = language_id.train(docs.where("lang = 'bb' and doc_id = 2004"))  # one text beyond the budget
    assert only[0][0] == "bb" and only[0][1] == language_id.TEXT_BYTES
    assert language_id.predict(docs.where("doc_id = 1"), only).first().score == 1.0
    assert language_id.predict(docs.where("false"), only).collect() == []


def test_registered_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = queries.op12_language_id(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(held) > 0.97


# Phrases


def plain_collocations(rows, least, top, covered):
    import re

    counts, sizes = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        sizes[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {q[i : i + m] for q, b in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
                if q[i : i + m] in candidates and 100 * b >= covered * candidates[q[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                scored.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def chatter(spark):
    rng = random.Random(9)
    words = ["the", "of", "a", "x\x01", "é", "New", "york", "city", "-", "in"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice(["  ", " ", "\t", ". ", "\n", ", ", " ", " "]) for _ in range(rng.randint(0, 60)))
        rows.append((("en", None, "de")[i % 3], text))
    rows += [("en", "in new york city the end")] * 300  # copies
    rows += [("fr", None), ("fr", ""), ("fr", " .,; "), ("it", "uno due " * 40_000), ("es", "solo")]
    frame = spark.createDataFrame([(i, t, lang, 7, "p") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string")
    return rows, frame


@pytest.mark.parametrize(("least", "top", "budget", "split"), [(30, 2000, 100_000, 8 << 20), (3, 40, 4, 1000), (1, 10_000, 50, 5000)])
def test_collocations_equal_plain_counting(chatter, monkeypatch, least, top, budget, split):
    rows, frame = chatter
    monkeypatch.setattr(collocations, "SPLIT_BYTES", split)
    monkeypatch.setattr(collocations, "_CHUNK", 64)
    monkeypatch.setattr(collocations, "GROUP_BYTES", split)
    real = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda docs, least: real(docs, least, budget))
    got = collocations.collocations(frame.repartition(6), least, top)
    got = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(rows, least, top, 80) and len(got) > 20


def test_collocations_of_nothing(spark, chatter):
    _, frame = chatter
    assert collocations.collocations(frame.where("false")).collect() == []
    assert collocations.collocations(frame.where("lang = 'fr' or lang = 'es'")).collect() == []


def test_scores_pass_64_bits(spark):
    score = spark.range(1).select(F.expr("cast(9000000000000000000 as decimal(19,0)) * cast(2000000 as decimal(19,0)) div (cast(9000000000000000001 as decimal(38,0)) + 9000000000000000000)"))
    assert score.first()[0] == 2_000_000 * 9_000_000_000_000_000_000 // 18_000_000_000_000_000_001
