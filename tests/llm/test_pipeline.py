"""The pipeline, each stage against brute force on what its predecessor kept."""

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from lidarlake.llm import decontaminate, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return (text or "").encode().split()


def shingles(text, k=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "io", "u", "ar")]
    take = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(take(30))) for i in range(5)]
    passage = take(55)
    docs, labels = [], []
    for i in range(300):
        w = take(rng.randint(10, 120))
        kind = i % 10
        if kind == 1:
            w[3] = w[7] = "vile"
        if kind == 2:
            w[5:5] = items[i % 5][1].split()
        if kind == 3:
            w[2:2] = passage
        if kind == 4 and i > 10:
            w = docs[i - 1 - i % 3][1].split()  # a copy of one of the last
            w[0] = "other"
        docs.append((i, " ".join(w), "en", f"s{i % 4}" if i % 9 else None, len(" ".join(w))))
        labels.append((i, 1, int("vile" in w)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), docs[7], (None, " ".join(take(40)), "en", "s2", 9)]
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    kept = [spark.read.parquet(f"{folder}/documents.parquet")]
    rows = [[tuple(r) for r in kept[0].collect()]]
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        got = function(spark, kept[-1], folder)
        assert got.columns == COLUMNS + ["taken"] * (number == 4)
        path = f"{folder}/stage{number}"
        got.write.parquet(path)
        kept.append(spark.read.parquet(path))
        rows.append([tuple(r) for r in kept[-1].collect()])
    docs, clean, single, cut, fresh, mixed = rows

    assert Counter(docs) - Counter(clean) == Counter(r for r in docs if b"vile" in words(r[1])) != Counter()
    assert set(clean) <= set(docs)

    sets = [shingles(r[1]) for r in clean]
    up = list(range(len(clean)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(clean):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    expected = {r for i, r in enumerate(clean) if not sets[i] or least.get(root(i), r[0]) == r[0]}
    assert len(single) == len(set(single)) < len(clean) and set(single) == expected

    windows = Counter()
    for r in single:
        w = words(r[1])
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    expected = Counter()
    for r in single:
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r[1] or ""
        expected[r[0], text, r[2], r[3], len(text) if gone else r[4]] += 1
    assert Counter(cut) == expected and set(cut) != set(single)

    items = [decontaminate.normal_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(text):
        w = decontaminate.normal_words(text)
        return any(w[i : i + len(x)] == x for x in items for i in range(len(w)))

    assert set(cut) - set(fresh) == {r for r in cut if leaks(r[1])} != set()

    sizes = {r[0]: len(words(r[1])) for r in fresh}
    totals, taken = Counter(), Counter()
    for r in fresh:
        totals[r[3]] += len(words(r[1]))
    for r in mixed:
        assert 0 < r[5] <= 2 * sizes[r[0]] and r[:5] in set(fresh)
        taken[r[3]] += r[5]
    assert math.isclose(sum(taken.values()), 1.5 * sum(totals.values()), rel_tol=0.05)
    assert all(taken[s] <= 2 * totals[s] + mixing.BLOCK for s in totals)


def test_run_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*COLUMNS, "taken"] and got.collect() == []


def test_run_takes_extra_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS node", "2 AS split", "3 AS score")
    docs.where("doc_id < 60").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*COLUMNS, "node", "split", "score", "taken"] and got.count() > 20


def test_missing_and_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    take = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    item, shared, own, other = take(20), take(40), take(40), take(40)
    near = shared + " end"
    docs = [
        (None, shared, "en", "a", 1),
        (1, near, "en", "a", 2),  # a near copy of the row above
        (2, own, "en", "b", 3),
        (2, near, "en", "b", 4),  # the second text of a doc_id
        (None, other, "en", None, 5),
        (None, take(9) + " " + item, "en", "b", 6),
        (3, take(9) + " " + item, "en", "b", 7),
        (3, take(30), "en", "a", 8),  # the same doc_id without the item
        (None, None, "en", "a", 9),
        (None, "", "en", "a", 10),
        (None, "", "en", "b", 11),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    single = stages["ngram_jaccard_join"](spark, frame, str(tmp_path))
    assert Counter(map(tuple, single.collect())) == Counter(r for r in docs if r[4] not in (1, 4))

    fresh = stages["benchmark_decontamination"](spark, frame, str(tmp_path))
    assert Counter(map(tuple, fresh.collect())) == Counter(r for r in docs if r[4] not in (6, 7))

    mixed = [tuple(r) for r in stages["source_mixing"](spark, frame, str(tmp_path)).collect()]
    expected = {(r.doc_id, r["size"], r.source, r.taken) for r in mixing.mix(frame).collect() if r.taken}
    sizes = {r[4]: len(words(r[1])) for r in docs}
    assert {(r[0], sizes[r[4]], r[3], r[5]) for r in mixed} == expected and len(mixed) == len({r[4] for r in mixed})
    assert {r[:5] for r in mixed} <= set(docs) and any(r[0] is None for r in mixed)
