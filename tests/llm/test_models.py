"""Toxicity, quality, neighbours and archives."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.llm import neighbours, quality, toxicity, warc


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic, good = int(i % 6 == 0), int(i % 4 != 1)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "xuq" + word()])
        if not good:
            words = [w + "$$$" for w in words] if i % 8 == 1 else [w for w in words[:9] for _ in range(7)]
        docs.append((i, " ".join(words), 3.0, 9))
        if i % 10:
            labels.append((i, good, toxic))
    docs += [(2000, None, 3.0, 9), (2001, "", 3.0, 9), (2002, "long " * 50_000, 3.0, 9), (None, "no number", None, 9), docs[0]]
    labels += [(2000, 1, 0), (None, 1, 1), (3, None, None), (5000, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double, label int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {d[0]: d for d in docs},
    )


@pytest.mark.parametrize(("module", "name", "cut"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.3)])
def test_held_out_labels(labelled, module, name, cut):
    docs, labels, _ = labelled
    model = module.train(docs, labels.where("doc_id % 3 <> 1"))
    got = module.score(docs, model, [F.col("doc_id"), F.col("label")]).select("rest.doc_id", "score").collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id % 3 == 1 and r.doc_id < 900}
    truth = {i: int(i % 6 == 0) if name == "toxic" else int(i % 4 != 1) for i in held}
    assert np.mean([(held[i] >= cut) == truth[i] for i in held]) > 0.97
    again = module.score(docs.repartition(5), module.train(docs.repartition(4), labels.where("doc_id % 3 <> 1"))).collect()
    key = lambda r: (str(r[0]), r[1])
    first = sorted(((r.doc_id, r.score) for r in got), key=key)
    second = sorted(((r.rest.doc_id, r.score) for r in again), key=key)
    assert [a for a, _ in first] == [b for b, _ in second]
    assert np.allclose([a for _, a in first], [b for _, b in second])


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_documents(labelled, module):
    docs, labels, _ = labelled
    model = module.train(docs, labels.where("false"))
    assert module.score(docs, model).count() == docs.count()
    assert module.score(docs.where("false"), model).collect() == []


def test_label_model_shares_a_voice_among_copies():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.3
    good = (rng.random((2000, 3)) < np.where(truth, 0.8, 0.1)[:, None]).astype(float)
    bad = (rng.random(2000) < np.where(truth, 0.5, 0.4)).astype(float)
    labels = np.where(rng.random(2000) < 0.95, truth, ~truth).astype(int)
    once = toxicity.label_model(np.column_stack([good, bad]), labels)
    often = toxicity.label_model(np.column_stack([good, *[bad] * 8]), labels)
    assert np.abs(once - often).mean() < 0.02
    assert np.mean((often > 0.5) == truth) > 0.94


def test_shouting_is_told_by_all_letters():
    assert toxicity.capitals("Hello there") == 1 and toxicity.capitals("hELLO T") == 5
    assert toxicity.capitals("İX ß É é 1") == 3 and toxicity.capitals("") == 0
    assert toxicity._pattern_votes("Hello there", 0, 2)[0] == 0 and toxicity._pattern_votes("hELLO T", 0, 2)[0] == 1


def test_texts_go_through_scoring_once(labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, [F.col("doc_id")], text=True)
    assert got.columns == ["text", "rest", "score"]
    plain = toxicity.score(docs, model, [F.col("doc_id"), F.col("text")]).select("rest.text", "rest.doc_id", "score")
    assert sorted(map(str, got.select("text", "rest.doc_id", "score").collect())) == sorted(map(str, plain.collect()))


def test_preferences_are_of_either_label():
    good, bad = quality.preferences(np.array([1, 0, 1, 0, 0]))
    assert set(good.tolist()) <= {0, 2} and set(bad.tolist()) <= {1, 3, 4} and len(good) == len(bad) > 0


def test_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(3000)]
    rows += [(i, rows[40][1], 1) for i in range(3000, 3200)]  # a hot vector
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [None] * 16, 1), (9004, [float("nan")] * 16, 1),
           (9005, [float("inf")] * 16, 1), (None, rows[0][1], 1), (9006, [], 1), (9020, [1.0, 2.0], 1), (9021, [2.0, 1.0], 1)]
    frame = spark.createDataFrame(rows + odd + [rows[7], rows[20]], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], np.float32).astype(float)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0} | {9020}
    assert [x[1:] for x in got.pop(9020)] == [(9021, 4.0)]
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = vectors @ vectors[q if q < 3000 else 40]
        scores[q] = -np.inf
        order = np.lexsort((ids, -np.round(scores, 9)))[:20]
        hits += len(set(ids[order].tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(vectors[v] @ vectors[q if q < 3000 else 40]), abs=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hits >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("folder", ["sf0.1", "sf0.01"])
def test_the_chi_square_test_stops_the_search(spark, folder):
    """Recall against brute force, and the share of vectors that are verified for it."""
    given = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, vectors = given["vec_id"].to_numpy(), np.array(given["embedding"].to_pylist(), float)
    block = neighbours.Block(vectors, float((vectors * vectors).sum(1).max()))
    point = neighbours.chi_square_point(neighbours.MISS, neighbours.PLACES)
    hits = verified = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for i in asked:
        rows, tested = block.near(vectors[i], 20, point)
        verified += tested
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        found = sorted((r for r in block.order[rows] if r != i), key=lambda r: -scores[r])[:20]
        hits += len(set(found) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.92 * 20 * len(asked)
    assert verified <= (0.5 if folder == "sf0.1" else 0.7) * len(asked) * len(vectors)


def test_blocks_lose_no_neighbour_but_by_chance(spark, monkeypatch):
    """The query over its whole table, in several blocks: recall of the result itself."""
    from lidarlake.llm import queries

    monkeypatch.setattr(neighbours, "BLOCK", 700)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, vectors = given["vec_id"].to_numpy(), np.array(given["embedding"].to_pylist(), float)
    got = {}
    for r in queries.op6_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0} and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(found.values()) & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.92 * 20 * len(got)


def test_nearest_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, frame.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert neighbours.nearest(frame.where("false"), frame.where("false")).collect() == []


def test_chi_square_point():
    assert neighbours.chi_square_point(0.05, 8) == pytest.approx(15.507, abs=1e-3)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [(i * 3, f"http://e/{i}\r\nx", "<p>é" + "ab" * rng.randint(0, 400) + "</p>", 1, "z") for i in range(200)]
    rows += [(1000 + i, "http://copy", "<b>same</b>", 1, "z") for i in range(50)] + [(1049, "http://copy", "<b>same</b>", 1, "z")]
    rows += [(2000, None, None, 1, "z"), (2001, "u", "", 1, "z"), (2002, "u", "x" * 300_000 + "\r\n\r\nWARC/1.1", 1, "z"),
             (None, "u", "no number", 1, "z"), (None, "u", "<b>same</b>", 1, "z")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, shard int, file string").repartition(4)


@pytest.mark.parametrize("least", [0, 12])
def test_archives_round_trip(spark, pages, tmp_path, least):
    rows, frame = pages
    outputs = []
    for turn in range(2):
        folder = f"file://{tmp_path}/{least}-{turn}"
        manifest = warc.write_archives(frame.repartition(turn + 2), folder, least, shard_bytes=40_000, roll_bytes=6_000).collect()
        got = warc.read_archives(spark, folder).collect()
        outputs.append(sorted(tuple(m) for m in manifest))
        assert len(manifest) > 4 and sum(m.records for m in manifest) == len(rows) == len(got)
        for m in manifest:
            data = (tmp_path / f"{least}-{turn}" / m.file).read_bytes()
            assert (len(data), hashlib.sha1(data).hexdigest()) == (m.bytes, m.sha1)
        best = {}
        for p, _, h, *_ in rows:
            best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
        assert all(r.intact for r in got)
        assert len({r.record_id for r in got}) >= len(rows) - 1
        expected = []
        for p, _, h, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
            data = (h or "").encode()
            copies = sum((x[2] or "") == (h or "") for x in rows) > 1 and len(data) >= least
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            revisit = copies and (best[h or ""] != p or (p, digest) in {e[:2] for e in expected})
            expected.append((p, digest, len(data), "revisit" if revisit else "response", best[h or ""] if revisit else None))
        order = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=order) == sorted(expected, key=order)
        for r in got:
            assert (r.payload is None) == (r.record_type == "revisit")
    assert outputs[0] == outputs[1]  # the same bytes, however the input was dealt


def test_one_far_id_leaves_shards_even(spark, tmp_path):
    frame = spark.range(2000).select(
        F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")).alias("page_id"), F.lit("u").alias("url"),
        F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 900)).alias("html"),
    )
    stretches, place = warc._stretches(frame, 100_000)
    dealt = stretches.send(frame.withColumn("_at", place), F.lit(0))
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 2 * 2000 / len(sizes)
    folder = f"file://{tmp_path}/far"
    warc.write_archives(frame, folder, shard_bytes=100_000)
    assert sorted(r.page_id for r in warc.read_archives(spark, folder).collect()) == sorted(r.page_id for r in frame.collect())


def test_archives_of_nothing(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(pages[1].where("false"), folder).collect() == []
    assert warc.read_archives(spark, folder).collect() == []


def test_members_notice_a_cut_file(tmp_path):
    data = warc.page_record(1, 0, "u", b"payload" * 1000, None, False)
    (tmp_path / "x").write_bytes(data[:-20])
    with open(tmp_path / "x", "rb") as stream, pytest.raises(ValueError):
        list(warc.members(stream, 64))
