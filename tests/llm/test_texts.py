"""Operators on documents against brute force, odd rows included."""

import hashlib
import math
import random
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lidarlake.llm import common, decontaminate, jaccard, licenses, mixing, substrings, suffix_tree

COLUMNS = "doc_id long, text string, source string, n_words long, split int, node long, taken long"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    """Documents of a small vocabulary, with copies, near copies, shared passages and odd rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    take = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = take(60)
    texts = [" ".join(take(rng.randint(1, 160))) for _ in range(60)]
    for text in texts[:25]:
        near = text.split()
        near[rng.randrange(len(near))] = "edited"
        texts += [text, " ".join(near), text.upper()]
    for _ in range(12):
        texts.append("  ".join(take(rng.randint(0, 30)) + passage + take(rng.randint(0, 30))))
    texts += [None, "", " \t\n", "one", "one two", "one two", "x\x1fy z w", " ".join(passage * 3), "a " * 400]
    texts.append(" ".join(take(30_000)))
    found = [(i, t, f"s{i % 5}" if i % 7 else None, 1, 2, 3, 4) for i, t in enumerate(texts)]
    found += [found[3], (3, "another text with the same number", "s1", 1, 2, 3, 4), (None, texts[5], None, 1, 2, 3, 4)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def shingle_set(text, k):
    w = words_of(text)
    w = [x.lower() for x in w]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard_join(docs, rows, k, num):
    sets = [shingle_set(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and 100 * common_ >= num * len(sets[i] | sets[j]) and sets[j]:
                up[root(i)] = root(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[root(i)] = min(names.get(root(i), r[0]), r[0])
    expected = Counter((r[0], len(s), names.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert Counter(map(tuple, jaccard.jaccard_join(docs, k, num).collect())) == expected

@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (7, 10)])
def test_jaccard_sets_leave_out_all_that_their_own_size_allows(num, den):
    """Each set keeps one slice more than its pairs may differ in, and linked pairs still share a slice."""
    rng = np.random.default_rng(41)
    met = 0
    for size in [1, 2, 3, 5, 9, 17, 30, 57, 58, 76, 77, 115, 130, 171, 172, 300, 385, 386, 500]:
        for more in {0, (size * den // num - size) // 2, size * den // num - size}:
            values = rng.integers(0, 2**63, size + more + size).astype(np.uint64)
            # As far apart as a link allows.
            shared = -(-(size + size + more) * num // (num + den))
            if shared > size:
                continue
            x, y = np.unique(values[:size]), np.unique(np.append(values[:shared], values[size + more :][: size + more - shared]))
            band = jaccard._band(size)
            rows = []
            for s in (x, y):
                of = jaccard._band(len(s))
                keys = [jaccard.slices(s, b, num, den) for b in (of, of - 1) if b == of or (of and len(s) * num <= jaccard._bounds(b)[1] * den)]
                rows.append((len(s), common.signed(np.concatenate(keys))))
            known = np.unique(np.append(rng.choice(rows[0][1], len(rows[0][1]) // 2), rows[1][1][::3]))
            frequent = types.SimpleNamespace(value=(known, rng.integers(2, 99, len(known))))
            batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([n for n, _ in rows]), pa.array([k.tolist() for _, k in rows], pa.list_(pa.int64()))], names=["node", "n", "keys"])
            kept = next(jaccard._choose(frequent, num, den)(iter([batch]))).to_pylist()
            mine, theirs = ([r["key"] for r in kept if r["node"] == i] for i in (0, 1))
            assert set(mine) & set(theirs)
            met += 1
            own = set(common.signed(jaccard.slices(x, band, num, den)).tolist())
            assert sum(k in own for k in mine) == 1 + (size + size * den // num) * (den - num) // (den + num)
    assert met > 20


@pytest.mark.parametrize("num", [80, 90])
def test_unrelated_sets_share_no_slice_by_chance(num):
    """Slices of few places were equal in most sets of a band, and such sets made one cluster."""
    rng, met = np.random.default_rng(3), Counter()
    for size in rng.integers(210, 290, 1000):
        keys = jaccard.slices(np.unique(rng.integers(0, 2**64, size, np.uint64)), jaccard._band(250), num, 100)
        met.update(keys[(keys & np.uint64(jaccard._RANK)) > 0].tolist())  # a slice without odd bits is left out
    assert max(met.values()) == 1


def test_jaccard_join_of_nothing(empty):
    assert jaccard.jaccard_join(empty).collect() == []


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[20:], rng.integers(0, 2**62, 30).astype(np.uint64)]))
    band = jaccard._band(len(a))
    x, y = (np.frombuffer(jaccard.parity(s, band), np.uint64) for s in (a, b))
    assert 0 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7, 7)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([(max(e), min(e)) if rng.random() < 0.5 else e for e in edges], "a long, b long")
    got = {r[0]: r[1] for r in common.components(frame.repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, **{2000 + i: 2000 for i in range(1, 50)}}


@pytest.mark.parametrize("window", [35, 5])
def test_remove_repeats(docs, rows, window):
    count = Counter()
    for r in rows:
        w = words_of(r[1])
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    expected = Counter()
    for r in rows:
        w = words_of(r[1])
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[r[0], len(w), len(gone), kept.decode()] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs, window).collect())) == expected


def test_remove_repeats_carries_clashing_names_and_whole_texts(docs, rows, empty):
    got = substrings.remove_repeats(docs, carried=("n_words", "split", "source"), whole=True).toDF("a", "b", "c", "n", "gone", "kept").collect()
    assert len(got) == len(rows) and {(r.a, r.b) for r in got} == {(1, 2)}
    texts = Counter(r[1] or "" for r in rows)
    assert all(r.kept in texts for r in got if not r.gone)
    assert substrings.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("words", range(50))
def test_windows_of_few_words(words):
    """19 words laid end to end were an error, as shifted slices were of unequal length."""
    text = " ".join(f"w{i}" for i in range(words)).encode()
    own = substrings._Windows([text, b"", b"one"], 35, common.WordHashes())
    assert own.at.tolist() == list(range(max(0, words - 34)))


def test_pieces_cover_a_table():
    texts = ["a" * n for n in (3, 0, 9, 30, 0, 0, 5, 5, 1)] + [None, "b"]
    table = pa.table({"n": range(len(texts)), "text": pa.chunked_array([texts[:4], texts[4:]], pa.string())})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "PIECE_BYTES", 10)
        got = [[(r["n"], r["text"]) for r in p.to_pylist()] for p in common.pieces(table)]
        assert list(common.pieces(table.slice(0, 0))) == []
    assert [r for p in got for r in p] == list(enumerate(texts))
    assert all(len(p) == 1 or sum(len(t or "") for _, t in p if (t or "") != "a" * 30) <= 10 for p in got) and len(got) >= 5


def test_a_split_is_read_piece_by_piece():
    """A split's words, hashes and windows were all in memory at once; now those of one piece."""
    rng = np.random.default_rng(5)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 5000, 2000)) for _ in range(600)]
    table = pa.table({"split": pa.array([3] * 600, pa.int32()), "text": pa.array(texts, pa.binary()).cast(pa.string())})
    held = [sum(len(t) for t in own.texts) for own in substrings._windows(table, 35)]
    assert sum(held) == sum(map(len, texts)) > 4 * common.PIECE_BYTES and max(held) <= common.PIECE_BYTES
    # Pieces change no seed: the whole split at once tells the same.
    at_once = substrings._Windows(texts, 35, common.WordHashes())
    pieces = list(substrings._windows(table, 35))
    assert np.array_equal(np.concatenate([p.anchors() for p in pieces]), at_once.anchors())
    assert np.array_equal(np.concatenate([p.digests(p.at) for p in pieces]), at_once.digests(at_once.at))


def distance(a, b):
    """Least word edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_contaminated(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    take = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(take(rng.randint(8, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (1, None)]
    rows_, edited = [], 0
    for i in range(300):
        words = take(rng.randint(0, 200))
        if i % 3 == 0:
            piece = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, len(piece) // 10])):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], ["new"], [piece[at], "new"]])
                edited += 1
            words[len(words) // 2 : len(words) // 2] = [w.upper() + rng.choice(["", ",", "!!"]) for w in piece]
        rows_.append((i, " ".join(words), 5))
    rows_ += [(1000, None, 5), (1001, "", 5), (None, items[0][1], 5)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, item_id long")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for d, t, _ in rows_:
        words = decontaminate.normal_words(t)
        for i, item in items[:40]:
            w = decontaminate.normal_words(item)
            if len(set(w) & set(words)) >= len(set(w)) / 2:
                off = distance(w, words)
                if off <= math.floor(0.2 * len(w)):
                    expected[d, i] = off
    assert edited and set(got) <= set(expected)
    assert len(got) >= 0.97 * len(expected)
    assert all(expected[k] == 0 for k in set(expected)) or all(got[k].distance == expected[k] for k in got)
    assert {k for k, off in expected.items() if not off} <= set(got)


def test_contaminated_at_most_edits_of_every_length(spark):
    rng = random.Random(21)
    take = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(n, " ".join(take(n))) for n in range(1, 45)]
    rows_, expected = [], set()
    for n, text in items:
        for turn in range(12):
            piece = text.split()
            for _ in range(n // 5):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], ["new"], [piece[at], "new"]])
            before = [] if turn % 4 == 0 else take(30)
            rows_.append((100 * n + turn, " ".join(before + piece + ([] if turn % 4 == 1 else take(30)))))
            expected.add((100 * n + turn, n))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert expected <= {(r.doc_id, r.item_id) for r in got}
    texts = {r[0]: decontaminate.normal_words(r[1]) for r in rows_}
    for r in got:
        item = dict(items)[r.item_id].split()
        assert r.distance == distance(item, texts[r.doc_id]) <= len(item) // 5


def test_contaminated_by_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.contaminated(empty, none).collect() == []


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(words_of(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, wanted = {}, set(order), 1.5 * sum(sizes.values())
    while left:  # full sources leave one round at a time
        rate = (wanted - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if 2 * sizes[s] <= rate * weight[s]}
        if not full:
            target |= {s: rate * weight[s] for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK


def test_mix_keeps_to_targets_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 10)
    rows_ = [(i, f"w{i} " * 12, "b") for i in range(500)] + [(1000 + i, f"h{i} " * 50, "a") for i in range(2000)]
    rows_ += [(5000 + i, "one two", f"s{i:03}") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 + t / 1000 for s, t in target.items())
    assert sum(taken.values()) == round(sum(target.values()))


def test_mix_of_few_words(spark):
    rows_ = [(1, "a b c", "x"), (2, "d e", "y"), (3, "f", None), (4, "g", "z")]
    got = mixing.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in got) == round(1.5 * 7) and all(r.taken <= 2 * r["size"] for r in got)


def test_highest_quotients_with_ties():
    claims, most = np.array([5.0, 5.0, 5.0, 1.0]), np.array([9, 9, 9, 9])
    for seats in range(40):
        slow, got = [0] * 4, mixing.highest(claims, most, seats)
        for _ in range(min(seats, 36)):
            free = [i for i in range(4) if slow[i] < most[i]]
            slow[max(free, key=lambda i: (claims[i] / (2 * slow[i] + 1), -i))] += 1
        assert got.tolist() == slow


def test_mix_without_words(spark, empty):
    assert mixing.mix(empty).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(none).collect()} == {(0, 0.0)}


def test_scan(spark, docs, empty):
    templates = licenses.default_templates(spark)
    long = " ".join(f"clause{i}" for i in range(400))
    templates = templates.unionByName(spark.createDataFrame([(100, "long", long), (101, "none", None), (102, "short", "a b")], templates.schema))
    filler = " ".join(f"f{i}" for i in range(300))
    texts = {i: f"{filler} {t.upper()}\n{filler}" for i, (_, t) in enumerate(licenses.TEMPLATES)}
    broken = long.split()
    broken[50:51] = []
    rows_ = [*texts.items(), (200, filler), (201, None), (202, ""), (203, f"{filler} {' '.join(broken)}"), (204, long[:400])]
    rows_ += [rows_[2], (None, texts[0])]
    frame = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("share", F.lit("x")).withColumn("template_id", F.lit(1))

    def words(text):
        import re

        return re.findall(r"[^\W_]+", (text or "").lower())

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    got = {(r.doc_id, r.template_id): r.share for r in licenses.scan(frame, templates).collect()}
    for d, t in rows_:
        for r in templates.collect():
            want = grams(words(r.text))
            share = len(want & grams(words(t))) / len(want) if want else 0
            if share == 1:
                assert got.pop((d, r.template_id), None) == 1 or d == 2 or d is None
            elif (d, r.template_id) in got:
                assert share >= 0.8
                got.pop((d, r.template_id))
    assert not got
    assert licenses.scan(empty, templates).collect() == []


def test_scan_stays_native(docs, spark):
    plan = licenses.scan(docs, licenses.default_templates(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_suffix_tree_scores(docs, rows):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = suffix_tree.score(docs, held).collect()
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter()
    for r in rows:
        if not is_held(r[0]):
            count.update(w.lower() for w in words_of(r[1]))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for r in rows:
        tokens = [*[w.lower() for w in words_of(r[1])], None]
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        expected[r[0], is_held(r[0]), len(tokens), sum(count[t] > 0 for t in tokens), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    apart = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_suffix_tree_is_a_distribution(docs, empty):
    """Over all next bytes, the chances from any context add up to one; the longest state decides."""
    for frame in (docs, empty):
        tree = suffix_tree.grow(frame)
        tree.ready()
        for context in (b"\x00" * 6, b"ab cd ", b"zzzzzz", "é abc".encode()):
            codes = suffix_tree.runs(b"".join(context + bytes([b]) for b in range(256)))[:: 7]
            assert len(codes) == 256
            assert (10 ** tree.walk(codes)).sum() == pytest.approx(1, abs=1e-4)
            assert np.allclose(tree.walk(codes), tree.scores(codes), atol=1e-5)


def test_suffix_tree_without_training(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score(frame, F.lit(True)).collect()}
    assert (got[2].n_tokens, got[2].n_known, got[2].train_tokens) == (1, 0, 0)
    assert got[2].base_score == pytest.approx(0.0)
    assert got[2].score == pytest.approx(-math.log10(256), abs=1e-4)


def test_lookup_finds_all_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**56, 5000).astype(np.uint64))
    values = rng.random(len(keys)).astype(np.float32)
    known, got = suffix_tree.Lookup(keys, values).find(np.append(keys, np.uint64(1)))
    assert known[:-1].all() and not known[-1] and (got[:-1] == values).all()


def test_lookups_are_small():
    """59 bytes a key before; a worker has one for each depth of the tree."""
    keys = np.unique(np.random.default_rng(3).integers(0, 2**56, 854_000).astype(np.uint64))
    lookup = suffix_tree.Lookup(keys, np.ones(len(keys), np.float32))
    arrays = [a for t in lookup.tables for a in t if isinstance(a, np.ndarray)] + [lookup.rest, lookup.left]
    assert sum(a.nbytes for a in arrays) <= 45 * len(keys)
    known, _ = lookup.find(keys)
    assert known.all() and not lookup.find(keys + np.uint64(2**57))[0].any()


def test_rare_runs_are_walked_once(docs, monkeypatch):
    """They were walked once in each piece of texts."""
    tree = suffix_tree.grow(docs)
    tree.ready()
    texts = [[b"qzx%d" % (i % 400)] * 40 for i in range(4000)]
    walked, walk = [], tree.walk
    monkeypatch.setattr(tree, "walk", lambda codes: walked.append(len(codes)) or walk(codes))
    got = tree.of_texts(texts)
    assert len(walked) > 4 and sum(walked[1:]) < walked[0] / 4
    pieces = [suffix_tree.runs(suffix_tree.symbols(t)) for t in texts[:400]]
    assert np.allclose(got, [walk(p).sum() for p in pieces] * 10)


def test_a_vocabulary_is_read_piece_by_piece():
    """A split's words were all in memory at once; now those of one piece."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 4000, 3000)) for _ in range(200)] + [None, ""]
    train = [i % 3 > 0 for i in range(len(texts))]
    seen = []
    table = pa.table({"text": pa.array(texts, pa.string())})
    own = suffix_tree._Vocabulary(table, train, lambda words: seen.append(sum(len(b" ".join(w)) for w in words)))
    assert len(seen) > 2 and max(seen) <= common.PIECE_BYTES
    words = [(t or "").lower().split() for t in texts]
    expected = Counter({w: 0 for t in words for w in t})
    expected.update(w for t, known in zip(words, train) if known for w in t)
    assert {w.decode(): n for w, n in zip(own.number, own.counts.tolist())} == expected
    names = [w.decode() for w in own.number]
    assert [[names[i] for i in t] for t in own.texts] == words


def test_rolling_hashes_tell_runs_apart():
    values = np.array([5, 7, 5, 7, 9, 5, 7], np.uint64)
    got = common.Rolling(values).runs(2)
    assert got[0] == got[2] == got[5] and len(set(got.tolist())) == 4
    assert common.Rolling(values).runs(2, np.array([2, 4])).tolist() == [got[2], got[4]]


def test_sha_of_kept_words(docs, spark):
    got = substrings.remove_repeats(docs).select("kept", F.sha2("kept", 256).alias("sha")).collect()
    assert all(r.sha == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
