"""Hard negatives, repeated passages and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance, negatives, substrings
from gridloom.llm.covertree import CoverTree, augmented, best_in_windows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def repeats_by_hand(rows, width):
    """Kept words and counts; rows (id, text) in the order that decides what is earlier."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, out = set(), []
    for own in words:
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((len(own), sum(gone), " ".join(w for w, g in zip(own, gone, strict=True) if not g)))
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    texts = []
    for _ in range(90):
        own = []
        for _ in range(rng.randrange(0, 6)):
            own += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    # Copies, near copies, one word over and over, long texts, short and empty ones.
    texts += [texts[3]] * 20 + [texts[5] + " more"] * 3 + ["a " * 300, "a b " * 200, " ".join(rng.choice(vocabulary[:3]) for _ in range(3000)), "", None, " \n ", "one", "Ü\x85é " * 30, "x\x1fy " * 25]
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "k", "most", "task_rows"), [(20, 5, 1 << 15, 1 << 16), (8, 2, 3, 40), (6, 5, 2, 10), (4, 1, 5, 7)])
def test_repeats(spark, width, k, most, task_rows):
    """Small groups make prefixes of every length; results do not change."""
    rows = corpus(random.Random(width))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"n_removed": F.lit("clash"), "id": F.lit(1)})
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, width, k, most, task_rows).collect()}
    want = repeats_by_hand(rows, width)
    assert [got[i] for i, _ in rows] == want
    assert any(w[1] for w in want)


def test_repeats_odd_rows(spark):
    """Null ids come first; equal rows are one document; texts of one id are in the order of their hashes; an empty table is fine."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, passage), (1, passage), (1, passage), (2, "head " + passage), (2, "other " + passage), (3, "q " * 30), (3, "q " * 30)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in out.collect()))
    assert [g[:4] for g in got[:5]] == [(False, 0, 25, 0), (True, 1, 25, 25), (True, 1, 25, 25), (True, 2, 26, 25), (True, 2, 26, 25)]
    assert [g[4] for g in got[3:5]] == ["head", "other"]
    assert [g[2:] for g in got[5:]] == [repeats_by_hand([(3, "q " * 30)], 20)[0]] * 2
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_places():
    rng = np.random.default_rng(2)
    for span in range(1, 20):
        x = rng.integers(0, 5, 60).astype(np.uint64)
        assert substrings.least_places(x, span).tolist() == [i + int(x[i : i + span].argmin()) for i in range(61 - span)]


def features_by_hand(text):
    words = WORD.findall(ascii_lower(text))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


ODD = ["", None, "A", "Ab c\x00D-e9", "x" * 70000 + " y " + "z" * 300 + " w", "a\x1fb\x1cc d\x85e", "Ünï 9z-Ä", " \n", "%%%"]


@pytest.mark.parametrize(("kept", "piece"), [(1 << 17, 1 << 20), (40, 300)])
def test_features(monkeypatch, kept, piece):
    """Buckets of all windows, whatever the task keeps in mind and how texts are sliced."""
    monkeypatch.setattr(importance, "KEPT", kept)
    monkeypatch.setattr(importance, "SLICE", piece)
    rng = random.Random(4)
    texts = [*ODD, *(" ".join("".join(rng.choice("abÜ'Z9.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60))) for _ in range(60)), *ODD]
    at = 0
    for words, owner, found in importance.Features().of(texts):
        for i in range(len(words)):
            want, n = features_by_hand(texts[at + i])
            assert (sorted(found[owner == i].tolist()), words[i]) == (sorted(want), n)
        at += len(words)
    assert at == len(texts)


def test_resampling(spark):
    """Weights, scores and ranks by hand, with null ids, repeated and odd rows and clashing names."""
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([20, 200])]) for _ in range(rng.randrange(10, 60))) for _ in range(300)]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(ODD)), (None, texts[0]), (7, texts[7])]
    target = [(i, " ".join(rng.choice(vocabulary[:20]) for _ in range(40))) for i in range(10)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"rank": F.lit(1), "weight": F.lit("x")})
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(docs, goal, share=(20, 100)).collect()
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    own = [features_by_hand(x) for _, x in rows]
    for found, _ in own:
        np.add.at(s, found, 1)
    for _, x in target:
        np.add.at(t, features_by_hand(x)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t, strict=True)]
    want, fit = [], []
    for (i, _), (found, n) in zip(rows, own, strict=True):
        weight = sum(gain[f] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                fit.append((-score, i))
        want.append((i, len(found), weight, score))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [(a, b) for _, a, b in drawn] == sorted(fit)[: 20 * len(fit) // 100] and [r for r, _, _ in drawn] == list(range(1, len(drawn) + 1))
    assert importance.resample(docs.limit(0), goal).count() == 0
    assert importance.resample(docs, goal.limit(0)).where("rank is not null").count() == len(fit) * 5 // 100


def points(rng, n, dim, clusters=0):
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 4 + 0.2 * x
    return np.floor(256 * x / np.sqrt((x * x).sum(axis=1, keepdims=True)))


@pytest.mark.parametrize(("clusters", "most"), [(0, 1.0), (40, 0.25)])
def test_cover_tree(clusters, most):
    """The tree's invariants, exact windows, and how many points are scored: few where points stand in clusters."""
    rng = np.random.default_rng(clusters)
    x = points(rng, 2000, 64, clusters)
    square = float((x * x).sum(axis=1).max())
    tree = CoverTree(augmented(x, square))
    assert len(tree.first) > 100 and sorted(tree.order.tolist()) == list(range(2000))
    for i in range(len(tree.first)):
        own = tree.points[tree.order[tree.first[i] : tree.end[i]]]
        assert np.sqrt(((own - tree.centres[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        if tree.kid_count[i]:
            kids = np.arange(tree.kids[i], tree.kids[i] + tree.kid_count[i])
            assert tree.first[kids[0]] == tree.first[i] and tree.end[kids[-1]] == tree.end[i] and (tree.radius[kids] < tree.radius[i]).all()
    ids, scored = np.arange(2000) * 3, 0
    for q in range(0, 2000, 100):
        low, high = np.array([-np.inf, 15000.0, 60000.0]), np.array([np.inf, 20000.0, 50000.0])
        found, _ = best_in_windows(tree, ids, square, x[q], int(ids[q]), low, high, 5)
        dots = x @ x[q]
        for (name, score), a, b in zip(found, low, high, strict=True):
            fit = [(-s, i) for s, i in zip(dots, ids.tolist(), strict=True) if a <= s <= b and i != ids[q]]
            assert [(-s, i) for i, s in zip(name.tolist(), score.tolist(), strict=True)] == sorted(fit)[:5]
        scored += best_in_windows(tree, ids, square, x[q], int(ids[q]), low[:1], high[:1], 5)[1]
    assert scored <= most * 20 * 2000


@pytest.mark.parametrize(("rows", "block"), [(400, 8192), (700, 16)])
def test_hard_negatives(spark, rows, block):
    """Against a loop over all pairs: ties, repeated and odd rows, null labels, other lengths, many small blocks."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, 8))
    x[rows // 2 :] = x[: rows - rows // 2] + np.round(rng.normal(size=(rows - rows // 2, 8)), 1) / 8
    data = [(i, [float(v) for v in row], int(rng.integers(0, 3))) for i, row in enumerate(x)]
    data += [(20, data[20][1], data[20][2]), (10, None, 1), (30, [1.0, None], 1), (40, [float("nan"), 1.0], 1), (50, [1.0, 2.0], None), (None, [1.0] * 8, 1), (60, [1.0, 2.0], 1), (61, [1.0, 2.0], 1), (62, [1.0, 1.5], 2), (70, [], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4).withColumns({"rank": F.lit("x"), "h": F.lit(1)})
    got = negatives.hard_negatives(df, every=20, block_rows=block, pack_rows=16 if block == 16 else 8192)
    good = [(i, np.floor(256 * np.array(v)), c) for i, v, c in data if i is not None and c is not None and v and all(e is not None and np.isfinite(e) for e in v)]
    want, asked = [], set()
    for i, v, c in good:
        if i % 20 or (i, v.tobytes(), c) in asked:
            continue
        asked.add((i, v.tobytes(), c))
        others = [(-int(v @ w), j, d) for j, w, d in good if j != i and len(w) == len(v)]
        for ps, p in sorted((s, j) for s, j, d in others if d == c)[:5]:
            fit = sorted((s, j) for s, j, d in others if d != c and 80 * -ps <= 100 * -s <= 100 * -ps)[:5]
            want += [(i, p, r, n, -ps, -s) for r, (s, n) in enumerate(fit, 1)]
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == sorted(want)
    assert len(want) > 100
    if block != 16:
        assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_secret_scan_is_repeatable(spark):
    """Probabilities are equal to the last digit whatever the partitions of the input are, and ``least`` bounds candidates."""
    from gridloom.llm import secret_scan

    rng = np.random.default_rng(21)
    signs = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    rows = []
    for i in range(120):
        key = "".join(rng.choice(signs, 20))
        rows += [(2 * i, f'api_key = {key} after {"x" * (i % 7)}', "a/b"), (2 * i + 1, f"call 2024-01-{i % 28 + 1:02d}-{i:05d} or {key} by test/path{i % 9}/example.txt", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, other = (sorted(map(tuple, secret_scan.scan(frame.repartition(n)).collect())) for n in (2, 7))
    assert first == other and len({r[4] for r in first}) > 2
    short = spark.createDataFrame([(1, "key: abcd1234", None)], "doc_id long, text string, source string")
    assert secret_scan.candidates(short, "doc_id", "text", "source").count() == 0
    assert [r.value for r in secret_scan.candidates(short, "doc_id", "text", "source", least=8).collect()] == ["abcd1234"]
