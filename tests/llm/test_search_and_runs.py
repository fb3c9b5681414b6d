"""Operators 11 to 13 against brute force, and their defined results for awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelink.llm import ann, hard_negatives, periodic_runs, queries
from kinelink.llm.kmeans_tree import Tree
from kinelink.llm.recompression import Grammar

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, cid string, score string, leaf string, query_id string"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def vectors(spark, rows):
    """Rows of (vec_id, embedding, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, "y", "z", None, "q") for r in rows], VECTORS)


AWKWARD = [
    (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1),
    (7, [float("inf"), 1.0], 2), (8, [None, 1.0], 2), (None, [1.0, 1.0], 1), (9, [], 1), (10, [2.0], 2), (11, [1.0, 0.0], None), (100, [0.0, -1.0], 1), (20, [0.5, 0.5], 2),
]


# 11


def dot(v, w):
    """Component after component, as sum() of floats is not."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def brute_nearest(rows, k, every=20):
    """{(query id, its vector): [(id, score), ...]} over distinct usable rows."""
    good = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            near = [(-dot(v, w), j) for j, w in good if (j, w) != (i, v)]
            out[i, v] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def test_nearest_neighbours_of_awkward_rows(spark):
    got = {}
    for r in ann.nearest_neighbours(vectors(spark, AWKWARD), ann.F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for (i, _), near in brute_nearest(AWKWARD, 3).items():
        assert sorted(got.pop(i)) == [(n, j, s) for n, (j, s) in enumerate(near, 1)]
    assert not got
    assert ann.report(vectors(spark, [])).collect() == []
    assert ann.report(vectors(spark, [(0, [1.0], 1)])).collect() == []


def test_nearest_neighbours_where_one_vector_is_everywhere(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0] if i % 3 else [float(x) for x in rng.normal(size=2).astype(np.float32)], 1) for i in range(900)]
    got = {}
    for r in ann.nearest_neighbours(vectors(spark, rows), ann.F.col("vec_id") % 20 == 0, k=5, leaf=16, part=40, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {i: [(n, j) for n, (j, _) in enumerate(near, 1)] for (i, _), near in brute_nearest(rows, 5).items()}
    right = sum(len(set(got[i]) & set(near)) for i, near in want.items())
    assert {i: len(x) for i, x in got.items()} == dict.fromkeys(want, 5) and right >= 0.95 * 5 * len(want)
    assert all(sorted(got[i]) == near for i, near in want.items() if i % 3)


def test_recall_against_all_pairs_and_exact_scores(embeddings):
    rows = [(r.vec_id, r.embedding, 0) for r in embeddings.collect()]
    found, want = {}, {i: dict(near) for (i, _), near in brute_nearest(rows, 20).items()}
    for r in ann.nearest_neighbours(embeddings, ann.F.col("vec_id") % 20 == 0, leaf=20).collect():
        found.setdefault(r.query_id, []).append(r)
    vector = {i: v for i, v, _ in rows}
    assert found.keys() == want.keys()
    for i, near in found.items():
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, 21)) and i not in {r.vec_id for r in near}
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        assert all(r.score == dot(vector[i], vector[r.vec_id]) for r in near)
    assert sum(len(want[i].keys() & {r.vec_id for r in near}) for i, near in found.items()) >= 0.9 * 20 * len(want)


def test_tree_visits_best_bins_first():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(600, 4))
    tree = Tree(sample, 20, branches=4)
    leaf = tree.locate(sample)
    assert set(leaf.tolist()) == set(range(tree.leaves))
    centre = {int(tree.leaf[v]): tree.centres[v] for v in range(len(tree.leaf)) if tree.leaf[v] >= 0}
    for q, seen in zip(sample[:20], tree.visits(sample[:20], tree.leaves)):
        assert sorted(seen) == list(range(tree.leaves))
        best = max(range(tree.first[0], tree.last[0]), key=lambda v: q @ tree.centres[v])
        while tree.leaf[best] < 0 and all(q @ tree.centres[v] >= max(q @ tree.centres[w] for w in range(tree.first[0], tree.last[0]) if w != best) for v in range(tree.first[best], tree.last[best])):
            best = max(range(tree.first[best], tree.last[best]), key=lambda v: q @ tree.centres[v])
        assert tree.leaf[best] < 0 or seen[0] == tree.leaf[best]
    few = tree.visits(sample[:20], 1, np.bincount(leaf, minlength=tree.leaves), 50)
    assert all(sum((leaf == x).sum() for x in seen) >= 50 for seen in few) and len(centre) == tree.leaves


# 12


def brute_runs(w, least=6, repeats=4):
    out, n = set(), len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, repeats * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.add((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5), st.integers(1, 7), st.integers(0, 40), st.integers(2, 5))
def test_runs_equal_brute_force(texts, period, tail, repeats):
    texts = [*texts, [b"xyzabcd"[i % period : i % period + 1] for i in range(tail)], *([t[:3] + (t[:period] * 30)[:tail] for t in texts])]
    text, *runs = periodic_runs.runs_of(texts, 6, repeats)
    got = [[] for _ in texts]
    for t, *r in zip(text.tolist(), *(x.tolist() for x in runs)):
        got[t].append(tuple(r))
    assert got == [brute_runs(t, 6, repeats) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.data())
def test_grammar_extensions(letters, data):
    string = np.array([3, *letters, 4])
    i = data.draw(st.integers(1, len(letters)))
    j = data.draw(st.integers(i, len(letters))) + 1
    forward = next(n for n in range(len(string)) if string[i + n] != string[j + n])
    backward = next(n for n in range(len(string)) if string[i - 1 - n] != string[j - 1 - n])
    grammar = Grammar(string)
    assert grammar.extensions(np.array([i]), np.array([j]))[0] == forward
    assert grammar.reversed().extensions(np.array([len(string) - j]), np.array([len(string) - i]))[0] == backward
    assert len(grammar.symbols[-1]) == 1


def brute_report(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert got == {i: brute_report(i, t) for i, t in texts.items()}
    assert sum(x[0] for x in got.values()) > 0


def test_runs_of_awkward_rows(spark):
    random.seed(2)
    long = " ".join(random.choice("ab") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "lorem " * 30000), (5, long), (None, "x " * 9), (7, "é " * 6 + "a b " * 4), (7, "é " * 6 + "a b " * 4), (8, "a b a b a b a"), (None, None)]
    df = spark.createDataFrame([(t, i, "n", 5) for i, t in rows], "text string, doc_id long, words string, start int")
    got = [tuple(r) for r in periodic_runs.report(df).collect()]
    key = lambda r: str(r)
    small = [(i, t) for i, t in rows if i != 4]
    assert sorted((r for r in got if r[0] != 4), key=key) == sorted(((i, *brute_report(i, t)) for i, t in small), key=key)
    assert next(r for r in got if r[0] == 4)[1:6] == (1, 0, 30000, 1, 30000000)
    runs = {r.doc_id: r for r in periodic_runs.find_runs(df).collect()}
    assert runs[7].n_words == 14 and runs[7].collapsed_text == "é a b" and [tuple(x) for x in runs[7].runs] == [(0, 6, 1), (6, 8, 2)]
    assert runs[1].runs == [] and runs[1].collapsed_text == ""
    assert periodic_runs.report(df.limit(0)).collect() == [] and periodic_runs.find_runs(df.limit(0)).collect() == []


# 13


def brute_negatives(rows, anchor, positives=5, negatives=5, lowest=80, scale=256):
    good = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, v in good:
        if anchor(a):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in good)
            for less, p, _ in [s for s in scored if s[2] == own and s[1] != a][:positives]:
                fits = [(-s, i) for s, i, label in scored if label != own and -lowest * less <= -100 * s <= -100 * less][:negatives]
                out += [(a, p, r, i, -less, s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force_in_any_blocks(embeddings):
    rows = [(r.vec_id, r.embedding, r.label) for r in embeddings.collect()]
    want = brute_negatives(rows, lambda i: i % 30 == 0, 4, 3, 50)
    for block in (1000, 5):
        got = hard_negatives.hard_negatives(embeddings, hard_negatives.F.col("vec_id") % 30 == 0, positives=4, negatives=3, lowest_percent=50, block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert want


def test_hard_negatives_of_awkward_rows(spark):
    anchor = hard_negatives.F.col("vec_id") % 20 == 0
    rows = AWKWARD + [(200 + i, [1.0, 1.0], i % 3) for i in range(60)] + [(300 + i, [float(i), -1.0], i % 2) for i in range(20)]
    rows = [r for r in rows if r[0] != 0] + [(0, [1.0, 0.25], 1)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), anchor).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert hard_negatives.report(vectors(spark, [])).collect() == []
    large = [(i, [float(1 << 30), float(i)], i % 2) for i in range(40)]
    got = hard_negatives.hard_negatives(vectors(spark, large), anchor, scale=1).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(large, lambda i: i % 20 == 0, scale=1)
