import random
import re

import numpy as np
import pytest

from loresift.llm import duplicates as d
from loresift.llm.vptree import VantageTree, close_pairs, distance

SCHEMA = "doc_id long, text string, url string, keys string, same string"


def shingles(text, size):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= 20 else set()


def brute(rows, threshold, size):
    sets = {doc: s for doc, text in rows if (s := shingles(text, size))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)] + ["Straße", "日本語", "naïve"]
    out = []
    for base in range(60):
        text = rng.choices(words, k=rng.randint(40, 120))
        out.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edited = list(text)
            for _ in range(rng.randint(0, 7)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            out.append(" , ".join(edited) if base % 2 else " ".join(edited))
    rng.shuffle(out)
    numbered = list(enumerate(out))
    return [*numbered, (900, None), (901, ""), (902, "too short " * 5), (903, "long " * 60_000), (904, "LONG, " * 60_000), *numbered[:5]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("hot_rows", [50_000, 2])
def test_pairs_equal_brute_force(spark, rows, hot_rows, monkeypatch):
    """Also where every shard is cut into blocks."""
    if hot_rows == 2:
        whole = d.hot_keys
        monkeypatch.setattr(d, "hot_keys", lambda bands, n, share=1: whole(bands, n, 1))
    got = [tuple(r) for r in d.similar_pairs(frame(spark, rows), 0.6, 3, hot_rows=hot_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3)


def test_groups(spark, rows):
    rows = rows[:100]
    pairs = brute(rows, 0.8, 5)
    label = {doc: doc for doc, _ in rows}
    for _ in range(10):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.class_id, r.links) for r in d.duplicate_groups(frame(spark, rows), 0.8, 5).collect()}
    assert got == {doc: (label[doc], sum(doc in p for p in pairs)) for doc, _ in rows}


def test_empty(spark, rows):
    assert d.similar_pairs(frame(spark, rows).limit(0), 0.6, 3).count() == 0
    assert d.duplicate_groups(frame(spark, rows).limit(0)).count() == 0
    assert d.duplicate_groups(frame(spark, [(1, None), (2, "x")])).count() == 2


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in d.components(chain).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("n", [3, 60, 700])
def test_tree_equals_brute_force(n):
    rng = np.random.default_rng(n)
    points = rng.integers(0, 2**63, size=(n, 2), dtype=np.int64).astype(np.uint64)
    points[n // 2 :] = points[: n - n // 2] ^ (rng.integers(0, 2**10, size=(n - n // 2, 2)).astype(np.uint64))
    a, b = np.triu_indices(n, 1)
    near = distance(points[a], points[b]) <= 20
    got = close_pairs(points, 20)
    assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == set(zip(a[near].tolist(), b[near].tolist(), strict=True))


def test_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, size=(40, 2), dtype=np.int64).astype(np.uint64)
    points = np.repeat(centres, 50, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, size=(2000, 2)).astype(np.uint64))
    tree = VantageTree(points)
    visited = []
    original = VantageTree.within
    VantageTree.within = lambda self, p, q, r: (visited.append(len(q) * len(self.index)) if self.leaf else None, original(self, p, q, r))[1]
    try:
        tree.within(points, np.arange(2000), 6)
    finally:
        VantageTree.within = original
    assert sum(visited) < 2000 * 2000 / 3
