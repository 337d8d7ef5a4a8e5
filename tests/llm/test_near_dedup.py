"""Near-duplicate groups against comparing all pairs of full shingle sets."""

import random

import numpy as np
import pytest

from corvane.llm import near_dedup as nd
from corvane.llm.common import chained


def shingles(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    n = min(words, len(parts))
    return frozenset(tuple(parts[i:i + n]) for i in range(len(parts) - n + 1))


def roots_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words):
    sets = [(d, shingles(t, words)) for d, t in rows]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i]
             if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    root = roots_of(links, {d for d, _ in rows})
    return sorted((d, len(s), root[d], root[d] == d) for d, s in sets)


def families(seed):
    """Texts in families of copies with few and many edits, and chains of edits."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 3, 10])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 12])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,words", [(1, 2), (2, 5), (3, 2)])
def test_components(spark, seed, words):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, nd.near_duplicates(docs, words).collect()))
    assert got == brute(rows, words)


def test_links_between_pivots_are_not_lost(spark):
    """Members of a bucket that both pivots miss are paired in the second step."""
    base = [f"b{i}" for i in range(200)]
    rows = [(k, " ".join(base[:12 * k] + [f"k{k}x{j}" for j in range(12)] + base[12 * k + 12:]))
            for k in range(1, 15)]
    rows += [(100 + d, t.replace("b150", f"y{d}")) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(docs, 2).collect())) == brute(rows, 2)


def test_edges(documents, no_documents, clashing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] is not None]
    got = nd.near_duplicates(documents, 2).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(rows, 2)
    alone = [r for r in got if r["doc_id"] is None]
    assert len(alone) == 1 and alone[0]["kept"] and alone[0]["component_id"] is None
    assert nd.near_duplicates(no_documents, 2).count() == 0
    kept = nd.drop_near_duplicates(clashing, 2)
    assert kept.columns == clashing.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert [d for d in ids if d != 11] == sorted(
        {r[0] for r in brute(rows, 2) if r[3]} - {11})
    assert nd.drop_near_duplicates(no_documents).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    apart = []
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
        a, b = (nd.odd_sketch(nd.min_hashes(np.unique(np.append(common, o)))) for o in own)
        apart.append(sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)))
    assert max(apart) <= nd.MOST_APART
    assert abs(np.mean(apart) - 64 * nd.SKETCH_WORDS * (1 - np.exp(-4 * 0.2 * nd.SAMPLES / 1024)) / 2) < 8


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = dict(map(tuple, chained(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}
    assert chained(spark.createDataFrame([], "a long, b long")).count() == 0
