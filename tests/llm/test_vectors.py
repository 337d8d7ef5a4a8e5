"""Near-duplicate vectors against the cosine of all pairs."""

import numpy as np
import pytest

from corvane.llm import vector_dedup as vd
from tests.llm.test_near_dedup import roots_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=vd.LINK):
    good = []
    for v, e, label in rows:
        x = None if e is None or any(n is None for n in e) else np.array(e, np.float32).astype(float)
        if x is not None and label is not None and np.isfinite(x).all() and x.any():
            good.append((v, x, label))
    links = [(a, b) for i, (a, x, p) in enumerate(good) for b, y, q in good[:i]
             if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least]
    n = {v: 0 for v, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = roots_of(links, n)
    return sorted((v, n[v], root[v], root[v] == v) for v in n)


@pytest.mark.parametrize("dims,tile", [(64, 16), (3, 1024), (1, 5), (20, 7)])
def test_links(spark, dims, tile):
    rng = np.random.default_rng(dims)
    rows = []
    for label in range(3):
        base = rng.normal(size=(6, dims))
        for k in range(90):
            x = base[k % 6] * rng.uniform(0.5, 2) + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.2])
            rows.append((1000 * label + k, x.astype(np.float32).tolist(), label))
    rows += [(5000 + k, rows[0][1], 0) for k in range(40)]  # copies
    got = vd.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1),
            (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [None, 1.0], 1), (9, [1.0], 1),
            (10, [1.0, 0.0, 0.0], 1), (11, [1e38, 1e30], 1), (12, [1e-30, 0.0], 1), (13, [], 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vd.near_vectors(docs).collect())) == brute(rows)
    from pyspark.sql import functions as F

    wide = docs.withColumns({c: F.lit("x") for c in ("n", "v", "rep", "dims", "tile", "root", "links")})
    assert sorted(map(tuple, vd.near_vectors(wide).collect())) == brute(rows)
    assert vd.near_vectors(docs.limit(0)).count() == 0
    twice = docs.where("vec_id = 1").union(docs.where("vec_id = 1")).unionByName(
        spark.createDataFrame([(None, [1.0, 0.0], 1)], SCHEMA))
    assert sorted(vd.near_vectors(twice).collect(), key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)], key=str)
