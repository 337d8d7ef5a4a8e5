"""The inverted file gives the rows of the plain search and skips what it can."""

import numpy as np
import pytest

from corvane.operators import retrieval as rt

VECTORS = "owner_id string, chunk_id string, embedding array<double>"
QUERIES = "owner_id string, query_id string, embedding array<double>"


def clustered(seed, n, centres, spread):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, 8))
    return [(middle[k % centres] + spread * draw.normal(size=8)).tolist() for k in range(n)]


@pytest.mark.parametrize("spread, skips", [(0.05, True), (3.0, False)])
def test_indexed_search_is_exact(spark, spread, skips):
    rows = [("o" if k % 3 else "p", f"c{k:03}", v) for k, v in enumerate(clustered(1, 400, 9, spread))]
    rows += [("o", "zero", [0.0] * 8), ("o", "twin1", rows[1][2]), ("o", "twin2", rows[1][2]), ("q", "one", [1.0] * 8)]
    asked = [("o" if k % 2 else "p", f"q{k}", v) for k, v in enumerate(clustered(1, 12, 9, spread))]
    asked += [("o", "zero", [0.0] * 8), ("q", "few", [1.0] + [0.0] * 7), ("gone", "x", [1.0] * 8)]
    v, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES)
    hits, probes = rt.indexed_topk(q, rt.inverted_file(v, block_rows=50), 7, 3, 11)
    want = rt.vector_topk(q, v, 7)
    columns = ["owner_id", "query_id", "chunk_id", "vec_rank"]
    assert sorted(map(tuple, hits.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    read = probes.collect()
    share = sum(r["n"] for r in read if r["read"]) / sum(r["n"] for r in read)
    assert share < 0.5 if skips else share <= 1
