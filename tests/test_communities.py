"""Community detection ends where no node gains, however the graph is dealt to blocks."""

import random

import pytest

from corvane.operators import communities as cm

GRAPH = "owner_id string, a string, b string, weight double, rel_type string, description string"


def planted(groups, size, seed):
    """Dense groups with a few links between them, and one hub that meets every node."""
    draw, nodes = random.Random(seed), [f"n{g}_{k}" for g in range(groups) for k in range(size)]
    pairs = {(a, b): 2.5 for a in nodes for b in nodes
             if a < b and draw.random() < (0.7 if a.split("_")[0] == b.split("_")[0] else 0.02)}
    pairs |= {tuple(sorted((n, "hub"))): 0.1 for n in nodes}
    return [("o", a, b, w, "", "") for (a, b), w in pairs.items()], nodes


@pytest.mark.parametrize("block_links", [cm.BLOCK_LINKS, 40])
def test_louvain_settles(spark, block_links):
    rows, nodes = planted(3, 7, 1)
    rows.append(("small", "x", "y", 1.0, "", ""))
    graph = spark.createDataFrame(rows, GRAPH).cache()
    found = cm.louvain(graph, block_links).cache()
    state = {(r["owner_id"], r["node"]): r["comm"] for r in found.collect()}
    assert len(state) == found.count() == len(nodes) + 3
    assert state["small", "x"] == state["small", "y"]
    for g in range(3):
        assert len({state["o", n] for n in nodes if n.startswith(f"n{g}_")}) == 1
    assert len({state["o", n] for n in nodes}) == 3
    assert {r["gaining"] for r in cm.gaining_nodes(graph, found).collect()} == {0}


def test_louvain_of_no_edges(spark):
    assert cm.louvain(spark.createDataFrame([], GRAPH)).count() == 0


def test_an_owner_in_one_task_leaves_no_gain():
    """By brute force: no node and no whole community gains by joining another one."""
    import random

    import pyarrow as pa

    from corvane.operators.communities import _settle_owner

    rng = random.Random(3)
    for n, p in ((2, 1.0), (12, 0.4), (40, 0.1), (60, 0.3)):
        edges = {(i, j): rng.choice([1.0, 2.5]) for i in range(n) for j in range(i)
                 if rng.random() < (p if i % 4 == j % 4 else p / 8)} or {(1, 0): 1.0}
        table = pa.table({"owner_id": ["o"] * len(edges), "a": [f"n{i}" for i, _ in edges],
                          "b": [f"n{j}" for _, j in edges], "weight": list(edges.values())})
        out = _settle_owner(table).to_pylist()
        comm = {r["node"]: r["comm"] for r in out}
        assert set(comm) == {f"n{x}" for e in edges for x in e}

        def quality(of):
            m = sum(edges.values())
            inside = sum(w for (i, j), w in edges.items() if of[f"n{i}"] == of[f"n{j}"])
            total = {}
            for (i, j), w in edges.items():
                for x in (i, j):
                    total[of[f"n{x}"]] = total.get(of[f"n{x}"], 0) + w
            return inside / m - sum(t * t for t in total.values()) / (4 * m * m)

        best, groups = quality(comm), set(comm.values())
        for node in comm:
            assert all(quality({**comm, node: g}) <= best + 1e-9 for g in groups)
        for one in groups:
            for other in groups:
                merged = {k: other if g == one else g for k, g in comm.items()}
                assert quality(merged) <= best + 1e-9


def test_an_owner_above_a_block_is_still_one_task(spark, monkeypatch):
    """Blocks are for owners that no task can hold; the sweeps over them take many jobs."""
    def unwanted(*_):
        raise AssertionError("sweeps over blocks")

    rows, nodes = planted(3, 7, 2)
    graph = spark.createDataFrame(rows, GRAPH).cache()
    monkeypatch.setattr(cm, "_louvain_in_blocks", unwanted)
    found = cm.louvain(graph, 40, owner_links=10_000)
    assert found.count() == len(nodes) + 1
    assert {r["gaining"] for r in cm.gaining_nodes(graph, found).collect()} == {0}
    monkeypatch.setattr(cm, "BLOCK_LINKS", 40)
    assert cm.louvain(graph, 40).count() == len(nodes) + 1


def test_modularity_adds_parallel_edges_without_grouping_them(spark):
    from corvane.operators import communities as cm
    edges = spark.sql("select 'o' as owner_id, a as src, b as dst, t as rel_type, t as description from values "
                      "('a', 'b', 'COOCCURS_WITH'), ('b', 'a', 'PART_OF'), ('b', 'c', 'PART_OF'), ('c', 'c', 'PART_OF'), "
                      "('c', 'd', 'COOCCURS_WITH'), ('d', 'x', 'PART_OF') v(a, b, t)")
    members = spark.sql("select 'o' as owner_id, n as node, c as comm from values ('a', 1), ('b', 1), ('c', 2), "
                        "('d', 2) v(n, c)")
    # weights 3.5 and 1 inside, 2.5 across; the edge to x counts only for d
    want = 4.5 / 7 - (9.5 ** 2 + 7.0 ** 2) / (4 * 49)
    for g in (cm.weighted_edges(edges), cm.entity_graph(edges)):
        assert abs(cm.modularity(g, members).collect()[0]["modularity"] - want) < 1e-12
    plan = cm.modularity(cm.weighted_edges(edges), members)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2


def test_owners_do_not_share_a_task(spark, monkeypatch):
    """By hash, five owners over four partitions meet in at least one."""
    from pyspark.sql import functions as F
    rows = [(f"owner {k}", f"n{i}", f"n{i + 1}", 1.0, "", "") for k in range(5) for i in range(200)]
    graph = spark.createDataFrame(rows, GRAPH)
    written = []
    real = cm.cut_lineage
    monkeypatch.setattr(cm, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    assert cm.louvain(graph).select("owner_id", "node").distinct().count() == 5 * 201
    files = written[-1].groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("owner_id").alias("n"))
    assert [r["n"] for r in files.collect()] == [1] * 5
