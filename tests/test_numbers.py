"""Queries over the whole graph take numbers for ids, and give the ids of their results."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph as gr
from workload import beds, load

SF = "/root/testdata/sf0.001"
EDGES = "owner_id string, src string, dst string, rel_type string, description string"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_numbers_stand_for_the_ids_in_their_order(spark):
    graph = beds.by_number(beds.graph_edges, spark, SF)
    want = beds.graph_edges(spark, SF)
    assert rows(graph.named(graph.edges, "src", "dst").select(want.columns)) == rows(want)
    ends = graph.edges.select("owner_id", F.explode(F.array("src", "dst")).alias("no")).distinct()
    named = graph.named(ends.withColumn("id", F.col("no")), "id").orderBy("no").collect()
    assert [(r["owner_id"], r["id"]) for r in named] == sorted((r["owner_id"], r["id"]) for r in named)


def test_any_edges_are_numbered(spark):
    given = [("p", "y", "x", "KNOWS", "d"), ("o", "x", "zz", "LIKES", ""), ("o", "x", "x", "KNOWS", "")]
    edges = spark.createDataFrame(given, EDGES)
    graph = beds.by_number(lambda *_: edges, spark, "")
    assert rows(graph.named(graph.edges, "src", "dst")) == rows(edges)


@pytest.mark.parametrize("name", ["neighbourhood_whole", "merge_small_communities", "louvain_settled", "path_steps"])
def test_whole_graph_is_walked_without_ids(spark, monkeypatch, name):
    monkeypatch.setattr(beds, "_STORED", {})
    monkeypatch.setattr(beds, "part_mentions", lambda *_: pytest.fail("ids of entities are not needed"))
    numbers = rows(load()[0][name](spark, SF))
    monkeypatch.undo()
    ids = beds.graph_edges(spark, SF)
    monkeypatch.setattr(beds, "graph_edges", lambda *_: ids)
    assert numbers and numbers == rows(load()[0][name](spark, SF))


def test_a_hop_sends_the_first_nodes_of_a_root_only(spark, monkeypatch):
    written = []
    real = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: written.append(df) or real(df))
    edges = spark.createDataFrame([("o", "hub", f"n{k:03}", "KNOWS", "") for k in range(300)], EDGES)
    found = gr.neighbourhood(edges.select("owner_id", F.col("src").alias("entity_id")).distinct(), edges, 1, 5)
    assert [r["node"] for r in found.orderBy("node").collect()] == [f"n{k:03}" for k in range(5)]
    assert "WindowGroupLimit" in written[0]._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in written[0]._jdf.queryExecution().executedPlan().toString()


def test_owner_is_settled_in_slices(monkeypatch):
    import random

    import pyarrow as pa
    from corvane.operators import communities as cm
    draw = random.Random(4)
    pairs = [(min(e), max(e)) for e in (draw.sample(range(60), 2) for _ in range(400))]
    table = pa.table({"owner_id": pa.array([0] * 400, pa.int32()), "a": pa.array([a for a, _ in pairs], pa.int32()),
                      "b": pa.array([b for _, b in pairs], pa.int32()), "weight": [1.0 + a % 3 for a, _ in pairs]})
    whole = cm._settle_owner(table)
    monkeypatch.setattr(cm, "LEVEL_LINKS", 7)
    assert cm._settle_owner(table).equals(whole)
    named = pa.table({"owner_id": ["o"] * 400, "a": [f"{a:02}" for a, _ in pairs], "b": [f"{b:02}" for _, b in pairs],
                      "weight": table["weight"]})
    assert cm._settle_owner(named)["comm"].to_pylist() == [f"{c:02}" for c in whole["comm"].to_pylist()]


def test_a_few_entities_need_no_stored_graph(spark, monkeypatch):
    entities = beds.graph_entities(spark, SF)
    wanted = entities.filter("name_norm rlike '[13]$' or type = 'LOCATION'").select("owner_id", "entity_id").distinct()
    key = ["owner_id", "entity_id"]
    edges, mentions = beds.graph_edges(spark, SF), beds.graph_mentions(spark, SF)
    near = gr.undirected(edges).withColumn("entity_id", F.col("node")).join(wanted, key, "left_semi").select(edges.columns)
    assert rows(beds.edges_around(spark, SF)(wanted)) == rows(near.distinct())
    assert rows(beds.mentions_of(spark, SF)(wanted).distinct().select(mentions.columns)) == rows(
        mentions.join(wanted, key, "left_semi").distinct().select(mentions.columns))
    for name in ("graph_edges", "graph_mentions", "part_mentions"):
        monkeypatch.setattr(beds, name, lambda *_: pytest.fail("the whole graph is not needed"))
    for name in ("graph_facts", "graph_retrieve"):
        assert load()[0][name](spark, SF).count()


def test_entities_of_documents_are_counted_by_number(spark, monkeypatch):
    want = rows(gr.document_entities(beds.graph_entities(spark, SF), beds.graph_mentions(spark, SF)))
    monkeypatch.setattr(beds, "graph_mentions", lambda *_: pytest.fail("ids of entities are not needed"))
    got = load()[0]["document_entities"](spark, SF).select(
        "owner_id", "entity_id", "file_id", "mentions", "name", "type")
    assert rows(got) == want


def test_ends_of_a_hub_are_searched_as_one(spark, monkeypatch):
    leaves = [f"leaf{i}" for i in range(9)]
    rows = [("o", leaf, "hub", "KNOWS", "") for leaf in leaves]
    rows += [("o", a, b, "KNOWS", "") for a, b in
             [("hub", "m"), ("m", "n"), ("n", "o"), ("o", "p"), ("p", "q"), ("hub", "k"), ("k", "n"), ("o", "hubs")]]
    written = []
    real = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    ends = [*[(leaf, "o") for leaf in leaves], ("leaf0", "leaf1"), ("leaf0", "hub"), ("leaf2", "p"), ("leaf2", "q")]
    pairs = spark.createDataFrame([("o", *e) for e in ends], "owner_id string, a string, b string")
    got = {(r["a"], r["b"]): (r["hops"], r["nodes"][0], r["nodes"][-1], len(r["rels"])) for r in
           gr.shortest_paths(pairs, spark.createDataFrame(rows, EDGES)).collect()}
    want = {**{(leaf, "o"): 4 for leaf in leaves}, ("leaf0", "leaf1"): 2, ("leaf0", "hub"): 1, ("leaf2", "p"): 5}
    assert got == {(a, b): (n, a, b, n) for (a, b), n in want.items()}
    assert not {r["root"] for df in written if "via" in df.columns for r in df.collect()} & set(leaves[1:])
