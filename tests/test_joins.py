"""Sides of joins that grow with the data are shuffled, however small their files look."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import communities as cm
from corvane.operators import graph as gr

ENTITIES = ("select 'o' as owner_id, concat('e', id) as entity_id, concat('Name ', id) as name, "
            "concat('name ', id) as name_norm, 'PERSON' as type, '' as description from range(5)")
MENTIONS = ("select 'o' as owner_id, 'f' as file_id, concat('c', id) as chunk_id, concat('e', id) as "
            "entity_id from range(5)")
EDGES = ("select 'o' as owner_id, concat('e', id) as src, concat('e', id + 1) as dst, 'KNOWS' as rel_type, "
         "'' as description from range(4)")
QUESTIONS = "select 'o' as owner_id, concat('q', id) as query_id, concat('Who is name ', id, '?') as question from range(5)"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables read from small files, as Spark would broadcast them."""
    folder = tmp_path_factory.mktemp("joins")
    tables = {"entities": ENTITIES, "mentions": MENTIONS, "edges": EDGES, "questions": QUESTIONS,
              "documents": "select 'o' as owner_id, 'f' as file_id, 'f.pdf' as file_name, '' as link",
              "membership": "select 'o' as owner_id, concat('e', id) as node, 'x' as comm from range(5)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}")
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    gr.link_entities(found["questions"], found["entities"]).write.parquet(f"{folder}/linked")
    return found | {"linked": spark.read.parquet(f"{folder}/linked")}


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_linking_sends_no_questions_to_the_driver(stored):
    linked = gr.link_entities(stored["questions"], stored["entities"])
    assert broadcasts(linked) == 0
    # the telling word "name" links every question to every name
    assert linked.count() == 25


def test_facts_and_hops_are_shuffled(stored):
    t = stored
    facts = gr.graph_facts(t["linked"], t["entities"], t["edges"], t["mentions"], t["documents"])
    hop1 = gr.graph_hop1(t["linked"], t["entities"], t["mentions"])
    hop2 = gr.graph_hop2(t["linked"], t["entities"], t["edges"], t["mentions"])
    for df in (facts, hop1, hop2):
        assert broadcasts(df) == 0
        assert df.count()


def test_members_of_communities_are_shuffled(stored):
    size = stored["membership"].groupBy("owner_id", "comm").count().selectExpr(
        "owner_id", "comm", "cast(count as int) as member_count", "'about names' as summary")
    found = cm.relevant_communities(stored["questions"], stored["linked"], size, stored["membership"],
                                    stored["entities"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "node" in line]
    assert not joins
    assert {r["comm"] for r in found.collect()} == {"x"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_frontier_meets_the_edges_where_they_lie(stored, monkeypatch):
    seen = []
    real = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: seen.append(plan_of(df)) or real(df))
    seeds = stored["entities"].filter("entity_id = 'e0'").select("owner_id", "entity_id")
    found = gr.neighbourhood(seeds, stored["edges"], 2)
    assert {(r["node"], r["hops"]) for r in found.collect()} == {("e1", 1), ("e2", 2)}
    assert seen and all("BroadcastHashJoin" in p for p in seen)


def test_paths_do_not_reach_dead_ends(spark, monkeypatch):
    rows = [("o", f"leaf{i}", hub, "KNOWS", "") for hub in "xy" for i in range(20 * (hub == "y"), 20 + 20 * (hub == "y"))]
    rows += [("o", "x", "m", "KNOWS", ""), ("o", "m", "y", "KNOWS", "")]
    edges = spark.createDataFrame(rows, "owner_id string, src string, dst string, rel_type string, description string")
    written = []
    real = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    pairs = spark.createDataFrame([("o", "leaf0", "leaf39")], "owner_id string, a string, b string")
    got = gr.shortest_paths(pairs, edges).collect()
    assert [(r["hops"], r["nodes"]) for r in got] == [(4, ["leaf0", "x", "m", "y", "leaf39"])]
    reached = {r["node"] for df in written if "via" in df.columns for r in df.collect()}
    assert reached <= {"x", "y", "m", "leaf0", "leaf39"}


def test_small_chunks_are_paired_without_a_join(stored, spark):
    m = stored["mentions"]
    plan = plan_of(gr.cooccurrence_edges(m))
    # the blocks of large chunks are the only join
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1
    rows = spark.range(30).selectExpr("'o' as owner_id", "concat('c', id % 3) as chunk_id",
                                      "concat('e', id div 3) as entity_id")
    want = {tuple(r) for r in gr.cooccurrence_edges(rows, block=3).collect()}
    assert want == {tuple(r) for r in gr.cooccurrence_edges(rows).collect()} and len(want) == 45


def test_counting_edges_needs_no_ids_of_entities(spark, monkeypatch):
    from workload import beds, load
    for name in ("graph_edges", "graph_mentions", "part_mentions"):
        monkeypatch.setattr(beds, name, lambda *_: pytest.fail("ids of entities are not needed"))
    lines = spark.sql("select 'o' as owner_id, 1L as o_custkey, o as o_orderkey, p as l_partkey, 7L as l_suppkey "
                      "from values (1L, 1L), (1L, 2L), (1L, 3L), (2L, 1L), (2L, 2L), (2L, 9L) t(o, p)")
    keys = {"part": spark.sql("select explode(array(1L, 2L, 3L)) as p_partkey"),
            "supplier": spark.sql("select 7L as s_suppkey")}
    monkeypatch.setattr(beds, "order_lines", lambda *_: lines)
    monkeypatch.setattr(beds, "table", lambda s, f, name: keys[name])
    monkeypatch.setattr(beds, "telling_edges", lambda *_: spark.sql("select 'o' as owner_id, 'PART_OF' as rel_type"))
    got = {r["rel_type"]: r["cnt"] for r in load()[0]["graph_stats_relations"](spark, "").collect()}
    assert got == {"PART_OF": 1, "COOCCURS_WITH": 3, "MENTIONS": 7}


def test_copies_of_an_entity_are_joined_once(stored, monkeypatch):
    """Sixty copies of an entity repeat its pairs, and no more pairs are made than can be kept."""
    seen = []
    real = gr.first_per
    monkeypatch.setattr(gr, "first_per", lambda df, by, *a, **k: seen.append(df) or real(df, by, *a, **k))
    t = stored
    copies = t["entities"].withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("copy")
    mentions = t["mentions"].withColumn("chunk_id", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn(
        "chunk_id", F.concat(F.lit("c"), "chunk_id"))
    linked = t["linked"].filter("query_id = 'q0' and name_norm = 'name 0'")
    facts = gr.graph_facts(linked, copies, t["edges"], mentions, t["documents"], 40)
    assert {(r["related_name"], r["chunk_id"]) for r in facts.collect()} == {("Name 1", "c1")}
    assert facts.count() == 40 and seen[-1].count() == 40


def test_copies_of_an_entity_repeat_its_hops_up_to_the_limit(stored):
    """As in the SQL: a neighbour's rows are counted with the copies, a first hop's chunks are not."""
    t = stored
    copies = t["entities"].withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(7)))).drop("copy")
    mentions = t["mentions"].withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn(
        "chunk_id", F.concat("chunk_id", F.lit("."), "n")).drop("n")
    linked = t["linked"].filter("query_id = 'q0' and name_norm = 'name 0'")
    hop2 = gr.graph_hop2(linked, copies, t["edges"], mentions, 10)
    assert {r["chunk_id"]: r["count"] for r in hop2.groupBy("chunk_id").count().collect()} == {"c1.1": 7, "c1.2": 3}
    hop1 = gr.graph_hop1(linked, copies, mentions, 10)
    assert [(r["copies"], r["score"]) for r in hop1.collect()] == [(7, 1.0)] * 9
    found = gr.graph_retrieve(hop1, hop2, t["mentions"].select("owner_id").distinct().select(
        "owner_id", F.explode(F.array(F.lit("c0.1"), F.lit("c1.1"))).alias("chunk_id")), 10)
    rows = {r["chunk_id"]: r for r in found.collect()}
    assert (rows["c0.1"]["graph_score"], rows["c1.1"]["graph_score"]) == (1.0, 0.5)
    assert rows["c0.1"]["entities"].count("Name 0 (PERSON)") == 7
