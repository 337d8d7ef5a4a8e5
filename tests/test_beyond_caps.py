"""Results beyond the sizes at which earlier versions cut rows, columns or letters."""

import unicodedata

from pyspark.sql import functions as F

from corvane.functions.text import fold_compat, normalize_name
from corvane.operators import graph as gr
from corvane.operators.communities import relevant_communities
from corvane.sources.files import csv_lines_to_text, read_csv_files

EDGE = "owner_id string, src string, dst string, rel_type string, description string"
ENTITY = "owner_id string, entity_id string, name string, name_norm string, type string, description string"
MENTION = "owner_id string, file_id string, chunk_id string, entity_id string"


def test_compatibility_letters(spark):
    words = ["Ⅱ", "㎏", "𝐀", "ﬁne", "한글 값", "ﷺ", "½ cup", "™", "plain", "Ǆ", "①", "각"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        fold_compat("w")).collect()]
    assert got == ["".join(x for x in unicodedata.normalize("NFKD", w)
                           if unicodedata.category(x) != "Mn") for w in words]
    names = spark.createDataFrame([("Ⅱ ㎏ 𝐀",)], "w string").select(normalize_name("w")).first()[0]
    assert names == "ii kg A"  # lower case comes before folding


def test_csv_has_no_column_limit(spark, tmp_path):
    line = ",".join(f"v{i}" for i in range(70))
    rows = spark.createDataFrame([("f", 1, line), ("f", 2, ",,"), ("f", 3, 'a,"b ""c"", d",')],
                                 "file_id string, row_no int, line string")
    assert csv_lines_to_text(rows).first()["text"] == line.replace(",", "\t") + '\na\tb "c", d\t'
    (tmp_path / "x.csv").write_text(line + '\r\n\r\n"two\nlines",5" pipe\r\n,,\r\n')
    assert read_csv_files(spark, str(tmp_path)).first()["text"] == (
        line.replace(",", "\t") + '\ntwo\nlines\t5" pipe')


def star(spark, n):
    """One linked entity with n neighbours, and n chunks that mention each."""
    entities = spark.createDataFrame(
        [("o", f"e{i:03}", f"E{i}", f"e{i}", "CONCEPT", "") for i in range(n + 1)], ENTITY)
    edges = spark.createDataFrame(
        [("o", "e000", f"e{i:03}", "USES", "") for i in range(1, n + 1)], EDGE)
    mentions = spark.createDataFrame(
        [("o", "f", f"c{i:03}_{j}", f"e{i:03}") for i in range(n + 1) for j in range(2)]
        + [("o", "f", f"d{i:03}", "e000") for i in range(n)], MENTION)
    linked = spark.createDataFrame([("o", "q", "e0", 1)],
                                   "owner_id string, query_id string, name_norm string, place int")
    documents = spark.createDataFrame([("o", "f", "f.txt", "l")],
                                      "owner_id string, file_id string, file_name string, link string")
    return linked, entities, edges, mentions, documents


def test_hops_follow_the_limit(spark):
    linked, entities, edges, mentions, _ = star(spark, 60)
    assert gr.graph_hop1(linked, entities, mentions, 20).count() == 40
    assert gr.graph_hop2(linked, entities, edges, mentions, 20).count() == 20
    sized = linked.withColumn("n", F.lit(30))
    assert gr.graph_hop1(sized, entities, mentions, F.col("n")).count() == 60
    assert gr.graph_hop2(sized, entities, edges, mentions, F.col("n")).count() == 30


def test_facts_follow_the_limit(spark):
    linked, entities, edges, mentions, documents = star(spark, 60)
    args = entities, edges, mentions, documents
    assert gr.graph_facts(linked, *args, limit=100).count() == 100
    rows = gr.graph_facts(linked.withColumn("row_limit", F.lit(150)), *args).orderBy("row_no")
    found = [(r["related_name"], r["chunk_id"]) for r in rows.collect()]
    chunks = sorted([f"c000_{j}" for j in range(2)] + [f"d{i:03}" for i in range(60)])
    related = sorted((f"e{i}", f"E{i}") for i in range(1, 61))
    assert found == [(name, c) for _, name in related for c in chunks][:150]


def test_largest_communities_follow_the_limit(spark):
    communities = spark.createDataFrame([("o", f"c{i}", 10 + i, "quiet") for i in range(6)],
                                        "owner_id string, comm string, member_count long, summary string")
    membership = spark.createDataFrame([("o", "x", "c0")], "owner_id string, node string, comm string")
    entities = spark.createDataFrame([("o", "x", "Hoa Kỳ", "hoa ky", "PLACE", "")], ENTITY)
    none = spark.createDataFrame([], "owner_id string, query_id string, name_norm string, place int")
    asked = spark.createDataFrame([("o", "q1", "zebra"), ("o", "q2", "tell about usa")],
                                  "owner_id string, query_id string, question string")
    found = relevant_communities(asked, none, communities, membership, entities, 5)
    assert found.filter("query_id = 'q1'").count() == 5
    best = found.filter("query_id = 'q2' and place = 1").first()
    assert best["comm"] == "c0" and best["overlap"] == 1
