"""Model outputs in both forms, relations of the ontology, and names of one sentence."""

import json

from corvane.operators import canonical as cn
from corvane.operators import extraction as ex

WHERE = "owner_id string, file_id string, chunk_id string"


def test_single_and_batch_outputs(spark):
    entity = {"name": " A ", "label": "PERSON"}
    relation = {"source": "A", "target": "B", "type": "works for", "description": "d"}
    one = json.dumps({"entities": [entity], "relations": [relation]})
    many = json.dumps({"chunks": [{"chunk_index": 4, "entities": [entity], "relations": [relation]},
                                  {"chunk_index": 9, "entities": [entity]}]})
    rows = [("o", "one", f"```json\n{one}\n```", [7]), ("o", "many", many, [4, 5]), ("o", "bad", one[:20], [1]),
            ("o", "none", "{}", [1])]
    outputs = spark.createDataFrame(rows, "owner_id string, file_id string, output string, chunk_indexes array<int>")
    expected = spark.createDataFrame([("o", "one", 7), ("o", "many", 4)],
                                     "owner_id string, file_id string, chunk_index int")
    entities, relations = ex.parse_extraction(outputs, expected)
    assert sorted((r["file_id"], r["chunk_index"], r["raw_name"], r["raw_type"]) for r in entities.collect()) == [
        ("many", 4, "A", "PERSON"), ("one", 7, "A", "PERSON")]
    assert sorted(tuple(r) for r in relations.collect()) == [
        ("o", "many", 4, 0, "A", "B", "works for", "d"), ("o", "one", 7, 0, "A", "B", "works for", "d")]
    assert ex.parse_extraction(outputs.drop("chunk_indexes"))[0].filter("file_id = 'one'").first()["chunk_index"] == 0


def test_unknown_relations_become_canonical(spark):
    rows = spark.createDataFrame([("a", "FROBNICATES"), ("b", "WORKS_FOR"), ("c", "EMPLOYED_NEAR")],
                                 "src string, rel_type string")
    plain = {r["src"]: r["rel_type"] for r in cn.canonical_relations(rows).collect()}
    assert plain == {"a": "RELATED_TO", "b": "WORKS_FOR", "c": "RELATED_TO"}
    vectors = "rel_type string, embedding array<double>"
    canonical = spark.createDataFrame([("WORKS_FOR", [1.0, 0.0]), ("USES", [0.0, 1.0])], vectors)
    keys = spark.createDataFrame([("EMPLOYED_NEAR", [0.9, 0.1]), ("FROBNICATES", [-1.0, 0.2])], vectors)
    near = {r["src"]: r["rel_type"] for r in cn.canonical_relations(rows, canonical, keys).collect()}
    assert near == {"a": "RELATED_TO", "b": "WORKS_FOR", "c": "WORKS_FOR"}


def test_names_of_one_sentence(spark):
    chunks = spark.createDataFrame([("o", "f", "c", "Ann Lee met Bob Ray. Cy Dan was out.\nBob Ray saw Ann Lee")],
                                   WHERE + ", text string")
    mentions = ex.extract_mentions(chunks)
    got = [(r["from_raw"], r["to_raw"], r["rel_ord"]) for r in
           ex.comention_relations(chunks, mentions).orderBy("rel_ord").collect()]
    assert got == [("Ann Lee", "Bob Ray", 0), ("Bob Ray", "Ann Lee", 1)]


def test_all_names_of_a_long_list_are_linked(spark):
    names = [f"Nam{chr(97 + i // 26)}{chr(97 + i % 26)} Xo" for i in range(90)]
    text = ", ".join([*names, names[3]])
    chunks = spark.createDataFrame([("o", "f", "c", text)], WHERE + ", text string")
    mentions = spark.createDataFrame([("o", "f", "c", n) for n in names], WHERE + ", raw_name string")
    rows = ex.comention_relations(chunks, mentions, block=16).collect()
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    want |= {(a, names[3]) for a in names if a != names[3]}
    assert {(r["from_raw"], r["to_raw"]) for r in rows} == want and len(rows) == len(want)
    rows.sort(key=lambda r: (text.index(r["from_raw"]), r["to_raw"]))
    assert [r["rel_ord"] for r in rows] == list(range(len(want)))


def test_gazetteer_names_of_any_length(spark):
    words = "aa bb cc dd ee ff gg hh ii jj kk ll".split()
    names = [" ".join(words[:n]) for n in range(1, 13)] + ["university of economics and law", "law", "", None,
                                                           "bb", "cc dd", "dd cc", "of economics"]
    texts = {"1": "He left the University of Economics and Law.", "2": " ".join(words) + " dd", "3": "", "4": None,
             "5": "xaa bb", "6": "aa bb cc xdd", "7": "Law", "8": "aa  bb\ncc-dd"}
    chunks = spark.createDataFrame([("o", "f", k, t) for k, t in texts.items()], WHERE + ", text string")
    gazetteer = spark.createDataFrame([(n, n, "T") for n in [*names, "law"]],
                                      "name_norm string, name string, type string")

    def plain(text):
        spaced = f" {' '.join((text or '').lower().replace('.', ' ').replace('-', ' ').split())} "
        return {n for n in names if n and f" {n} " in spaced}

    want = sorted((k, n) for k, t in texts.items() for n in plain(t))
    for letters in (ex.AUTOMATON_LETTERS, 0):
        got = ex.gazetteer_matches(chunks, gazetteer, letters)
        assert sorted((r["chunk_id"], r["name_norm"]) for r in got.collect()) == want
    found = {r["raw_name"] for r in ex.extract_mentions(chunks, gazetteer).filter("raw_type = 'T'").collect()}
    assert "university of economics and law" in found and " ".join(words) in found


def test_relations_are_rewritten_after_one_shuffle(spark):
    from corvane.operators import canonical as cn
    names = spark.sql(
        "select 'o' as owner_id, 'f' as file_id, c as chunk_id, ord, raw_name, trim(raw_name) as name, "
        "lower(trim(raw_name)) as name_norm from values ('c1', 1, 'Ann'), ('c1', 2, ' Bob'), ('c1', 3, 'ANN'), "
        "('c2', 4, 'Bob') t(c, ord, raw_name)")
    told = spark.sql(
        "select 'o' as owner_id, 'f' as file_id, c as chunk_id, n as rel_ord, a as from_raw, b as to_raw, "
        "'works for' as relation_raw, 'd' as description from values ('c1', 1, 'ann', 'BOB'), "
        "('c1', 2, 'Ann', 'ANN'), ('c2', 3, 'Ann', 'Bob'), ('c1', 4, ' ', 'Bob'), ('c1', 5, 'Bob', 'Ann') "
        "t(c, n, a, b)")
    out = cn.rewrite_relations(told, names)
    got = {(r["rel_ord"], r["src"], r["dst"]) for r in out.collect()}
    assert got == {(1, "o__ann", "o__bob"), (5, "o__bob", "o__ann")}
    counted = out.groupBy("owner_id", "chunk_id", "src", "dst").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
