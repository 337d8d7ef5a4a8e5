import re

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import canonical as cn
from corvane.operators import chunking as ck
from corvane.operators import communities as cm
from corvane.operators import context as cx
from corvane.operators import evaluation as ev
from corvane.operators import graph as gr
from corvane.operators import retrieval as rt


def plain_chunks(text, size=512, overlap=50):
    """Straight restatement of the packing rule."""
    limit, done, held, n = max(size // 2, 200), [], [], 0
    blocks = [p.strip() for p in re.split(r"\n{2,}", text.replace("\r\n", "\n")) if p.strip()]
    for block in blocks:
        pieces = [block] if len(block) <= size else [
            s.strip() for part in re.split(r"(?<=[.!?])\s+", block) for s in part.split("\n")
            if s.strip()]
        for piece in pieces:
            for full in (lambda: n >= limit, lambda: n + len(piece) + 1 > size):
                if held and full():
                    done.append(" ".join(held))
                    held = [done[-1][-overlap:]]
                    n = len(held[0])
            held.append(piece)
            n += len(piece) + 1
    return done + ([" ".join(held)] if held else [])


def test_chunking_matches_rule(spark):
    texts = ["", "short", "a" * 300 + "\r\n\r\n" + "b" * 480, "One. Two! " * 200,
             "x" * 900, "para\n\n" * 3, "[Trang 1]\nfoo bar.\n\n[Trang 2]\n" + "baz. " * 150]
    df = spark.createDataFrame([("o", str(i), t) for i, t in enumerate(texts)],
                               "owner_id string, file_id string, text string")
    rows = ck.chunk_documents(df).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.file_id == str(i)), key=lambda r: r.chunk_index)
        assert [r.text for r in mine] == plain_chunks(text)
        starts = [r.char_start for r in mine]
        assert starts == sorted(set(starts))
    assert [len(c) for c in plain_chunks(texts[2])] == [300, 50, 531]
    assert max(r.page_estimate for r in rows if r.file_id == "6") == 2
    dropped = df.select(ck.chunk_texts("text", drop_overlap_only=True).alias("c"), "file_id")
    assert [len(c) for c in dropped.filter("file_id = '2'").first()["c"]] == [300, 531]


def brute_leaders(names, threshold=85):
    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(a) + len(b))

    leaders, out = [], {}
    for n in names:
        s = " ".join(sorted(n.split(" ")))
        best = None
        for lead, sorted_lead in leaders if len(n) >= 4 else []:
            if len(lead) >= 4:
                r = round(ratio(sorted_lead, s))
                if r >= threshold and (best is None or r > best[1]):
                    best = (lead, r)
        if best is None:
            leaders.append((n, s))
        out[n] = best[0] if best else n
    return out


def test_fuzzy_leaders_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["nguyen van an", "tran thi binh", "red widget large", "acme corporation", "blue ring",
            "le dinh khoi", "small anvil", "kien duc thinh"]
    names = []
    for b in base:
        names.append(b)
        for _ in range(6):
            i = int(rng.integers(0, len(b)))
            names.append(b[:i] + rng.choice(list("abx ")) + b[i + 1:])
        names.append(" ".join(reversed(b.split(" "))))
    names = [n for n in dict.fromkeys(re.sub(" +", " ", x).strip() for x in names)]
    rng.shuffle(names)
    df = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)], "g string, id string, pos int")
    got = cn.fuzzy_leaders(df.withColumn("text", cn.token_sorted("id")), ["g"]).collect()
    assert {r["id"]: r["leader_id"] for r in got} == brute_leaders(names)


def test_titles_merge_to_one_person(spark):
    rows = [("o", "f", "c1", 1, "KIẾN ĐỨC THỊNH", "ORGANIZATION", "", ""),
            ("o", "f", "c2", 2, "Ông KIẾN ĐỨC THỊNH", "PERSON", "", "long text"),
            ("o", "f", "c2", 3, "tôi", "PERSON", "", ""), ("o", "f", "c3", 4, "Sai Gon", "CITY", "", "")]
    m = spark.createDataFrame(rows, "owner_id string, file_id string, chunk_id string, ord int, "
                              "raw_name string, raw_type string, subtype string, description string")
    for parts in (1, 3):
        r = cn.resolve_entities(m.repartition(parts), cn.alias_table(spark), fuzzy=True)
        out = {x["name"]: x for x in cn.merge_mentions(r).collect()}
        assert set(out) == {"KIẾN ĐỨC THỊNH", "TP. Hồ Chí Minh"}
        assert out["KIẾN ĐỨC THỊNH"]["type"] == "PERSON"
        assert out["KIẾN ĐỨC THỊNH"]["description"] == "long text"


def test_edge_weights(spark):
    kinds = ["COOCCURS_WITH", "WORKS_FOR", "RELATED_TO", "MENTIONS", "CONTAINS", "NEXT"]
    df = spark.createDataFrame([(k,) for k in kinds], ["t"])
    assert [r["w"] for r in df.select(cm.edge_weight("t").alias("w")).collect()] == [
        1.0, 2.5, 2.0, 2.0, 2.0, 2.0]


def test_nearest_relation(spark):
    canon = spark.createDataFrame([("LEADS_TO", [1.0, 0.0]), ("OWNS", [0.0, 1.0])],
                                  ["rel_type", "embedding"])
    asked = spark.createDataFrame([("brings about", [1.0, 0.0]), ("zero", [0.0, 0.0])],
                                  ["key", "embedding"])
    got = {r["key"]: r["rel_type"] for r in cn.nearest_relation(asked, canon, 0.9).collect()}
    assert got == {"brings about": "LEADS_TO", "zero": "RELATED_TO"}


def test_pairs_survive_blocks(spark):
    rows = [("o", "c", f"e{i:03d}") for i in range(40)] + [("o", "d", "e000"), ("o", "d", "e001")]
    m = spark.createDataFrame(rows, "owner_id string, chunk_id string, entity_id string")
    want = {tuple(r) for r in gr.cooccurrence_edges(m).select("src", "dst", "chunks").collect()}
    got = {tuple(r) for r in gr.cooccurrence_edges(m, block=7).select("src", "dst", "chunks").collect()}
    assert want == got and len(got) == 780 and ("e000", "e001", 2) in got


def test_paths_prefer_telling_edges(spark):
    e = spark.createDataFrame(
        [("o", "a", "b", "OWNS", ""), ("o", "c", "b", "PART_OF", "x"), ("o", "a", "c", "COOCCURS_WITH", ""),
         ("o", "c", "z", "COOCCURS_WITH", "")],
        "owner_id string, src string, dst string, rel_type string, description string")
    pairs = spark.createDataFrame([("o", "a", "c"), ("o", "a", "z"), ("o", "a", "q")],
                                  "owner_id string, a string, b string")
    got = {r["b"]: (r["hops"], r["nodes"], r["semantic"]) for r in gr.shortest_paths(pairs, e).collect()}
    assert got == {"c": (2, ["a", "b", "c"], True), "z": (2, ["a", "c", "z"], False)}


def test_louvain_and_small_communities(spark):
    edges = []
    for g in range(4):
        names = [f"n{g}{i}" for i in range(6)]
        edges += [("o", a, b, 2.0) for a in names for b in names if a < b]
    edges += [("o", f"n{g}0", f"n{g + 1}0", 1.0) for g in range(3)] + [("o", "lone", "n00", 3.0)]
    g = spark.createDataFrame(edges, "owner_id string, a string, b string, weight double").cache()
    m = cm.louvain(g)
    groups = {}
    for r in m.collect():
        groups.setdefault(r["comm"], set()).add(r["node"][:2])
    assert sorted(map(sorted, groups.values())) == [["lo", "n0"], ["n1"], ["n2"], ["n3"]]
    single = g.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        F.lit("o").alias("owner_id"), "node",
        F.when(F.col("node") == "lone", "lone").otherwise(F.substring("node", 1, 2)).alias("comm"))
    merged = {r["node"]: r["comm"] for r in cm.merge_small_communities(single, g).collect()}
    assert merged["lone"] == "n0" and len(set(merged.values())) == 4


def test_metrics(spark):
    keys = ["wrong__chunk_0", "good__chunk_1", "good__chunk_2", "other__chunk_0"]
    res = spark.createDataFrame([("q", "rag", i + 1, k) for i, k in enumerate(keys)],
                                "question_id string, mode string, rank int, chunk_key string")
    exp = spark.createDataFrame([("q", "good__chunk_1"), ("q", "good__chunk_2")],
                                "question_id string, chunk_key string")
    asked = spark.createDataFrame([("q", "rag"), ("none", "rag")], "question_id string, mode string")
    rows = {r["question_id"]: r for r in ev.retrieval_metrics(res, exp, asked, 3).collect()}
    assert (rows["q"]["hit_at_k"], rows["q"]["recall_at_k"], rows["q"]["precision_at_k"],
            rows["q"]["mrr"]) == (1, 1.0, 0.6667, 0.5)
    assert rows["none"]["skipped"] and rows["none"]["mrr"] is None


def test_citations(spark):
    row = ("o", "q", "HopDong.pdf", "fid1", "3", "12", "15", "https://x/view")
    df = spark.createDataFrame(
        [(*row, 1), (*row, 2), ("o", "q", "b.pdf", "fid2", "", "5", "8", "", 3)],
        "owner_id string, query_id string, file_name string, file_id string, page_estimate string, "
        "line_start string, line_end string, link string, ref int")
    out = sorted(cx.citations(df).collect(), key=lambda r: r["index"])
    assert [r["location"] for r in out] == ["Trang 3, dòng 12–15", "dòng 5–8"]
    assert out[0]["location_link"] == "https://x/preview#page=3" and out[1]["index"] == 2


def test_both_vector_searches_agree(spark):
    rng = np.random.default_rng(1)
    vec = [("o" if i % 3 else "p", f"c{i:03d}", rng.normal(size=8).tolist()) for i in range(60)]
    vec += [("o", f"d{i:03d}", vec[1][2]) for i in range(30)]
    v = spark.createDataFrame(vec, "owner_id string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("o", f"q{i}", rng.normal(size=8).tolist()) for i in range(9)]
                              + [("p", "r", rng.normal(size=8).tolist()), ("o", "same", vec[1][2])],
                              "owner_id string, query_id string, embedding array<double>")
    def pull(df):
        return {(r["query_id"], r["vec_rank"]): r["chunk_id"] for r in df.collect()}
    near, far = rt.vector_topk(q, v, 7), rt.vector_topk(q, v, 7, max_local_queries=2, block_rows=11)
    assert pull(near) == pull(far) and len(pull(near)) == 77


def test_slices_of_batches():
    """Runs of rows are cut by the bytes of their texts; every row is in exactly one run."""
    import pyarrow as pa

    from corvane.operators.chunking import slices

    for texts in (pa.array(["a" * 6, None, "bb", "c" * 30, "", "d"]),
                  pa.array([["a" * 6], [], ["b", "b"], ["c" * 30], None, ["d"]], pa.list_(pa.string()))):
        runs = list(slices(texts, 10))
        assert [k for begin, n in runs for k in range(begin, begin + n)] == list(range(6))
        assert runs == [(0, 3), (3, 3)]
    assert list(slices(pa.array([], pa.string()))) == []
