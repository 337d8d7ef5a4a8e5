"""Vector search, rerank, fusion, context and citations over vectors and topic questions."""

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.operators import context as cx
from corvane.operators import graph as gr
from corvane.operators import questions as qs
from corvane.operators import retrieval as rt
from corvane.plans import answer as an
from workload import beds
from workload.registry import query
from workload.sqlparts import facts, norm_name, snippet


def tables(spark, sf):
    v = beds.vectors(spark, sf)
    return (beds.topic_questions(spark, sf), v.select("owner_id", "chunk_id", "embedding"),
            v.drop("embedding", "label", "mime_type"))


def retrieved(spark, sf, top_k=5, hits=None):
    q, v, c = tables(spark, sf)
    return rt.retrieve(q, v, c, top_k, hits=hits)


@beds.stored
def topic_hits(spark, sf):
    """The vector search of every topic question, once for all modes that start from it."""
    q, v, _ = tables(spark, sf)
    return rt.vector_topk(q, v, lx.MAX_CANDIDATES)


@query("vector_topk", facts("hits") + "select owner_id, query_id, chunk_id, round(cosine, 6) as "
       "cosine, round(greatest(0, 1 - (1 - cosine) / 2), 4) as score, cast(vec_rank as integer) as "
       "vec_rank from hits where vec_rank <= 15")
def vector_topk(spark, sf):
    q, v, _ = tables(spark, sf)
    return rt.vector_topk(q, v, 15).select(
        "owner_id", "query_id", "chunk_id", F.round("cosine", 6).alias("cosine"),
        rt.similarity("cosine").alias("score"), "vec_rank")


@query("vector_topk_blocks", facts("hits") + "select owner_id, query_id, chunk_id, "
       "cast(vec_rank as integer) as vec_rank from hits where vec_rank <= 15")
def vector_topk_blocks(spark, sf):
    """The same search by joined blocks, as for batches too large to travel to every task."""
    q, v, _ = tables(spark, sf)
    return rt.vector_topk(q, v, 15, max_local_queries=4, block_rows=16).drop("cosine")


@query("vector_topk_indexed", facts("hits") + "select owner_id, query_id, chunk_id, round(cosine, 6) as "
       "cosine, cast(vec_rank as integer) as vec_rank from hits where vec_rank <= 15")
def vector_topk_indexed(spark, sf):
    """The same search by an inverted file that skips lists too far away."""
    q, v, _ = tables(spark, sf)
    return rt.indexed_topk(q, rt.inverted_file(v), 15)[0].withColumn("cosine", F.round("cosine", 6))


@query("vector_scored_share")
def vector_scored_share(spark, sf):
    """Share of the owner's vectors that the indexed search reads, over all its questions."""
    q, v, _ = tables(spark, sf)
    probes = rt.indexed_topk(q, rt.inverted_file(v), 15)[1]
    return probes.groupBy("owner_id").agg(
        F.countDistinct("query_id").alias("questions"), F.sum("n").alias("pairs"),
        (F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)) / F.sum("n")).alias("scored_share"))


@query("keyword_score", facts("scored") + "select query_id, chunk_id, round(kw, 4) as keyword_score "
       "from scored where vec_rank <= 15")
def keyword_score(spark, sf):
    q, v, c = tables(spark, sf)
    hits = rt.vector_topk(q, v, 15).join(q.select("owner_id", "query_id", "question"),
                                         ["owner_id", "query_id"])
    return rt.with_keyword_score(rt.candidate_columns(hits, c)).select(
        "query_id", "chunk_id", F.round("keyword_score", 4).alias("keyword_score"))


@query("hybrid_scores", facts("reranked") + "select query_id, chunk_id, vector_score, keyword_score, "
       "combined_score from reranked where vec_rank <= 15")
def hybrid_scores(spark, sf):
    q, v, c = tables(spark, sf)
    hits = rt.vector_topk(q, v, 15).join(q.select("owner_id", "query_id", "question"),
                                         ["owner_id", "query_id"])
    rows = rt.candidate_columns(hits, c).withColumn("vector_score", rt.similarity("cosine"))
    return rt.hybrid_scores(rows).select("query_id", "chunk_id", "vector_score", "keyword_score",
                                         "combined_score")


@query("retrieve", facts("retrieved") + "select owner_id, query_id, chunk_id, file_name, "
       "vector_score, keyword_score, combined_score, cast(rank as integer) as rank from retrieved")
def retrieve(spark, sf):
    return retrieved(spark, sf).select("owner_id", "query_id", "chunk_id", "file_name",
                                       "vector_score", "keyword_score", "combined_score", "rank")


TG = "retrieved10 tg_linked tg_entities tg_mentions tg_edges"
TG_GRAPH = (
    ", h1 as (select l.owner_id, l.query_id, m.chunk_id, 1.0::double as score from tg_linked l join "
    "tg_entities e on l.owner_id = e.owner_id and l.name_norm = e.name_norm join (select *, "
    "row_number() over (partition by owner_id, entity_id order by chunk_id, file_id) as rn from "
    "tg_mentions) m on m.owner_id = e.owner_id and m.entity_id = e.entity_id where rn <= 20), bw as "
    "(select owner_id, src as node, dst as other, rel_type, 0 as back from tg_edges union all select "
    "owner_id, dst, src, rel_type, 1 from tg_edges), h2 as (select owner_id, query_id, chunk_id, "
    "0.5::double as score from (select l.owner_id, l.query_id, m.chunk_id, row_number() over "
    "(partition by l.owner_id, l.query_id, e.entity_id order by b.other, b.rel_type, b.back, "
    "m.chunk_id) as rn from tg_linked l join tg_entities e on l.owner_id = e.owner_id and "
    "l.name_norm = e.name_norm join bw b on b.owner_id = e.owner_id and b.node = e.entity_id join "
    "tg_mentions m on m.owner_id = b.owner_id and m.entity_id = b.other) where rn <= 10), s as "
    "(select owner_id, query_id, chunk_id, sum(score) as raw from (select * from h1 union all "
    "select * from h2) group by 1, 2, 3), gr as (select * from (select *, round(raw / best, 4) as g, "
    "row_number() over (partition by owner_id, query_id order by round(raw / best, 4) desc, id_no) "
    "as g_rank from (select *, max(raw) over (partition by owner_id, query_id) as best, "
    "row_number() over (partition by owner_id, query_id order by raw desc, chunk_id) as id_no "
    "from s) where id_no <= 20) where g_rank <= 10), fused as (select coalesce(v.owner_id, "
    "gr.owner_id) as owner_id, coalesce(v.query_id, gr.query_id) as query_id, coalesce(v.chunk_id, "
    "gr.chunk_id) as chunk_id, coalesce(combined_score, 0) as vector_score, coalesce(g, 0) as "
    "graph_score, v.rank as v_rank, g_rank, case when g is null then 'vector' when v.rank is null "
    "then 'graph' else 'hybrid' end as source from retrieved10 v full join gr on v.owner_id = "
    "gr.owner_id and v.query_id = gr.query_id and v.chunk_id = gr.chunk_id), comb as (select *, "
    "round(round(0.6 * vector_score + (1 - 0.6) * graph_score, 10), 4) as combined_score from fused) "
)


def fusion(spark, sf):
    q, v, c = tables(spark, sf)
    entities, mentions, edges = beds.topic_graph(spark, sf)
    linked = gr.link_entities(q, entities)
    graph = gr.graph_retrieve(gr.graph_hop1(linked, entities, mentions),
                              gr.graph_hop2(linked, entities, edges, mentions), v)
    vector = retrieved(spark, sf, 10, topic_hits(spark, sf)).withColumn("score", F.col("combined_score"))
    params = q.select("owner_id", "query_id", F.lit(0.6).alias("alpha"), F.lit(5).alias("n"))
    return rt.hybrid_fusion(vector, graph, params)


@query("hybrid_fusion", facts(TG) + TG_GRAPH + "select query_id, chunk_id, vector_score, graph_score, "
       "combined_score, source from comb")
def hybrid_fusion(spark, sf):
    return fusion(spark, sf).select("query_id", "chunk_id", "vector_score", "graph_score",
                                    "combined_score", "source")


#: The first five of the graph mode, vector hits in front.
TG_RANKED = (
    TG_GRAPH + ", ranked as (select query_id, chunk_id, source, cast(rn as integer) as rank from "
    "(select *, row_number() over (partition by owner_id, query_id order by case when v_rank <= 5 "
    "then 0 else 1 end, case when v_rank <= 5 then v_rank else 0 end, combined_score desc, "
    "coalesce(v_rank, 1000000 + g_rank)) as rn from comb) where rn <= 5) "
)


@query("protected_ranking", facts(TG) + TG_RANKED + "select query_id, chunk_id, source, rank from "
       "ranked")
def protected_ranking(spark, sf):
    return rt.protected_ranking(fusion(spark, sf)).select("query_id", "chunk_id", "source", "rank")


@query("pack_context", facts("retrieved") + ", e as (select owner_id, query_id, rank, '[' || rank || "
       "'] Nguồn: ' || file_name || ' (Trang 1, dòng 1)' || chr(10) || text as entry from retrieved), "
       "u as (select *, sum(length(entry)) over (partition by owner_id, query_id order by rank) as "
       "used from e), k as (select owner_id, query_id, rank, case when used <= 8000 then entry else "
       "substr(entry, 1, cast(8000 - (used - length(entry)) as bigint)) || '...[truncated]' end as "
       "entry from u where used <= 8000 or 8000 - (used - length(entry)) > 200) select query_id, "
       "string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as text, "
       "count(*) as n_refs from k group by 1")
def pack_context(spark, sf):
    return cx.pack_context(retrieved(spark, sf)).drop("owner_id")


@query("citations", facts("retrieved") + "select query_id, row_number() over (partition by query_id "
       "order by ref) as index, ref, file_name as label, 'Trang 1, dòng 1' as location, "
       + snippet("substr(text, 1, 200)", 120) + " as snippet, 'Tài liệu' as source_label from (select "
       "query_id, file_name, text, min(rank)::integer as ref from retrieved group by 1, 2, 3)")
def citations(spark, sf):
    rows = retrieved(spark, sf).select(
        "owner_id", "query_id", F.col("rank").alias("ref"), "file_name", "file_id", "link",
        "page_estimate", "line_start", "line_end", F.substring("text", 1, 200).alias("snippet"))
    return cx.citations(rows).select("query_id", "index", "ref", "label", "location", "snippet",
                                     "source_label")


@query("filter_relations", facts("topics tg_edges") + "select q.query_id, substr(src, "
       "length(q.owner_id) + 3) as from_name, substr(dst, length(q.owner_id) + 3) as to_name from "
       "topics q join tg_edges e on q.owner_id = e.owner_id where contains(lower(strip_accents("
       "question)), substr(src, length(q.owner_id) + 3)) or contains(lower(strip_accents(question)), "
       "substr(dst, length(q.owner_id) + 3)) or contains(lower(strip_accents(question)), 'type')")
def filter_relations(spark, sf):
    """Relations of the owner's topics that a question names."""
    q = beds.topic_questions(spark, sf).withColumn("query_type", F.lit("factual"))
    _, _, edges = beds.topic_graph(spark, sf)
    rel = edges.join(q.select("owner_id", "query_id"), "owner_id").select(
        "owner_id", "query_id",
        F.element_at(F.split("src", "__"), 2).alias("from_name"),
        F.element_at(F.split("dst", "__"), 2).alias("to_name"))
    return cx.filter_relations(rel, q).drop("owner_id")


@query("retrieve_all")
def retrieve_all(spark, sf):
    """Questions to contexts in graph mode, all sections fused."""
    return an.answer_graph(beds.topic_questions(spark, sf),
                           beds.topic_knowledge_base(spark, sf)).contexts


@query("retrieve_all_plain")
def retrieve_all_plain(spark, sf):
    return an.answer_plain(beds.topic_questions(spark, sf),
                           beds.topic_knowledge_base(spark, sf)).contexts
