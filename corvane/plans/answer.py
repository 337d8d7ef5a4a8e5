"""Whole plans: answer a batch of questions in plain or graph mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import context as cx
from corvane.operators import graph as gr
from corvane.operators import questions as qs
from corvane.operators import retrieval as rt
from corvane.operators.communities import relevant_communities
from corvane.session import cut_lineage

Q = ["owner_id", "query_id"]


@dataclass
class KnowledgeBase:
    """The tables that answering reads."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    communities: DataFrame
    membership: DataFrame


@dataclass
class Answers:
    """Context text, ranked chunks and citations per question."""

    contexts: DataFrame
    chunks: DataFrame
    citations: DataFrame


def _chunk_sources(rows: DataFrame, source: str | None = None) -> DataFrame:
    return rows.select(
        *Q, "ref", F.lit(source).alias("source") if source else F.col("source"), "file_name",
        "file_id", "link", "page_estimate", "line_start", "line_end",
        F.substring("text", 1, 200).alias("snippet"))


def answer_plain(questions: DataFrame, kb: KnowledgeBase, top_k: int | None = None) -> Answers:
    """Vector and keyword retrieval, packed into one context."""
    found = cut_lineage(rt.retrieve(questions, kb.vectors, kb.chunks, top_k))
    contexts = cx.pack_context(found).select(*Q, F.col("text").alias("context"))
    empty = questions.select(*Q).join(contexts, Q, "left_anti").select(
        *Q, F.lit(cx.lx.EMPTY_CONTEXT).alias("context"))
    ranked = found.withColumn("score", F.col("combined_score")).withColumn(
        "source", F.lit("vector"))
    cited = cx.citations(_chunk_sources(ranked.withColumn("ref", F.col("rank"))))
    return Answers(contexts.unionByName(empty), ranked, cited)


def answer_graph(questions: DataFrame, kb: KnowledgeBase, top_k: int | None = None) -> Answers:
    """Classify, link, walk the graph, fuse with vector search, and assemble the sections."""
    params = cut_lineage(qs.query_params(qs.classify_questions(questions), top_k))
    linked = cut_lineage(gr.link_entities(params, kb.entities))
    kind = params.select(*Q, "query_type", "n", "alpha")

    paths, path_relations = gr.entity_paths(linked, kb.entities, kb.edges)
    path_relations = cut_lineage(path_relations)

    limit = F.when(F.col("query_type") == "factual", 1).otherwise(2)
    communities = relevant_communities(
        params, linked, kb.communities, kb.membership, kb.entities, 2
    ).join(kind, Q).filter(F.col("place") <= limit)
    # A factual question without linked entities gets no community.
    communities = communities.join(
        params.filter("query_type = 'factual'").select(*Q).join(linked, Q, "left_anti"),
        Q, "left_anti")

    capped = linked.join(kind, Q).withColumn(
        "row_limit", F.when(F.col("query_type") == "descriptive", 15).otherwise(40))
    facts = cut_lineage(gr.graph_facts(capped, kb.entities, kb.edges, kb.mentions, kb.documents))

    sized = linked.join(kind.withColumn("max_results", F.col("n") * 2), Q).drop(
        "query_type", "n", "alpha")
    hop1 = gr.graph_hop1(sized, kb.entities, kb.mentions, F.col("max_results"))
    hop2 = gr.graph_hop2(sized, kb.entities, kb.edges, kb.mentions, F.col("max_results"))
    graph = gr.graph_retrieve(hop1, hop2, kb.vectors)
    vector = rt.retrieve(params.withColumn("top_k", F.col("n") * 2), kb.vectors, kb.chunks)
    fused = rt.hybrid_fusion(vector.withColumn("score", F.col("combined_score")), graph, kind)
    ranked = cut_lineage(rt.candidate_columns(rt.protected_ranking(fused), kb.chunks))

    # Reference numbers run through the sections in the order of the question type.
    factual = F.col("query_type") == "factual"
    comm_params = params.withColumn("ref_start", F.lit(1))
    first_comm = cx.community_section(
        communities.join(params.filter(~factual).select(*Q), Q, "left_semi"), comm_params)
    vector_first = cx.vector_section(
        ranked.join(params.filter(factual).select(*Q, "vector_budget"), Q)
        .withColumn("ref_start", F.lit(1)))
    before = first_comm.select(*Q, "n_refs").unionByName(vector_first[0].select(*Q, "n_refs"))
    graph_params = params.join(before, Q, "left").withColumn(
        "ref_start", (F.coalesce("n_refs", F.lit(0)) + 1).cast("int"))
    facts_rel = cx.filter_relations(
        gr.fact_relations(facts).select(
            *Q, F.col("name").alias("from_name"), F.col("related_name").alias("to_name"),
            "rel_type", F.col("rel_desc").alias("description"), F.col("row_no").alias("at")),
        params)
    graph_text, graph_cites = cx.graph_section(path_relations, facts_rel, facts, graph_params)
    graph_text, graph_cites = cut_lineage(graph_text), cut_lineage(graph_cites)
    after = graph_params.select(*Q, "query_type", "vector_budget", "community_budget",
                                F.col("ref_start").alias("start")).join(
        graph_text.select(*Q, F.col("n_refs").alias("g")), Q, "left").withColumn(
        "ref_start", (F.col("start") + F.coalesce("g", F.lit(0))).cast("int"))
    last_comm = cx.community_section(
        communities.join(params.filter(factual).select(*Q), Q, "left_semi"), after)
    vector_last = cx.vector_section(
        ranked.join(after.filter(~factual).select(*Q, "vector_budget", "ref_start"), Q))

    comm = first_comm.unionByName(last_comm)
    entries = vector_first[1].unionByName(vector_last[1])
    sections = [
        (comm, "community"), (graph_text, "graph"),
        (vector_first[0].unionByName(vector_last[0]), "vector")]
    stacked = None
    for df, name in sections:
        part = df.select(*Q, F.lit(name).alias("section"), "text")
        stacked = part if stacked is None else stacked.unionByName(part)
    contexts = cx.fuse_sections(stacked, params)
    raw = (
        _chunk_sources(entries)
        .unionByName(graph_cites.drop("entry").withColumn("source", F.lit("graph")),
                     allowMissingColumns=True)
        .unionByName(comm.select(
            *Q, "ref", "file_name", F.lit("community").alias("source"),
            F.substring("summary", 1, 200).alias("summary_preview"), "member_count"),
            allowMissingColumns=True))
    return Answers(contexts, ranked.withColumn("score", F.col("combined_score")),
                   cx.citations(raw))
