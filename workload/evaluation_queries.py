"""Retrieval metrics, summaries, scores and indexing statistics.

Relevance is the label: a topic question expects every chunk of its label.
"""

from pyspark.sql import functions as F

from corvane.operators import evaluation as ev
from corvane.operators import retrieval as rt
from workload import beds
from workload.registry import query
from workload.retrieval_queries import TG, TG_RANKED, fusion, retrieved, topic_hits
from workload.sqlparts import facts


@beds.stored
def runs(spark, sf):
    """Two modes: reranked vector search, and its fusion with graph retrieval."""
    def of(ranked, mode):
        return ranked.select(F.col("query_id").alias("question_id"),
                             F.col("chunk_id").alias("chunk_key"), "rank", F.lit(mode).alias("mode"))

    return of(retrieved(spark, sf, hits=topic_hits(spark, sf)), "rag").unionByName(
        of(rt.protected_ranking(fusion(spark, sf)), "graph_rag"))


def parts(spark, sf):
    q = beds.topic_questions(spark, sf).select(
        F.col("query_id").alias("question_id"),
        F.when(F.col("label") < 5, "factual").when(F.col("label") < 8, "edge_case")
        .otherwise("combined").alias("category"),
        (F.col("label") == 9).alias("should_refuse"), (F.col("label") % 3).alias("human_score"),
        F.split("question", " ").alias("keywords"), "label")
    v = beds.vectors(spark, sf)
    expected = v.filter("label <> 8").select(
        F.concat_ws("_", "owner_id", "label").alias("question_id"),
        F.col("chunk_id").alias("chunk_key"))
    modes = F.explode(F.array(F.lit("rag"), F.lit("graph_rag"))).alias("mode")
    answers = q.select("question_id", modes, "label").select(
        "question_id", "mode", F.when(F.col("label") == 9, "Tôi không tìm thấy gì").otherwise(
            F.concat(F.lit("What is label_"), F.col("label"))).alias("answer"))
    return q, expected, answers


@beds.stored
def rows(spark, sf):
    q, expected, answers = parts(spark, sf)
    return ev.evaluate_questions(q, ["rag", "graph_rag"], runs(spark, sf), expected, answers)


METRICS = (
    TG_RANKED + ", modes(mode) as (values ('rag'), ('graph_rag')), runs as (select query_id as "
    "question_id, chunk_id, rank, 'rag' as mode from retrieved union all select query_id, chunk_id, "
    "rank, 'graph_rag' from ranked), ex as (select "
    "owner_id || '_' || label as question_id, chunk_id from vecs where label <> 8), m as (select "
    "q.query_id as question_id, mode, label, question, (select count(*) from ex where "
    "ex.question_id = q.query_id) as ec, (select count(*) from runs r join ex using (question_id, "
    "chunk_id) where r.question_id = q.query_id and r.mode = modes.mode and rank <= 5) as rel, "
    "(select min(rank) from runs r join ex using (question_id, chunk_id) where r.question_id = "
    "q.query_id and r.mode = modes.mode) as first from topics q, modes), e as (select question_id, "
    "mode, label, case when ec > 0 then (rel > 0)::integer end as hit_at_k, case when ec > 0 then "
    "round(rel / ec, 4) end as recall_at_k, case when ec > 0 then round(rel / 5, 4) end as "
    "precision_at_k, case when ec > 0 then round(coalesce(1 / first, 0), 4) end as mrr, rel as "
    "relevant_in_top_k, ec as expected_count, ec = 0 as skipped, case when label < 5 then 'factual' "
    "when label < 8 then 'edge_case' else 'combined' end as category, label % 3 as human_score, "
    "label = 9 as refused, case when label = 9 or label between 5 and 7 then label = 9 end as "
    "refusal_correct, round(len(list_filter(kw, lambda k: contains(case when label = 9 then "
    "'toi khong tim thay gi' else 'what is label_' || label end, k))) / len(kw), 4) as "
    "keyword_overlap from (select *, list_filter(string_split(strip_accents(lower(question)), ' '), "
    "lambda k: trim(k) <> '') as kw from m)) "
)
SUMMARY = (
    "count(*) as questions, count(*) filter (not skipped) as evaluated, round(avg(hit_at_k), 4) as "
    "hit_at_k, round(avg(recall_at_k), 4) as recall_at_k, round(avg(precision_at_k), 4) as "
    "precision_at_k, round(avg(mrr), 4) as mrr, cast(sum(human_score) as bigint) as "
    "human_score_total, count(human_score) * 2 as human_score_max, round(avg(human_score), 4) as "
    "human_score_avg, round(avg(keyword_overlap), 4) as keyword_overlap_avg, "
    "round(avg(refusal_correct::integer), 4) as refusal_accuracy, count(refusal_correct) as "
    "refusal_evaluated from e"
)


@query("retrieval_metrics", facts(f"retrieved vecs {TG}") + METRICS + "select question_id, mode, hit_at_k, "
       "recall_at_k, precision_at_k, mrr, relevant_in_top_k, expected_count, skipped from e")
def retrieval_metrics(spark, sf):
    q, expected, answers = parts(spark, sf)
    return ev.retrieval_metrics(runs(spark, sf), expected, answers)


@query("evaluate_questions", facts(f"retrieved vecs {TG}") + METRICS + "select question_id, mode, category, "
       "mrr, refused, refusal_correct, keyword_overlap from e")
def evaluate_questions(spark, sf):
    return rows(spark, sf).select("question_id", "mode", "category", "mrr", "refused",
                                  "refusal_correct", "keyword_overlap")


@query("summary_by_mode", facts(f"retrieved vecs {TG}") + METRICS + f"select mode, {SUMMARY} group by mode")
def summary_by_mode(spark, sf):
    return ev.summary_by_mode(rows(spark, sf))


@query("summary_by_category", facts(f"retrieved vecs {TG}") + METRICS + f"select category, mode, {SUMMARY} "
       "group by category, mode")
def summary_by_category(spark, sf):
    return ev.summary_by_category(rows(spark, sf))


@query("summaries", facts(f"retrieved vecs {TG}") + METRICS + f"select category, mode, {SUMMARY} group by "
       "grouping sets ((mode), (category, mode))")
def summaries(spark, sf):
    return ev.summaries(rows(spark, sf))


@query("category_table", facts(f"retrieved vecs {TG}") + METRICS + "select category, round(avg(mrr) filter "
       "(mode = 'rag'), 4) as rag, round(avg(mrr) filter (mode = 'graph_rag'), 4) as graph_rag from e "
       "group by 1")
def category_table(spark, sf):
    return ev.category_table(ev.summary_by_category(rows(spark, sf)), "mrr", ["rag", "graph_rag"])


def scored_answers(spark, sf):
    """Answers of the conversations, scored by the first words of the turn before."""
    from pyspark.sql import Window as W
    w = W.partitionBy("conv_id").orderBy("turn")
    c = beds.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text", F.lag("text").over(w).alias("asked"))
    a = c.filter("role = 'assistant' and asked is not null")
    return a.select(
        F.concat_ws("_", "conv_id", "turn").alias("question_id"),
        ev.auto_score("text", F.split("asked", " "), F.lit(False)).alias("score"))


SCORES = ("select conv_id || '_' || turn as question_id, case when r >= 1 then 2 when r >= 0.5 then 1 "
          "else 0 end as score from (select conv_id, turn, len(list_filter(string_split(strip_accents("
          "lower(asked)), ' '), lambda k: contains(t, k) or contains(t, replace(k, ',', '.')) or "
          "contains(t, replace(k, '.', ',')))) / len(string_split(asked, ' ')) as r from (select *, "
          "strip_accents(lower(text)) as t, lag(text) over (partition by conv_id order by turn) as "
          "asked from conversations) where role = 'assistant' and asked is not null)")


@query("auto_score", SCORES)
def auto_score(spark, sf):
    return scored_answers(spark, sf)


def label_scores(spark, sf):
    """Quality and (inverse) toxicity labels as the scores of two modes."""
    d = beds.files(spark, sf).select("file_id", "mime_type")
    lab = beds.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file_id"),
                                                 "quality", "toxic")
    modes = F.explode(F.array(
        F.struct(F.lit("rag").alias("mode"), (F.col("quality") * 2).alias("score")),
        F.struct(F.lit("graph_rag").alias("mode"), (1 - F.col("toxic")).alias("score")))).alias("s")
    return d.join(lab, "file_id").select(
        F.col("file_id").alias("question_id"), F.col("mime_type").alias("category"),
        (F.col("toxic") == 1).alias("should_refuse"), modes).select(
        "question_id", "category", "should_refuse", "s.*")


LABELLED = (", s as (select file_id, mime_type as category, quality * 2 as rag, 1 as graph_rag from "
            "files join labels on file_id = cast(doc_id as varchar) where toxic = 0) ")


@query("score_totals", facts("files") + LABELLED + "select 'rag' as mode, cast(sum(rag) as bigint) as "
       "score, count(*) * 2 as max_score, round(avg(rag), 2) as avg_score from s union all select "
       "'graph_rag', cast(sum(graph_rag) as bigint), count(*) * 2, round(avg(graph_rag), 2) from s")
def score_totals(spark, sf):
    return ev.score_totals(label_scores(spark, sf))


@query("score_report", facts("files") + LABELLED + "select category, cast(sum(rag) as bigint) as rag, "
       "cast(sum(graph_rag) as bigint) as graph_rag from s group by 1")
def score_report(spark, sf):
    return ev.score_report(label_scores(spark, sf), ["rag", "graph_rag"])


@query("score_table", facts("files") + LABELLED + "select file_id as question_id, category, max(rag) "
       "as rag, max(graph_rag) as graph_rag from s group by 1, 2")
def score_table(spark, sf):
    return ev.score_table(label_scores(spark, sf), ["rag", "graph_rag"])


@query("discover_chunks", facts("retrieved") + "select query_id, cast(rank as integer) as rank, "
       "chunk_id, combined_score as score, substr(text, 1, 160) as preview, rank = 1 as proposed "
       "from retrieved")
def discover_chunks(spark, sf):
    found = retrieved(spark, sf).withColumn("score", F.col("combined_score"))
    return ev.discover_chunks(found.drop("text"), beds.vectors(spark, sf)).drop("owner_id")


@query("indexing_stats", facts("g_documents g_chunks g_entities g_edges nation_comms") + "select * "
       "from (select owner_id, count(*) as file_count from g_documents group by 1) join (select "
       "owner_id, count(*) as chunk_nodes, count(*) as chunk_vectors from g_chunks group by 1) using "
       "(owner_id) join (select owner_id, count(*) as entity_nodes from g_entities group by 1) using "
       "(owner_id) join (select owner_id, count(*) as total_relations from g_edges group by 1) using "
       "(owner_id) join (select owner_id, count(*) as community_nodes from nation_comms group by 1) "
       "using (owner_id)")
def indexing_stats(spark, sf):
    c = beds.graph_chunks(spark, sf)
    return ev.indexing_stats(beds.graph_documents(spark, sf), c, c, beds.graph_entities(spark, sf),
                             beds.graph_edges(spark, sf), beds.nation_communities(spark, sf))


@query("mime_counts", facts("files") + "select owner_id, mime_type, count(*) as files from files group "
       "by grouping sets ((owner_id, mime_type), (owner_id), (mime_type))")
def mime_counts(spark, sf):
    return ev.mime_counts(beds.files(spark, sf))
