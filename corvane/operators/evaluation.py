"""Retrieval and answer metrics, their summaries, scores and indexing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.text import (
    is_refusal, keyword_overlap, let, matches_any, strip_accents, trim_blank,
)

KEY = ["question_id", "mode"]


def retrieval_metrics(results: DataFrame, expected: DataFrame, questions: DataFrame,
                      k: int = 5) -> DataFrame:
    """hit, recall, precision at k and reciprocal rank per question and mode.

    ``results(question_id, mode, rank, chunk_key)``, ``expected(question_id, chunk_key)``,
    ``questions(question_id, mode)`` lists what was asked, so that questions without results
    count. Precision divides by k. Nothing expected gives null metrics.
    """
    wanted = expected.filter(trim_blank("chunk_key") != "").select(
        "question_id", trim_blank("chunk_key").alias("chunk_key")).distinct()
    n = wanted.groupBy("question_id").agg(F.count("*").alias("expected_count"))
    hits = results.join(wanted, ["question_id", "chunk_key"], "left_semi").groupBy(*KEY).agg(
        F.count_if(F.col("rank") <= k).alias("relevant_in_top_k"),
        F.count_distinct(F.when(F.col("rank") <= k, F.col("chunk_key"))).alias("found"),
        F.min("rank").alias("first"))
    rows = questions.select(*KEY).join(n, "question_id", "left").join(hits, KEY, "left")
    zero = F.lit(0).cast("bigint")
    known = F.col("expected_count").isNotNull()

    def metric(value: Column) -> Column:
        return F.when(known, F.round(F.coalesce(value, F.lit(0.0)), 4))

    return rows.select(
        *KEY,
        F.when(known, (F.coalesce("relevant_in_top_k", zero) > 0).cast("int")).alias("hit_at_k"),
        metric(F.col("found") / F.col("expected_count")).alias("recall_at_k"),
        metric(F.col("relevant_in_top_k") / F.lit(k)).alias("precision_at_k"),
        metric(1 / F.col("first")).alias("mrr"),
        F.coalesce("relevant_in_top_k", zero).alias("relevant_in_top_k"),
        F.coalesce("expected_count", zero).alias("expected_count"),
        (~known).alias("skipped"))


def evaluate_questions(questions: DataFrame, modes: list[str], results: DataFrame,
                       expected: DataFrame, answers: DataFrame | None = None,
                       k: int = 5) -> DataFrame:
    """One row per question and mode with retrieval metrics and, given answers, answer checks.

    Refusing is right when it was asked for, and for edge cases that do expect chunks.
    """
    asked = questions.select("*", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    rows = asked.join(retrieval_metrics(results, expected, asked, k), KEY)
    if answers is None:
        return rows
    told = rows.join(answers.select(*KEY, "answer"), KEY, "left")
    refused = is_refusal("answer")
    asked_refusal = F.coalesce("should_refuse", F.lit(False)) | (
        (F.col("category") == "edge_case") & (F.col("expected_count") > 0))
    return told.withColumn("refused", refused).withColumn(
        "refusal_correct", F.when(asked_refusal, F.col("refused"))).withColumn(
        "keyword_overlap", keyword_overlap("answer", "keywords"))


def _summary_columns() -> list[Column]:
    def mean(c: str) -> Column:
        return F.round(F.avg(c), 4).alias(c)

    scored = F.count("human_score")
    return [
        F.count("*").alias("questions"),
        F.count_if(~F.col("skipped")).alias("evaluated"),
        *[mean(c) for c in ("hit_at_k", "recall_at_k", "precision_at_k", "mrr")],
        F.sum("human_score").cast("bigint").alias("human_score_total"),
        F.when(scored > 0, scored * 2).alias("human_score_max"),
        F.round(F.avg("human_score"), 4).alias("human_score_avg"),
        F.round(F.avg("keyword_overlap"), 4).alias("keyword_overlap_avg"),
        F.round(F.avg(F.col("refusal_correct").cast("int")), 4).alias("refusal_accuracy"),
        F.count("refusal_correct").alias("refusal_evaluated"),
    ]


def summary_by_mode(rows: DataFrame) -> DataFrame:
    """Means over what was evaluated, per mode; nulls do not count."""
    return rows.groupBy("mode").agg(*_summary_columns())


def summary_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "mode").agg(*_summary_columns())


def summaries(rows: DataFrame) -> DataFrame:
    """Both summaries in one pass; the rows over all categories have category null."""
    return rows.groupingSets([["mode"], ["category", "mode"]], "category", "mode").agg(
        *_summary_columns())


def category_table(by_category: DataFrame, value: str, modes: list[str]) -> DataFrame:
    """One row per category with a column per mode."""
    return by_category.groupBy("category").pivot("mode", modes).agg(F.first(value))


def auto_score(answer: Column | str, keywords: Column | str, should_refuse: Column | str) -> Column:
    """2, 1 or 0 by the share of keywords found; a refusal is 2 only where it was expected.

    A keyword also counts with its decimal comma and point exchanged.
    """
    def column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    words = F.coalesce(column(keywords), F.array().cast("array<string>"))
    folded = F.transform(words, lambda k: strip_accents(F.lower(k)))

    def score(text: Column) -> Column:
        found = F.filter(folded, lambda k: (
            F.contains(text, k) | F.contains(text, F.replace(k, F.lit(","), F.lit(".")))
            | F.contains(text, F.replace(k, F.lit("."), F.lit(",")))))
        ratio = F.size(found) / F.nullif(F.size(words), F.lit(0))
        return (
            F.when(trim_blank(text) == "", 0)
            .when(matches_any(text, lx.AUTO_SCORE_REFUSALS),
                  F.when(column(should_refuse), 2).otherwise(0))
            .when(ratio >= 1.0, 2).when(ratio >= 0.5, 1).otherwise(0)
        )

    return let(strip_accents(F.lower(F.coalesce(column(answer), F.lit("")))), score)


def _scored(scores: DataFrame, overrides: DataFrame | None) -> DataFrame:
    rows = scores.filter(~F.col("should_refuse"))
    if overrides is None:
        return rows
    manual = overrides.select(*KEY, F.col("score").alias("_manual"))
    return rows.join(manual, KEY, "left").withColumn(
        "score", F.coalesce("_manual", "score")).drop("_manual")


def score_totals(scores: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Total, maximum and mean score per mode; refusal questions are left out."""
    return _scored(scores, overrides).groupBy("mode").agg(
        F.sum("score").cast("bigint").alias("score"), (F.count("score") * 2).alias("max_score"),
        F.round(F.avg("score"), 2).alias("avg_score"))


def score_report(scores: DataFrame, modes: list[str], overrides: DataFrame | None = None
                 ) -> DataFrame:
    """Sums by category, one column per mode."""
    rows = _scored(scores, overrides)
    return rows.groupBy("category").pivot("mode", modes).agg(F.sum("score").cast("bigint"))


def score_table(scores: DataFrame, modes: list[str], overrides: DataFrame | None = None
                ) -> DataFrame:
    """Scores of each question, one column per mode."""
    rows = _scored(scores, overrides)
    return rows.groupBy("question_id", "category").pivot("mode", modes).agg(F.max("score"))


def discover_chunks(results: DataFrame, chunks: DataFrame, top: int = 5, width: int = 160
                    ) -> DataFrame:
    """Preview of the best chunks per question; the first one may become the expected chunk."""
    best = results.filter(F.col("rank") <= top)
    text = chunks.select("owner_id", "chunk_id", F.substring("text", 1, width).alias("preview"))
    return best.join(text, ["owner_id", "chunk_id"]).select(
        "owner_id", "query_id", "rank", "chunk_id", "score", "preview",
        (F.col("rank") == 1).alias("proposed"))


def indexing_stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame,
                   entities: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Files, chunks, vectors, nodes and relations per owner."""
    def per_owner(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("owner_id").agg(F.count("*").alias(name))

    out = per_owner(documents, "file_count")
    parts = {"chunk_nodes": chunks, "chunk_vectors": vectors, "entity_nodes": entities,
             "total_relations": edges, "community_nodes": communities}
    for name, df in parts.items():
        out = out.join(per_owner(df, name), "owner_id", "full_outer")
    return out.select("owner_id", *[F.coalesce(c, F.lit(0)).alias(c)
                                    for c in ("file_count", *parts)])


def mime_counts(documents: DataFrame) -> DataFrame:
    """Documents by owner and MIME type, with the totals of each in the same pass."""
    return documents.groupingSets(
        [["owner_id", "mime_type"], ["owner_id"], ["mime_type"]], "owner_id", "mime_type").agg(
        F.count("*").alias("files"))
