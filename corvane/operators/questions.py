"""Question classification, parameters, inventory answers, chat history and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.text import (
    count_matches, fold_patterns, lookup, matches_any, normalize_name, split_words, trim_blank,
)
from corvane.operators.graph import first_per


def entity_hints(question: Column | str) -> Column:
    """Telling words of a question: one point for five letters or more, one for an alias."""
    words = F.filter(split_words(normalize_name(question), 3),
                     lambda w: ~w.isin(lx.QUESTION_STOPWORDS))
    names = {a: d for a, d in reversed(lx.NAME_ALIASES)}
    names.update({a.replace(" ", ""): d for a, d in reversed(lx.NAME_ALIASES)
                  if a.replace(" ", "") not in names})
    changed = {a: d for a, d in names.items() if " " not in a and d.lower() != a}
    points = F.transform(words, lambda w: F.when(F.length(w) >= 5, 1).otherwise(0)
                         + F.when(w.isin(list(changed)), 1).otherwise(0))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x)


def classify_questions(questions: DataFrame, normalize_patterns: bool = False) -> DataFrame:
    """Type, scores and confidence of each question.

    Patterns meet text without accents, so those written with accents never match unless
    ``normalize_patterns`` folds them too.
    """
    def prepared(patterns: list[str]) -> list[str]:
        return fold_patterns(patterns) if normalize_patterns else patterns

    scored = questions.withColumn("_norm", normalize_name("question")).withColumn(
        "entity_hint_count", entity_hints("question")).withColumn(
        "factual_score", count_matches(F.col("_norm"), prepared(lx.FACTUAL_PATTERNS))
        + F.when(F.col("entity_hint_count") >= 1, 1).otherwise(0)).withColumn(
        "descriptive_score", count_matches(F.col("_norm"), prepared(lx.DESCRIPTIVE_PATTERNS)))
    f, d = F.col("factual_score"), F.col("descriptive_score")
    gap = F.abs(f - d)
    kind = (
        F.when((f >= 2) & (d >= 2), "combined")
        .when((gap <= 1) & (f >= 1) & (d >= 1), "combined")
        .when((d >= 2) & (f <= 1), "descriptive")
        .when(f > d, "factual").when(d > f, "descriptive").otherwise("combined")
    )
    confidence = F.least(F.lit(1.0), gap / F.greatest(f + d, F.lit(1)) + 0.3)
    return scored.withColumn("query_type", kind).withColumn(
        "confidence", F.round(confidence, 3)).drop("_norm")


def query_params(classified: DataFrame, top_k: int | None = None) -> DataFrame:
    """Vector weight, chunk count and character budgets by question type."""
    top_k = lx.TOP_K if top_k is None else top_k
    kind = F.col("query_type")

    def by_type(values: dict[str, float]) -> Column:
        return F.coalesce(lookup(kind, {k: str(v) for k, v in values.items()}),
                          F.lit(str(values["combined"])))

    community = by_type({k: b["community"] for k, b in lx.BUDGETS_BY_TYPE.items()}).cast("int")
    graph = by_type({k: b["graph"] for k, b in lx.BUDGETS_BY_TYPE.items()}).cast("int")
    k = F.when(kind == "factual", min(top_k, 3)).when(kind == "descriptive", max(top_k, 7)
                                                      ).otherwise(top_k)
    return classified.select(
        "*", by_type(lx.ALPHA_BY_TYPE).cast("double").alias("alpha"), k.alias("n"),
        community.alias("community_budget"), graph.alias("graph_budget"),
        (F.lit(lx.CONTEXT_MAX_CHARS) - community - graph).alias("vector_budget"))


def is_relationship_question(question: Column | str, normalize_patterns: bool = False) -> Column:
    patterns = lx.RELATIONSHIP_PATTERNS
    if normalize_patterns:
        patterns = fold_patterns(patterns)
    return matches_any(normalize_name(question), patterns)


def inventory_route(question: Column | str) -> Column:
    """``documents`` or ``topics`` for questions about the collection itself, else null."""
    text = trim_blank(F.lower(F.col(question) if isinstance(question, str) else question))
    return F.when(matches_any(text, lx.LIST_DOCUMENTS_PATTERNS), "documents").when(
        matches_any(text, lx.TOPIC_PATTERNS), "topics")


def inventory_label(mime: Column | str) -> Column:
    m = F.coalesce(F.col(mime) if isinstance(mime, str) else mime, F.lit("unknown"))
    tail = F.upper(F.element_at(F.split(m, "/"), -1))
    return F.coalesce(lookup(m, lx.INVENTORY_LABELS),
                      F.when(F.contains(m, F.lit("/")), tail).otherwise(F.lit("Khác")))


def corpus_inventory(documents: DataFrame, samples: int = 4) -> DataFrame:
    """Documents per type label with sample names, largest group first.

    Names are ranked before they are gathered, so only the samples of a group travel.
    """
    key = ["owner_id", "label"]
    rows = documents.select("owner_id", inventory_label("mime_type").alias("label"),
                            F.coalesce("file_name", "file_id").alias("name"), "file_id")
    counts = rows.groupBy(*key).agg(F.count("*").alias("files"))
    shown = first_per(rows, key, ["name", "file_id"], samples, "n").groupBy(*key).agg(
        F.expr("listagg(name, ', ') within group (order by n)").alias("names"))
    more = F.when(F.col("files") > samples, F.concat(
        F.lit(" (+"), (F.col("files") - samples).cast("string"), F.lit(" file)"))
    ).otherwise(F.lit(""))
    line = F.concat(F.lit("• "), F.col("label"), F.lit(" ("), F.col("files").cast("string"),
                    F.lit(" file): "), F.col("names"), more)
    grouped = counts.join(shown, key).select(*key, "files", "names", line.alias("line"))
    order = W.partitionBy("owner_id").orderBy(F.desc("files"), "label")
    return grouped.withColumn("place", F.row_number().over(order))


def document_list(documents: DataFrame, shown: int = 30) -> DataFrame:
    """Numbered list of the first documents of each owner with their chunk counts."""
    total = documents.groupBy("owner_id").agg(F.count("*").alias("total"))
    first = first_per(documents.select("owner_id", "file_id", "file_name", "chunk_count"),
                      ["owner_id"], ["file_name", "file_id"], shown, "n")
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.coalesce("file_name", "file_id"),
                    F.lit(" ("), F.col("chunk_count").cast("string"), F.lit(" chunks)"))
    text = first.select("owner_id", "n", line.alias("line")).groupBy("owner_id").agg(
        F.expr("listagg(line, '\\n') within group (order by n)").alias("lines"))
    more = F.when(F.col("total") > shown, F.concat(
        F.lit("\n... "), (F.col("total") - shown).cast("string"))).otherwise(F.lit(""))
    return total.join(text, "owner_id").select(
        "owner_id", "total", F.concat("lines", more).alias("text"))


# --- Conversations --------------------------------------------------------

def recent_history(turns: DataFrame, last: int = 6) -> DataFrame:
    """Last turns of each conversation in order; every role but the user's is the model's."""
    kept = turns.filter(trim_blank(F.coalesce("text", F.lit(""))) != "")
    recent = first_per(kept, ["conv_id"], [F.desc("turn")], last)
    role = F.when(F.col("role") == "user", "user").otherwise("model")
    return recent.select("conv_id", "turn", role.alias("role"), "text")


def user_questions(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("user_questions"),
        F.count("*").alias("turns"))


def prompt_rows(history: DataFrame, asked: DataFrame) -> DataFrame:
    """History turns and the question with its context as one text per conversation.

    ``asked`` holds ``(conv_id, question, context)``.
    """
    line = F.concat("role", F.lit(": "), "text")
    past = history.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(
        F.expr("listagg(line, '\\n') within group (order by turn)").alias("history"))
    message = F.concat(
        F.lit(lx.PROMPT_OPEN + "\n"), F.coalesce("context", F.lit("")),
        F.lit("\n" + lx.PROMPT_CLOSE + "\n\nCâu hỏi: "), F.col("question"))
    return asked.join(past, "conv_id", "left").select(
        "conv_id", F.concat_ws("\n", "history", F.concat(F.lit("user: "), message)).alias("prompt"))
