"""Context sections under character budgets, their fusion, and citations.

Sections are built from ranked rows per question with running sums over those rows; a
question has at most a few dozen, so these windows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.keys import location_label, location_link, positive
from corvane.functions.text import mentioned_in, snippet, trim_blank
from corvane.operators.graph import first_per

Q = ["owner_id", "query_id"]
TRUNCATED = "...[truncated]"
MIN_REMAINDER = 200


def _numbered(df: DataFrame, order: str, ref_start: Column) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*Q).orderBy(order))
    return df.withColumn("ref", place - 1 + ref_start)


def pack_entries(rows: DataFrame, budget: Column, ref_start: Column | None = None) -> DataFrame:
    """Entries in rank order while they fit; the first that does not is cut if enough room is
    left, and nothing follows it. Adds ``ref`` and ``entry``.
    """
    start = F.lit(1) if ref_start is None else ref_start
    location = location_label(positive("page_estimate"), positive("line_start"),
                              positive("line_end"))
    header = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] Nguồn: "),
                      F.coalesce("file_name", F.lit("Unknown")),
                      F.when(location != "", F.concat(F.lit(" ("), location, F.lit(")")))
                      .otherwise(F.lit("")))
    entries = _numbered(rows, "rank", start).withColumn(
        "entry", F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")))).withColumn(
        "_budget", budget)
    used = F.sum(F.length("entry")).over(
        W.partitionBy(*Q).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    sized = entries.withColumn("_used", used).withColumn(
        "_left", F.col("_budget") - (F.col("_used") - F.length("entry")))
    fits = F.col("_used") <= F.col("_budget")
    # The running sum only grows, so the first misfit is the one whose predecessors all fit.
    cut = ~fits & (F.col("_left") > MIN_REMAINDER)
    return sized.filter(fits | cut).withColumn("entry", F.when(fits, F.col("entry")).otherwise(
        F.concat(F.substring(F.col("entry"), F.lit(1), F.col("_left")), F.lit(TRUNCATED)))
    ).drop("_budget", "_used", "_left")


def _joined(entries: DataFrame, separator: str) -> DataFrame:
    sep = separator.replace("\n", "\\n")
    return entries.groupBy(*Q).agg(
        F.expr(f"listagg(entry, '{sep}') within group (order by ref)").alias("text"),
        F.count("*").alias("n_refs"))


def pack_context(results: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Context of plain retrieval: one text per question."""
    budget = F.lit(lx.CONTEXT_MAX_CHARS if max_chars is None else max_chars)
    return _joined(pack_entries(results, budget), lx.SECTION_SEPARATOR)


def vector_section(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titled chunk section within ``vector_budget``, numbered from ``ref_start``."""
    entries = pack_entries(results, F.col("vector_budget"), F.col("ref_start"))
    text = _joined(entries, "\n\n").select(
        *Q, trim_blank(F.concat(F.lit(lx.VECTOR_TITLE + "\n\n"), F.col("text"))).alias("text"),
        "n_refs")
    return text, entries


def filter_relations(relations: DataFrame, questions: DataFrame) -> DataFrame:
    """Relations with an end named in the question; all of them for combined questions.

    Relations are rows ``(owner_id, query_id, from_name, to_name, ..)``.
    """
    asked = questions.select(*Q, "question", "query_type")
    named = mentioned_in("from_name", "question") | mentioned_in("to_name", "question")
    return relations.join(asked, Q).filter(
        F.col("query_type").isin("relationship", "combined") | named).select(*relations.columns)


def graph_section(path_relations: DataFrame, relations: DataFrame, sources: DataFrame,
                  params: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Titled relation section: path relations, then facts, without repeats, within budget.

    Both inputs hold ``(.., from_name, to_name, rel_type, description, at)`` with ``at`` sortable;
    ``sources(.., chunk_id, file_name, link, row_no)`` gives the first named source;
    ``params(.., graph_budget, ref_start)``.
    """
    columns = [*Q, "from_name", "to_name", "rel_type", "description"]
    first = path_relations.select(
        *columns, F.lit(0).alias("kind"),
        F.row_number().over(W.partitionBy(*Q).orderBy("at", "from_name", "to_name", "rel_type"))
        .alias("n"))
    then = relations.select(
        *columns, F.lit(1).alias("kind"),
        F.row_number().over(W.partitionBy(*Q).orderBy("at", "from_name", "to_name", "rel_type"))
        .alias("n"))
    top = first_per(first.unionByName(then), Q, ["kind", "n"], most, "place")
    unique = first_per(top, [*Q, "from_name", "to_name", "rel_type"], ["place"], 1)
    numbered = _numbered(unique.join(params.select(*Q, "graph_budget", "ref_start"), Q), "place",
                         F.col("ref_start"))
    kind = F.lower(F.replace("rel_type", F.lit("_"), F.lit(" ")))
    text = trim_blank(F.coalesce("description", F.lit("")))
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "), F.col("from_name"),
                    F.lit(" — "), kind, F.lit(" → "), F.col("to_name"),
                    F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")")))
                    .otherwise(F.lit("")))
    rows = numbered.withColumn("entry", line).withColumn("relation", kind)
    used = F.sum(F.length("entry") + 2).over(
        W.partitionBy(*Q).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("_used", used - 2 + len(lx.GRAPH_TITLE) + 1).filter(
        F.col("_used") <= F.col("graph_budget")).drop("_used")
    source = sources.filter(F.coalesce("file_name", F.lit("")) != "").groupBy(*Q).agg(
        F.min_by(F.struct("chunk_id", "file_name", "link"), F.struct("row_no", "chunk_id"))
        .alias("s"))
    cited = kept.join(source, Q, "left").select(
        *Q, "ref", "entry", "relation", F.concat("from_name", F.lit(" → "), "to_name")
        .alias("file_name"), F.coalesce("description", F.lit("")).alias("snippet"),
        F.coalesce("s.file_name", F.lit("")).alias("source_file"),
        F.coalesce("s.link", F.lit("")).alias("link"),
        F.when(F.contains("s.chunk_id", F.lit("__chunk_")),
               F.split_part("s.chunk_id", F.lit("__chunk_"), F.lit(1))).otherwise(F.lit(""))
        .alias("file_id"))
    # The section exists whenever there is a relation, even if none fits the budget.
    body = _joined(kept, "\n\n")
    section = unique.select(*Q).distinct().join(body, Q, "left").select(
        *Q, trim_blank(F.concat(F.lit(lx.GRAPH_TITLE), F.coalesce(
            F.concat(F.lit("\n\n"), F.col("text")), F.lit("")))).alias("text"),
        F.coalesce("n_refs", F.lit(0)).alias("n_refs"))
    return section, cited


def community_section(communities: DataFrame, params: DataFrame) -> DataFrame:
    """Titled section of the best community that has a summary, cut to its budget.

    ``communities(.., summary, member_count, score, place)``,
    ``params(.., community_budget, ref_start)``.
    """
    told = communities.filter(trim_blank(F.coalesce("summary", F.lit(""))) != "")
    best = first_per(told, Q, ["place"], 1).join(
        params.select(*Q, "community_budget", "ref_start"), Q)
    label = F.concat(F.col("member_count").cast("string"), F.lit(" entities"))
    summary = trim_blank("summary")
    entry = F.concat(F.lit("["), F.col("ref_start").cast("string"), F.lit("] "), summary,
                     F.lit("\n(Community — "), label, F.lit(")"))
    head = len(lx.COMMUNITY_TITLE) + 1
    room = F.greatest(F.col("community_budget") - head, F.lit(0))
    fitted = F.when(F.length(entry) + head > F.col("community_budget"), F.concat(
        F.substring(entry, F.lit(1), room), F.lit("..."))).otherwise(entry)
    return best.select(
        *Q, F.col("ref_start").alias("ref"),
        trim_blank(F.concat(F.lit(lx.COMMUNITY_TITLE + "\n\n"), fitted)).alias("text"),
        F.lit(1).cast("bigint").alias("n_refs"), summary.alias("summary"), "member_count", "score",
        F.concat(F.lit("Community ("), label, F.lit(")")).alias("file_name"))


SECTION_ORDER = {
    "factual": ["vector", "graph", "community"],
    "descriptive": ["community", "vector", "graph"],
    "combined": ["community", "graph", "vector"],
}


def fuse_sections(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """Join non-empty sections ``(.., section, text)`` in the order of the question type."""
    place = F.lit(9)
    for kind, order in SECTION_ORDER.items():
        for n, section in enumerate(order):
            place = F.when((F.col("query_type") == kind) & (F.col("section") == section), n
                           ).otherwise(place)
    sep = lx.SECTION_SEPARATOR.replace("\n", "\\n")
    rows = sections.filter(trim_blank("text") != "").join(
        questions.select(*Q, "query_type"), Q).withColumn("place", place).withColumn(
        "text", trim_blank("text"))
    return rows.groupBy(*Q).agg(
        F.expr(f"listagg(text, '{sep}') within group (order by place)").alias("context"))


CITATION_DEFAULTS = {
    "source": "vector", "file_name": "", "file_id": "", "link": "", "page_estimate": "",
    "line_start": "", "line_end": "", "mime_type": "", "snippet": "", "summary_preview": "",
    "text": "", "relation": "", "member_count": "", "source_file": "",
}


def citations(raw: DataFrame, max_items: int = 10) -> DataFrame:
    """Readable citations per question: repeats dropped, cut, renumbered; ``ref`` is kept.

    Rows hold ``owner_id, query_id, ref`` and any of the columns in ``CITATION_DEFAULTS``.
    """
    have = set(raw.columns)
    rows = raw.select(*Q, "ref", *[
        (F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d)).alias(c)
        for c, d in CITATION_DEFAULTS.items()])
    page, start, end = positive("page_estimate"), positive("line_start"), positive("line_end")
    preview = F.coalesce(F.nullif("snippet", F.lit("")), F.col("summary_preview"))
    key = F.concat_ws("|", "source", trim_blank("file_name"),
                      *[F.coalesce(x.cast("string"), F.lit("")) for x in (page, start, end)],
                      trim_blank("relation"), snippet(preview, 40))
    unique = first_per(rows.withColumn("_key", key), [*Q, "_key"], ["ref"], 1)
    kept = first_per(unique, Q, ["ref"], max_items, "index")
    name, relation = trim_blank("file_name"), trim_blank("relation")
    members, file = trim_blank("member_count"), trim_blank("source_file")
    community, graph = F.col("source") == "community", F.col("source") == "graph"
    label = (
        F.when(community & (members != ""), F.concat(F.lit("Tổng quan ("), members,
                                                     F.lit(" thực thể)")))
        .when(community, "Tổng quan chủ đề")
        .when(graph, F.coalesce(F.nullif(name, F.lit("")), F.lit("Quan hệ trong đồ thị tri thức")))
        .otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("Tài liệu")))
    )
    where = (
        F.when(community, "")
        .when(graph & (file != ""), F.concat(F.lit("Tài liệu: "), file))
        .when(graph & (relation != ""), F.initcap(F.replace(relation, F.lit("_"), F.lit(" "))))
        .when(graph, "Đồ thị tri thức")
        .otherwise(location_label(page, start, end))
    )
    source_label = F.lit(lx.UNKNOWN_SOURCE_LABEL)
    for source, text in lx.SOURCE_LABELS.items():
        source_label = F.when(F.col("source") == source, text).otherwise(source_label)
    body = F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("summary_preview", F.lit("")),
                      F.col("text"))
    link = location_link("link", "file_id", page, "mime_type", "file_name")
    return kept.select(
        *Q, F.col("index").cast("bigint").alias("index"), "ref", label.alias("label"),
        where.alias("location"), snippet(body).alias("snippet"), "source",
        source_label.alias("source_label"), trim_blank("link").alias("link"),
        link.alias("location_link"), trim_blank("file_id").alias("file_id"),
        *[F.coalesce(x.cast("string"), F.lit("")).alias(n)
          for x, n in ((page, "page"), (start, "line_start"), (end, "line_end"))])
