"""Catalogue maintenance over tables: skip, upsert, delete, fetch, roll up.

Updates return the new state of a table. Written with ``partitionOverwriteMode=dynamic``
and ``partitionBy('owner_id')`` they replace only the owners they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.keys import default_link
from corvane.functions.text import trim_blank
from corvane.sources.files import is_supported

FILE_KEY = ["owner_id", "file_id"]


def skip_indexed(batch: DataFrame, catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Only files the catalogue does not hold yet."""
    keys = keys or FILE_KEY
    return batch.join(catalog.select(*keys), keys, "left_anti")


def replace_rows(current: DataFrame, fresh: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop every old row of the keys in ``fresh``, then add the fresh rows."""
    keys = keys or FILE_KEY
    kept = current.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


def index_status(batch: DataFrame, catalog: DataFrame, chunk_counts: DataFrame,
                 force: bool = False) -> DataFrame:
    """Status and reason per file; the first matching rule wins."""
    known = catalog.select(*FILE_KEY).distinct().withColumn("known", F.lit(True))
    counts = chunk_counts.select(*FILE_KEY, F.col("chunks_count").cast("bigint").alias("n"))
    mime = F.col("mime_type")
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    indexed = F.coalesce(F.col("known"), F.lit(False)) & F.lit(not force)
    blank = trim_blank(F.coalesce(F.col("text"), F.lit(""))) == ""
    rule = (
        F.when(mime.isin(lx.SKIPPED_MIME), "skip_listed")
        .when(~is_supported(mime), "unsupported")
        .when(indexed, "already_indexed")
        .when(blank, "no_text")
        .when(n == 0, "no_chunks")
        .otherwise("")
    )
    status = (
        F.when(F.col("reason").isin("skip_listed", "unsupported", "already_indexed"), "skipped")
        .when(F.col("reason") != "", "error")
        .otherwise("success")
    )
    return (
        batch.join(known, FILE_KEY, "left").join(counts, FILE_KEY, "left")
        .withColumn("reason", rule)
        .withColumn("status", status)
        .select(*FILE_KEY, "file_name", "status", "reason",
                F.when(F.col("status") == "success", n).otherwise(F.lit(0)).alias("chunks_count"))
    )


def latest_by_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins. ``max_by`` combines before the shuffle, so a hot key stays cheap."""
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.col(version)).alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "row.*").select(*rows.columns)


def upsert_vectors(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """New vectors replace old ones of the same (owner, chunk).

    Lengths must agree within an owner; a differing vector fails the job, it is not dropped.
    """
    rows = current.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    latest = latest_by_key(rows, ["owner_id", "chunk_id"], "_v").drop("_v")
    size = latest.groupBy("owner_id").agg(
        F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    checked = latest.join(size, "owner_id").withColumn(
        "embedding",
        F.when(F.col("low") == F.col("high"), F.col("embedding")).otherwise(
            F.raise_error(F.concat(F.lit("vectors of unequal length: "), F.col("owner_id"))
                          ).cast(latest.schema["embedding"].dataType)))
    return checked.drop("low", "high")


def upsert_properties(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Present properties overwrite, absent (null) ones keep their value."""
    columns = list(dict.fromkeys(current.columns + fresh.columns))
    old = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in current.columns
                                  if c not in keys])
    new = fresh.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fresh.columns
                                if c not in keys])

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        parts = [F.col(f"{side}_{c}") for side, frame in (("new", fresh), ("old", current))
                 if c in frame.columns]
        return F.coalesce(*parts).alias(c)

    return old.join(new, keys, "full_outer").select(*[merged(c) for c in columns])


def upsert_documents(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalogue rows keyed by owner and file; a missing link is built from the file id."""
    link = F.coalesce(F.nullif(F.col("link"), F.lit("")), default_link("file_id"))
    return upsert_properties(current, fresh, FILE_KEY).withColumn("link", link)


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame,
                     edges: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Remove documents with their chunks, vectors, incident edges and orphaned entities.

    Only an entity that lost its last mention through this delete goes; entities that other
    documents of the owner mention stay, and so do entities that never had a mention.
    """
    files = gone.select(*FILE_KEY).distinct()
    dead_chunks = chunks.join(files, FILE_KEY, "left_semi").select("owner_id", "chunk_id")
    mentions = edges.filter("rel_type = 'MENTIONS'").select(
        "owner_id", F.col("src").alias("chunk_id"), F.col("dst").alias("entity_id"))
    dead = F.col("dead").isNotNull()
    marked = mentions.join(dead_chunks.withColumn("dead", F.lit(1)), ["owner_id", "chunk_id"],
                           "left")
    orphans = (
        marked.groupBy("owner_id", "entity_id")
        .agg(F.count_if(dead).alias("lost"), F.count_if(~dead).alias("left"))
        .filter("lost > 0 and left = 0").select("owner_id", "entity_id")
    )
    ids = (
        files.select("owner_id", F.col("file_id").alias("id"))
        .union(dead_chunks).union(orphans)
    )
    kept_edges = (
        edges.join(ids.withColumnRenamed("id", "src"), ["owner_id", "src"], "left_anti")
        .join(ids.withColumnRenamed("id", "dst"), ["owner_id", "dst"], "left_anti")
        .select(*edges.columns)
    )
    return {
        "documents": documents.join(files, FILE_KEY, "left_anti"),
        "chunks": chunks.join(files, FILE_KEY, "left_anti"),
        "vectors": vectors.join(dead_chunks, ["owner_id", "chunk_id"], "left_anti"),
        "edges": kept_edges,
        "entities": entities.join(orphans, ["owner_id", "entity_id"], "left_anti"),
    }


def collection_info(rows: DataFrame) -> DataFrame:
    return rows.groupBy("owner_id").agg(F.count("*").alias("count"))


def drop_collection(rows: DataFrame, owner: str) -> DataFrame:
    return rows.filter(F.col("owner_id") != owner)


def ids_from_text(texts: DataFrame, column: str = "ids") -> DataFrame:
    """Ids given as lines of text: split, trimmed, blanks dropped."""
    lines = F.explode(F.split(column, r"\r?\n")).alias("chunk_id")
    return (texts.select(lines).select(trim_blank("chunk_id").alias("chunk_id"))
            .filter("chunk_id <> ''").distinct())


def get_by_ids(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the wanted ids; unknown ids are silently absent."""
    return rows.join(ids.select(key), key, "left_semi")


def list_documents(documents: DataFrame, owner: str | None = None, limit: int = 100) -> DataFrame:
    scope = documents if owner is None else documents.filter(F.col("owner_id") == owner)
    return scope.orderBy("file_name", "file_id").limit(limit)


def sync_rollup(log: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Found, indexed, skipped and failed files per owner; a listing size overrides the count."""
    status = F.col("status")
    counts = log.groupBy("owner_id").agg(
        F.count("*").alias("results"),
        F.count_if(status == "success").alias("indexed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status.isin("error", "failed")).alias("errors"),
    )
    if listed is None:
        return counts.withColumnRenamed("results", "total_found")
    found = F.when(F.col("files_found") > 0, F.col("files_found")).otherwise(F.col("results"))
    return counts.join(listed, "owner_id", "left").select(
        "owner_id", F.coalesce(found, F.col("results")).alias("total_found"),
        "indexed", "skipped", "errors")


def top_errors(log: DataFrame, limit: int = 5, width: int = 80) -> DataFrame:
    """Most frequent error reasons."""
    reason = F.substring("reason", 1, width).alias("reason")
    return (log.filter(F.col("status").isin("error", "failed")).groupBy(reason)
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(limit))


def write_report(df: DataFrame, path: str, **meta: str) -> None:
    """Metrics as JSON lines, each with the metadata of the run."""
    for name, value in meta.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").json(path)


QUESTION_SET = (
    "version string, collection_name string, owner_id string, questions array<struct<"
    "id string, category string, question string, ground_truth string, "
    "expected_chunks array<struct<chunk_id string, file_id string, chunk_index string>>, "
    "ground_truth_keywords array<string>, should_refuse boolean, human_score int, notes string>>"
)


def load_questions(sets: DataFrame) -> DataFrame:
    """One row per question of each parsed question set, with defaults filled in."""
    item = F.col("item")
    category = F.lower(F.coalesce(item["category"], F.lit("")))
    number = F.lpad((F.col("pos") + 1).cast("string"), 2, "0")
    empty = F.array().cast("array<string>")
    return sets.select(
        "collection_name", "owner_id", F.posexplode("questions").alias("pos", "item")
    ).select(
        "collection_name", "owner_id", "pos",
        F.coalesce(item["id"], F.concat(F.lit("q"), number)).alias("question_id"),
        F.when(category.isin(lx.QUESTION_CATEGORIES), category).otherwise(F.lit("factual"))
        .alias("category"),
        item["question"].alias("question"),
        F.coalesce(item["ground_truth_keywords"], empty).alias("keywords"),
        item["expected_chunks"].alias("expected"),
        F.coalesce(item["should_refuse"], F.lit(False)).alias("should_refuse"),
        item["human_score"].alias("human_score"),
        F.coalesce(item["notes"], F.lit("")).alias("notes"),
    )


def read_question_set(spark, path: str) -> DataFrame:
    return load_questions(spark.read.schema(QUESTION_SET).option("multiLine", "true").json(path))
