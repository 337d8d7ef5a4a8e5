"""Structured Streaming over the given files."""

from pyspark.sql import functions as F

from corvane.session import scratch_path
from corvane.sources import store as st
from corvane.streaming import jobs
from workload import beds
from workload.files_queries import status_log
from workload.registry import query
from workload.sqlparts import facts, trim


def stream(spark, sf, name):
    schema = beds.table(spark, sf, name).schema
    return jobs.read_table_stream(spark, sf, f"{name}.parquet", schema)


@query("stream_ingest", facts("kept") + "select owner_id, chunk_id, char_start from kept")
def stream_ingest(spark, sf):
    """Ingest the documents from two sources with their own checkpoints into one table.

    The first source holds two thirds of the documents and is read in several batches; the second
    holds all of them, so its batches repeat files that the table has. The result is that of the
    batch job.
    """
    path = scratch_path(spark, "ingest")
    docs = beds.table(spark, sf, "documents").select(
        F.col("source").alias("owner_id"), F.col("doc_id").cast("string").alias("file_id"), "text")
    first = F.pmod(F.xxhash64("file_id"), F.lit(3)) < 2
    for name, rows in (("first", docs.filter(first)), ("second", docs)):
        rows.repartition("file_id").write.parquet(f"{path}/in/{name}")
        files = spark.read.parquet(f"{path}/in/{name}").inputFiles()
        source = jobs.read_table_stream(spark, f"{path}/in/{name}", "*.parquet", docs.schema,
                                        -(-len(files) // 3))
        jobs.ingest_stream(source, f"{path}/chunks", f"{path}/state/{name}", name).awaitTermination()
    return spark.read.parquet(f"{path}/chunks").select(
        "owner_id", "chunk_id", F.col("char_start").cast("bigint").alias("char_start"))


DAYS = 8

#: A hash is held until the watermark, a day behind the latest row of the batch before, has passed its
#: day and the delay; so it comes through again from the fourth day after.
@query("stream_dedupe", f"with h as (select distinct sha256({trim('text')}) as content_hash, "
       f"hash_day as day from (select *, ascii(substr(md5(doc_id::varchar), 1, 1)) % {DAYS} as hash_day from "
       "documents)), f as (select content_hash, min(day) as day from h group by 1), a as (select h.content_hash, "
       "min(h.day) as day from h join f using (content_hash) where h.day >= f.day + 4 group by 1) select "
       "content_hash, day::integer as day from f union all select content_hash, day::integer from a")
def stream_dedupe(spark, sf):
    """Documents arrive over eight days, a day in each batch; a repeat within the delay is dropped."""
    path = scratch_path(spark, "days")
    docs = beds.table(spark, sf, "documents").select("text", (F.ascii(
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) % DAYS).alias("day"))
    for day in range(DAYS):  # files of a day are older than those of the next
        docs.filter(F.col("day") == day).repartition(4).write.mode("append").parquet(path)
    rows = jobs.with_hash(jobs.read_table_stream(spark, path, "*.parquet", docs.schema, 4)).select(
        "content_hash", "day", F.timestamp_seconds(1_700_006_400 + F.col("day") * 86_400).alias("ts"))
    return jobs.run_to_table(jobs.dedupe_stream(rows, event_time="ts"), "dedupe").select(
        "content_hash", "day")


@query("stream_counters", "select cast(epoch(date_trunc('hour', ts)) as bigint) as start, count(*) as "
       "processed, count(*) filter (event_type = 'error') as errors from events where "
       "date_trunc('hour', ts) + interval 70 minute <= (select max(ts) from events) group by 1")
def stream_counters(spark, sf):
    """Hourly counters; only windows the watermark has closed are written."""
    e = stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"),
                                           F.col("event_type").alias("status"))
    out = jobs.run_to_table(jobs.counters_stream(e), "counters")
    return out.select(F.unix_seconds("start").alias("start"), "processed", "errors")


@query("index_progress", "select count(*) as processed, count(*) filter (event_type not in ('error', "
       "'view')) as indexed, count(*) filter (event_type = 'view') as skipped, count(*) filter "
       "(event_type = 'error') as errors from events")
def index_progress(spark, sf):
    """Counters observed while the log is written; the written log gives the same roll-up."""
    path = scratch_path(spark, "progress")
    seen = jobs.observed_progress(status_log(spark, sf), path)
    written = spark.read.parquet(path).groupBy().agg(F.count("*").alias("n"))
    return written.filter(F.col("n") == seen["processed"]).select(
        *[F.lit(seen[c]).cast("bigint").alias(c)
          for c in ("processed", "indexed", "skipped", "errors")])


BATCHES = 3


@query("stream_progress", "select count(*) as processed, count(*) filter (event_type not in ('error', "
       "'view')) as indexed, count(*) filter (event_type = 'view') as skipped, count(*) filter "
       f"(event_type = 'error') as errors, {BATCHES}::bigint as batches from events")
def stream_progress(spark, sf):
    """A status log arrives in three batches; a listener writes the counts of each to a table."""
    path = scratch_path(spark, "tracked")
    log = status_log(spark, sf)
    log.repartition(BATCHES).write.parquet(f"{path}/in")
    table = jobs.ProgressTable(spark, f"{path}/progress")
    spark.streams.addListener(table)
    try:
        source = jobs.read_table_stream(spark, f"{path}/in", "*.parquet", log.schema, 1)
        table.wait(jobs.tracked_stream(source, f"{path}/out", f"{path}/state"))
    finally:
        spark.streams.removeListener(table)
    counts = [F.sum(c).alias(c) for c in ("processed", "indexed", "skipped", "errors")]
    return table.read().where("processed > 0").agg(*counts, F.count("*").alias("batches"))
