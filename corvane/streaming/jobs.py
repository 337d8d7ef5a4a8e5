"""Structured Streaming jobs: incremental ingest, exact deduplication, job counters."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from corvane.functions.text import content_hash
from corvane.operators.chunking import chunk_documents
from corvane.session import scratch_path
from corvane.sources.store import FILE_KEY, skip_indexed


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ingest_stream(documents: DataFrame, chunks_path: str, checkpoint: str,
                  stream_id: str = "main", newest: str | None = None):
    """Chunk new documents once: files that are held already are skipped.

    Chunks are partitioned by stream and batch, and a batch overwrites its own partition only, so
    a batch that is run again replaces its rows, and streams with own checkpoints (``stream_id``)
    write to one table without touching each other's rows. A stream that lost its checkpoint
    needs a new ``stream_id``. Beside the chunks lies a small catalogue of files, written after
    them, which is what each batch reads to skip. Of several versions of a file in one batch the
    one with the largest ``newest`` column (or text) is taken.
    """
    files_path = chunks_path.rstrip("/") + "_files"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = [F.desc(c) for c in ([newest] if newest else []) + ["text"]]
        fresh = batch.withColumn("_n", F.row_number().over(
            W.partitionBy(*FILE_KEY).orderBy(*order))).filter("_n = 1").drop("_n")
        mine = (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)
        if _exists(spark, files_path):
            held = spark.read.parquet(files_path).filter(~mine)
            fresh = skip_indexed(fresh, held.select(*FILE_KEY).distinct())

        def put(rows: DataFrame, path: str) -> None:
            (rows.withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id)})
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("stream_id", "batch_id").parquet(path))

        put(chunk_documents(fresh, dedupe=True), chunks_path)
        put(fresh.select(*FILE_KEY), files_path)

    return (documents.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedupe_stream(rows: DataFrame, hash_column: str = "content_hash",
                  event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row of each content hash across all batches of the stream.

    With an event time the state is dropped after ``delay``; without one it is kept, which
    suits the RocksDB state store on a cluster.
    """
    if event_time is None:
        return rows.dropDuplicates([hash_column])
    return rows.withWatermark(event_time, delay or "1 day").dropDuplicatesWithinWatermark(
        [hash_column])


def counters_stream(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Processed and failed counts per closed window of ``events(ts, status)``."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", size))
            .agg(F.count("*").alias("processed"),
                 F.count_if(F.col("status").isin("error", "failed")).alias("errors"))
            .select(F.col("window.start").alias("start"), "processed", "errors"))


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available now into a table of the shared folder, and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{path}/table").option("checkpointLocation", f"{path}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType,
                      files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", name)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_hash", content_hash("text"))


def progress_counts() -> list:
    """Counts of a status log: what was looked at, indexed, skipped and failed."""
    status = F.col("status")
    return [F.count(F.lit(1)).alias("processed"), F.count_if(status == "success").alias("indexed"),
            F.count_if(status == "skipped").alias("skipped"),
            F.count_if(status.isin("error", "failed")).alias("errors")]


PROGRESS = "query string, batch long, processed long, indexed long, skipped long, errors long"


class ProgressTable(StreamingQueryListener):
    """Feeds a table with the progress of the streams of a session that are made by ``tracked_stream``.

    One row for each batch, in a folder of its own, so a batch that is run again replaces its row.
    ``on_progress`` is called with each row. Rows come after their batch; ``wait`` returns once a
    query's last row is written.
    """

    def __init__(self, spark: SparkSession, path: str,
                 on_progress: Callable[[dict], None] | None = None):
        self.spark, self.path, self.on_progress = spark, path, on_progress
        self.ended: dict[str, threading.Event] = {}
        self.failed: dict[str, Exception] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("file_progress")
        if seen is None:
            return
        row = {"query": str(p.id), "batch": p.batchId, **{k: int(v) for k, v in seen.asDict().items()}}
        try:
            self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(
                f"{self.path}/{row['query']}-{row['batch']}")
            if self.on_progress:
                self.on_progress(row)
        except Exception as problem:  # raised to the caller of wait(), a listener has none
            self.failed[str(p.runId)] = problem

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query, seconds: float = 60.0) -> None:
        """Wait for the end of a query and of its rows; an error while a row was written is raised."""
        query.awaitTermination()
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"no end of query {query.id} was reported")
        if str(query.runId) in self.failed:
            raise self.failed[str(query.runId)]

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(f"{self.path}/*")


def tracked_stream(log: DataFrame, path: str, checkpoint: str):
    """Write a streamed status log; its counts per batch reach the session's ``ProgressTable``."""
    return (log.observe("file_progress", *progress_counts()).writeStream.format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def observed_progress(log: DataFrame, path: str) -> dict[str, int]:
    """Write a log and report its progress counts from the same pass."""
    seen = Observation("progress")
    log.observe(seen, *progress_counts()).write.mode("overwrite").parquet(path)
    return seen.get
