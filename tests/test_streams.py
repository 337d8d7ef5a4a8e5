"""Incremental ingest: several sources, repeated files, and no rows lost."""

from corvane.operators.chunking import chunk_documents, chunk_places, pack_units
from corvane.streaming import jobs

SCHEMA = "owner_id string, file_id string, text string, version int"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, table, state, name):
    source = jobs.read_table_stream(spark, folder, "*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)
    jobs.ingest_stream(source, table, state, name, newest="version").awaitTermination()


def test_sources_share_a_table(spark, tmp_path):
    a, b, table = (str(tmp_path / n) for n in ("a", "b", "chunks"))
    put(spark, a, [("o", "f1", "one text. " * 40, 1)])
    run(spark, a, table, str(tmp_path / "sa"), "a")
    put(spark, a, [("o", "f1", "changed", 2), ("o", "f2", "two", 1), ("o", "f2", "newer two", 2)])
    put(spark, a, [("o", "f3", "three", 1)])
    run(spark, a, table, str(tmp_path / "sa"), "a")
    put(spark, b, [("o", "f2", "other", 9), ("o", "f4", "four", 1)])
    run(spark, b, table, str(tmp_path / "sb"), "b")
    run(spark, b, table, str(tmp_path / "lost"), "b2")  # a lost checkpoint brings nothing twice
    got = sorted((r["file_id"], r["text"]) for r in spark.read.parquet(table).collect())
    docs = spark.createDataFrame([("o", "f1", "one text. " * 40, 1), ("o", "f2", "newer two", 2),
                                  ("o", "f3", "three", 1), ("o", "f4", "four", 1)], SCHEMA)
    assert got == sorted((r["file_id"], r["text"])
                         for r in chunk_documents(docs, dedupe=True).collect())


def naive_places(body, parts):
    begin, out = 0, []
    for part in parts:
        at = body.find(part, begin)
        if at < 0:
            at = body.find(part[:100], begin)
        at = begin if at < 0 else at
        out.append((at, at + len(part)))
        begin = at + 1
    return out


def test_places_are_those_of_searching_each_chunk():
    units = [f"Sentence {i % 17} of some text é😀." for i in range(400)]
    body = "".join(u + ("\n\n" if i % 3 else "  ") for i, u in enumerate(units)) + "[Trang 7] end"
    for size, overlap in ((512, 50), (200, 0), (90, 30)):
        parts = pack_units(units, size, overlap) + ["missing", "", "end"]
        got = [(r["char_start"], r["char_end"]) for r in chunk_places(body, parts)]
        assert got == naive_places(body, parts)


def test_state_falls_once_the_delay_has_passed(spark, tmp_path):
    from pyspark.sql import functions as F

    day, folder = 86_400, str(tmp_path / "in")
    schema = "content_hash string, at long"
    for rows in ([("a", 0), ("b", 0)], [("a", 1), ("c", 1)], [("d", 2)], [("e", 3)], [("a", 4), ("e", 4), ("b", 0)]):
        spark.createDataFrame([(h, 1_700_006_400 + d * day) for h, d in rows], schema).coalesce(1).write.mode(
            "append").parquet(folder)
    source = jobs.read_table_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    kept = jobs.dedupe_stream(source.withColumn("ts", F.timestamp_seconds("at")), event_time="ts", delay="1 day")
    query = (kept.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r["content_hash"], (r["at"] - 1_700_006_400) // day)
                 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the repeat of a on day 1 is dropped, that of day 4 finds no state; b comes too late
    assert got == [("a", 0), ("a", 4), ("b", 0), ("c", 1), ("d", 2), ("e", 3)]
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(held) > held[-1]


def test_a_listener_feeds_the_progress_table(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    for rows in (["success", "skipped"], ["error"], ["success", "failed", "success"]):
        spark.createDataFrame([(r,) for r in rows], "status string").coalesce(1).write.mode(
            "append").parquet(folder)
    table = jobs.ProgressTable(spark, str(tmp_path / "progress"), seen.append)
    spark.streams.addListener(table)
    try:
        source = jobs.read_table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, 1)
        for _ in range(2):  # the second run finds nothing new
            table.wait(jobs.tracked_stream(source, str(tmp_path / "out"), str(tmp_path / "state")))
    finally:
        spark.streams.removeListener(table)
    rows = [r for r in table.read().orderBy("batch").collect() if r["processed"]]
    assert sorted((r["processed"], r["indexed"], r["skipped"], r["errors"]) for r in rows) == [
        (1, 0, 0, 1), (2, 1, 1, 0), (3, 2, 0, 1)]
    assert [r["batch"] for r in seen if r["processed"]] == [0, 1, 2] and len({r["query"] for r in rows}) == 1
