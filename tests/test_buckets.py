"""Tables in buckets: updates equal those of whole tables and rewrite only what they touch."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.sources import buckets as bk
from corvane.sources import store as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, sign=1.0, size=3, every=1):
    return spark.range(0, n, every).select(
        F.concat(F.lit("o"), F.col("id") % 4).alias("owner_id"), F.col("id").cast("string").alias("chunk_id"),
        F.array(*[F.lit(sign) * F.col("id")] * size).alias("embedding"))


def stamps(path):
    return {f"{folder}/{f}" for folder, _, files in os.walk(path) for f in files if f.startswith("part-")}


def test_vectors_are_replaced_in_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "v")
    bk.write_vectors(vectors(spark, 400), path, 16)
    before = stamps(path)
    assert bk.upsert_vectors(spark, path, vectors(spark, 3, -1.0)) <= 3
    assert len(before - stamps(path)) <= 3 and len(before & stamps(path)) >= 13
    got = bk.read_table(spark, path).drop("dims")
    want = st.upsert_vectors(vectors(spark, 400), vectors(spark, 3, -1.0))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert bk.upsert_vectors(spark, path, vectors(spark, 0)) == 0


def test_another_length_fails_before_anything_is_written(spark, tmp_path):
    path = str(tmp_path / "v")
    bk.write_vectors(vectors(spark, 40), path, 4)
    before = stamps(path)
    with pytest.raises(ValueError, match="unequal length: o0"):
        bk.upsert_vectors(spark, path, vectors(spark, 1, size=2))
    assert stamps(path) == before


def test_small_updates_do_not_shuffle_the_stored_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    bk.write_vectors(vectors(spark, 400), path, 16)
    table = spark.read.parquet(path)
    fresh = vectors(spark, 2).withColumn("dims", F.lit(3)).cache()
    stored, touched = bk.touched_rows(table, fresh, bk.VECTOR_KEY)
    text = plan(bk.replaced(stored.drop("bucket_16"), fresh, bk.VECTOR_KEY))
    assert "PartitionFilters: [" in text and "bucket_16" in text.split("PartitionFilters: [")[1][:200]
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text
    assert len(touched) <= 2


def test_properties_and_catalogue(spark, tmp_path):
    path = str(tmp_path / "p")
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "id string, n int, s string")
    new = spark.createDataFrame([("a", None, "y"), ("d", 4, None)], "id string, n int, s string")
    bk.write_table(old, path, ["id"], 4)
    bk.upsert_properties(spark, path, new, ["id"])
    assert sorted(map(tuple, bk.read_table(spark, path).select("id", "n", "s").collect())) == [
        ("a", 1, "y"), ("b", 2, None), ("c", 3, "z"), ("d", 4, None)]
    with pytest.raises(ValueError, match="lacks"):
        bk.upsert_properties(spark, path, new.withColumn("more", F.lit(1)), ["id"])

    docs = str(tmp_path / "d")
    kind = "owner_id string, file_id string, file_name string, link string"
    bk.write_table(spark.createDataFrame([("o", "1", "old", "L"), ("o", "2", "old", "")], kind), docs,
                   st.FILE_KEY, 4)
    fresh = spark.createDataFrame([("o", "1", "new", None), ("o", "2", "new", ""), ("o", "3", "new", "M")], kind)
    bk.upsert_documents(spark, docs, fresh)
    rows = {r["file_id"]: r["link"] for r in bk.read_table(spark, docs).collect()}
    assert rows["1"] == "L" and rows["3"] == "M" and rows["2"].endswith("/2/view")


def test_deletes_empty_buckets_too(spark, tmp_path):
    path = str(tmp_path / "k")
    rows = spark.range(20).select(F.col("id").cast("string").alias("id"))
    bk.write_table(rows, path, ["id"], 8)
    bk.delete_keys(spark, path, rows.where("id <> '7'"), ["id"])
    assert [r["id"] for r in bk.read_table(spark, path).collect()] == ["7"]
    bk.delete_keys(spark, path, spark.createDataFrame([(None,), ("99",)], "id string"), ["id"])
    assert bk.read_table(spark, path).count() == 1
