"""Tables kept in buckets by a hash of their key, so that an update rewrites only what it touches.

A table is a folder of Parquet files, partitioned by a column named ``bucket_<n>`` that holds the
bucket of each row; the name keeps the number of buckets with the table. An update finds the
buckets of its keys, reads those alone (the others are pruned by their folder), and overwrites
those alone. The update is the small side: where it was checked to fit it is broadcast, and then
the stored rows are not shuffled; otherwise both sides meet in a join by key.

Updates of one table run one after the other. Tasks stage their files, and the driver moves them when
all have ended, so lost executors do no harm; but the move is not one atomic step, so keep a copy (or
a table format with commits) where the driver itself may die in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.keys import default_link
from corvane.session import broadcast_if_small, cut_lineage
from corvane.sources.store import FILE_KEY, latest_by_key

#: Buckets of a new table. A bucket should be a few files of a few hundred MB; thousands suit 100 TB.
BUCKETS = 64
VECTOR_KEY = ["owner_id", "chunk_id"]


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_column(table: DataFrame) -> tuple[str, int]:
    """Name of the bucket column and the number of buckets in it."""
    name = next(c for c in table.columns if c.startswith("bucket_"))
    return name, int(name.removeprefix("bucket_"))


def write_table(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write ``rows`` as a new table; the one shuffle of a table's life deals its rows to buckets."""
    name = f"bucket_{buckets}"
    rows.withColumn(name, bucket_of(keys, buckets)).repartition(name).write.partitionBy(name).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows, without the bucket column."""
    table = spark.read.parquet(path)
    return table.drop(bucket_column(table)[0])


def touched_rows(table: DataFrame, fresh: DataFrame, keys: list[str]) -> tuple[DataFrame, list[int]]:
    """Stored rows of the buckets that the keys of ``fresh`` fall into, and those buckets.

    The list is bounded by the number of buckets.
    """
    name, n = bucket_column(table)
    found = fresh.select(bucket_of(keys, n).alias("b")).distinct().collect()
    touched = sorted(r["b"] for r in found)
    return table.where(F.col(name).isin(touched)), touched


def update(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str],
           merge: Callable[[DataFrame, DataFrame], DataFrame], may_empty: bool = False) -> int:
    """Replace the stored rows that share a bucket with ``fresh`` by ``merge(stored, fresh)``.

    ``fresh`` has one row for each key, and columns of the table only. Null keys do not match stored
    ones. Returns the number of buckets rewritten; an empty ``fresh`` rewrites none. Where ``merge``
    ``may_empty`` a bucket, the buckets that keep rows are found first, from the key columns.
    """
    table = spark.read.parquet(path)
    name, n = bucket_column(table)
    kinds = {f.name: f.dataType for f in table.schema.fields if f.name != name}
    unknown = set(fresh.columns) - set(kinds)
    if unknown:
        raise ValueError(f"columns that the table lacks: {sorted(unknown)}")
    fresh = fresh.select(*[F.col(c).cast(kinds[c]).alias(c) for c in fresh.columns])
    stored, touched = touched_rows(table, fresh, keys)
    if not touched:
        return 0
    merged = merge(stored.drop(name), fresh).select(*kinds).withColumn(name, bucket_of(keys, n))
    left = {r[name] for r in merged.select(name).distinct().collect()} if may_empty else set(touched)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        name).parquet(path)
    for b in set(touched) - left:  # nothing was written over an emptied bucket
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(touched)


def replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key ``fresh`` lacks, and the rows of ``fresh``."""
    gone = broadcast_if_small(fresh.select(*keys))
    return stored.join(gone, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_vectors(spark: SparkSession, path: str, fresh: DataFrame, version: str | None = None) -> int:
    """New vectors replace stored ones of the same (owner, chunk); of several the latest ``version``.

    The lengths of an owner's vectors are kept in a column ``dims``, so the check against what is
    stored reads two columns and no vector. A vector of another length than the owner's fails the job
    before anything is written.
    """
    fresh = fresh.withColumn("dims", F.size("embedding"))
    fresh = latest_by_key(fresh, VECTOR_KEY, version) if version else fresh.dropDuplicates(VECTOR_KEY)
    fresh = cut_lineage(fresh)
    table = spark.read.parquet(path)
    owners = broadcast_if_small(fresh.select("owner_id").distinct())
    sizes = table.join(owners, "owner_id", "left_semi").select("owner_id", "dims").unionByName(
        fresh.select("owner_id", "dims")).groupBy("owner_id").agg(
        F.min("dims").alias("low"), F.max("dims").alias("high"))
    wrong = sizes.where("low <> high").orderBy("owner_id").first()
    if wrong:
        raise ValueError(f"vectors of unequal length: {wrong['owner_id']}")
    return update(spark, path, fresh, VECTOR_KEY,
                  lambda stored, new: replaced(stored, new, VECTOR_KEY))


def write_vectors(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    write_table(rows.withColumn("dims", F.size("embedding")), path, VECTOR_KEY, buckets)


def upsert_properties(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> int:
    """Present properties overwrite, absent (null) ones keep their value; new keys are added."""
    def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
        values = [c for c in new.columns if c not in keys]
        side = broadcast_if_small(new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values]))
        kept = stored.join(side, keys, "left").select(*keys, *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c)
            for c in stored.columns if c not in keys])
        held = stored.select(*keys).join(broadcast_if_small(new.select(*keys)), keys, "left_semi")
        added = new.join(broadcast_if_small(held), keys, "left_anti")
        return kept.unionByName(added, allowMissingColumns=True)

    return update(spark, path, cut_lineage(fresh), keys, merge)


def upsert_documents(spark: SparkSession, path: str, fresh: DataFrame) -> int:
    """Catalogue rows by owner and file; a missing link of a row that is written is built from its id."""
    link = F.nullif(F.col("link"), F.lit(""))
    stored = read_table(spark, path).join(broadcast_if_small(fresh.select(*FILE_KEY)), FILE_KEY, "left_semi")
    known = stored.select(*FILE_KEY, F.nullif(F.col("link"), F.lit("")).alias("_old"))
    rows = fresh.withColumn("link", link).join(broadcast_if_small(known), FILE_KEY, "left").withColumn(
        "link", F.coalesce("link", "_old", default_link("file_id"))).drop("_old")
    return upsert_properties(spark, path, rows, FILE_KEY)


def delete_keys(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> int:
    """Remove the rows of the given keys from a table in buckets by the same keys."""
    return update(spark, path, cut_lineage(gone.select(*keys).distinct()), keys, lambda stored, dead:
                  stored.join(broadcast_if_small(dead), keys, "left_anti"), may_empty=True)
