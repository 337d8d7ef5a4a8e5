"""Session helpers: local test session, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, name: str = "corvane", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of the shared folder and continue from the files.

    Loops keep short plans and survive lost executors. Unlike a checkpoint, a written table
    also has real sizes: the size estimate of a checkpoint is that of the plan behind it,
    which grows with each join of a loop until planning takes longer than the work.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_steps(*steps: DataFrame | None) -> None:
    """Delete the files of steps that ``cut_lineage`` wrote and nothing reads any more.

    Loops call it for step n - 1 once step n is written, so they hold two steps on the shared
    store. Frames that read anything but whole steps of this library are left alone.
    """
    for df in steps:
        if df is None:
            continue
        spark = df.sparkSession
        root = shared_dir(spark).split(":", 1)[-1].strip("/")
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if f"{root}/stage-" in folder and folder.split(f"{root}/", 1)[1].count("/") == 0:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the data: the next join shuffles it.

    Spark takes a side for small by the compressed bytes of its files, and does not count what an
    explode adds; such a side reaches the driver whole although its rows are many.
    """
    return df.hint("merge")


def within_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only for a side whose rows and bytes were counted; otherwise shuffle-join."""
    size = F.sum(F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def by_size(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Mark a join side that may be small or grow: broadcast if its rows were counted small, else shuffled.

    Beside a large table a small side spares the shuffle of that table.
    """
    counted = broadcast_if_small(df, max_rows)
    return by_shuffle(df) if counted is df else counted
