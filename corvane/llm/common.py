"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.encoders import SLICE_CHARS, slices
from corvane.session import cut_lineage, drop_steps

__all__ = ["chained", "cut_lineage", "local_roots", "sliced", "table"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_CHARS
           ) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``most`` characters, or one text."""
    for batch in batches:
        sizes = [x or 0 for x in pc.utf8_length(batch.column(text)).to_pylist()]
        for begin, end in slices(sizes, most):
            yield batch.slice(begin, end - begin)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def chained(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 100
            ) -> DataFrame:
    """Connected components: (node, root) with the smallest reachable node as root.

    ``edges`` has long columns a and b; nodes without an edge are not returned. Stars are grown
    and shrunk in turn (each node points at the smallest node it knows of), so the rounds grow
    with the logarithm of the longest chain. A round is two partial aggregations and two joins;
    nothing is gathered per node, so a node with very many links is no hot group. Each round is
    written to the shared folder, and the one before it deleted.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut_lineage(e.distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"),
                                                            F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b")))
                            .where("a <> b").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_steps(e)
        e = after
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds; chains double each round")
