"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage, sliced
from corvane.llm.encoders import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Lengths per block of the suffix sums.
BLOCK = 256


def token_lengths(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)
                  ) -> DataFrame:
    """``keep`` and n_tokens, the encoded length of the whole text (null and empty: 0)."""
    path = path or vocabulary(VOCABULARY)
    docs = docs.select(*keep, "text")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in sliced(batches, "text"):
            lengths = [len(i) for i in encode(batch.column("text").to_pylist())]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64())],
                                             [*(f.name for f in fields), "n_tokens"])

    return docs.mapInArrow(count, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with sums over all shorter and all longer documents.

    Columns: length, n_docs, docs_over (longer documents), tokens_over (their tokens), docs_upto,
    tokens_upto, truncated_tokens (tokens kept when each document is cut to ``length``), rank
    (docs_upto divided by all documents). Documents are summed up by length in each task before
    the shuffle; running sums are made within blocks of lengths and over blocks, so no task
    reads all lengths.
    """
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    counts = cut_lineage(counts.withColumn("tokens", F.col("length") * F.col("n_docs"))
                         .withColumn("block", F.floor(F.col("length") / BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    ahead = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bd").over(ahead), F.lit(0)).alias("over_d"),
        F.coalesce(F.sum("bt").over(ahead), F.lit(0)).alias("over_t"),
        F.sum("bd").over(every).alias("all_d"), F.sum("bt").over(every).alias("all_t"))
    within = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    out = counts.withColumns({
        "in_d": F.coalesce(F.sum("n_docs").over(within), F.lit(0)),
        "in_t": F.coalesce(F.sum("tokens").over(within), F.lit(0))}).join(blocks, "block")
    docs_over, tokens_over = F.col("in_d") + F.col("over_d"), F.col("in_t") + F.col("over_t")
    return out.select(
        "length", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("all_d") - docs_over).alias("docs_upto"),
        (F.col("all_t") - tokens_over).alias("tokens_upto"),
        (F.col("all_t") - tokens_over + docs_over * F.col("length")).alias("truncated_tokens"),
        ((F.col("all_d") - docs_over) / F.col("all_d")).alias("rank"))


def kept_tokens(histogram: DataFrame, limit: int | Column) -> DataFrame:
    """Totals for one context limit, also one that no document has: tokens (all), kept_tokens
    (each document cut to the limit), docs_cut."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    n, length = F.col("n_docs"), F.col("length")
    return histogram.agg(F.sum(n * length).alias("tokens"),
                         F.sum(n * F.least(length, limit)).alias("kept_tokens"),
                         F.sum(F.when(length > limit, n).otherwise(0)).alias("docs_cut"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of the documents does not exceed."""
    return histogram.where(F.col("rank") >= q).agg(F.min("length").alias("length"))
