"""Mix sources to target weights by Poisson replication, with DataFrame functions only.

Each document of a source is repeated a Poisson number of times whose mean is the source's
target repetition rate. The number comes from inverting the distribution at a uniform number
that a hash of (seed, doc_id) gives, so it does not depend on partitions, order or retries, and
documents decide independently: no counts are passed between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage
from corvane.session import broadcast_if_small

#: Means above this are split into equal parts that are drawn apart and added up.
PART_MEAN = 16.0
#: Terms of the inverted distribution; beyond, a Poisson variable of mean 16 has mass 1e-28.
TERMS = 80
SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"),
                                         F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5,
                     total: int | None = None) -> DataFrame:
    """source, n_docs, weight, rate: the mean number of copies of each document of a source.

    ``weights`` has (source, weight); sources without a weight get 0 and leave the mixture. By
    default a source weighs its number of documents to the power ``exponent``. The copies of all
    sources number ``total`` on average (default: as many as there are documents). A null source
    is a source of its own. Weights are summed as decimals, so the sum has no order.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(exponent)))
    else:
        given = weights.select(F.col("source").alias("_s"),
                               F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        sizes = sizes.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = cut_lineage(sizes)
    whole = sizes.agg(F.sum(F.col("weight").cast("decimal(28,6)")).cast("double").alias("_w"),
                      F.sum("n_docs").alias("_n")).first()
    wanted = float(whole["_n"] or 0 if total is None else total)
    share = F.col("weight") / F.lit(whole["_w"] or 1.0)
    return sizes.withColumn("rate", F.lit(wanted) * share / F.col("n_docs"))


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson variable."""
    first = F.exp(-mean)

    def step(s: Column, k: Column) -> Column:
        term = s["t"] * mean / k
        return F.struct(term.alias("t"), (s["c"] + term).alias("c"),
                        F.concat(s["a"], F.array(s["c"] + term)).alias("a"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)),
                       F.struct(first.alias("t"), first.alias("c"), F.array(first).alias("a")),
                       step, lambda s: s["a"])


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Add mix_copies, the number of times that each row is repeated."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    table = rates.select(F.col("source").alias("_source"), parts.alias("_parts"),
                         distribution(F.col("rate") / parts).alias("_cdf"))
    joined = docs.join(broadcast_if_small(table), F.col("source").eqNullSafe(F.col("_source")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda total, part: total + F.size(F.filter(
            "_cdf", lambda c: c <= uniform(F.lit(seed), F.col("doc_id"), part))))
    return joined.withColumn("mix_copies", drawn).drop("_source", "_parts", "_cdf")


def mix(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5,
        total: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixture: the rows of ``docs`` repeated by source, in a global random order.

    Adds mix_copies, mix_copy (from 1) and mix_key (32 hex digits; rows are dealt by it and
    sorted by it in each partition); columns of these names in ``docs`` are replaced. Rows that
    repeat a doc_id draw the same number. Null doc_ids draw alike; a null text is a document
    like any other; an empty table gives no rows. The one shuffle moves each copy once, by a
    hash, so a source that holds most rows is spread evenly.
    """
    docs = docs.drop("mix_copies", "mix_copy", "mix_key")
    rates = repetition_rates(docs, weights, exponent, total)
    copies = with_copies(docs, rates, seed).where("mix_copies > 0")
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"),
                                                         F.lit("null")), "mix_copy"))
    return copies.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
