"""Poisson replication: exact draws, rates, and defined edge cases."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import mixing


def uniform(*parts):
    text = "|".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def draw(doc, rate):
    parts = max(1, math.ceil(rate / mixing.PART_MEAN))
    total = 0
    for part in range(1, parts + 1):
        u, k, mean = uniform(mixing.SEED, doc, part), 0, rate / parts
        term = below = math.exp(-mean)
        while below <= u:
            k += 1
            term = term * mean / k
            below += term
        total += k
    return total


def test_draws_invert_the_distribution(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") < 300, "big").when(F.col("id") < 340, "mid").otherwise("small").alias("source"),
        F.lit("t").alias("text"))
    weights = spark.createDataFrame([("big", 1.0), ("mid", 3.0), ("absent", 5.0)],
                                    "source string, weight double")
    got = Counter(r["doc_id"] for r in mixing.mix(docs, weights, total=4000).collect())
    rates = {"big": 4000 / 4 / 300, "mid": 4000 * 0.75 / 40, "small": 0.0}
    want = {d: draw(d, rates["big" if d < 300 else "mid"]) for d in range(340)}
    assert got == Counter({d: n for d, n in want.items() if n})
    assert abs(sum(got.values()) - 4000) < 4 * 4000 ** 0.5


def test_draws_do_not_depend_on_partitions(documents):
    one = mixing.mix(documents).drop("text").collect()
    two = mixing.mix(documents.repartition(7)).drop("text").collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_edges(documents, no_documents, clashing):
    assert mixing.mix(no_documents).count() == 0
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(documents).collect()}
    sizes = Counter(r["source"] for r in documents.collect())
    whole = sum(n ** 0.5 for n in sizes.values())
    for source, n in sizes.items():
        assert math.isclose(rates[source], sum(sizes.values()) * n ** 0.5 / whole / n, rel_tol=1e-6)
    out = mixing.mix(clashing, total=200)
    assert sorted(out.columns) == sorted({*clashing.columns, "mix_copies", "mix_copy", "mix_key"})
    groups = {}
    for r in out.select("doc_id", "mix_copies", "mix_copy").collect():
        groups.setdefault(r["doc_id"], []).append((r["mix_copies"], r["mix_copy"]))
    for doc, rows in groups.items():
        n = rows[0][0]
        times = 2 if doc == 11 else 1
        assert sorted(c for _, c in rows) == sorted(list(range(1, n + 1)) * times)
