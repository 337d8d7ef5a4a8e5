"""Vector search, keyword rerank and fusion with graph results, for many questions at once.

``queries(owner_id, query_id, question, embedding[, top_k])`` are searched in
``vectors(owner_id, chunk_id, embedding)`` of the same owner;
``chunks(owner_id, chunk_id, file_id, file_name, text, ..)`` hold the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.keys import default_link
from corvane.functions.text import normalize_text, split_words
from corvane.operators.graph import first_per
from corvane.session import cut_lineage, within_rows

Q = ["owner_id", "query_id"]
TOP_SCHEMA = "owner_id string, query_id string, chunk_id string, cosine double"


def _block_search():
    """The per-block kernel: cosine of a query matrix with a vector matrix, best k per query.

    Scores are rounded to ten digits before ranking so that equal vectors tie whatever the
    block they sit in; ties go to the smaller chunk id.
    """
    def unit(rows):
        matrix = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
        size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)

    def best(scores, ids, k):
        if len(scores) > k:
            bound = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= bound)
        else:
            near = np.arange(len(scores))
        order = np.lexsort((ids[near], -scores[near]))[:k]
        return near[order]

    def search(queries, vectors, ids, k):
        scores = np.round(queries @ vectors.T, 10) + 0.0
        return [(row[pick], ids[pick]) for row in scores for pick in (best(row, ids, k),)]

    return unit, best, search


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, max_local_queries: int = 4096,
                block_rows: int = 16384) -> DataFrame:
    """Exact cosine top k per question within the owner: ``(.., chunk_id, cosine, vec_rank)``.

    A batch of questions whose size was checked travels to every task once: the vector table
    is scanned where it lies, each task keeps k rows per question, and only those are
    shuffled. A larger batch is joined in blocks of bounded size, so neither side has to
    fit in one task; each pair of blocks again gives k rows per question.
    """
    asked = queries.select("owner_id", F.col("query_id").cast("string").alias("query_id"),
                           "embedding")
    stored = vectors.select("owner_id", "chunk_id", "embedding")
    if within_rows(asked, max_local_queries):
        found = _scan_search(asked, stored, k)
    else:
        found = _block_join_search(asked, stored, k, max_local_queries, block_rows)
    return first_per(found, Q, [F.desc("cosine"), "chunk_id"], k, "vec_rank")


def _scan_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    unit, best, search = _block_search()
    by_owner = {}
    for owner, rows in queries.toPandas().groupby("owner_id"):
        rows = rows.sort_values("query_id")
        by_owner[owner] = (rows["query_id"].to_numpy(dtype=object), unit(rows["embedding"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for frame in frames:
            for owner, rows in frame.groupby("owner_id"):
                if owner not in by_owner:
                    continue
                ids = rows["chunk_id"].to_numpy(dtype=object)
                fresh = search(by_owner[owner][1], unit(rows["embedding"]), ids, k)
                if owner in held:
                    merged = []
                    for (s0, i0), (s1, i1) in zip(held[owner], fresh):
                        s, i = np.concatenate([s0, s1]), np.concatenate([i0, i1])
                        pick = best(s, i, k)
                        merged.append((s[pick], i[pick]))
                    fresh = merged
                held[owner] = fresh
        for owner, results in held.items():
            names = by_owner[owner][0]
            yield pd.DataFrame({
                "owner_id": owner,
                "query_id": np.repeat(names, [len(s) for s, _ in results]),
                "chunk_id": np.concatenate([i for _, i in results]),
                "cosine": np.concatenate([s for s, _ in results]),
            })

    return vectors.mapInPandas(run, TOP_SCHEMA)


def _block_join_search(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int,
                       vector_rows: int, by: tuple[str, ...] = ("owner_id",)) -> DataFrame:
    """Best k of each question in the vectors with equal ``by``, block against block."""
    unit, _, search = _block_search()

    def counted(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    blocks = counted(queries, query_rows, "nq").join(counted(vectors, vector_rows, "nv"), [*by])

    def spread(df: DataFrame, key: str, mine: str, n_mine: str, other: str, n_other: str):
        return df.join(blocks, [*by]).withColumn(
            mine, F.pmod(F.xxhash64(key), F.col(n_mine)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("nq", "nv")

    key = [*by, "qb", "vb"]
    left = spread(queries, "query_id", "qb", "nq", "vb", "nv").groupBy(*key)
    right = spread(vectors, "chunk_id", "vb", "nv", "qb", "nq").groupBy(*key)

    def pair(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        columns = ["owner_id", "query_id", "chunk_id", "cosine"]
        if asked.empty or stored.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns}).astype(
                {"cosine": float})
        ids = stored["chunk_id"].to_numpy(dtype=object)
        found = search(unit(asked["embedding"]), unit(stored["embedding"]), ids, k)
        return pd.DataFrame({
            "owner_id": asked["owner_id"].iloc[0],
            "query_id": np.repeat(asked["query_id"].to_numpy(dtype=object),
                                  [len(s) for s, _ in found]),
            "chunk_id": np.concatenate([i for _, i in found]),
            "cosine": np.concatenate([s for s, _ in found]),
        }).astype({c: object for c in columns[:3]})

    return left.cogroup(right).applyInPandas(pair, TOP_SCHEMA)


# --- Inverted file --------------------------------------------------------

@dataclass
class InvertedFile:
    """Vectors in lists around centroids, with the widest angle of each list.

    ``members(owner_id, list_id, chunk_id, embedding)``;
    ``lists(owner_id, list_id, centroid, radius, n)`` with unit centroids.
    """

    members: DataFrame
    lists: DataFrame


def inverted_file(vectors: DataFrame, most_lists: int = 64, sample_rows: int = 2048,
                  rounds: int = 4, block_rows: int = 8192) -> InvertedFile:
    """Deal each owner's vectors to the nearest of at most ``most_lists`` centroids.

    Centroids are learned from at most ``sample_rows`` vectors of an owner, chosen by hash; every
    vector is a member of one list. They decide how much a search can skip, never its result.
    """
    unit, _, _ = _block_search()
    stored = vectors.select("owner_id", "chunk_id", "embedding")
    sample = first_per(stored, ["owner_id"], [F.xxhash64("chunk_id"), "chunk_id"], sample_rows)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(rows.sort_values("chunk_id")["embedding"])
        centres = x[np.linspace(0, len(x) - 1, min(most_lists, int(np.ceil(np.sqrt(len(x)))))).astype(int)]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1)
            centres = unit([x[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        return pd.DataFrame({"owner_id": rows["owner_id"].iloc[0], "list_id": np.arange(len(centres)),
                             "centroid": list(centres)})

    centroids = cut_lineage(sample.groupBy("owner_id").applyInPandas(
        learn, "owner_id string, list_id int, centroid array<double>"))
    blocks = stored.groupBy("owner_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = stored.join(blocks, "owner_id").withColumn(
        "block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")).drop("blocks")
    everywhere = centroids.join(blocks, "owner_id").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in ("owner_id", "list_id", "chunk_id", "embedding", "cosine")})
        near = near.sort_values("list_id")
        cosines = unit(rows["embedding"]) @ np.stack(near["centroid"]).T
        own = cosines.argmax(axis=1)
        return rows[["owner_id", "chunk_id", "embedding"]].assign(
            list_id=near["list_id"].to_numpy()[own], cosine=cosines[np.arange(len(own)), own])[
            ["owner_id", "list_id", "chunk_id", "embedding", "cosine"]]

    key = ["owner_id", "block"]
    members = cut_lineage(dealt.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInPandas(
        assign, "owner_id string, list_id int, chunk_id string, embedding array<double>, cosine double"))
    angle = F.acos(F.greatest(F.least(F.min("cosine"), F.lit(1.0)), F.lit(-1.0))) + 1e-7
    sizes = members.groupBy("owner_id", "list_id").agg(F.count("*").alias("n"), angle.alias("radius"))
    return InvertedFile(members.drop("cosine"), cut_lineage(sizes.join(centroids, ["owner_id", "list_id"])))


def indexed_topk(queries: DataFrame, index: InvertedFile, k: int, query_rows: int = 4096,
                 vector_rows: int = 16384) -> tuple[DataFrame, DataFrame]:
    """The rows of ``vector_topk`` from an inverted file, and which lists were read for each question.

    No vector of a list is nearer to a question than the angle to its centroid less its radius. The
    nearest lists that hold k vectors are searched first; of the others only those that can beat the
    worst of these k. So the result is exact. Everything is joined by (owner, list) in blocks; no
    part of it passes through the driver.
    """
    def unit(c: str) -> Column:
        size = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        return F.transform(c, lambda x: F.when(size > 0, x / size).otherwise(0.0))

    asked = queries.select("owner_id", F.col("query_id").cast("string").alias("query_id"), "embedding")
    met = asked.withColumn("u", unit("embedding")).join(index.lists, "owner_id").withColumn(
        "cosine", F.aggregate(F.zip_with("u", "centroid", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    away = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))) - F.col("radius")
    nearest = W.partitionBy(*Q).orderBy("away", "list_id").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("away", away).select(
        *Q, "list_id", "n", F.when(F.col("away") <= 0, 1.0).otherwise(F.cos("away")).alias("best"),
        (F.coalesce(F.sum("n").over(nearest), F.lit(0)) < k).alias("first"))
    met = cut_lineage(met)

    def search(lists: DataFrame) -> DataFrame:
        return cut_lineage(_block_join_search(
            lists.select(*Q, "list_id").join(asked, Q), index.members, k, query_rows, vector_rows,
            ("owner_id", "list_id")))

    begun = search(met.where("first"))
    worst = first_per(begun, Q, [F.desc("cosine"), "chunk_id"], k).groupBy(*Q).agg(
        F.min("cosine").alias("worst"), F.count("*").alias("held"))
    probes = cut_lineage(met.join(worst, Q, "left").select(
        *Q, "list_id", "n", "first", (F.col("first") | (F.coalesce("held", F.lit(0)) < k)
                                      | (F.col("best") + 1e-9 >= F.col("worst"))).alias("read")))
    rest = search(probes.where("read and not first"))
    hits = first_per(begun.unionByName(rest), Q, [F.desc("cosine"), "chunk_id"], k, "vec_rank")
    return hits, probes.drop("first")


def round4(value: Column) -> Column:
    """Four digits; the last bits of a sum do not decide how a half is rounded."""
    return F.round(F.round(value, 10), 4)


def similarity(cosine: Column | str) -> Column:
    """Cosine distance in [0, 2] as a similarity in [0, 1], four digits."""
    c = F.col(cosine) if isinstance(cosine, str) else cosine
    return F.round(F.greatest(F.lit(0.0), 1 - (1 - c) / 2), 4)


def candidate_columns(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join the chunk columns to search hits, with defaults for missing metadata."""
    joined = hits.join(chunks, ["owner_id", "chunk_id"], "left")
    present = set(chunks.columns)

    def with_default(name: str, default: Column) -> Column:
        return (F.coalesce(name, default) if name in present else default).alias(name)

    return joined.select(
        *hits.columns,
        with_default("text", F.lit("")),
        with_default("file_name", F.lit("Unknown")),
        with_default("file_id", F.lit("")),
        with_default("chunk_index", F.lit(0)),
        with_default("page_estimate", F.lit(1)),
        with_default("line_start", F.lit(0)),
        with_default("line_end", F.lit(0)),
        (F.coalesce(F.col("link"), default_link("file_id")) if "link" in present
         else default_link("file_id")).alias("link"),
    )


# --- Keywords -------------------------------------------------------------

def with_keyword_score(df: DataFrame, question: str = "question", text: str = "text",
                       file_name: str = "file_name", name: str = "keyword_score") -> DataFrame:
    """Share of question words in the text and in the file name, and a phrase bonus, in [0, 1].

    Each normal form is computed once per row, in a projection of its own.
    """
    forms = df.withColumn("_q", normalize_text(question)).withColumn(
        "_t", normalize_text(text)).withColumn("_f", normalize_text(file_name))
    words = forms.withColumn("_qw", F.array_distinct(split_words(F.col("_q"), 2))).withColumn(
        "_tw", split_words(F.col("_t"), 2)).withColumn("_fw", split_words(F.col("_f"), 2)
    ).withColumn("_all", F.concat("_t", F.lit(" "), "_f"))
    n = F.size("_qw")
    in_text = F.size(F.array_intersect("_qw", "_tw")) / n
    in_name = F.size(F.array_intersect("_qw", "_fw")) / n
    long_words = F.filter("_qw", lambda w: F.length(w) >= 4)
    bonus = (
        F.when((F.length("_q") >= 4) & F.contains("_all", F.col("_q")), 1.0)
        .when((F.length("_q") >= 3) & (F.size(long_words) > 0)
              & F.forall(long_words, lambda w: F.contains(F.col("_all"), w)), 0.6)
        .otherwise(0.0)
    )
    score = 0.65 * in_text + 0.25 * in_name + 0.10 * bonus
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return words.withColumn(name, F.when(n == 0, 0.0).otherwise(bounded)).drop(
        "_q", "_t", "_f", "_qw", "_tw", "_fw", "_all")


def blend_weights(vector_weight: float, keyword_weight: float) -> tuple[float, float]:
    """Weights clipped to [0, 1] and scaled to sum 1; 0.85 and 0.15 when both are zero."""
    v, w = (min(1.0, max(0.0, x)) for x in (vector_weight, keyword_weight))
    return (v / (v + w), w / (v + w)) if v + w > 0 else (0.85, 0.15)


def hybrid_scores(candidates: DataFrame, vector_weight: float | None = None,
                  keyword_weight: float | None = None) -> DataFrame:
    """Blend ``vector_score`` with the keyword score; four digits each."""
    v, w = blend_weights(
        lx.VECTOR_WEIGHT if vector_weight is None else vector_weight,
        lx.KEYWORD_WEIGHT if keyword_weight is None else keyword_weight)
    return with_keyword_score(candidates).withColumn(
        "combined_score",
        round4(F.lit(v) * F.col("vector_score") + F.lit(w) * F.col("keyword_score"))
    ).withColumn("keyword_score", F.round("keyword_score", 4))


def retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, top_k: int | None = None,
             min_score: float | None = None, file_id: str | None = None,
             hits: DataFrame | None = None) -> DataFrame:
    """Vector candidates, reranked with keywords, above a score, best ``top_k`` per question.

    A ``top_k`` column of the questions overrides the argument. ``hits`` are the rows of a
    ``vector_topk`` that was made before, of at least as many candidates.
    """
    top_k = lx.TOP_K if top_k is None else top_k
    min_score = lx.MIN_SCORE if min_score is None else min_score
    limits = queries.withColumn("_k", F.coalesce(F.col("top_k"), F.lit(top_k))
                                if "top_k" in queries.columns else F.lit(top_k))
    if "top_k" in queries.columns:
        widest = lx.MAX_CANDIDATES
    else:
        widest = min(top_k * lx.CANDIDATE_MULTIPLIER, lx.MAX_CANDIDATES)
    if file_id is not None:
        wanted = chunks.filter(F.col("file_id") == file_id).select("owner_id", "chunk_id")
        vectors = vectors.join(wanted, ["owner_id", "chunk_id"], "left_semi")
    if hits is None:
        hits = vector_topk(queries, vectors, widest)
    asked = limits.select("owner_id", F.col("query_id").cast("string").alias("query_id"),
                          "question", "_k")
    cap = F.least(F.col("_k") * lx.CANDIDATE_MULTIPLIER, F.lit(lx.MAX_CANDIDATES))
    candidates = candidate_columns(hits.join(asked, Q).filter(F.col("vec_rank") <= cap), chunks)
    scored = hybrid_scores(candidates.withColumn("vector_score", similarity("cosine")))
    kept = scored.filter(F.col("combined_score") >= min_score)
    return first_per(kept, Q, [F.desc("combined_score"), "vec_rank"], F.col("_k"), "rank").drop(
        "_k")


# --- Fusion ---------------------------------------------------------------

def hybrid_fusion(vector: DataFrame, graph: DataFrame, params: DataFrame) -> DataFrame:
    """Weighted union of vector and graph hits: ``(.., chunk_id, combined_score, source)``.

    ``vector(.., chunk_id, score, rank)`` and ``graph(.., chunk_id, graph_score, graph_rank)``
    hold the best 2n per question, ``params(.., alpha, n)`` the weight and the size.
    A question with hits on one side only keeps that side's scores.
    """
    v = vector.select(*Q, "chunk_id", F.col("score").alias("v"), F.col("rank").alias("v_rank"))
    g = graph.select(*Q, "chunk_id", F.col("graph_score").alias("g"),
                     F.col("graph_rank").alias("g_rank"))
    rows = v.join(g, [*Q, "chunk_id"], "full_outer").join(params.select(*Q, "alpha", "n"), Q)
    w = W.partitionBy(*Q)
    rows = rows.withColumn("has_v", F.count("v").over(w) > 0).withColumn(
        "has_g", F.count("g").over(w) > 0)
    vs, gs = F.coalesce("v", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    combined = (
        F.when(~F.col("has_g"), vs).when(~F.col("has_v"), gs)
        .otherwise(round4(F.col("alpha") * vs + (1 - F.col("alpha")) * gs))
    )
    source = (
        F.when(F.col("g").isNull(), "vector").when(F.col("v").isNull(), "graph")
        .otherwise("hybrid")
    )
    return rows.select(
        *Q, "chunk_id", vs.alias("vector_score"), gs.alias("graph_score"),
        combined.alias("combined_score"), source.alias("source"), "n", "v_rank", "g_rank",
        "has_v", "has_g")


def protected_ranking(fused: DataFrame) -> DataFrame:
    """The best n vector hits keep their order and come first; the rest follows by score."""
    shielded = F.col("v_rank").isNotNull() & (F.col("v_rank") <= F.col("n"))
    alone = ~F.col("has_v")
    order = [
        F.when(shielded, 0).otherwise(1),
        F.when(shielded, F.col("v_rank")).otherwise(0),
        F.when(alone, F.col("g_rank")).otherwise(0),
        F.desc("combined_score"),
        F.coalesce(F.col("v_rank"), F.lit(1_000_000) + F.col("g_rank")),
    ]
    return first_per(fused, Q, order, F.col("n"), "rank").drop("v_rank", "g_rank", "has_v",
                                                               "has_g")
