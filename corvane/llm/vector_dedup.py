"""Near-duplicate vectors: PCA-ordered, tiled comparison with early stops.

Unit vectors are turned into the axes of their principal components, so the leading numbers of a
vector hold most of it. Two unit vectors with cosine >= t are at most sqrt(2 - 2t) apart, also in
each axis; so a grid of that width over the two leading axes leaves only neighbouring cells to
compare. Cells are cut into tiles of bounded size, and pairs of tiles are compared in tasks:
leading axes first, the rest bounded by the product of the suffix norms; a tile pair, and then
each pair of vectors in it, stops as soon as the bound says that its cosine cannot reach t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chained, cut_lineage, local_roots

LINK = 0.98
#: Vectors of a tile.
TILE = 1024
#: Leading axes after which a pair may stop.
STOPS = (8, 16, 32)
#: Cosines nearer to the threshold than this are computed again from the given numbers.
CLOSE = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the vectors that can link: label not null, finite numbers only, and
    a norm above zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                       F.col("embedding").alias("v")).where("label is not null and v is not null")
    infinite = float("inf")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return v.where(good & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions: the axes (columns), most variance first.

    Tasks add up products of their vectors and Spark adds the sums, so the driver gets one matrix
    per number of dimensions, whatever the number of vectors.
    """
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist())
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = unit(matrix(part.column("v"), part.num_rows))
                total[d] = total.get(d, 0.0) + x.T @ x
        for d, m in total.items():
            at = np.arange(d * d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d * d, d, np.int32)), pa.array(at.astype(np.int64)),
                 pa.array(m.reshape(-1))], ["dims", "at", "x"])

    sums = classes.select("dims", "v").mapInArrow(products, "dims int, at long, x double")
    axes: dict[int, np.ndarray] = {}
    found = sums.groupBy("dims", "at").agg(F.sum("x").alias("x")).toArrow()  # packed, no row objects
    of, at, x = (found.column(c).to_numpy() for c in ("dims", "at", "x"))
    for d in np.unique(of).tolist():
        m = np.zeros(d * d)
        m[at[of == d]] = x[of == d]
        m = m.reshape(d, d)
        _, vectors = np.linalg.eigh((m + m.T) / 2)
        axes[d] = np.ascontiguousarray(vectors[:, ::-1])
    return axes


def linked_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine >= least; x, y in principal axes, a, b as given."""
    dims = x.shape[1]
    stops = [d for d in STOPS if d < dims]
    rest_x = np.sqrt(np.maximum(1 - np.cumsum(x * x, axis=1), 0))
    rest_y = np.sqrt(np.maximum(1 - np.cumsum(y * y, axis=1), 0))
    if not stops:
        at = np.nonzero(x @ y.T >= least - CLOSE)
        dot = np.einsum("ij,ij->i", x[at[0]], y[at[1]])
    else:
        d = stops[0]
        lead = x[:, :d] @ y[:, :d].T
        at = np.nonzero(lead + np.outer(rest_x[:, d - 1], rest_y[:, d - 1]) >= least - CLOSE)
        dot = lead[at]
        for d, end in zip(stops, [*stops[1:], dims]):
            step = 1 << 20
            dot = dot + np.concatenate([np.einsum(
                "ij,ij->i", x[at[0][k:k + step], d:end], y[at[1][k:k + step], d:end])
                for k in range(0, len(dot), step)] or [np.empty(0)])
            bound = dot + rest_x[at[0], end - 1] * rest_y[at[1], end - 1] if end < dims else dot
            on = bound >= least - CLOSE
            at, dot = (at[0][on], at[1][on]), dot[on]
            if not len(dot):
                break
    keep = dot >= least
    for k in np.nonzero(np.abs(dot - least) <= CLOSE)[0]:
        p, q = a[at[0][k]], b[at[1][k]]
        keep[k] = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= least
    return at[0][keep], at[1][keep]


def near_vectors(vectors: DataFrame, least: float = LINK, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id,
    kept.

    Vectors with equal, non-null labels and as many dimensions are linked when their cosine in
    double precision is at least ``least``. Null vectors, zero vectors and those with null or
    non-finite numbers link with nothing. Equal vectors are one class and are compared once;
    n_links counts rows, so a row that repeats links with its repeats. A row with a null vec_id
    is returned with a null component. An empty table gives no rows; other columns are not read.
    """
    v = usable(vectors)
    group = ["label", "dims", "v"]
    v = v.withColumn("dims", F.size("v"))
    classes = cut_lineage(v.where("vec_id is not null").groupBy(*group).agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    axes = principal_axes(classes)
    width = float(np.sqrt(max(2 - 2 * least, 1e-12)) * (1 + 1e-6))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist(), int)
            cells = np.zeros((batch.num_rows, 2), np.int64)
            for d in np.unique(dims):
                on = dims == d
                x = unit(matrix(batch.column("v").filter(pa.array(on)), int(on.sum())))
                lead = np.floor(x @ axes[d][:, :2] / width).astype(np.int64)
                cells[on, :lead.shape[1]] = lead
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])],
                [*batch.schema.names, "c1", "c2"])

    kind = classes.schema["label"].dataType.simpleString()
    numbers = classes.schema["v"].dataType.simpleString()
    cell = ["label", "dims", "c1", "c2"]
    located = cut_lineage(classes.mapInArrow(
        locate, f"label {kind}, dims int, v {numbers}, rep long, n long, c1 long, c2 long"))
    sizes = located.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = cut_lineage(sizes)
    tiled = located.join(sizes, cell).withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))

    # each cell meets itself and the neighbours behind it; a tile pair is one group
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    neighbour = F.explode(F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2"))
                                    for a, b in steps]))
    pairs = sizes.withColumn("s", neighbour).select(
        "label", "dims", "c1", "c2", F.col("tiles").alias("left_tiles"),
        (F.col("c1") + F.col("s.d1")).alias("e1"), (F.col("c2") + F.col("s.d2")).alias("e2"))
    others = sizes.select("label", "dims", F.col("c1").alias("e1"), F.col("c2").alias("e2"),
                          F.col("tiles").alias("right_tiles"))
    pairs = cut_lineage(pairs.join(others, ["label", "dims", "e1", "e2"]))
    same = (F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2"))
    whole = F.lit(0)
    columns = ["label", "dims", "c1", "c2", "e1", "e2", "lt", "rt", "side", "rep", "n", "v"]
    left = tiled.join(pairs, cell).withColumn("lt", F.col("tile")).withColumn("rt", F.explode(
        F.sequence(F.when(same, F.col("tile")).otherwise(whole), F.col("right_tiles") - 1))
    ).withColumn("side", F.lit(0))
    right = tiled.withColumnsRenamed({"c1": "e1", "c2": "e2"}).join(
        pairs, ["label", "dims", "e1", "e2"]).withColumn("rt", F.col("tile")).withColumn(
        "lt", F.explode(F.sequence(whole, F.when(same, F.col("tile")).otherwise(
            F.col("left_tiles") - 1)))).withColumn("side", F.lit(1))
    right = right.where(~(same & (F.col("lt") == F.col("rt"))))
    met = left.select(*columns).unionByName(right.select(*columns))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = np.asarray(t.column("side"))
        d = t.column("dims")[0].as_py()
        given = unit(matrix(t.column("v").combine_chunks(), t.num_rows))
        turned = given @ axes[d]
        rep, n = np.asarray(t.column("rep")), np.asarray(t.column("n"))
        alone = t.column("lt")[0] == t.column("rt")[0] and all(
            t.column(a)[0] == t.column(b)[0] for a, b in (("c1", "e1"), ("c2", "e2")))
        lefts = np.nonzero(side == 0)[0]
        rights = lefts if alone else np.nonzero(side == 1)[0]
        raw = matrix(t.column("v").combine_chunks(), t.num_rows)
        i, j = linked_pairs(turned[lefts], turned[rights], raw[lefts], raw[rights], least)
        i, j = lefts[i], rights[j]
        if alone:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, n[j], t.num_rows) + np.bincount(j, n[i], t.num_rows)
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = rep[order][local_roots(t.num_rows, place[i], place[j])[place]]
        on = links > 0
        return pa.table({"rep": rep[on], "links": links[on].astype(np.int64), "root": root[on]})

    found = cut_lineage(met.groupBy("label", "dims", "c1", "c2", "e1", "e2", "lt", "rt").applyInArrow(
        compare, "rep long, links long, root long"))
    roots = chained(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.select(*group, "rep", "n").join(links, "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left")
    by_row = v.join(classes, group).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"))
    by_row = by_row.where("vec_id is not null").distinct()
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_row, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      (component.isNull() | (component == F.col("vec_id"))).alias("kept"))
