"""Communities of the weighted entity graph, their texts, and the ones a question needs.

``graph(owner_id, a, b, weight, rel_type, description)`` holds one row per unordered pair
of entities; ``membership(owner_id, node, comm)`` one row per entity.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import keys
from corvane.functions import lexicon as lx
from corvane.functions.text import (
    normalize_name, normalize_text, relation_type, tokenize, trim_blank,
)
from corvane.operators.canonical import alias_table, is_blocked, resolve_alias
from corvane.operators.graph import first_per, largest_limit
from corvane.session import by_shuffle, by_size, cut_lineage, drop_steps


def edge_weight(rel_type: Column | str) -> Column:
    """Co-occurrence below generic and system relations below telling relations."""
    given = F.col(rel_type) if isinstance(rel_type, str) else rel_type
    raw = F.upper(trim_blank(F.coalesce(given, F.lit(""))))
    return (
        F.when(raw == "COOCCURS_WITH", lx.COOCCURRENCE_WEIGHT)
        .when(raw.isin(lx.SYSTEM_RELATIONS) | (relation_type(given) == "RELATED_TO"),
              lx.RELATED_WEIGHT)
        .otherwise(lx.RELATED_WEIGHT * lx.SEMANTIC_WEIGHT_FACTOR)
    )


def entity_graph(edges: DataFrame) -> DataFrame:
    """Undirected weights between entities; parallel edges add up, the first type is kept."""
    order = F.struct("rel_type", "description", "src")
    return edges.filter("src <> dst").groupBy(
        "owner_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(edge_weight("rel_type")).alias("weight"),
        F.min_by("rel_type", order).alias("rel_type"),
        F.min_by("description", order).alias("description"))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Weight of each edge between two entities; parallel edges stay apart."""
    return edges.filter("src <> dst").select("owner_id", F.col("src").alias("a"), F.col("dst").alias("b"),
                                             edge_weight("rel_type").alias("weight"))


def _both_ways(graph: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                   F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return graph.select("owner_id", "weight", F.explode(ends).alias("e")).select(
        "owner_id", "e.src", "e.dst", "weight")


def _best_moves(links: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    """Per node: the neighbouring community of highest gain, and the gain of staying."""
    sizes = state.groupBy("owner_id", "comm").agg(F.sum("degree").alias("tot"))
    near = links.join(state.select("owner_id", F.col("node").alias("dst"), "comm"),
                      ["owner_id", "dst"]).groupBy(
        "owner_id", F.col("src").alias("node"), "comm").agg(F.sum("weight").alias("w"))
    own = state.select("owner_id", "node", "comm", F.lit(0.0).alias("w"))
    options = near.unionByName(own).groupBy("owner_id", "node", "comm").agg(
        F.sum("w").alias("w"))
    scored = (
        options.join(sizes, ["owner_id", "comm"])
        .join(state.select("owner_id", "node", "degree", F.col("comm").alias("home")),
              ["owner_id", "node"])
        .join(totals, "owner_id")
    )
    rest = F.col("tot") - F.when(F.col("comm") == F.col("home"), F.col("degree")).otherwise(0.0)
    gain = F.col("w") - rest * F.col("degree") / F.col("two_m")
    return scored.withColumn("gain", gain).groupBy("owner_id", "node", "degree", "home").agg(
        F.min(F.struct((-F.col("gain")).alias("minus"), "comm")).alias("best"),
        F.max(F.when(F.col("comm") == F.col("home"), F.col("gain"))).alias("stay"))


#: Links of the nodes that one task moves; a node with more moves by itself, from sums.
BLOCK_LINKS = 500_000
#: Links of an owner that one task settles whole (about 40 bytes each in its Python).
OWNER_LINKS = 40_000_000
#: Links that such a task sorts or adds up at once.
LEVEL_LINKS = 1_000_000


def _moves(ends: list[int], inner: np.ndarray, outer: np.ndarray | None, weight: np.ndarray, degree: list[float],
           comm: list[int], tot: list[float], two_m: float) -> list[int]:
    """Communities of nodes after single moves, one after the other, until none gains.

    Node i has the links ``ends[i]`` to ``ends[i + 1]``; a link leads to node ``inner`` or, where that is
    negative, into community ``outer``. After a move only the neighbours of the node are scored again.
    """
    waiting, waits = deque(range(len(comm))), [True] * len(comm)
    while waiting:
        i = waiting.popleft()
        waits[i] = False
        here, k = comm[i], degree[i]
        first, last = ends[i], ends[i + 1]
        near, mine = {here: 0.0}, inner[first:last].tolist()
        if outer is not None:
            mine_in = [comm[j] if j >= 0 else o for j, o in zip(mine, outer[first:last].tolist())]
        else:
            mine_in = [comm[j] for j in mine]
        for c, w in zip(mine_in, weight[first:last].tolist()):
            if c in near:
                near[c] += w
            else:
                near[c] = w
        share = k / two_m
        most, best = near.pop(here) - (tot[here] - k) * share + 1e-9, here
        for c, w in near.items():
            gain = w - tot[c] * share
            if gain > most or (gain == most and here != best > c):
                most, best = gain, c
        if best != here:
            comm[i] = best
            tot[here] -= k
            tot[best] += k
            for j in mine:
                if j >= 0 and not waits[j] and comm[j] != best:
                    waits[j] = True
                    waiting.append(j)
    return comm


def _places(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sorted ids of both ends of the links, and the place of each end among them."""
    if pa.types.is_integer(table.schema.field("a").type):
        a, b = (table[c].to_numpy() for c in "ab")
        names = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        return pa.array(names), *(np.searchsorted(names, x).astype(np.int32) for x in (a, b))
    names = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().unique()
    names = names.take(pc.sort_indices(names))
    return names, *(pc.index_in(table[c], value_set=names).to_numpy().astype(np.int32) for c in "ab")


def _slices(*columns: np.ndarray):
    """The columns in slices of LEVEL_LINKS rows."""
    for at in range(0, len(columns[0]), LEVEL_LINKS):
        yield [c[at:at + LEVEL_LINKS] for c in columns]


def _by_source(ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (source, end, weight) in the order of their source: ``ends`` of the nodes, ends, weights, and degrees.

    Links are placed slice by slice, so that beside them only a slice is held more than once.
    """
    held, degree = np.zeros(n, np.int64), np.zeros(n)
    for way in ways:
        for s, w in _slices(way[0], way[2]):
            held += np.bincount(s, minlength=n)
            degree += np.bincount(s, w, n)
    ends = np.concatenate([[0], np.cumsum(held)])
    at, dst = ends[:-1].copy(), np.empty(ends[-1], ways[0][1].dtype)
    weight = np.empty(ends[-1], ways[0][2].dtype)
    for way in ways:
        for s, d, w in _slices(*way):
            order = np.argsort(s, kind="stable")
            s = s[order]
            to = at[s] + np.arange(len(s)) - np.searchsorted(s, s)
            dst[to], weight[to] = d[order], w[order]
            at += np.bincount(s, minlength=n)
    return ends, dst, weight, degree


def _level(ends: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, place: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between communities, numbered below ``n`` at the places of their nodes, by source.

    Nodes are taken in the order of their community, and the links of a slice added up. Where a slice
    ends within a community, its links to one other may stay apart.
    """
    order = np.argsort(place, kind="stable")
    held = np.diff(ends)[order]
    cuts = np.flatnonzero(np.diff(np.cumsum(held) // LEVEL_LINKS)) + 1
    count, to, sums = np.zeros(n, np.int64), [np.zeros(0, np.int32)], [np.zeros(0)]
    for nodes in np.split(order, cuts):
        n_links = ends[nodes + 1] - ends[nodes]
        at = np.arange(n_links.sum()) + np.repeat(ends[nodes] - np.cumsum(n_links) + n_links, n_links)
        x, y = np.repeat(place[nodes], n_links), place[dst[at]]
        apart = x != y
        links, link = np.unique(x[apart] * n + y[apart], return_inverse=True)
        sums.append(np.bincount(link, weight[at[apart]], len(links)))
        to.append((links % max(n, 1)).astype(np.int32))
        count += np.bincount(links // max(n, 1), minlength=n)
    return np.concatenate([[0], np.cumsum(count)]), np.concatenate(to), np.concatenate(sums)


def _settle_owner(table: pa.Table) -> pa.Table:
    """Communities of an owner whose whole graph is one block: (owner_id, a, b, weight) rows.

    Nodes move, then whole communities as nodes of the smaller graph, and again until nothing moves.
    """
    names, a, b = _places(table)
    weight = table["weight"].to_numpy().astype(float)
    short = weight.astype(np.float32)
    if np.array_equal(weight, short):
        weight = short
    ends, dst, weight, degree = _by_source([(a, b, weight), (b, a, weight)], len(names))
    two_m = float(degree.sum())
    del a, b, short

    def settled(ends, dst, weight, degree, comm):
        return np.array(_moves(ends.tolist(), dst, None, weight, degree.tolist(), comm.tolist(),
                               np.bincount(comm, degree, len(comm)).tolist(), two_m))

    comm = np.arange(len(names))
    while True:
        before = comm
        comm = settled(ends, dst, weight, degree, comm)
        while True:
            used, place = np.unique(comm, return_inverse=True)
            n = len(used)
            up = settled(*_level(ends, dst, weight, n, place), np.bincount(place, degree, n), np.arange(n))
            if (up == np.arange(n)).all():
                break
            comm = used[up[place]]
        if np.array_equal(before, comm):
            owner = table["owner_id"].combine_chunks()[:1].take(pa.array(np.zeros(len(names), np.int64)))
            return pa.table({"owner_id": owner, "node": names, "comm": names.take(pa.array(comm))})


def _settle(table: pa.Table) -> pa.Table:
    """Move the nodes of one block one after the other until none gains.

    Rows are links (src, degree, home, home_tot, dst, comm, tot, weight, two_m). Communities of nodes
    outside the block stay as they are. After a move only the neighbours of the node are scored
    again. Every move raises the modularity as the block sees it, so the moves end.
    """
    names = pa.chunked_array([*table["home"].chunks, *table["comm"].chunks]).combine_chunks().unique()
    names = names.take(pc.sort_indices(names))  # ties go to the smallest community
    nodes = table["src"].combine_chunks().unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    column = {c: table[c].to_numpy() for c in ("degree", "home_tot", "tot", "weight", "two_m")}
    src, inner, home, outer = (pc.fill_null(pc.index_in(table[c], value_set=v), -1).to_numpy()
                               for c, v in (("src", nodes), ("dst", nodes), ("home", names), ("comm", names)))
    tot = np.zeros(len(names))
    tot[outer], tot[home] = column["tot"], column["home_tot"]
    degree, comm = np.zeros(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
    degree[src], comm[src] = column["degree"], home
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist()
    inner, outer, weight = (x[order] for x in (inner, outer, column["weight"]))
    comm = _moves(ends, inner, outer, weight, degree.tolist(), comm.tolist(), tot.tolist(),
                  float(column["two_m"][0]))
    return pa.table({"owner_id": table["owner_id"].combine_chunks()[:1].take(
        pa.array(np.zeros(len(nodes), dtype=np.int64))), "node": nodes, "best": names.take(pa.array(comm))})


def _local_moves(links: DataFrame, nodes: DataFrame, totals: DataFrame, most_left: float = 0.0,
                 block_links: int = BLOCK_LINKS) -> DataFrame:
    """Move nodes to the neighbouring community of highest modularity gain until none gains, or
    at most the share ``most_left`` of them moved in a sweep.

    ``links`` are directed both ways without self loops, ``nodes`` carry degree and comm. Nodes are
    dealt to blocks of about ``block_links`` links: an owner with few links is one block, otherwise
    communities are dealt by hash and large communities split by node. Each block is settled in its
    own task against the communities that the others had before. A node with more links than a block
    takes its best move from sums by community instead. Where an owner has several blocks, a turn
    moves only a part of them, every ten sweeps the parts get smaller, and a block that moves alone
    raises the modularity; so the sweeps end. Ties go to the smallest community.
    """
    count = links.groupBy("owner_id", F.col("src").alias("node")).agg(F.count("*").alias("n"))
    state = cut_lineage(nodes.select("owner_id", "node", "degree", "comm").join(
        count, ["owner_id", "node"], "left").fillna(0, ["n"]))
    owners = cut_lineage(totals.join(state.groupBy("owner_id").agg(
        F.ceil(F.sum("n") / block_links).alias("blocks"),
        F.max("n").alias("most")), "owner_id"))
    facts = owners.agg(F.max("blocks"), F.max("most")).first()
    split, heavy = (facts[0] or 0) > 1, (facts[1] or 0) > block_links
    enough = most_left * state.count()
    sweep = moved_in_sweep = turn = 0
    while True:
        parts = 2 + sweep // 10 if split or heavy else 1
        sizes = state.groupBy("owner_id", "comm").agg(F.sum("degree").alias("tot"),
                                                      F.sum("n").alias("held"))
        block = F.when(F.col("held") > block_links, F.concat_ws("/", "comm", F.pmod(
            F.xxhash64("node"), F.ceil(F.col("held") / block_links)).cast("string"))).otherwise(
            F.pmod(F.xxhash64("comm"), F.greatest("blocks", F.lit(1))).cast("string"))
        placed = state.join(sizes, ["owner_id", "comm"]).join(owners, "owner_id").withColumn("block", block)
        goes = F.when(F.col("blocks") <= 1, F.lit(turn == 0)).otherwise(
            F.pmod(F.xxhash64("block", F.lit(sweep)), F.lit(parts)) == turn)
        movers = placed.where(goes & F.col("n").between(1, block_links)).select(
            "owner_id", F.col("node").alias("src"), "degree", F.col("comm").alias("home"),
            F.col("tot").alias("home_tot"), "two_m", "block")
        others = placed.select("owner_id", F.col("node").alias("dst"), "comm", "tot")
        moved = links.join(movers, ["owner_id", "src"]).join(others, ["owner_id", "dst"]).groupBy(
            "owner_id", "block").applyInArrow(_settle, _kinds(links, owner_id="owner_id", node="src", best="src"))
        if heavy:
            hubs = state.where((F.col("n") > block_links) & (
                F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(parts)) == turn))
            best = _best_moves(links.join(hubs.select("owner_id", F.col("node").alias("src")),
                                          ["owner_id", "src"], "left_semi"), state, totals)
            moved = moved.unionByName(best.join(hubs.select("owner_id", "node"), ["owner_id", "node"])
                                      .where(-F.col("best.minus") > F.col("stay") + 1e-9)
                                      .select("owner_id", "node", F.col("best.comm").alias("best")))
        after = cut_lineage(state.join(moved, ["owner_id", "node"], "left").select(
            "owner_id", "node", "degree", "n", F.col("comm").alias("home"),
            F.coalesce("best", "comm").alias("comm")))
        moved_in_sweep += after.filter("comm <> home").count()
        drop_steps(state)
        state = after.drop("home")
        turn += 1
        if turn == parts:
            # whole blocks are settled, so without a second block one sweep is enough
            if moved_in_sweep <= enough or parts == 1:
                drop_steps(owners)
                return state.select("owner_id", "node", "comm")
            sweep, turn, moved_in_sweep = sweep + 1, 0, 0


def _kinds(rows: DataFrame, **columns: str) -> str:
    """Schema of columns that hold what the given columns of ``rows`` do."""
    return ", ".join(f"{name} {rows.schema[c].dataType.simpleString()}" for name, c in columns.items())


def louvain(graph: DataFrame, block_links: int = BLOCK_LINKS, owner_links: int | None = None) -> DataFrame:
    """Communities by modularity: single nodes move, then whole communities, and again, until
    neither a node nor a community gains by joining another.

    ``graph`` is read several times; parallel edges may stay apart. Owners are independent. One with at most ``owner_links`` links is settled in one task; the
    others share the jobs of ``_louvain_in_blocks``. By default that is OWNER_LINKS,
    or ``block_links`` where these were chosen.
    """
    if owner_links is None:
        owner_links = OWNER_LINKS if block_links == BLOCK_LINKS else block_links
    rows = graph.select("owner_id", "a", "b", F.col("weight").cast("double"))
    sizes = cut_lineage(rows.groupBy("owner_id").agg((2 * F.count("*")).alias("links")))
    large = sizes.where(F.col("links") > owner_links).select("owner_id")
    # An owner's time is that of its task, so owners are dealt by range: by hash a few of them share a task.
    parts = max(1, min(4 * sizes.count(), 400))
    settled = cut_lineage(rows.join(large, "owner_id", "left_anti").repartitionByRange(parts, "owner_id").groupBy(
        "owner_id").applyInArrow(_settle_owner, _kinds(rows, owner_id="owner_id", node="a", comm="a")))
    if large.isEmpty():
        return settled
    return settled.unionByName(_louvain_in_blocks(cut_lineage(rows.join(large, "owner_id", "left_semi")),
                                                  block_links))


def _louvain_in_blocks(graph: DataFrame, block_links: int) -> DataFrame:
    """Communities of owners with many links, by sweeps over blocks.

    The first pass leaves the last few moves to the later ones, which go on until nothing moves.
    Owners share every job.
    """
    links = _both_ways(graph)
    totals = cut_lineage(links.groupBy("owner_id").agg(F.sum("weight").alias("two_m")))
    degrees = cut_lineage(links.groupBy("owner_id", F.col("src").alias("node")).agg(
        F.sum("weight").alias("degree")))
    members = cut_lineage(degrees.select("owner_id", "node", F.col("node").alias("comm")))
    most_left = 0.02
    while True:
        moved = _local_moves(links, degrees.join(members, ["owner_id", "node"]), totals, most_left,
                             block_links)
        before, members = members, _joined_up(graph, degrees, moved, totals, most_left, block_links)
        same = before.join(members.withColumnRenamed("comm", "now"), ["owner_id", "node"])
        pairs = same.select("owner_id", "comm", "now").distinct()
        # a partition is the same when its communities and those before are one to one
        done = pairs.count() == before.select("owner_id", "comm").distinct().count() == (
            members.select("owner_id", "comm").distinct().count())
        drop_steps(before, moved)
        if done and not most_left:
            drop_steps(totals, degrees)
            return members
        most_left = 0.0


def _joined_up(graph: DataFrame, degrees: DataFrame, members: DataFrame, totals: DataFrame,
               most_left: float, block_links: int) -> DataFrame:
    """Let communities move as the nodes of a smaller graph, level by level."""
    members = cut_lineage(members)
    while True:
        up = members.select("owner_id", "node", "comm")
        current = cut_lineage(
            graph.select("owner_id", "a", "b", "weight")
            .join(up.select("owner_id", F.col("node").alias("a"), F.col("comm").alias("x")),
                  ["owner_id", "a"])
            .join(up.select("owner_id", F.col("node").alias("b"), F.col("comm").alias("y")),
                  ["owner_id", "b"])
            .filter("x <> y")
            .groupBy("owner_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .agg(F.sum("weight").alias("weight")))
        nodes = degrees.join(members, ["owner_id", "node"]).groupBy(
            "owner_id", F.col("comm").alias("node")).agg(F.sum("degree").alias("degree"))
        moved = _local_moves(_both_ways(current), nodes.withColumn("comm", F.col("node")), totals,
                             most_left, block_links)
        idle = moved.filter("node <> comm").isEmpty()
        if not idle:
            step = moved.select("owner_id", F.col("node").alias("comm"), F.col("comm").alias("up"))
            before, members = members, cut_lineage(members.join(step, ["owner_id", "comm"]).select(
                "owner_id", "node", F.col("up").alias("comm")))
            drop_steps(before)
        drop_steps(current, moved)
        if idle:
            return members


def gaining_nodes(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """Per owner: nodes placed, and nodes that would gain modularity by moving to a neighbour."""
    links = _both_ways(graph)
    totals = links.groupBy("owner_id").agg(F.sum("weight").alias("two_m"))
    state = links.groupBy("owner_id", F.col("src").alias("node")).agg(
        F.sum("weight").alias("degree")).join(by_shuffle(membership), ["owner_id", "node"])
    best = _best_moves(links, state, totals)
    gains = -F.col("best.minus") > F.col("stay") + 1e-9
    return best.groupBy("owner_id").agg(F.count("*").alias("nodes"),
                                        F.count(F.when(gains, 1)).alias("gaining"))


def modularity(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a partition per owner.

    Sums of weights decide, so parallel edges need not be added up first. Each edge gives its weight to
    the communities of its ends, added up in each task before the shuffle.
    """
    def comm(c: str) -> DataFrame:
        return by_shuffle(membership.select("owner_id", F.col("node").alias(c), F.col("comm").alias(f"c_{c}")))

    rows = graph.select("owner_id", "a", "b", "weight").join(comm("a"), ["owner_id", "a"], "left").join(
        comm("b"), ["owner_id", "b"], "left")
    known = F.when(F.col("c_a").isNotNull() & F.col("c_b").isNotNull(), F.col("weight")).otherwise(0.0)
    same = F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0.0)
    shares = F.array(
        F.struct(F.col("c_a").alias("comm"), F.col("weight").alias("tot"), same.alias("inside"), known.alias("m")),
        F.struct(F.col("c_b").alias("comm"), F.col("weight").alias("tot"), F.lit(0.0).alias("inside"),
                 F.lit(0.0).alias("m")))
    tot = rows.select("owner_id", F.inline(shares)).filter("comm is not null").groupBy("owner_id", "comm").agg(
        *[F.sum(x).alias(x) for x in ("tot", "inside", "m")])
    sums = tot.groupBy("owner_id").agg(F.sum("inside").alias("inside"), F.sum("m").alias("m"),
                                       F.sum(F.col("tot") * F.col("tot")).alias("sq")).filter("m > 0")
    return sums.select("owner_id", (
        F.col("inside") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))
    ).alias("modularity"))


def merge_small_communities(membership: DataFrame, graph: DataFrame,
                            min_size: int | None = None) -> DataFrame:
    """Merge communities below the minimum into the one at their single strongest cross edge.

    Smaller ones first, ties to the smaller id; a community without cross edges is dropped. A
    round moves every small community whose target stays where it is, so a chain needs a few
    rounds and a pair of small ones cannot swap. Each round removes a community, so they end.
    Parallel edges may stay apart: weights are added up beside the small communities only.
    """
    min_size = lx.COMMUNITY_MIN_SIZE if min_size is None else min_size
    members = membership.select("owner_id", "node", "comm")
    both = _both_ways(graph)
    written = None
    while True:
        sizes = members.groupBy("owner_id", "comm").agg(F.count("*").alias("size"))
        small = cut_lineage(sizes.filter(F.col("size") < min_size))
        if small.isEmpty():
            return members
        at = members.join(small, ["owner_id", "comm"]).select(
            "owner_id", F.col("node").alias("src"), "comm", "size")
        beside = both.join(by_size(at, 400_000), ["owner_id", "src"]).groupBy(
            "owner_id", "comm", "size", "src", "dst").agg(F.sum("weight").alias("weight"))
        best = beside.join(
            by_shuffle(members.select("owner_id", F.col("node").alias("dst"), F.col("comm").alias("target"))),
            ["owner_id", "dst"]).filter("comm <> target").groupBy("owner_id", "comm", "size").agg(
            F.min(F.struct((-F.col("weight")).alias("minus"), "target")).alias("best")).select(
            "owner_id", "comm", "size", F.col("best.target").alias("target"))
        other = small.select("owner_id", F.col("comm").alias("target"),
                             F.col("size").alias("target_size"))
        eager = cut_lineage(best.join(other, ["owner_id", "target"], "left").filter(
            F.col("target_size").isNull()
            | (F.struct("size", "comm") < F.struct("target_size", "target"))))
        going = eager.select("owner_id", F.col("comm").alias("target"))
        # Of movers that point at movers only the end of the chain goes now.
        moves = eager.join(going, ["owner_id", "target"], "left_anti").select(
            "owner_id", "comm", "target")
        lonely = small.join(best, ["owner_id", "comm"], "left_anti").select("owner_id", "comm")
        members = cut_lineage(
            members.join(lonely, ["owner_id", "comm"], "left_anti")
            .join(moves, ["owner_id", "comm"], "left")
            .select("owner_id", "node", F.coalesce("target", "comm").alias("comm")))
        drop_steps(small, eager, written)
        written = members


# --- Bundles and texts ----------------------------------------------------

def community_edges(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with both ends in the same community."""
    def side(c: str) -> DataFrame:
        return membership.select("owner_id", F.col("node").alias(c), F.col("comm").alias(f"c_{c}"))

    return graph.join(side("a"), ["owner_id", "a"]).join(side("b"), ["owner_id", "b"]).filter(
        "c_a = c_b").select("owner_id", F.col("c_a").alias("comm"), "a", "b", "weight",
                            "rel_type", "description")


def community_text(graph: DataFrame, membership: DataFrame, entities: DataFrame,
                   n_entities: int = 15, n_relations: int = 20) -> DataFrame:
    """Entity and relation blocks of each community, cut to the first rows before the join."""
    key = ["owner_id", "comm"]
    named = entities.select("owner_id", F.col("entity_id").alias("node"), "name", "type",
                            trim_blank(F.substring(F.coalesce("description", F.lit("")), 1, 120))
                            .alias("text"))
    top = first_per(membership.select("owner_id", "node", "comm"), key, ["node"], n_entities, "n")
    ent_line = F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.col("type"), F.lit("]"),
                        F.when(F.col("text") != "", F.concat(F.lit(": "), F.col("text")))
                        .otherwise(F.lit("")))
    ents = top.join(named, ["owner_id", "node"]).select(
        *key, F.lit(1).alias("part"), "n", ent_line.alias("line"))
    inner = first_per(community_edges(graph, membership), key, ["a", "b"], n_relations, "n")
    names = entities.select("owner_id", "entity_id", "name")
    text = trim_blank(F.coalesce("description", F.lit("")))
    rel_line = F.concat(F.lit("- "), F.col("from_name"), F.lit(" —["), F.col("rel_type"),
                        F.lit("]→ "), F.col("to_name"),
                        F.when(text != "", F.concat(F.lit(" ("), F.substring(text, 1, 80),
                                                    F.lit(")"))).otherwise(F.lit("")))
    rels = inner.join(names.select("owner_id", F.col("entity_id").alias("a"),
                                   F.col("name").alias("from_name")), ["owner_id", "a"]).join(
        names.select("owner_id", F.col("entity_id").alias("b"), F.col("name").alias("to_name")),
        ["owner_id", "b"]).select(*key, F.lit(2).alias("part"), "n", rel_line.alias("line"))
    return ents.unionByName(rels).groupBy(*key).agg(*[
        F.coalesce(F.expr(f"listagg(line, '\\n') within group (order by n) "
                          f"filter (where part = {p})"), F.lit(empty)).alias(name)
        for p, name, empty in ((1, "entities_block", "(không có)"),
                               (2, "relations_block", "(không có quan hệ nội bộ)"))])


def community_summary(graph: DataFrame, membership: DataFrame, entities: DataFrame,
                      n_names: int = 5, n_types: int = 3, width: int = 2000) -> DataFrame:
    """Extractive summary: members of highest weighted degree and the strongest relation types."""
    key = ["owner_id", "comm"]
    inner = community_edges(graph, membership)
    ends = inner.select(*key, "weight", F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy(*key, "node").agg(F.sum("weight").alias("degree"))
    named = entities.select("owner_id", F.col("entity_id").alias("node"), "name")
    top = first_per(degree, key, [F.desc("degree"), "node"], n_names, "n").join(
        named, ["owner_id", "node"]).select(*key, F.lit(1).alias("part"), "n",
                                            F.col("name").alias("word"))
    types = first_per(inner.groupBy(*key, "rel_type").agg(F.sum("weight").alias("w")), key,
                      [F.desc("w"), "rel_type"], n_types, "n").select(
        *key, F.lit(2).alias("part"), "n", F.col("rel_type").alias("word"))
    words = top.unionByName(types).groupBy(*key).agg(*[
        F.expr(f"listagg(word, ', ') within group (order by n) filter (where part = {p})")
        .alias(name) for p, name in ((1, "names"), (2, "types"))])
    text = F.concat(F.col("names"), F.lit(" ("), F.col("types"), F.lit(")"))
    return words.select(*key, F.substring(text, 1, width).alias("summary"))


def memberships(membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Community rows with an id made of the members, and BELONGS_TO edges.

    The members column is the stored form of a community, as long as the community itself;
    edges are joined from the id, not exploded from it.
    """
    listed = membership.groupBy("owner_id", "comm").agg(
        F.count("*").cast("int").alias("member_count"),
        F.array_sort(F.collect_list("node")).alias("members"))
    communities = listed.withColumn("community_id", keys.community_id("owner_id", F.col("members")))
    edges = membership.join(communities.select("owner_id", "comm", "community_id"),
                            ["owner_id", "comm"]).select(
        "owner_id", F.col("node").alias("src"), F.col("community_id").alias("dst"),
        F.lit("BELONGS_TO").alias("rel_type"))
    return communities, edges


def replace_communities(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """All communities of an owner are replaced by the owner's new ones."""
    owners = fresh.select("owner_id").distinct()
    return current.join(owners, "owner_id", "left_anti").unionByName(fresh)


def run_stats(entities: DataFrame, graph: DataFrame, merged: DataFrame,
              min_size: int | None = None) -> DataFrame:
    """Outcome per owner with the reason for a skip; counts of what was written."""
    min_size = lx.COMMUNITY_MIN_SIZE if min_size is None else min_size
    n = entities.groupBy("owner_id").agg(F.count("*").alias("entities"))
    e = graph.groupBy("owner_id").agg(F.count("*").alias("edges"))
    big = merged.groupBy("owner_id", "comm").agg(F.count("*").alias("size")).filter(
        F.col("size") >= min_size)
    c = big.groupBy("owner_id").agg(F.count("*").alias("communities_created"),
                                    F.sum("size").alias("entities_in_communities"))
    zero = F.lit(0).cast("bigint")
    rows = n.join(e, "owner_id", "left").join(c, "owner_id", "left").select(
        "owner_id", "entities", *[F.coalesce(x, zero).alias(x) for x in
                                  ("edges", "communities_created", "entities_in_communities")])
    reason = (
        F.when(F.col("entities") < 2, "too_few_entities")
        .when(F.col("edges") == 0, "no_edges")
        .when(F.col("communities_created") == 0, "no_large_community")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason") == "", "success").otherwise("skipped"))


def list_communities(communities: DataFrame, limit: int = 50) -> DataFrame:
    """Largest communities of each owner."""
    return first_per(communities, ["owner_id"], [F.desc("member_count"), "community_id"], limit)


def relevant_communities(questions: DataFrame, linked: DataFrame, communities: DataFrame,
                         membership: DataFrame, entities: DataFrame,
                         limit: int | Column = 2, aliases: DataFrame | None = None) -> DataFrame:
    """Best communities per question: 3 per linked entity, 1 per question word in the summary,
    0.1 per member; the largest ones where nothing matches.

    A question without linked entities names them by its words, which pass the block list and
    the aliases (``aliases``, by default the fixed list) as any name of type OTHER does.

    ``communities`` holds ``(owner_id, comm, member_count, summary)``. Entities and words meet
    communities by equality: each distinct word of the summaries is cut once into the pieces
    a question word can equal. Size alone never has to be scored: among communities without a match
    only the largest ``limit`` of an owner can be chosen.
    """
    q = ["owner_id", "query_id"]
    cap = limit if isinstance(limit, Column) else F.lit(limit)
    words = by_shuffle(questions.select(*q, F.explode(F.array_distinct(tokenize("question", 3)))
                                        .alias("word")))
    # A question without linked entities is matched by its own words.
    own = words.join(by_shuffle(linked.select(*q).distinct()), q, "left_anti").select(
        *q, "word", normalize_name("word").alias("clean_norm")).filter(
        ~is_blocked(F.col("word"), F.col("clean_norm"), F.lit("OTHER")))
    if aliases is None:
        aliases = alias_table(questions.sparkSession)
    own = resolve_alias(own, aliases).select(
        *q, F.coalesce(normalize_name("alias_name"), "clean_norm").alias("name_norm"))
    linked = by_shuffle(linked.select(*q, "name_norm").unionByName(own).filter("name_norm <> ''").distinct())
    norms = entities.select("owner_id", F.col("entity_id").alias("node"), "name_norm")
    member_norms = by_shuffle(membership).join(norms, ["owner_id", "node"]).select(
        "owner_id", "comm", "name_norm").distinct()
    overlap = linked.join(member_norms, ["owner_id", "name_norm"]).groupBy(*q, "comm").agg(
        F.count("*").alias("overlap"))
    # A question word is inside a summary when it equals a piece of one of its words.
    summary_words = communities.select(
        "owner_id", "comm", F.explode(F.array_distinct(
            F.split(trim_blank(normalize_text("summary")), r"(?U)\s+"))).alias("w"))
    asked = words.select("word").distinct()
    longest = F.coalesce(asked.agg(F.max(F.length("word"))).scalar(), F.lit(3))
    starts = summary_words.select("w").distinct().filter(F.length("w") >= 3).select(
        "w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"))
    pieces = starts.select("w", "i", F.explode(F.sequence(
        F.lit(3), F.greatest(F.lit(3), F.least(F.length("w") - F.col("i") + 1, longest))))
        .alias("n")).select("w", F.substring("w", F.col("i"), F.col("n")).alias("word")).distinct()
    inside = pieces.join(asked, "word", "left_semi")
    held = summary_words.join(inside, "w").select("owner_id", "comm", "word").distinct()
    hits = words.join(held, ["owner_id", "word"]).groupBy(*q, "comm").agg(
        F.count("*").alias("hits"))
    size = communities.select("owner_id", "comm", "member_count", "summary")
    zero = F.lit(0).cast("bigint")
    matched = overlap.join(by_shuffle(hits), [*q, "comm"], "full_outer").join(size, ["owner_id", "comm"]
                                                                  ).select(
        *q, "comm", "member_count", "summary",
        F.coalesce("overlap", zero).alias("overlap"), F.coalesce("hits", zero).alias("hits"))
    scored = matched.withColumn("score", F.round(
        3.0 * F.col("overlap") + F.col("hits") + 0.1 * F.col("member_count"), 3))
    known = linked.select(*q).distinct().withColumn("known", F.lit(True))
    largest = first_per(size, ["owner_id"], [F.desc("member_count"), "comm"],
                        largest_limit(limit, questions), "size_no")
    # Without linked entities unmatched communities compete by size; else they are a fallback.
    silent = questions.select(*q).join(by_shuffle(known), q, "left").join(largest, "owner_id").join(
        by_shuffle(matched.select(*q, "comm")), [*q, "comm"], "left_anti")
    filler = silent.select(
        *q, "comm", "member_count", "summary", zero.alias("overlap"), zero.alias("hits"),
        F.when(F.col("known").isNull(), F.round(0.1 * F.col("member_count"), 3)).otherwise(0.0)
        .alias("score"), F.col("known").alias("known"))
    any_match = matched.select(*q).distinct().withColumn("any_match", F.lit(True))
    filler = filler.join(by_shuffle(any_match), q, "left").filter("known is null or any_match is null").drop(
        "known", "any_match")
    return first_per(scored.unionByName(filler), q,
                     [F.desc("score"), F.desc("member_count"), "comm"], cap, "place")
