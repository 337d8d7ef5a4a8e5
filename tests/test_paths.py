"""Shortest paths and neighbourhoods of random graphs against plain searches."""

import random
from collections import defaultdict

from corvane.operators import graph as gr

EDGES = "owner_id string, src string, dst string, rel_type string, description string"


def random_edges(seed, n, count):
    draw, kinds = random.Random(seed), ["KNOWS", "LIKES", "COOCCURS_WITH"]
    return [("o", f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}", draw.choice(kinds), f"d{k % 3}")
            for k in range(count)] + [("p", "x", "y", "KNOWS", "")]


def distances(edges, start):
    near = defaultdict(set)
    for o, a, b, *_ in edges:
        if a != b:
            near[o, a].add((o, b))
            near[o, b].add((o, a))
    dist, queue = {start: 0}, [start]
    for node in queue:
        for other in near[node] - dist.keys():
            dist[other] = dist[node] + 1
            queue.append(other)
    return dist


def test_paths_are_shortest_and_real(spark):
    edges = random_edges(3, 40, 45)
    pairs = [("o", f"n{a:02}", f"n{b:02}") for a in range(0, 40, 4) for b in range(1, 40, 3) if a != b]
    pairs += [("p", "x", "y"), ("p", "x", "gone"), ("o", "n00", "n00"), pairs[0]]
    df = spark.createDataFrame(pairs, "owner_id string, a string, b string")
    got = {(r["owner_id"], r["a"], r["b"]): r for r in gr.shortest_paths(
        df, spark.createDataFrame(edges, EDGES), 5).collect()}
    want = {}
    for o, a, b in pairs:
        for telling in (True, False):
            d = distances([e for e in edges if not telling or e[3] != "COOCCURS_WITH"], (o, a)).get((o, b))
            if a != b and d and d <= 5:
                want[o, a, b] = (d, telling)
                break
    assert {k: (r["hops"], r["semantic"]) for k, r in got.items()} == want
    assert {d for d, _ in want.values()} >= {1, 2, 3, 4, 5}
    have = {e[:4] for e in edges}
    for (o, a, b), r in got.items():
        nodes = r["nodes"]
        assert (nodes[0], nodes[-1], len(nodes), len(r["rels"])) == (a, b, r["hops"] + 1, r["hops"])
        for x, y, rel in zip(nodes, nodes[1:], r["rels"]):
            assert (o, *((x, y) if rel["back"] == 0 else (y, x)), rel["rel_type"]) in have


def test_no_pairs_or_edges(spark):
    none = spark.createDataFrame([], EDGES)
    pairs = spark.createDataFrame([("o", "a", "b")], "owner_id string, a string, b string")
    assert gr.shortest_paths(pairs, none).count() == 0
    assert gr.shortest_paths(pairs.limit(0), spark.createDataFrame(random_edges(1, 5, 5), EDGES)).count() == 0


def test_neighbourhood_keeps_the_nearest(spark):
    edges = [*random_edges(5, 60, 80), *[("o", "hub", f"n{k:02}", "KNOWS", "") for k in range(50)]]
    seeds = [("o", "hub"), ("o", "n01"), ("o", "n55"), ("p", "x")]
    got = gr.neighbourhood(spark.createDataFrame(seeds, "owner_id string, entity_id string"),
                           spark.createDataFrame(edges, EDGES), 2, 12).collect()
    for o, root in seeds:
        near = sorted((d, n) for (_, n), d in distances(edges, (o, root)).items() if 0 < d <= 2)[:12]
        assert sorted((r["hops"], r["node"]) for r in got if (r["owner_id"], r["root"]) == (o, root)) == near
