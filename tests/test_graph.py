"""Traversals of a graph with a node that most edges share."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph

EDGES = [(f"p{i}", ("uses", "cites", "likes")[j], f"t{i % 3}" if i % 2 else "t0", 3 * i + j) for i in range(400) for j in range(i % 4)]


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame([(s, p, o, n, n / 9999, f"m{n}", n % 5 > 0) for s, p, o, n in EDGES], "subject_id string, predicate string, object_id string, ord bigint, confidence double, source_memory_id string, active boolean")


def reached(seeds: set[str], depth: int) -> tuple[dict[str, int], dict[tuple, int]]:
    """Hops of each node, and the ord of the last edge of each pair."""
    live = [(s, o, n) for s, _, o, n in EDGES if n % 5]
    hops, kept = dict.fromkeys(seeds, 0), {}
    for hop in range(1, depth + 1):
        near = {v for v, h in hops.items() if h == hop - 1}
        step = [(s, o, n) for s, o, n in live if s in near or o in near]
        for s, o, n in step:
            kept[s, o] = max(n, kept.get((s, o), -1))
        for v in {v for s, o, _ in step for v in (s, o)} - set(hops):
            hops[v] = hop
    return hops, kept


def edges_are_sorted(*frames) -> bool:
    """Whether a join of edges with a frontier sorts a task's edges."""
    plans = "".join(df._jdf.queryExecution().executedPlan().toString() for df in frames)
    return any("SortMergeJoin" in line and ", Inner" in line for line in plans.splitlines())


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_the_global_graph_sorts_no_shared_nodes_edges(spark, relations, depth):
    day = datetime(2024, 1, 20)
    entities = spark.createDataFrame([("t0", "T", "tool", 9, day, "s"), ("p5", "P", "person", 8, day, "s")], "id string, name string, type string, mention_count bigint, last_seen_at timestamp_ntz, scope_hash string")
    nodes, kept = graph.global_graph(entities, relations, "2024-01-31 00:00:00", depth=depth)
    hops, pairs = reached({"t0", "p5"}, depth)
    assert not edges_are_sorted(nodes, kept)
    assert {r.node: r.hops for r in nodes.collect()} == hops
    said = {n: (p, n / 9999, f"m{n}") for _, p, _, n in EDGES}
    rows = kept.collect()
    assert len(rows) == len(pairs) and {(r.subject_id, r.object_id): (r.predicate, r.confidence, r.source_memory_id) for r in rows} == {k: said[n] for k, n in pairs.items()}


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_n_hop_sorts_no_shared_nodes_edges(spark, relations, depth):
    seeds = {"t0", "t1", "p5", "none"}
    nodes, kept = graph.n_hop(relations, spark.createDataFrame([(x,) for x in seeds], "seed string"), depth)
    assert not edges_are_sorted(nodes, kept)
    wanted = {x: reached({x}, depth) for x in seeds}
    assert sorted((r.seed, r.node, r.hops) for r in nodes.collect()) == sorted((x, v, h) for x in seeds for v, h in wanted[x][0].items())
    said = {n: p for _, p, _, n in EDGES}
    assert sorted((r.seed, r.subject_id, r.object_id, r.predicate) for r in kept.collect()) == sorted((x, *k, said[n]) for x in seeds for k, n in wanted[x][1].items())


def test_a_shared_nodes_edges_are_dealt_into_groups(spark, relations):
    step = graph._step(graph._sides(graph.last_edges(relations, "predicate")), spark.createDataFrame([("t0",)], "node string"))
    sizes = [r["count"] for r in step.groupBy("group_").count().collect()]
    assert len(sizes) == graph.GROUPS and max(sizes) < sum(sizes) / 4
    assert step.select("other").distinct().count() == step.count() and step.where(F.col("node") != "t0").count() == 0
