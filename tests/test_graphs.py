import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import graphs as g

NODES, EDGES = "graph_id long, node_id long, type string, line int, code string", "graph_id long, src long, dst long, type string"


@pytest.fixture(scope="module")
def tables(spark):
    """A chain of 150 nodes, a graph with many ways, and one with two parts and a node that no edge touches."""
    rng = random.Random(4)
    kinds = ["DDG", "CDG", "CFG", "CALL", "AST"]
    edges = [(1, k, k + 1, "DDG" if k % 2 else "CFG") for k in range(149)]
    edges += [(2, a, b, rng.choice(kinds)) for a, b in itertools.permutations(range(12), 2) if rng.random() < 0.4]
    edges += [(3, 0, 1, "CALL"), (3, 1, 0, "CALL"), (3, 5, 4, "DDG")]
    nodes = [(1, k, "CALL", k, f"c{k}") for k in range(150)] + [(2, k, "CALL", k, f"c{k}") for k in range(12)] + [(3, k, None if k == 7 else "IDENTIFIER", k, f"c{k}") for k in (0, 1, 4, 5, 7)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), nodes, edges


def plain_reach(edges, graph, start, most=None):
    depth, front = {start: 0}, [start]
    while front and (most is None or depth[front[0]] < most):
        front = sorted({d for q, s, d, _ in edges if q == graph and s in front and d not in depth})
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    return depth


@pytest.mark.parametrize("limit", [50_000, 20, 0])
def test_searches_agree_in_tasks_and_in_rounds(spark, tables, monkeypatch, limit):
    monkeypatch.setattr(g, "MOST_EDGES", limit)
    nodes, edges, _, raw = tables
    if limit:
        starts = spark.createDataFrame([(1, 140), (2, 0), (3, 5), (4, 9)], "graph_id long, node_id long")
        found = {(r.graph_id, r.node_id): r.depth for r in g.reach(edges, starts).collect()}
        assert found == {(q, n): d for q, s in ((1, 140), (2, 0), (3, 5), (4, 9)) for n, d in plain_reach(raw, q, s).items()}
        parts = {(r.graph_id, r.node_id): r.component for r in g.components(nodes, edges).collect()}
        assert parts == {(q, n): (0 if q < 3 else {0: 0, 1: 0, 4: 4, 5: 4, 7: 7}[n]) for q, n in parts} and len(parts) == 167
    else:  # a deep chain by joins alone would take a written table a step
        starts = spark.createDataFrame([(2, 3), (3, 5)], "graph_id long, node_id long")
        assert {(r.graph_id, r.node_id): r.depth for r in g.reach(edges, starts, 2).collect()} == {(q, n): d for q, s in ((2, 3), (3, 5)) for n, d in plain_reach(raw, q, s, 2).items()}


def test_deep_graphs_keep_their_depths(spark, tables):
    nodes, edges, *_ = tables
    deep = {r.node_id: r for r in g.bfs_depth(nodes.where("graph_id = 1"), edges).collect()}
    assert deep[149].depth == 148 and deep[149].share == 1 and deep[75].share == pytest.approx(74 / 148)
    assert g.bfs_truncate(nodes.where("graph_id = 1"), edges, 120).count() == 120
    ends = spark.createDataFrame([(1, 0, 149), (2, None, 3), (3, 0, 7)], "graph_id long, source long, sink long")
    got = {r.graph_id: (r.path_length, r.call_depth) for r in g.path_features(edges, ends).collect()}
    calls = edges.where("graph_id = 2 AND type = 'CALL'").count()
    assert got == {1: (1.0, 0.0), 2: (1.0, min(calls / 8, 1.0)), 3: (1.0, 0.0)}


@pytest.mark.parametrize("limit", [50_000, 45])
def test_coverage_counts_the_first_paths(spark, tables, monkeypatch, limit):
    nodes, edges, _, raw = tables
    monkeypatch.setattr(g, "MOST_EDGES", max(limit, sum(e[0] == 2 for e in raw) - 1 if limit == 45 else limit))
    near = {n: sorted({d for q, s, d, _ in raw if q == 2 and s == n}) for n in range(12)}
    paths: list = []

    def walk(path):
        if path[-1] == 11:
            paths.append(path)
        elif len(path) <= 5:
            for n in near[path[-1]]:
                if n not in path:
                    walk([*path, n])

    walk([0])
    paths.sort()
    ends = spark.createDataFrame([(2, 0, 11), (3, None, 1)], "graph_id long, source long, sink long")
    for most in (50, 10**6):
        want = [bool({3, 7} & set(p)) for p in paths[:most]]
        try:
            got = {r.graph_id: r.coverage for r in g.sanitizer_coverage(nodes, edges, ends, F.col("node_id").isin(3, 7), 5, most).collect()}
        except ValueError:
            assert limit == 45
            continue
        assert len(paths) > 50 and got == {2: round(sum(want) / len(want), 6), 3: 0.0}


def test_statistics_by_type(spark, tables):
    nodes, edges, *_ = tables
    got = {r.graph_id: r for r in g.graph_stats(nodes, edges, spark.createDataFrame([(3,)], "graph_id long")).collect()}
    assert [tuple(x) for x in got[3].nodes_by_type] == [("IDENTIFIER", 4), ("UNKNOWN", 1)] and [tuple(x) for x in got[3].edges_by_type] == [("CALL", 2), ("DDG", 1)]
    assert got[3].is_stub and not got[1].is_stub and got[3].components == 3 and got[1].components == 1


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_vectors_are_summed_by_node(spark, batch):
    rng = np.random.default_rng(6)
    x = {(q, k): rng.integers(-9, 9, size=773).astype(float) for q in (1, 2) for k in range(40)}
    ways = [(1, int(a), 0) for a in range(1, 40)] + [(q, int(a), int(b)) for q in (1, 2) for a, b in rng.integers(0, 40, size=(60, 2))] + [(1, 99, 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        features = spark.createDataFrame([(q, k, v.tolist()) for (q, k), v in x.items()] + [(3, 0, [1.0, None, 3.0]), (3, 1, [4.0]), (3, 2, None), (4, 0, [])], "graph_id long, node_id long, x array<double>")
        edges = spark.createDataFrame([*ways, (3, 1, 0)], "graph_id long, src long, dst long")
        plan = g.neighbour_sum(features, edges)
        got = {(r.graph_id, r.node_id): r.x for r in plan.collect()}
        pooled = {r.graph_id: r for r in g.graph_pool(features).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {k: v.copy() for k, v in x.items()}
    for q, a, b in ways:
        if (q, a) in x:
            want[q, b] += x[q, a]
    assert got == {k: v.tolist() for k, v in want.items()} | {(3, 0): [5.0, 0.0, 3.0], (3, 1): [4.0], (4, 0): []}
    assert pooled[1].sum == sum(v for (q, _), v in x.items() if q == 1).tolist() and pooled[2].mean == pytest.approx(np.mean([v for (q, _), v in x.items() if q == 2], axis=0))
    assert (pooled[3].sum, pooled[3].mean) == ([5.0, 0.0, 3.0], [2.5, None, 3.0])
    assert "Generate" not in plan._jdf.queryExecution().toString()
