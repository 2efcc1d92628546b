"""Graphs are searched many at a time, dealt by their id once; results are those of a search by hand."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import graphs as g


def _walked(ways, starts):
    """{(graph, node): depth} from starts[(graph, node, depth)]."""
    seen, depth = {}, 0
    while depth <= max(d for *_, d in starts) or any(d == depth - 1 for d in seen.values()):
        new = {(q, n) for q, n, d in starts if d == depth} | {(q, b) for q, a, b in ways if seen.get((q, a)) == depth - 1}
        seen |= {k: depth for k in new if k not in seen}
        depth += 1
    return seen


@pytest.mark.parametrize("limit", [50_000, 30])
def test_searches_of_many_graphs(spark, monkeypatch, limit):
    """Starts may come later, names may be text, and a table of whole graphs may end anywhere."""
    rng = random.Random(3)
    monkeypatch.setattr(g, "MOST_EDGES", limit)
    monkeypatch.setattr(g, "ROWS_HELD", 40)
    ways = [(q, str(rng.randrange(12)), str(rng.randrange(12))) for q in range(40) for _ in range(10)] + [(50, str(k % 6), str(k % 6 + 1)) for k in range(35)]
    starts = [(q, "3", 0) for q in (*range(30), 50)] + [(q, "5", 4) for q in range(20, 45)]
    edges = spark.createDataFrame([(q, a, b, "DDG") for q, a, b in ways], "graph_id long, src string, dst string, type string")
    for both in (False, True):
        got = [((r.graph_id, r.node_id), r.depth) for r in g.reach(edges, spark.createDataFrame(starts, "graph_id long, node_id string, at int"), both=both).collect()]
        assert len(got) == len(dict(got)) and dict(got) == _walked(ways + ([(q, b, a) for q, a, b in ways] if both else []), starts)
    nodes = spark.createDataFrame([(q, str(k)) for q in range(45) for k in range(12)], "graph_id long, node_id string")
    both = ways + [(q, b, a) for q, a, b in ways]
    want = {(q, str(k)): min(n for (_, n) in _walked([w for w in both if w[0] == q], [(q, str(k), 0)])) for q in (0, 22, 44) for k in range(12)}
    got = {(r.graph_id, r.node_id): r.component for r in g.components(nodes, edges).collect()}
    assert len(got) == 45 * 12 and {k: got[k] for k in want} == want


def test_points_and_context(spark):
    nodes = spark.createDataFrame([(1, k, "CALL", 10 * k, "") for k in range(1, 6)] + [(2, 1, "CALL", 0, ""), (2, 2, "CALL", 7, "")], "graph_id long, node_id long, type string, line int, code string")
    points = spark.createDataFrame([(1, 32), (1, 32), (2, 3), (9, 1)], "graph_id long, line int")
    assert sorted((r.graph_id, r.line, r.node_id or 0) for r in g.nearest_node(nodes, points).collect()) == [(1, 32, 3), (1, 32, 3), (2, 3, 0), (9, 1, 0)]
    edges = spark.createDataFrame([(1, 1, 2, "AST"), (1, 3, 2, "AST"), (1, 3, 4, "AST"), (1, 2, 3, "DDG"), (2, 1, 2, "DDG")], "graph_id long, src long, dst long, type string")
    inside = spark.createDataFrame([(1, 2)], "graph_id long, node_id long")
    assert sorted(tuple(r) for r in g.expand_context(nodes, edges, inside).collect()) == [(1, 2)]
    assert sorted(tuple(r) for r in g.expand_context(nodes, edges, inside, 10).collect()) == [(1, 1), (1, 2), (1, 3)]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.strip(" :+-").startswith("Exchange") for line in plan.split("\n"))


def test_a_graph_is_dealt_once_a_step(spark):
    """Exchanges of rows in the plans: before, 3 for degrees and roots, 9 for the context, 4 for the nearest node."""
    nodes = spark.range(9).selectExpr("id % 3 AS graph_id", "id AS node_id", "'CALL' AS type", "CAST(id AS INT) AS line", "'' AS code")
    edges = nodes.selectExpr("graph_id", "node_id AS src", "node_id AS dst", "'AST' AS type")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(g.roots(nodes, edges)) == 1
        assert _exchanges(g.expand_context(nodes, edges, nodes.select("graph_id", "node_id"))) == 1
        assert _exchanges(g.nearest_node(nodes, nodes.select("graph_id", F.col("line")))) <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
