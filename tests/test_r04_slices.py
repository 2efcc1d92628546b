"""Graphs whose sink isn't found are met by a merge join when they are many, however small their files are."""

from siftline import tables
from siftline.operators import graphs as g


def test_many_lost_graphs_are_not_broadcast(spark, monkeypatch):
    nodes = spark.createDataFrame([(k, n, "CALL", 10 * n, "f") for k in range(6) for n in (1, 2, 3)], "graph_id long, node_id long, type string, line int, code string")
    edges = spark.createDataFrame([(k, 1, 2, "DDG") for k in range(6)], "graph_id long, src long, dst long, type string")
    sinks = spark.createDataFrame([(k, 2 if k < 2 else None) for k in range(6)], "graph_id long, node_id long")
    whole = {(k, n) for k in range(2, 6) for n in (1, 2, 3)} | {(0, 1), (0, 2), (1, 1), (1, 2)}
    for most, broadcast in ((1, False), (100, True)):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", most)
        got = g.slice_for_points(nodes, edges, sinks, nodes.where("node_id = 2").select("graph_id", "node_id"))
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == broadcast
        assert {tuple(r) for r in got.collect()} == whole
