"""Operators over many small code graphs: nodes(graph_id, node_id, type, line, code) and edges(graph_id, src, dst, type)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftline import fixed
from siftline.tables import small_side, written

G = "graph_id"
#: Edges of a graph that a task may hold to search it; larger graphs are searched by joins.
MOST_EDGES = 50_000
#: Rows of whole graphs that a task searches at once; a larger graph is searched by itself.
ROWS_HELD = 200_000


def _split_by_size(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """edges of graphs of at most MOST_EDGES edges, which one task may hold, and those of larger ones (None if there are none)."""
    large = written(edges.groupBy(G).agg(F.count("*").alias("n")).where(F.col("n") > (MOST_EDGES if most is None else most)).select(G), "large_graphs")
    n = large.count()
    if not n:
        return edges, None
    side = small_side(large, n)
    return edges.join(side, G, "left_anti"), edges.join(side, G, "left_semi")


def _arrays(edges: DataFrame, *columns: str) -> DataFrame:
    """A row for each graph with arrays of its edges' columns."""
    packed = edges.groupBy(G).agg(F.collect_list(F.struct(*columns)).alias("e"))
    return packed.select(G, *[F.col(f"e.{c}").alias(f"e_{c}") for c in columns])


def _walk(near: dict, starts, most: int | None) -> dict:
    """{node: (depth, least sum of weights over the shortest paths)} of a breadth-first search."""
    seen = dict.fromkeys(starts, (0, 0))
    front, depth = {n: 0 for n in seen}, 0
    while front and (most is None or depth < most):
        depth += 1
        found: dict = {}
        for node, calls in front.items():
            for to, w in near.get(node, ()):
                if to not in seen:
                    found[to] = min(found.get(to, calls + w), calls + w)
        seen |= {n: (depth, c) for n, c in found.items()}
        front = found
    return seen


def _whole_graphs(rows: DataFrame, run: Callable[[pa.Table], pa.RecordBatch], kinds: str) -> DataFrame:
    """run on tables of whole graphs, of about ROWS_HELD rows at a time; rows are dealt by graph, once, as plain columns."""
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, ROWS_HELD
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                table = pa.Table.from_batches(held)
                last = table[G][n - 1]
                whole = n - (pc.sum(pc.equal(table[G], last)).as_py() if last.is_valid else table[G].null_count)
                if whole:
                    yield run(table.slice(0, whole)).cast(schema)
                held, n = table.slice(whole).to_batches(), n - whole
                most = max(ROWS_HELD, 2 * n)
        if n:
            yield run(pa.Table.from_batches(held)).cast(schema)

    return rows.repartition(G).sortWithinPartitions(G).mapInArrow(stream, kinds)


def _numbers(*pairs: tuple[pa.ChunkedArray, pa.ChunkedArray]) -> tuple[list[np.ndarray], pa.DictionaryArray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Numbers from 0 for the nodes of pairs(graphs, nodes), and the graphs and nodes with the codes that each number has in their dictionaries."""
    whole = [pa.chunked_array([c for p in pairs for c in p[k].chunks], pairs[0][k].type).combine_chunks().dictionary_encode("encode") for k in (0, 1)]
    size = max(1, len(whole[1].dictionary))
    number, keys = pd.factorize(whole[0].indices.to_numpy().astype(np.int64) * size + whole[1].indices.to_numpy())
    return np.split(number, np.cumsum([len(p[0]) for p in pairs])[:-1]), *whole, keys // size, keys % size


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, weight: Column | None = None, both: bool = False) -> DataFrame:
    """(graph_id, node_id, depth, calls): nodes within `most` steps (any number by default) of starts(graph_id, node_id) along edges, or along
    both directions of them, by the fewest steps. Starts may have `at`, the depth that they count as (0 by default).

    `calls` is the least sum of weight over the shortest paths. Graphs of at most MOST_EDGES edges are gathered by their id, once, and
    searched many at a time; larger ones by rounds of joins over all of them until no new node is found.
    """
    kind = dict(starts.dtypes)
    graph, end = F.col(G).cast(kind[G]).alias(G), lambda c: F.col(c).cast(kind["node_id"]).alias(c)
    steps = edges.select(graph, end("src"), end("dst"), (F.lit(0) if weight is None else weight).cast("long").alias("w")).where("src IS NOT NULL AND dst IS NOT NULL")
    small, large = _split_by_size(steps)
    begin = starts.select(G, "node_id", (F.col("at") if "at" in kind else F.lit(0)).cast("long").alias("at"))
    if large is None:
        return _reach_in_tasks(small, begin, most, both)
    side = written(large.select(G).distinct(), "large_graphs")
    if both:
        large = large.unionByName(large.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return _reach_in_tasks(small, begin.join(side, G, "left_anti"), most, both).unionByName(_reach_in_rounds(large, begin.join(side, G, "left_semi"), most))


def _walks(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, starts: np.ndarray, at: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For n nodes of many graphs the depth (-1 if not reached) and the least sum of weights over the shortest paths."""
    order = np.argsort(src, kind="stable")
    ends, w = dst[order], w[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    depths, calls = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    front, depth, last = np.empty(0, dtype=np.int64), 0, at.max(initial=0)
    while most is None or depth <= most:
        count = first[front + 1] - first[front]
        place = np.repeat(first[front] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found, sums = ends[place], np.repeat(calls[front], count) + w[place]
        if depth <= last:
            found, sums = np.concatenate([found, starts[at == depth]]), np.concatenate([sums, np.zeros((at == depth).sum(), dtype=np.int64)])
        new = depths[found] < 0
        np.minimum.at(calls, found[new], sums[new])
        front = np.unique(found[new])
        depths[front] = depth
        if not len(front) and depth >= last:
            break
        depth += 1
    return depths, calls


def _reach_in_tasks(steps: DataFrame, starts: DataFrame, most: int | None, both: bool) -> DataFrame:
    kind = dict(starts.dtypes)
    rows = steps.unionByName(starts.select(G, F.col("node_id").alias("src"), F.lit(None).cast(kind["node_id"]).alias("dst"), F.col("at").alias("w")))

    def run(t: pa.Table) -> pa.RecordBatch:
        e, s = t.filter(t["dst"].is_valid()), t.filter(t["dst"].is_null())
        (src, dst, begin), graphs, nodes, graph, node = _numbers((e[G], e["src"]), (e[G], e["dst"]), (s[G], s["src"]))
        w = e["w"].to_numpy()
        if both:
            src, dst, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
        depth, calls = _walks(len(graph), src, dst, w, begin, s["w"].to_numpy(), most)
        found = np.flatnonzero(depth >= 0)
        return pa.RecordBatch.from_arrays([graphs.dictionary.take(pa.array(graph[found])), nodes.dictionary.take(pa.array(node[found])), pa.array(depth[found]), pa.array(calls[found])], [G, "node_id", "depth", "calls"])

    return _whole_graphs(rows, run, f"{G} {kind[G]}, node_id {kind['node_id']}, depth int, calls int")


def _reach_in_rounds(steps: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    begin = written(starts.groupBy(G, "node_id").agg(F.min("at").cast("int").alias("depth")).withColumn("calls", F.lit(0)), "reach")
    last = begin.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    front, depth = begin.where("depth = 0"), 0
    seen = front
    while most is None or depth < most:
        depth += 1
        next_front = front.select(G, F.col("node_id").alias("src"), "calls").join(steps.withColumnRenamed("dst", "node_id"), [G, "src"]).select(G, "node_id", (F.col("calls") + F.col("w")).cast("int").alias("calls"))
        if depth <= last:
            next_front = next_front.unionByName(begin.where(F.col("depth") == depth).select(G, "node_id", "calls"))
        front = written(next_front.groupBy(G, "node_id").agg(F.min("calls").alias("calls")).join(seen, [G, "node_id"], "left_anti").select(G, "node_id", F.lit(depth).alias("depth"), "calls"), "front")
        if depth >= last and front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), "type")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges))


def dependency_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(fixed.DEPENDENCY_EDGES))


def backward_slice(edges: DataFrame, sinks: DataFrame, most: int = 10) -> DataFrame:
    """Nodes that a sink depends on, with their distance, within `most` edges of fixed.SLICE_EDGES."""
    return reach(reverse(edges.where(F.col("type").isin(fixed.SLICE_EDGES))), sinks, most)


def nearest_node(nodes: DataFrame, points: DataFrame, tolerance: int = 3) -> DataFrame:
    """points(graph_id, line) with the node of the graph that stands there: of a preferred type on the line, else any on it, else the
    nearest within the tolerance; the smaller id of equals, null if there is none."""
    key = points.columns
    each = points.repartition(G).groupBy(*key).agg(F.count("*").alias("n_points"))
    placed = nodes.where("line > 0").select(G, "node_id", F.col("type").alias("node_type"), F.col("line").alias("node_line"))
    near = each.alias("p").join(placed.alias("n"), (F.col(f"p.{G}") == F.col(f"n.{G}")) & (F.abs(F.col("node_line") - F.col("line")) <= tolerance), "left").drop(F.col(f"n.{G}"))
    gap = F.abs(F.col("node_line") - F.col("line"))
    rank = F.when((gap == 0) & F.col("node_type").isin("CALL", "IDENTIFIER", "METHOD"), 0).when(gap == 0, 1).otherwise(2)
    best = near.groupBy(*key, "n_points").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct(rank.alias("rank"), gap.alias("gap"), "node_id"))).alias("b"))
    return best.select(*key, F.col("b.node_id").alias("node_id"), F.explode(F.sequence(F.lit(1), "n_points"))).drop("col")


def expand_context(nodes: DataFrame, edges: DataFrame, inside: DataFrame, lines: int = 5) -> DataFrame:
    """inside(graph_id, node_id) and the nodes that an AST edge joins to it whose line is within its lines, five more at either end.

    Nodes, tree edges and what is inside are dealt by graph once; all that follows stays within a graph."""
    kind = dict(nodes.dtypes)
    none, no = F.lit(None).cast(kind["node_id"]), F.lit(None).cast(kind["line"])
    rows = inside.select(G, "node_id", F.lit("inside").alias("is"), none.alias("other"), no.alias("line"))
    rows = rows.unionByName(nodes.select(G, "node_id", F.lit("node").alias("is"), none.alias("other"), "line"))
    rows = rows.unionByName(edges.where("type = 'AST'").select(G, F.col("src").alias("node_id"), F.lit("edge").alias("is"), F.col("dst").alias("other"), no.alias("line"))).where("node_id IS NOT NULL").repartition(G)
    way = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
    rows = rows.select(G, "is", "line", F.explode(F.when(F.col("is") == "edge", F.array(way("node_id", "other"), way("other", "node_id"))).otherwise(F.array(way("node_id", "other")))).alias("w")).select(G, "is", "line", "w.*")
    marked = rows.withColumn("from_inside", F.max(F.col("is") == "inside").over(Window.partitionBy(G, "node_id")))
    beside = marked.where("`is` <> 'edge' OR from_inside").select(G, "is", "line", F.when(F.col("is") == "edge", F.col("other")).otherwise(F.col("node_id")).alias("node_id"))
    one = beside.groupBy(G, "node_id").agg(F.max("line").alias("line"), *[F.max(F.col("is") == k).alias(k) for k in ("inside", "node", "edge")])
    w, own = Window.partitionBy(G), F.when(F.col("inside") & (F.col("line") > 0), F.col("line"))
    span = one.withColumns({"lo": F.min(own).over(w) - lines, "hi": F.max(own).over(w) + lines})
    return span.where("inside OR (node AND edge AND line BETWEEN lo AND hi)").select(G, "node_id")


def slice_for_points(nodes: DataFrame, edges: DataFrame, sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph_id, node_id): what the sinks depend on within ten edges and the sources within three, with context; a graph whose sink
    isn't found stays whole, so nothing is searched in it. Both are one search, in which sources begin seven steps later."""
    lost, known = small_side(written(sinks.where("node_id IS NULL").select(G).distinct(), "lost")), sinks.where("node_id IS NOT NULL")
    late = sources.where("node_id IS NOT NULL").join(lost, G, "left_anti").select(G, "node_id", F.lit(7).alias("at"))
    begin = written(known.join(lost, G, "left_anti").select(G, "node_id", F.lit(0).alias("at")).unionByName(late), "starts")
    searched = written(begin.select(G).distinct(), "searched")
    few = small_side(searched)
    part = edges.join(few, G, "left_semi")
    kept = expand_context(nodes.join(few, G, "left_semi"), part, backward_slice(part, begin, 10).select(G, "node_id"))
    return kept.unionByName(nodes.join(lost, G, "left_semi").select(G, "node_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, n_in, n_out)."""
    rows = nodes.select(G, F.col("node_id").alias("src"), F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("dst"), F.lit(True).alias("own")).unionByName(edges.select(G, "src", "dst", F.lit(False).alias("own"))).repartition(G)
    count = lambda c, own, i, o: F.struct(F.col(c).alias("node_id"), F.lit(own).alias("own"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = rows.select(G, F.explode(F.when(F.col("own"), F.array(count("src", 1, 0, 0))).otherwise(F.array(count("src", 0, 0, 1), count("dst", 0, 1, 0)))).alias("e")).select(G, "e.*")
    n = ends.groupBy(G, "node_id").agg(F.max("own").alias("own"), F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return n.where("own = 1").select(G, "node_id", "n_in", "n_out")


def degree_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees as shares of the graph's largest (at least 1)."""
    d, w = degrees(nodes, edges), Window.partitionBy(G)
    return d.select(G, "node_id", (F.col("n_in") / F.greatest(F.max("n_in").over(w), F.lit(1))).alias("f_in"), (F.col("n_out") / F.greatest(F.max("n_out").over(w), F.lit(1))).alias("f_out"))


def has_word(code: Column, words: list[str]) -> Column:
    """Whether code contains one of the words, whatever the case."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(code), w))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node of the highest degree of each graph, the smaller id of equals."""
    d = degrees(nodes, edges).withColumn("n", F.col("n_in") + F.col("n_out"))
    return d.groupBy(G).agg(F.min(F.struct((-F.col("n")).alias("n"), "node_id")).alias("r")).select(G, F.col("r.node_id").alias("node_id"))


def bfs_depth(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, node_id, depth, share): steps from the root whatever the direction, as a share of the deepest; 1 if not reached, within
    `most` steps (any number by default)."""
    found = reach(edges, roots(nodes, edges), most, both=True)
    rows = nodes.select(G, "node_id", F.lit(None).cast("int").alias("depth"), F.lit(True).alias("own")).unionByName(found.select(G, "node_id", "depth", F.lit(False).alias("own")))
    one = rows.repartition(G).groupBy(G, "node_id").agg(F.max("depth").alias("depth"), F.max("own").alias("own"))
    deep = F.greatest(F.max("depth").over(Window.partitionBy(G)), F.lit(1))
    return one.withColumn("deep", deep).where("own").select(G, "node_id", "depth", F.coalesce(F.col("depth") / F.col("deep"), F.lit(1.0)).alias("share"))


def bfs_truncate(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The first `most` nodes of each graph from its root, by depth and then id; graphs that are small enough stay whole."""
    d = bfs_depth(nodes, edges)
    w = Window.partitionBy(G)
    return d.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(F.col("depth").asc_nulls_last(), "node_id"))}).where((F.col("n") <= most) | ((F.col("rn") <= most) & F.col("depth").isNotNull())).select(G, "node_id")


def path_features(edges: DataFrame, ends: DataFrame, most_dependent: int | None = None, most: int | None = None) -> DataFrame:
    """ends(graph_id, source, sink) with path_length (shares of 20 steps along dependency edges, else along all edges; 1 if there is no
    path) and call_depth (fewest CALL edges on a shortest path of all edges, as a share of 8; 0 if there is none). With an unknown
    end the length is 1, and all CALL edges of the graph count. Paths along dependency edges have up to `most_dependent` steps and those along
    all edges up to `most`, any number by default."""
    known = ends.where("source IS NOT NULL AND sink IS NOT NULL")
    starts, goal = known.select(G, F.col("source").alias("node_id")), known.select(G, F.col("sink").alias("node_id"))
    dep = reach(dependency_edges(edges), starts, most_dependent).join(goal, [G, "node_id"]).select(G, F.col("depth").alias("dep"))
    every = reach(edges, starts, most, F.when(F.col("type") == "CALL", 1).otherwise(0)).join(goal, [G, "node_id"]).select(G, F.col("depth").alias("any"), F.col("calls").alias("on_path"))
    calls = edges.where("type = 'CALL'").groupBy(G).agg(F.count("*").alias("in_graph"))
    x = ends.join(dep, G, "left").join(every, G, "left").join(calls, G, "left")
    counted = F.when(F.col("source").isNull() | F.col("sink").isNull(), F.col("in_graph")).otherwise(F.col("on_path"))
    return x.select(G, F.least(F.coalesce(F.col("dep") / 20, F.col("any") / 20, F.lit(1.0)), F.lit(1.0)).alias("path_length"), F.least(F.coalesce(counted / 8, F.lit(0.0)), F.lit(1.0)).alias("call_depth"))


def flat_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, control_flow, fan_out): 1 - exp(-5 share of decisions) and the most data edges out of a node as a share of 15."""
    decision = F.col("type").isin(fixed.DECISION_NODES) | ((F.col("type") == "CALL") & F.lower("code").isin("if", "while", "for", "switch", "case"))
    control = nodes.groupBy(G).agg(F.round(1 - F.exp(-5 * F.count_if(decision) / F.count("*")), 6).alias("control_flow"))
    out = edges.where(F.col("type").isin("DDG", "REACHING_DEF")).groupBy(G, "src").agg(F.count("*").alias("n")).groupBy(G).agg(F.max("n").alias("n"))
    return control.join(out, G, "left").select(G, "control_flow", F.least(F.coalesce(F.col("n") / 15, F.lit(0.0)), F.lit(1.0)).alias("fan_out"))


def _simple_paths(near: dict, source, sink, cutoff: int, most: int) -> list[list]:
    """The first `most` simple paths of at most `cutoff` edges in order of their nodes. Nodes that are too far from the sink are not entered."""
    back: dict = {}
    for a, group in near.items():
        for b in group:
            back.setdefault(b, []).append((a, 0))
    left = {n: d for n, (d, _) in _walk(back, [sink], cutoff).items()}
    out: list[list] = []
    path, inside = [source], {source}
    todo = [iter(near.get(source, ()))] if source != sink and source in left else []
    while todo and len(out) < most:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
            inside.discard(path.pop())
        elif node == sink:
            out.append([*path, node])
        elif node not in inside and len(path) + left.get(node, cutoff) <= cutoff:
            path.append(node)
            inside.add(node)
            todo.append(iter(near.get(node, ())))
    return out


def sanitizer_coverage(nodes: DataFrame, edges: DataFrame, ends: DataFrame, is_sanitizer: Column, cutoff: int = 15, most: int = 50) -> DataFrame:
    """ends(graph_id, source, sink) with the share of simple paths of at most `cutoff` edges that pass a sanitizer; 0 without paths or with
    an unknown end.

    As their number can be exponential, the first `most` paths count, in order of their nodes' ids; parallel edges are one
    step. Graphs without a sanitizer are left out. A graph is gathered with the edges that lie on walks of at most `cutoff` steps
    from source to sink; if those are over MOST_EDGES, that is an error.
    """
    marks = nodes.where(is_sanitizer).groupBy(G).agg(F.collect_set("node_id").alias("marks"))
    known = ends.where("source IS NOT NULL AND sink IS NOT NULL").join(marks, G)
    steps = edges.select(G, "src", "dst").distinct()
    small, large = _split_by_size(steps)
    if large is not None:
        typed = large.withColumn("type", F.lit(""))
        forth = reach(typed, known.select(G, F.col("source").alias("node_id")), cutoff).select(G, F.col("node_id").alias("src"), F.col("depth").alias("from_source"))
        back = reach(reverse(typed), known.select(G, F.col("sink").alias("node_id")), cutoff).select(G, F.col("node_id").alias("dst"), F.col("depth").alias("to_sink"))
        narrow = written(large.join(forth, [G, "src"]).join(back, [G, "dst"]).where(F.col("from_source") + F.col("to_sink") < cutoff).select(G, "src", "dst"), "narrow_edges")
        if narrow.groupBy(G).count().where(F.col("count") > MOST_EDGES).limit(1).count():
            raise ValueError(f"a graph has over {MOST_EDGES} edges between source and sink")
        small = small.unionByName(narrow)
    packed = known.select(G, "source", "sink", "marks").join(_arrays(small, "src", "dst"), G)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, shares = [], []
            for g, source, sink, marked, src, dst in b.itertuples(index=False):
                near: dict = {}
                for x, y in sorted(zip(src.tolist(), dst.tolist(), strict=True)):
                    near.setdefault(x, []).append(y)
                paths, clean = _simple_paths(near, source, sink, cutoff, most), set(marked.tolist())
                ids.append(g)
                shares.append(round(sum(not clean.isdisjoint(p) for p in paths) / len(paths), 6) if paths else 0.0)
            yield pd.DataFrame({G: ids, "coverage": shares})

    share = packed.mapInPandas(run, f"{G} {dict(ends.dtypes)[G]}, coverage double")
    return ends.join(share, G, "left").select(G, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): the smallest node that is reachable whatever the direction.

    Graphs of at most MOST_EDGES edges are gathered by their id. In larger ones nodes pass on the smallest label and then the label
    of that label, so that the rounds grow with the logarithm of the widest component, until no label changes.
    """
    kind = dict(nodes.dtypes)
    end = lambda c, name: F.col(c).cast(kind["node_id"]).alias(name)
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col(G).cast(kind[G]).alias(G), end("src", "src"), end("dst", "dst"))
    small, large = _split_by_size(links.unionByName(nodes.select(G, end("node_id", "src"), F.lit(None).cast(kind["node_id"]).alias("dst"))))

    def run(t: pa.Table) -> pa.RecordBatch:
        e, own = t.filter(t["dst"].is_valid()), t.filter(t["dst"].is_null())
        (src, dst, mine), graphs, nodes, graph, node = _numbers((e[G], e["src"]), (e[G], e["dst"]), (own[G], own["src"]))
        by_size = np.empty(len(nodes.dictionary), dtype=np.int64)
        by_size[pc.sort_indices(nodes.dictionary).to_numpy()] = np.arange(len(by_size))
        smallest = np.full(len(graph), len(by_size))
        label = _linked(len(graph), src, dst)
        np.minimum.at(smallest, label, by_size[node])
        least = pc.sort_indices(nodes.dictionary).take(pa.array(smallest[label[mine]]))
        return pa.RecordBatch.from_arrays([graphs.dictionary.take(pa.array(graph[mine])), nodes.dictionary.take(pa.array(node[mine])), nodes.dictionary.take(least)], [G, "node_id", "component"])

    linked = _whole_graphs(small, run, f"{G} {kind[G]}, node_id {kind['node_id']}, component {kind['node_id']}")
    if large is None:
        return linked
    far = _components_in_rounds(large.where("dst IS NOT NULL"))
    rest = large.where("dst IS NULL").select(G, F.col("src").alias("node_id")).join(far, [G, "node_id"], "left")
    return linked.unionByName(rest.select(G, "node_id", F.coalesce("component", "node_id").alias("component")))


def _linked(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For n nodes of many graphs the smallest number that edges join them to, whatever the direction."""
    low = np.arange(n)
    while len(src):
        a, b = low[src], low[dst]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
        apart = low[src] != low[dst]
        src, dst = src[apart], dst[apart]
    return low


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    both = undirected(edges.withColumn("type", F.lit(""))).select(G, "src", F.col("dst").alias("node_id")).distinct()
    labels = written(both.select(G, "node_id").distinct().withColumn("component", F.col("node_id")), "labels")
    while True:
        near = both.join(labels.select(G, F.col("node_id").alias("src"), F.col("component").alias("c")), [G, "src"]).groupBy(G, "node_id").agg(F.min("c").alias("c"))
        low = labels.join(near, [G, "node_id"], "left").select(G, "node_id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = low.select(G, F.col("node_id").alias("component"), F.col("component").alias("next"))
        new = written(low.join(jump, [G, "component"]).select(G, "node_id", "was", F.least("component", "next").alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.drop("was")
        labels = new.drop("was")


def graph_stats(nodes: DataFrame, edges: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """(graph_id, nodes, edges, nodes_by_type, edges_by_type, mean_degree, density, components, is_stub): counts by type are arrays of (type, n)
    in order of type; is_stub says whether the graph is one of stubs(graph_id), which stand in for graphs that couldn't be built."""

    typed = lambda rows, edge: rows.select(G, F.lit(edge).alias("edge"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"))
    each = typed(nodes, False).unionByName(typed(edges, True)).repartition(G).groupBy(G, "edge", "type").agg(F.count("*").alias("n"))
    of = lambda edge, name: (F.sum(F.when(edge, F.col("n"))).alias(name), F.array_sort(F.collect_list(F.when(edge, F.struct("type", "n")))).alias(f"{name}_by_type"))
    x = each.groupBy(G).agg(*of(~F.col("edge"), "nodes"), *of(F.col("edge"), "edges")).where("nodes IS NOT NULL")
    c = components(nodes, edges).groupBy(G).agg(F.countDistinct("component").alias("components"))
    x = x.join(c, G).withColumn("edges", F.coalesce("edges", F.lit(0)))
    x = x.withColumn("is_stub", F.lit(False)) if stubs is None else x.join(stubs.select(G, F.lit(True).alias("is_stub")).distinct(), G, "left").withColumn("is_stub", F.coalesce("is_stub", F.lit(False)))
    density = F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))
    none = F.array().cast("array<struct<type:string,n:bigint>>")
    return x.select(G, "nodes", "edges", "nodes_by_type", F.coalesce("edges_by_type", none).alias("edges_by_type"), (F.col("edges") / F.col("nodes")).alias("mean_degree"), density.alias("density"), "components", "is_stub")


def vector_sums(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows(keys, array columns) -> a row for each key with the sums of its arrays by position, as long as its longest; null components count as 0.

    Batches are summed where they lie; the sums are dealt by key, sorted, and summed as they stream by, a batch and one key's sum at a time, so a
    key of most rows costs no more memory than another.
    """
    rows = rows.select(*keys, *[F.transform(c, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias(c) for c in columns]).where(" AND ".join(f"{c} IS NOT NULL" for c in columns))

    def added(b: pd.DataFrame) -> pd.DataFrame:
        group = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        out = b.iloc[np.unique(group, return_index=True)[1]][keys].reset_index(drop=True)
        for c in columns:
            size = b[c].str.len().to_numpy(dtype=np.int64)
            width, n = np.zeros(len(out), dtype=np.int64), int(size.max(initial=0))
            np.maximum.at(width, group, size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat = np.concatenate([np.asarray(x, dtype=float) for x in b[c]])
            sums = np.bincount(np.repeat(group * n, size) + place, weights=flat, minlength=len(out) * n).reshape(len(out), n)
            out[c] = [sums[i, :w] for i, w in enumerate(width)]
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (added(b) for b in batches if len(b))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if len(b):
                sums = added(b if held is None else pd.concat([held, b], ignore_index=True))
                held = sums.iloc[-1:]
                yield sums.iloc[:-1]
        if held is not None:
            yield held

    return rows.mapInPandas(each, rows.schema).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, rows.schema)


def neighbour_sum(features: DataFrame, edges: DataFrame) -> DataFrame:
    """features(graph_id, node_id, x array) -> each node's features and those of the nodes with an edge to it, added up."""
    own = features.select(G, "node_id", "x")
    sent = edges.select(G, F.col("src").alias("node_id"), "dst").join(own, [G, "node_id"]).select(G, F.col("dst").alias("node_id"), "x")
    return vector_sums(own.unionByName(sent), [G, "node_id"], ["x"])


def graph_pool(features: DataFrame) -> DataFrame:
    """features(graph_id, node_id, x array) -> mean and sum of each component over the graph's nodes that have it."""
    counted = features.select(G, "x", F.transform("x", lambda v: v.isNotNull().cast("double")).alias("n"))
    return vector_sums(counted, [G], ["x", "n"]).select(G, F.zip_with("x", "n", lambda s, n: F.try_divide(s, n)).alias("mean"), F.col("x").alias("sum"))


def chain_graph(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph for findings(id, line, end_line): a node a line, six for a single line, CFG edges from each to the
    next and a DDG edge from the first to the last (instead of the CFG edge if there are two)."""
    end = F.when(F.coalesce("end_line", "line") <= F.col("line"), F.col("line") + 5).otherwise(F.col("end_line"))
    nodes = findings.select(F.col("id").alias(G), F.posexplode(F.sequence("line", end)).alias("node_id", "line"), (end - F.col("line")).alias("last"))
    nodes = nodes.withColumn("type", F.when(F.col("node_id") == 0, "CALL").otherwise("IDENTIFIER"))
    chain = nodes.where("node_id < last").select(G, F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.when(F.col("last") == 1, "DDG").otherwise("CFG").alias("type"))
    long = nodes.where("node_id = 0 AND last > 1").select(G, F.lit(0).alias("src"), F.col("last").alias("dst"), F.lit("DDG").alias("type"))
    return nodes.drop("last"), chain.unionByName(long)
