"""Code graphs: exported XML to node and edge tables, and tables to node-link JSON."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftline.tables import written

ELEMENT = "edge boolean, a string, b string, type string, code string, line string"
#: Attribute names of several exporters, the first that is there counts.
TYPE, CODE, LINE = {False: ("labelV", "type", "label"), True: ("labelE", "type", "label")}, ("CODE", "code"), ("LINE_NUMBER", "lineNumber")
#: Nodes and edges that a task hands on at once, beside those of one document.
ELEMENTS_HELD = 50_000


def _elements(xml: str | None) -> Iterator[tuple]:
    """A row as ELEMENT for each node and edge of a document's first graph; none of one that is no XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return
    name = lambda x: x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
    for x in next((g for g in root if name(g) == "graph"), ()):
        if (kind := name(x)) in ("node", "edge"):
            data: dict = {}
            for d in x:
                if name(d) == "data":
                    data.setdefault(d.get("key"), (d.text or "").strip() or None)
            found = [next((data[n] for n in names if data.get(n) is not None), None) for names in (TYPE[kind == "edge"], CODE, LINE)]
            yield kind == "edge", x.get("id") if kind == "node" else x.get("source"), x.get("target"), *found


def load(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(graph_id, xml) -> nodes(graph_id, node_id, type, code, line) and edges(graph_id, src, dst, type). Attribute names of
    several exporters are known; missing lines are 0. Each document is parsed once, its nodes and edges are rows of a written table."""
    schema = f"graph_id {dict(documents.dtypes)['graph_id']}, {ELEMENT}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []

            def batch():
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(arrow[0].type), *columns], schema=arrow)  # noqa: B023

            for k, xml in enumerate(b.column(1)):
                found = list(_elements(xml.as_py()))
                at += [k] * len(found)
                rows += found
                if len(rows) >= ELEMENTS_HELD:
                    yield batch()
                    at, rows = [], []
            if rows:
                yield batch()

    x = written(documents.select("graph_id", "xml").mapInArrow(parse, schema), "graph_elements")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    nodes = x.where("NOT edge").select("graph_id", F.col("a").cast("long").alias("node_id"), blank("type"), blank("code"), F.coalesce(F.col("line").try_cast("int"), F.lit(0)).alias("line"))
    edges = x.where("edge").select("graph_id", F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), blank("type"))
    return nodes, edges


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, xml) of node and edge tables."""
    item = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), v.cast("string"), F.lit("</data>"))
    node = F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), item("labelV", F.col("type")), item("CODE", F.col("code")), item("LINE_NUMBER", F.col("line")), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('">'), item("labelE", F.col("type")), F.lit("</edge>"))
    n = nodes.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(node)), "").alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(edge)), "").alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.concat(F.lit("<graphml><graph>"), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>")).alias("xml"))


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, body): node-link JSON with counts, nodes and links in order."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "type", "code", "line"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type"))).alias("links"))
    x = n.join(e, "graph_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<source:bigint,target:bigint,type:string>>")))
    meta = F.struct(F.size("nodes").alias("num_nodes"), F.size("links").alias("num_edges"))
    return x.select("graph_id", F.to_json(F.struct(F.lit(True).alias("directed"), meta.alias("metadata"), "nodes", "links")).alias("body"))
