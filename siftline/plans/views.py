"""Stand-in views: the shapes that the operators expect, mapped onto the given tables; for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CWES = [89, 78, 79, 22, 502, 327, 416, 862, 1321, 400, None, 798]
LANGUAGES = ["python", "javascript", "java", "c", "go"]
SEVERITY_BY_PRIORITY = {"1": "critical", "2": "high", "3": "medium", "4": "low", "5": "info"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _cwe(custkey):
    return _pick(["" if c is None else f"CWE-{c}" for c in CWES], custkey % 12)


def findings(spark: SparkSession, sf: str, flow: bool = False) -> DataFrame:
    """A finding for each order; with flow, also its ordered taint steps (null for none)."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    out = o.select(
        key.alias("id"), F.concat(F.lit("r"), F.col("o_custkey") % 12).alias("rule_id"), _cwe(F.col("o_custkey")).alias("cwe_id"),
        _pick(list(SEVERITY_BY_PRIORITY.values()), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("severity"),
        ((key * 37 % 101) / 100).alias("confidence"), _pick(LANGUAGES, key % 5).alias("language"),
        F.concat(F.lit("src/f"), F.col("o_custkey") % 500).alias("file_path"), (key % 997 + 1).cast("int").alias("line"),
        (F.col("o_custkey") % 15).cast("int").alias("repo"), F.col("o_orderstatus").alias("tool"), F.col("o_custkey").alias("custkey"),
        F.when(F.col("o_orderstatus") != "F", F.array(F.lit("a"), F.lit("b"))).alias("corroborating_tools"),
        F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("a"), F.lit("likely"), F.lit("b"), F.when(F.col("o_custkey") % 2 == 0, "likely").otherwise("safe"))).alias("tool_verdicts"),
    )
    return out.join(flows(spark, sf), "id", "left") if flow else out


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """(id, taint_flow): the returned lines of an order as steps, in order."""
    li = table(spark, sf, "lineitem").where("l_returnflag = 'A'")
    step = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"))
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda x: F.struct(F.concat(F.lit("src/f"), x["p"] % 4).alias("file_path"), x["s"].cast("int").alias("line")))
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(steps.alias("taint_flow"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """An attacker and defender record for each order."""
    o, key, cust = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("id"), (cust % 2 == 0).alias("exploitable"), ((key * 13 % 101) / 100).alias("confidence"), ((key * 7 % 101) / 100).alias("coverage"), (cust % 3 != 0).alias("feasible"),
        _pick(["network", "adjacent", "local", "physical"], cust % 4).alias("av"), _pick(["low", "high"], cust % 2).alias("ac"), _pick(["none", "low", "high"], cust % 3).alias("pr"),
        _pick(["none", "required"], key % 2).alias("ui"), _pick(["unchanged", "changed"], key % 2).alias("scope"), _pick(["none", "low", "high"], key % 3).alias("c"),
        _pick(["none", "low", "high"], (key + 1) % 3).alias("i"), _pick(["none", "low", "high"], (cust + 1) % 3).alias("a"),
    )


def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """(label, cwe_id, verdict, lo, hi): every seventh without a range."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    lo = F.when(key % 7 != 0, (key % 900).cast("int"))
    return o.select(key.alias("label"), _cwe(F.col("o_custkey")).alias("cwe_id"), F.when(key % 2 == 0, "confirmed").otherwise("safe").alias("verdict"), lo.alias("lo"), (lo + 25).alias("hi"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, logits, label, grp) from embeddings: the label is the larger logit's class, wrong for every twentieth."""
    x, y = F.element_at("embedding", 1).cast("double") * 8, F.element_at("embedding", 2).cast("double") * 8
    top = F.when(y > x, 1).otherwise(0)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array(x, y).alias("logits"), F.when(F.col("vec_id") % 20 == 0, 1 - top).otherwise(top).alias("label"), F.col("label").alias("grp"))


def cpg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A node for each line of an order: (graph_id, node_id, type, line, code, partkey, after), after being how many nodes follow it, up to two."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "CALL").when(F.col("l_returnflag") == "N", "IDENTIFIER").otherwise("CONTROL_STRUCTURE")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.row_number().over(order).cast("long").alias("node_id"), kind.alias("type"), F.col("l_suppkey").cast("int").alias("line"), F.concat(F.lit("part"), F.col("l_partkey")).alias("code"), F.col("l_partkey").alias("partkey"), (F.lead(F.lit(1), 1, 0).over(order) + F.lead(F.lit(1), 2, 0).over(order)).alias("after"))


def cpg_edges(nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst, type): a typed chain, a CALL edge over one node for some, and an AST edge beside each chain edge; of cpg_nodes, each from its own row."""
    ahead = lambda k: F.when(F.col("after") >= k, F.col("node_id") + k)
    at = nodes.select("graph_id", "node_id", "partkey", ahead(1).alias("one"), ahead(2).alias("two"))
    chain = F.struct(F.col("one").alias("dst"), _pick(["CFG", "DDG", "CDG"], F.col("partkey") % 3).alias("type"))
    call = F.struct(F.when(F.col("partkey") % 5 == 0, F.col("two")).alias("dst"), F.lit("CALL").alias("type"))
    tree = F.struct(F.col("one").alias("dst"), F.lit("AST").alias("type"))
    return at.select("graph_id", F.col("node_id").alias("src"), F.explode(F.array(chain, call, tree)).alias("e")).select("graph_id", "src", "e.dst", "e.type").where("dst IS NOT NULL")


def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(file, repo, language, line_no, code): the lines of each document."""
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.col("source").alias("repo"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "code")).withColumn("line_no", F.col("line_no") + 1)


def cve_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, description, cwe_ids) from documents."""
    d = table(spark, sf, "documents")
    cwe = _cwe(F.col("doc_id"))
    return d.select(F.concat(F.lit("CVE-2024-"), F.col("doc_id")).alias("id"), F.col("text").alias("description"), F.when(cwe == "", F.array().cast("array<string>")).otherwise(F.array(cwe)).alias("cwe_ids"), "doc_id")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(id, code, label, language, source): labelled documents."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("toxic").alias("label"), F.col("lang").alias("language"), "source")


_CWE_LIST = "[" + ", ".join(f"'CWE-{c}'" if c else "''" for c in CWES) + "]"
_NODE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

#: The same views for DuckDB, by name; each may use those before it.
SQL = {
    "flows": "SELECT l_orderkey AS id, count(*) AS len, count(DISTINCT l_partkey % 4) AS files FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey",
    "steps": "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 'src/f' || (l_partkey % 4) AS file_path, CAST(l_suppkey AS INTEGER) AS line FROM lineitem WHERE l_returnflag = 'A'",
    "findings": f"""SELECT o_orderkey AS id, 'r' || (o_custkey % 12) AS rule_id, {_CWE_LIST}[CAST(o_custkey % 12 + 1 AS INTEGER)] AS cwe_id,
        ['critical','high','medium','low','info'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS severity, CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 AS confidence,
        ['python','javascript','java','c','go'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS language, 'src/f' || (o_custkey % 500) AS file_path, CAST(o_orderkey % 997 + 1 AS INTEGER) AS line,
        CAST(o_custkey % 15 AS INTEGER) AS repo, o_orderstatus AS tool, o_custkey AS custkey FROM orders""",
    "verdicts": """SELECT o_orderkey AS id, o_custkey % 2 = 0 AS exploitable, CAST(o_orderkey * 13 % 101 AS DOUBLE) / 100 AS confidence, CAST(o_orderkey * 7 % 101 AS DOUBLE) / 100 AS coverage, o_custkey % 3 <> 0 AS feasible,
        ['network','adjacent','local','physical'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS av, ['low','high'][CAST(o_custkey % 2 + 1 AS INTEGER)] AS ac, ['none','low','high'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS pr,
        ['none','required'][CAST(o_orderkey % 2 + 1 AS INTEGER)] AS ui, ['unchanged','changed'][CAST(o_orderkey % 2 + 1 AS INTEGER)] AS scope, ['none','low','high'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS c,
        ['none','low','high'][CAST((o_orderkey + 1) % 3 + 1 AS INTEGER)] AS i, ['none','low','high'][CAST((o_custkey + 1) % 3 + 1 AS INTEGER)] AS a FROM orders""",
    "ground_truth": f"""SELECT o_orderkey AS label, {_CWE_LIST}[CAST(o_custkey % 12 + 1 AS INTEGER)] AS cwe_id, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'safe' END AS verdict,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 900 AS INTEGER) END AS lo, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 900 + 25 AS INTEGER) END AS hi FROM orders""",
    "predictions": """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 8 AS x, CAST(embedding[2] AS DOUBLE) * 8 AS y,
        CASE WHEN vec_id % 20 = 0 THEN CASE WHEN embedding[2] > embedding[1] THEN 0 ELSE 1 END ELSE CASE WHEN embedding[2] > embedding[1] THEN 1 ELSE 0 END END AS label, label AS grp FROM embeddings""",
    "cpg_nodes": f"SELECT l_orderkey AS graph_id, {_NODE} AS node_id, CASE l_returnflag WHEN 'A' THEN 'CALL' WHEN 'N' THEN 'IDENTIFIER' ELSE 'CONTROL_STRUCTURE' END AS type, CAST(l_suppkey AS INTEGER) AS line, 'part' || l_partkey AS code, l_partkey AS partkey FROM lineitem",
    "cpg_edges": """SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, ['CFG','DDG','CDG'][CAST(a.partkey % 3 + 1 AS INTEGER)] AS type FROM cpg_nodes a JOIN cpg_nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1
        UNION ALL SELECT a.graph_id, a.node_id, b.node_id, 'CALL' FROM cpg_nodes a JOIN cpg_nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 2 WHERE a.partkey % 5 = 0
        UNION ALL SELECT a.graph_id, a.node_id, b.node_id, 'AST' FROM cpg_nodes a JOIN cpg_nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1""",
    "source_lines": "SELECT 'doc/' || doc_id AS file, source AS repo, lang AS language, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS code FROM documents",
    "cve_docs": f"SELECT 'CVE-2024-' || doc_id AS id, text AS description, {_CWE_LIST}[CAST(doc_id % 12 + 1 AS INTEGER)] AS cwe, doc_id FROM documents",
    "samples": "SELECT d.doc_id AS id, d.text AS code, l.toxic AS label, d.lang AS language, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
}


def sql(body: str, *names: str, more: str = "") -> str:
    """body with the named views, and `more` further common table expressions, before it."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else [])
    return ("WITH " + ("RECURSIVE " if "RECURSIVE " in more or "UNION ALL SELECT s." in more else "") + ",\n".join(parts).replace("RECURSIVE ", "") + "\n" + body) if parts else body
