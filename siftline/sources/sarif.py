"""SARIF 2.1.0: documents to findings and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions import scoring as s
from siftline.tables import dealt, small_side, written

LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,startColumn:int,endColumn:int,snippet:struct<text:string>>,contextRegion:struct<snippet:struct<text:string>>>>"
RULE = "struct<id:string,shortDescription:struct<text:string>,fullDescription:struct<text:string>,defaultConfiguration:struct<level:string>,properties:struct<tags:array<string>,precision:string,cwe:string>>"
RESULT = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{LOCATION}>,codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{LOCATION}>>>>>>,properties:struct<confidence:string,precision:string>>"
TOOL = f"struct<driver:struct<name:string,rules:array<{RULE}>>,extensions:array<struct<rules:array<{RULE}>>>>"

#: Results that a task holds as text to make documents of them.
RESULTS_A_TASK = 20_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc, body) of SARIF files, a document a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("body"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def problems(documents: DataFrame) -> DataFrame:
    """(doc, problem) of documents(doc, body) that aren't SARIF: `no JSON` or `no object`; null bodies are no JSON."""
    v = F.try_parse_json("body")
    return documents.select("doc", F.when(v.isNull(), "no JSON").when(~_is_object(v), "no object").alias("problem")).where("problem IS NOT NULL")


def runs(documents: DataFrame, strict: bool = False) -> DataFrame:
    """documents(doc, body) -> (doc, run, tool, results): the runs that are objects, results still an array of variants, as each is judged by
    itself. Documents that are no JSON object have no runs; with strict they are an error."""
    v = F.try_parse_json("body")
    if strict:
        v = F.when(_is_object(v), v).otherwise(F.raise_error(F.concat(F.lit("no SARIF object: "), F.col("doc").cast("string"))).cast("variant"))
    x = documents.select("doc", v.alias("v")).select("doc", F.posexplode(F.try_variant_get("v", "$.runs", "array<variant>")).alias("run", "r")).where(_is_object(F.col("r")))
    return x.select("doc", "run", F.try_variant_get("r", "$.tool", TOOL).alias("tool"), F.try_variant_get("r", "$.results", "array<variant>").alias("results"))


def rules_index(documents: DataFrame) -> DataFrame:
    """(doc, run, rule_id, rule): the rules of driver and extensions, of a repeated id the last."""
    none = F.array().cast(f"array<{RULE}>")
    every = F.concat(F.coalesce("tool.driver.rules", none), F.coalesce(F.flatten(F.transform("tool.extensions", lambda e: F.coalesce(e["rules"], none))), none))
    x = runs(documents).select("doc", "run", F.posexplode(every).alias("k", "rule")).where("rule IS NOT NULL")
    return x.groupBy("doc", "run", F.col("rule.id").alias("rule_id")).agg(F.max_by("rule", "k").alias("rule"))


def _cwe(rule: Column) -> Column:
    """The explicit CWE, else the last `cwe-n` part of the first tag that has one; empty without."""
    explicit = rule["properties"]["cwe"]
    tags = F.filter(F.transform(F.coalesce(rule["properties"]["tags"], F.array().cast("array<string>")), lambda t: F.regexp_extract(F.lower(F.replace(t, F.lit("\\"), F.lit("/"))), r"(?:.*/)?\s*cwe-(\d+)\s*(?:$|/)", 1)), lambda n: n != "")
    return F.when(explicit != "", s.normal_cwe(explicit)).otherwise(F.coalesce(F.concat(F.lit("CWE-"), F.try_element_at(tags, F.lit(1))), F.lit("")))


def _confidence(result: Column, rule: Column) -> Column:
    level = F.lower(rule["defaultConfiguration"]["level"])
    found = [result["properties"]["confidence"].try_cast("double"), s.lookup(F.lower(result["properties"]["precision"]), fixed.CONFIDENCE_BY_PRECISION), s.lookup(F.lower(rule["properties"]["precision"]), fixed.CONFIDENCE_BY_PRECISION), s.lookup(level, fixed.CONFIDENCE_BY_LEVEL)]
    return F.coalesce(*found, F.lit(0.5))


def scan(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of SARIF documents: (doc, run, n, id, rule_id, cwe_id, cwe_name, severity, confidence, message, file_path, line, snippet, tool, taint_flow).

    A result joins its rule, or none. Missing levels count as warnings, missing places as ("", 0); the flow is the first thread
    of the first code flow, null without one. Results that aren't objects are left out and cost no other result; fields of a wrong kind
    count as missing. Documents that are no objects are left out, see problems(); with strict they are an error.
    """
    x = runs(documents, strict).select("doc", "run", F.col("tool.driver.name").alias("tool"), F.posexplode("results").alias("n", "v")).where(_is_object(F.col("v")))
    x = x.select("doc", "run", "tool", "n", F.try_variant_get("v", "$", RESULT).alias("x")).withColumn("rule_id", F.col("x.ruleId"))
    x = x.join(rules_index(documents), ["doc", "run", "rule_id"], "left")
    place = F.try_element_at(F.col("x.locations"), F.lit(1))["physicalLocation"]
    thread = F.try_element_at(F.try_element_at(F.col("x.codeFlows"), F.lit(1))["threadFlows"], F.lit(1))["locations"]
    step = lambda l: F.struct(F.coalesce(l["location"]["physicalLocation"]["artifactLocation"]["uri"], F.lit("")).alias("file_path"), F.coalesce(l["location"]["physicalLocation"]["region"]["startLine"], F.lit(0)).alias("line"))  # noqa: E731, E741
    text = lambda c: F.nullif(c, F.lit(""))
    rule = F.col("rule")
    named = F.coalesce(text(rule["shortDescription"]["text"]), text(rule["fullDescription"]["text"]), F.lit(""))
    out = x.select(
        "doc", "run", "n", "rule_id", "tool", _cwe(rule).alias("cwe_id"), named.alias("cwe_name"),
        s.lookup(F.lower(F.coalesce("x.level", rule["defaultConfiguration"]["level"], F.lit("warning"))), fixed.SEVERITY_BY_LEVEL, "medium").alias("severity"), _confidence(F.col("x"), rule).alias("confidence"),
        F.coalesce(text(F.col("x.message.text")), text(rule["shortDescription"]["text"]), text(rule["fullDescription"]["text"]), F.lit("")).alias("message"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("file_path"), F.coalesce(place["region"]["startLine"], F.lit(0)).alias("line"),
        F.coalesce(place["region"]["snippet"]["text"], place["contextRegion"]["snippet"]["text"]).alias("snippet"), F.transform(thread, step).alias("taint_flow"),
    )
    return out.withColumn("id", s.finding_id(F.col("rule_id"), F.col("file_path"), F.col("line")))


def distinct_rules(findings: DataFrame, group: str) -> DataFrame:
    """(group, rule_id, cwe_id, precision) of the first finding of each rule by id; precision is high from a confidence of .8."""
    first = findings.groupBy(group, "rule_id").agg(F.min_by(F.struct("cwe_id", "confidence"), "id").alias("f"))
    return first.select(group, "rule_id", F.col("f.cwe_id").alias("cwe_id"), F.when(F.col("f.confidence") >= 0.8, "high").otherwise("medium").alias("precision"))


def group_of(doc: Column) -> Column:
    """The group that a document of documents() belongs to."""
    return F.regexp_replace(doc, r"#\d+$", "")


def documents(findings: DataFrame, group: str, most: int = 10_000) -> DataFrame:
    """(doc, body): SARIF documents of each value of group, named `group#number`, of about `most` results each in order of id, with all the group's
    rules and a count of their findings.

    A group's findings are dealt by a hash of their id over as many documents as they need, so one that holds most findings is written
    and read by many tasks: up to BROADCAST_ROWS rules go to the documents, which stay where they are. Each finding becomes its JSON text where it stands; a
    task then holds documents of about RESULTS_A_TASK results together, or one, however many there are.
    """
    where = lambda path, line: F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    steps = F.transform("taint_flow", lambda t: F.struct(where(t["file_path"], t["line"]).alias("location")))
    flows = F.when(F.col("taint_flow").isNotNull(), F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), s.lookup(F.col("severity"), fixed.LEVEL_BY_SEVERITY, "warning").alias("level"), F.struct(F.concat(F.lit("finding "), F.col("id").cast("string")).alias("text")).alias("message"),
        F.array(where(F.col("file_path"), F.col("line"))).alias("locations"), flows.alias("codeFlows"), F.struct(F.when(F.col("confidence").isNotNull(), F.col("confidence").cast("string")).alias("confidence")).alias("properties"),
    )
    parts = written(findings.groupBy(group).agg(F.count("*").alias("_n")), "document_parts")
    total = parts.agg(F.sum("_n")).first()[0] or 0
    named = findings.join(small_side(parts.select(group, F.ceil(F.col("_n") / most).alias("_parts"))), group)
    doc = F.concat_ws("#", F.col(group).cast("string"), F.pmod(F.xxhash64("id"), "_parts").cast("string"))
    each = named.select(doc.alias("_doc"), group, F.struct("id", F.to_json(result).alias("x")).alias("_result"))
    results = dealt(each, total, RESULTS_A_TASK, "_doc").groupBy("_doc").agg(F.any_value(group).alias(group), F.array_join(F.transform(F.array_sort(F.collect_list("_result")), lambda p: p["x"]), ",").alias("results"), F.count("*").alias("n"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.concat(F.lit("rule "), "rule_id").alias("text")).alias("shortDescription"), F.struct(F.array(F.lit("security"), F.concat(F.lit("external/cwe/"), F.lower("cwe_id"))).alias("tags"), F.col("precision")).alias("properties"))
    known = written(distinct_rules(findings, group), "document_rules")
    rules = small_side(known.groupBy(group).agg(F.array_sort(F.collect_list(rule)).alias("rules")), known.count())
    tool = F.to_json(F.struct(F.struct(F.lit("siftline").alias("name"), F.col("rules")).alias("driver")))
    calls = F.to_json(F.array(F.struct(F.lit(True).alias("executionSuccessful"), F.struct(F.col("n").alias("findings")).alias("properties"))))
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":'), tool, F.lit(',"results":['), F.col("results"), F.lit('],"invocations":'), calls, F.lit("}]}"))
    return results.join(rules, group).select(F.col("_doc").alias("doc"), body.alias("body"))
