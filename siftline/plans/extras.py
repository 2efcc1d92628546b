"""Queries of sinks, plug-in stages and assembled records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftline import plugins
from siftline.functions import scoring as s
from siftline.functions import texts
from siftline.operators import detection as det
from siftline.operators import findings as op
from siftline.operators.keyword_index import KeywordIndex
from siftline.plans import retrieval, triage
from siftline.plans import views as v
from siftline.plans.views import sql
from siftline.sources import sarif
from siftline.tables import new_path, small_side, written

D = triage.D


def sarif_write(spark, sf):
    """SARIF documents of each repository, of at most some hundred results each, with what they say of themselves, added up."""
    x = sarif.documents(v.findings(spark, sf, flow=True), "repo", most=400)
    said = F.from_json("body", "version string, runs array<struct<results:array<struct<ruleId:string>>,tool:struct<driver:struct<rules:array<struct<id:string>>>>,invocations:array<struct<properties:struct<findings:bigint>>>>>")
    x = x.select(sarif.group_of(F.col("doc")).cast("int").alias("repo"), said.alias("d")).select("repo", F.col("d.version").alias("version"), F.col("d.runs")[0].alias("r"))
    each = x.select("repo", "version", "r.results", F.size("r.tool.driver.rules").alias("rules"), F.col("r.invocations")[0]["properties"]["findings"].alias("findings"))
    return each.groupBy("repo", "version").agg(F.sum(F.size("results")).alias("results"), F.max("rules").alias("rules"), F.sum("findings").alias("findings"))


def code_examples(spark, sf):
    """The first two documents of each CWE as its examples, beside every finding that has one."""
    table = v.cve_docs(spark, sf).where("size(cwe_ids) = 1").select(F.col("cwe_ids")[0].alias("cwe_id"), "doc_id")
    first = op.cap_per_key(table, "cwe_id", "doc_id", 2).groupBy("cwe_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("examples"))
    return v.findings(spark, sf).join(first, "cwe_id", "left").select("id", F.coalesce("examples", F.lit("")).alias("examples"))


def _refreshed(spark, sf):
    """A kept index of all documents, extended by a part of patched ones, those of one language."""
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    index = KeywordIndex(spark, new_path(spark, "keyword_index"))
    index.add(d.select("id", "text"), 0)
    index.add(d.where("lang = 'de'").select("id", F.concat("text", F.lit(" patchedword")).alias("text")), 1)
    return index


def corpus_refresh(spark, sf):
    """Document frequencies after an upsert of all documents by patched ones; only the patched ones are read again."""
    return _refreshed(spark, sf).terms().select("term", "df")


def keyword_index_topk(spark, sf):
    """The search of a kept index after it was extended."""
    asked = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")
    return _refreshed(spark, sf).search(asked).select("q", "rank", "id", F.round("score", 5).alias("score"))


def verdict_provider(spark, sf):
    """Records of a provider that answers every prompt with a confidence made of its length, parsed."""
    from siftline.sources import verdict_json

    prompts = v.findings(spark, sf).select("id", F.concat_ws(" ", "cwe_id", "file_path", "language").alias("prompt"))
    answers = plugins.run_stages(prompts, [plugins.verdict_provider(lambda p: '{"exploitable": true, "confidence": %.2f}' % (len(p) % 101 / 100))])
    return verdict_json.parse(answers).select("id", "exploitable", F.round("confidence", 6).alias("confidence"))


def model_score(spark, sf):
    """Classes of a model that is called on batches of feature columns."""
    model = plugins.feature_model(lambda f: pd.DataFrame({"klass": (f["confidence"] > 0.5).astype("int32"), "probability": f["confidence"], "confidence": (f["confidence"] - 0.5).abs() * 2}), ["confidence", "line"])
    x = v.findings(spark, sf).transform(model)
    return x.select("id", F.col("predicted.klass").alias("klass"), F.round("predicted.confidence", 6).alias("sure"))


def context_assemble(spark, sf):
    """The hash of a JSON record for each labelled document's third line: slice, factors, flow and lookups."""
    d = v.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), "text")
    points = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.lit(3).alias("line"))
    x = op.with_uncertainty(v.findings(spark, sf, flow=True)).join(det.code_slice(d, points), "id")
    record = F.struct("id", "cwe_id", "severity", "slice", texts.flow_text(F.col("taint_flow")).alias("taint_path"), F.struct(*[F.format_string("%.6f", c).alias(c) for c in ("conf", "comp", "nov", "confl")]).alias("uncertainty"), s.owasp_category(F.col("cwe_id")).alias("owasp"), s.prompt_tier(F.round("total", 9)).alias("tier"))
    return x.select("id", F.md5(F.to_json(record, {"ignoreNullFields": "false"})).alias("hash"))


def rag_context_text(spark, sf):
    """The hash of the text that three hits of a search make, for each query."""
    hits = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(small_side(written(retrieval.keyword_topk(spark, sf), "hits")), "id")
    x = hits.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("h"))
    return x.select("q", F.md5(texts.retrieval_text(F.lit("similar documents"), F.col("h"))).alias("hash"))


QUERIES = {"sarif_write": sarif_write, "code_examples": code_examples, "corpus_refresh": corpus_refresh, "keyword_index_topk": keyword_index_topk, "verdict_provider": verdict_provider, "model_score": model_score, "context_assemble": context_assemble, "rag_context_text": rag_context_text}

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"
SQL = {
    "sarif_write": sql("SELECT repo, '2.1.0' AS version, count(*) AS results, CAST(count(DISTINCT rule_id) AS INTEGER) AS rules, count(*) AS findings FROM findings GROUP BY 1", "findings"),
    "code_examples": sql("SELECT f.id, coalesce(e.examples, '') AS examples FROM findings f LEFT JOIN (SELECT cwe, string_agg(doc_id, ',' ORDER BY doc_id) AS examples FROM (SELECT cwe, doc_id, row_number() OVER (PARTITION BY cwe ORDER BY doc_id) AS rn FROM cve_docs WHERE cwe <> '') q WHERE rn <= 2 GROUP BY 1) e ON f.cwe_id = e.cwe", "findings", "cve_docs"),
    "corpus_refresh": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM (SELECT CASE WHEN lang = 'de' THEN text || ' patchedword' ELSE text END AS text FROM documents) d) q GROUP BY 1",
    "keyword_index_topk": f"WITH patched AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' patchedword' ELSE text END AS text FROM documents), {retrieval._TERMS.replace('FROM documents', 'FROM patched')}, {retrieval._KEY} SELECT q, rank, id, round(score, 5) AS score FROM kr",
    "verdict_provider": sql("SELECT id, TRUE AS exploitable, round(CAST(length(concat_ws(' ', cwe_id, file_path, language)) % 101 AS DOUBLE) / 100, 6) AS confidence FROM findings", "findings"),
    "model_score": sql(f"SELECT id, CASE WHEN confidence > 0.5 THEN 1 ELSE 0 END AS klass, round(abs(confidence - {D(0.5)}) * 2, 6) AS sure FROM findings", "findings"),
    "context_assemble": sql(f"""SELECT q.id, md5('{{"id":' || q.id || ',"cwe_id":"' || cwe_id || '","severity":"' || severity || '","slice":' || to_json(slice) || ',"taint_path":' || to_json(coalesce(path, 'No taint path')) || ',"uncertainty":{{"conf":"' || printf('%.6f', conf) || '","comp":"' || printf('%.6f', comp) || '","nov":"' || printf('%.6f', nov) || '","confl":"' || printf('%.6f', confl)
        || '"}},"owasp":' || coalesce('"' || ({triage._OWASP}) || '"', 'null') || ',"tier":"' || CASE WHEN round(total, 9) < {D(0.3)} THEN 'minimal' WHEN round(total, 9) < {D(0.6)} THEN 'standard' ELSE 'full' END || '"}}') AS hash FROM totalled q JOIN sl ON q.id = sl.id LEFT JOIN pt ON q.id = pt.id""", "flows", "steps", "findings", "source_lines", more=triage.SCORED + """,
        sl AS (SELECT l.doc_id AS id, coalesce(string_agg(lpad(CAST(s.line_no AS VARCHAR), 4, ' ') || CASE WHEN s.line_no = 3 THEN ' >> ' ELSE '    ' END || s.code, chr(10) ORDER BY s.line_no), '') AS slice FROM labels l LEFT JOIN source_lines s ON s.file = 'doc/' || l.doc_id AND s.line_no BETWEEN 1 AND 23 GROUP BY 1),
        pt AS (SELECT id, string_agg('  ' || n || '. ' || file_path || ':' || line, chr(10) ORDER BY n) AS path FROM steps GROUP BY 1)"""),
    "rag_context_text": f"WITH {retrieval._TERMS}, {retrieval._KEY} SELECT q, md5('similar documents' || chr(10) || string_agg('- ' || substr(text, 1, 200), chr(10) ORDER BY rank)) AS hash FROM kr JOIN documents d ON kr.id = d.doc_id WHERE rank <= 3 GROUP BY q",
}
