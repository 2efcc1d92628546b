"""Queries that count, rank, sort and filter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions import scoring as s
from siftline.operators import findings as op
from siftline.operators import reports as rep
from siftline.plans import triage
from siftline.plans import views as v
from siftline.plans.views import sql

D = triage.D


def verdict_of(findings):
    """findings with the verdict that the confidence alone gives; under a tenth it is safe."""
    return findings.withColumn("verdict", F.when(F.col("confidence") < 0.1, "safe").otherwise(s.sast_verdict(F.col("confidence"))))


VERDICT = "vf AS (SELECT *, CASE WHEN confidence < 0.1 THEN 'safe' WHEN confidence >= 0.9 THEN 'confirmed' WHEN confidence >= 0.8 THEN 'likely' ELSE 'potential' END AS verdict FROM findings)"


def by_severity(spark, sf):
    return rep.counted(v.findings(spark, sf).where("severity <> 'info'"), "severity", fixed.SEVERITIES)


def by_cwe(spark, sf):
    return rep.counted(v.findings(spark, sf), "cwe_id")


def by_language(spark, sf):
    return rep.counted(v.findings(spark, sf), "language")


def verdict_counts(spark, sf):
    return rep.counted(verdict_of(v.findings(spark, sf)), "verdict", fixed.VERDICTS)


def cascade_stats(spark, sf):
    return rep.cascade_stats(triage.cascade_rows(spark, sf))


def _cascade_counts(inner: str, by: str = "") -> str:
    sums = ", ".join(f"count(*) FILTER (stage_resolved = '{x}') AS {x}" for x in ("sast", "graph", "llm", "unresolved"))
    rates = "round(CASE WHEN total = 0 THEN 0 ELSE CAST(sast AS DOUBLE) / total END, 6) AS efficiency, round(CASE WHEN total - sast = 0 THEN 0 ELSE CAST(graph AS DOUBLE) / (total - sast) END, 6) AS graph_rate, round(CASE WHEN total - sast - graph = 0 THEN 0 ELSE CAST(llm AS DOUBLE) / (total - sast - graph) END, 6) AS llm_rate"
    return f"SELECT *, {rates} FROM (SELECT {by + ', ' if by else ''}count(*) AS total, {sums} FROM ({inner}) q {'GROUP BY ' + by if by else ''}) t"


def stage_outcome_counts(spark, sf):
    x = triage.cascade_rows(spark, sf)
    third = F.col("stage_resolved") == "llm"
    return x.agg(F.count_if(F.col("stage_resolved") == "unresolved").alias("unresolved"), F.count_if(third & F.col("verdict").isin("confirmed", "likely")).alias("confirmed"), F.count_if(third & (F.col("verdict") == "safe")).alias("filtered"))


def benchmark_report(spark, sf):
    """Findings by repository and stage, with the floor of the percentage."""
    x = rep.cascade_stats(triage.cascade_rows(spark, sf), "repo").drop("efficiency", "graph_rate", "llm_rate")
    return x.withColumns({f"{c}_pct": F.floor(100 * F.col(c) / F.greatest(F.col("total"), F.lit(1))) for c in ("sast", "graph", "llm")})


def risk_level(spark, sf):
    return rep.risk_level(verdict_of(v.findings(spark, sf)), "file_path")


def binary_metrics(spark, sf):
    p = v.predictions(spark, sf).withColumn("top", F.col("logits")[1] > F.col("logits")[0])
    return rep.binary_metrics(p, F.col("label") == 1, F.col("top"))


def metrics_by_group(spark, sf):
    """The 15 largest groups of at least 3 predictions."""
    p = v.predictions(spark, sf).withColumn("top", F.col("logits")[1] > F.col("logits")[0])
    x = rep.binary_metrics(p, F.col("label") == 1, F.col("top"), ["grp"]).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return x.where("n >= 3").orderBy(F.desc("n"), "grp").limit(15)


def metrics_rollup(spark, sf):
    x = op.matched_truth(v.ground_truth(spark, sf), v.findings(spark, sf).where("confidence >= 0.97"))
    out = rep.binary_metrics(x, F.col("verdict") == "confirmed", F.col("matched"), ["cwe_id"], rollup=True)
    return out.withColumn("cwe_id", F.coalesce("cwe_id", F.lit("OVERALL")))


def _metrics(counts: str) -> str:
    safe = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"
    return f"SELECT *, {safe('tp', 'tp + fp')} AS precision, {safe('tp', 'tp + fn')} AS recall, {safe('2 * tp', '2 * tp + fp + fn')} AS f1, {safe('(tp + tn)', 'tp + fp + fn + tn')} AS accuracy FROM ({counts}) c"


_COUNTS = "count(*) FILTER ({0} AND {1}) AS tp, count(*) FILTER (NOT {0} AND {1}) AS fp, count(*) FILTER ({0} AND NOT {1}) AS fn, count(*) FILTER (NOT {0} AND NOT {1}) AS tn"


def class_weights(spark, sf):
    """rows / (classes * rows of the class) for each label."""
    x = v.table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    rows, classes = x.agg(F.sum("n"), F.count("*")).first()
    return x.select("quality", F.round(F.lit(float(rows or 0)) / (classes * F.col("n")), 6).alias("weight"))


def distinct_languages(spark, sf):
    return v.findings(spark, sf).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def primary_language(spark, sf):
    order = {x: k for k, x in enumerate(["python", "javascript", "java", "go", "c"])}
    return v.findings(spark, sf).groupBy("file_path", "cwe_id").agg(F.min_by("language", s.lookup(F.col("language"), order, 99)).alias("language"))


def corpus_profile(spark, sf):
    """Counts of labelled samples by language and label, with each language's share of label 1."""
    x = v.samples(spark, sf).groupBy("language", "source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"))
    return x.withColumn("ratio", F.round(rep.rate(F.col("positive"), F.col("n")), 6))


def label_pivot(spark, sf):
    return v.samples(spark, sf).groupBy("language").pivot("label", [0, 1]).agg(F.count(F.lit(1))).select("language", F.coalesce("0", F.lit(0)).alias("safe"), F.coalesce("1", F.lit(0)).alias("vulnerable"))


def histogram(spark, sf):
    x = v.findings(spark, sf).select(F.least(F.width_bucket("confidence", F.lit(0.0), F.lit(1.0), F.lit(40)), F.lit(40)).cast("int").alias("bin"))
    return x.groupBy("bin").agg(F.count("*").alias("n"))


def usage_report(spark, sf):
    """Requests, tokens and cost by key and in all."""
    t = s.estimate_tokens(F.col("text"))
    x = v.table(spark, sf, "conversations").select((F.col("conv_id") % 3).alias("api_key"), (F.col("role") == "assistant").alias("out"), t.alias("tokens"))
    cost_in, cost_out = fixed.COST["flash"]
    x = x.rollup("api_key").agg(F.count("*").alias("requests"), F.sum(F.when(~F.col("out"), F.col("tokens")).otherwise(0)).alias("tokens_in"), F.sum(F.when(F.col("out"), F.col("tokens")).otherwise(0)).alias("tokens_out"))
    return x.select(F.coalesce(F.col("api_key").cast("string"), F.lit("total")).alias("api_key"), "requests", "tokens_in", "tokens_out", F.round(F.col("tokens_in") / 1000 * cost_in + F.col("tokens_out") / 1000 * cost_out, 6).alias("cost"))


def estimate_tokens(spark, sf):
    return v.table(spark, sf, "conversations").select("conv_id", "turn", s.estimate_tokens(F.col("text")).alias("tokens"))


def verdict_tier_order(spark, sf):
    """All findings by verdict, severity and id, with their place."""
    rank = lambda c, values: s.lookup(F.col(c), {x: k for k, x in enumerate(values)}, 99)
    x = verdict_of(v.findings(spark, sf)).select("id", "verdict", "severity")
    return rep.placed(x, rank("verdict", fixed.VERDICTS), rank("severity", fixed.SEVERITIES), F.col("id"))


def table_sort(spark, sf):
    """All findings by falling confidence, ties by id downwards, with their place."""
    return rep.placed(v.findings(spark, sf).select("id", "confidence", "file_path"), F.desc("confidence"), F.desc("id"))


def top_cwes(spark, sf):
    return rep.counted(v.findings(spark, sf).where("cwe_id <> ''"), "cwe_id").orderBy(F.desc("n"), "cwe_id").limit(8)


def findings_filter(spark, sf):
    x = verdict_of(v.findings(spark, sf))
    text = F.lower(F.concat_ws(" ", "cwe_id", "file_path", "severity"))
    return x.where(F.col("verdict").isin("confirmed", "likely") & text.contains("f12")).select("id", "verdict", "file_path")


def export_projection(spark, sf):
    x = v.findings(spark, sf)
    return x.select("id", F.round("confidence", 3).alias("score"), s.lookup(F.col("severity"), fixed.LEVEL_BY_SEVERITY).alias("level"), F.substring(F.repeat("file_path", 300), 1, 2000).alias("path"), F.to_json(F.struct("rule_id", "cwe_id", "line")).alias("properties"))


def cap_per_source(spark, sf):
    return op.cap_per_key(v.table(spark, sf, "documents"), "source", "doc_id", 7).select("doc_id", "source")


def distinct_content(spark, sf):
    """The first document of each distinct text, with the text's hash."""
    d = v.table(spark, sf, "documents").select(F.md5("text").alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


def early_stop_epoch(spark, sf):
    """By user as a run and minute as an epoch: the best value so far, epochs since, and where patience ends."""
    e = v.table(spark, sf, "events").where("value IS NOT NULL").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("epoch"), "value").groupBy("user_id", "epoch").agg(F.max("value").alias("value"))
    w = Window.partitionBy("user_id").orderBy("epoch")
    e = e.withColumns({"n": F.row_number().over(w), "before": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    e = e.withColumn("best_at", F.last(F.when(F.col("before").isNull() | (F.col("value") > F.col("before")), F.col("n")), ignorenulls=True).over(w))
    return e.groupBy("user_id").agg(F.min(F.when(F.col("n") - F.col("best_at") >= 5, F.col("n"))).alias("stop_at"), F.max("value").alias("best"), F.max("n").cast("long").alias("epochs"))


def rank_lists(spark, sf):
    w = Window.partitionBy("repo").orderBy(F.desc("confidence"), "id")
    return v.findings(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("repo", "rank", "id")


def scan_result(spark, sf):
    """One row for a whole scan: languages, findings and stages."""
    x = triage.cascade_rows(spark, sf)
    return x.agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count("*").alias("findings"), F.count_if(F.col("stage_resolved") == "sast").alias("sast"), F.count_if(F.col("stage_resolved") == "graph").alias("graph"), F.count_if(F.col("stage_resolved") == "llm").alias("llm"))


def attention_summary(spark, sf):
    """Mean and largest weight for each label's vectors, over their positive components."""
    x = v.table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("w")).where("w > 0")
    return x.groupBy("label").agg(F.round(F.avg(F.col("w").cast("double")), 6).alias("mean"), F.round(F.max(F.col("w").cast("double")), 6).alias("max"))


QUERIES = {
    "by_severity": by_severity, "by_cwe": by_cwe, "by_language": by_language, "verdict_counts": verdict_counts, "cascade_stats": cascade_stats, "stage_outcome_counts": stage_outcome_counts,
    "benchmark_report": benchmark_report, "risk_level": risk_level, "binary_metrics": binary_metrics, "metrics_by_group": metrics_by_group, "metrics_rollup": metrics_rollup, "class_weights": class_weights,
    "distinct_languages": distinct_languages, "primary_language": primary_language, "corpus_profile": corpus_profile, "label_pivot": label_pivot, "histogram": histogram, "usage_report": usage_report,
    "estimate_tokens": estimate_tokens, "verdict_tier_order": verdict_tier_order, "table_sort": table_sort, "top_cwes": top_cwes, "findings_filter": findings_filter, "export_projection": export_projection,
    "cap_per_source": cap_per_source, "distinct_content": distinct_content, "early_stop_epoch": early_stop_epoch, "rank_lists": rank_lists, "scan_result": scan_result, "attention_summary": attention_summary,
}

_CASCADE = triage.cascade_sql()
_ORDER = "array_position(['{}'], {})"
SQL = {
    "by_severity": sql("SELECT s.severity, count(f.id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN (SELECT * FROM findings WHERE severity <> 'info') f ON s.severity = f.severity GROUP BY 1", "findings"),
    "by_cwe": sql("SELECT cwe_id, count(*) AS n FROM findings GROUP BY 1", "findings"),
    "by_language": sql("SELECT language, count(*) AS n FROM findings GROUP BY 1", "findings"),
    "verdict_counts": sql("SELECT s.verdict, count(f.id) AS n FROM (VALUES ('confirmed'), ('likely'), ('potential'), ('safe'), ('unknown')) s(verdict) LEFT JOIN vf f ON s.verdict = f.verdict GROUP BY 1", "findings", more=VERDICT),
    "cascade_stats": _cascade_counts(_CASCADE),
    "stage_outcome_counts": f"SELECT count(*) FILTER (stage_resolved = 'unresolved') AS unresolved, count(*) FILTER (stage_resolved = 'llm' AND verdict IN ('confirmed', 'likely')) AS confirmed, count(*) FILTER (stage_resolved = 'llm' AND verdict = 'safe') AS filtered FROM ({_CASCADE}) q",
    "benchmark_report": "SELECT repo, total, sast, graph, llm, unresolved, CAST(floor(100.0 * sast / greatest(total, 1)) AS BIGINT) AS sast_pct, CAST(floor(100.0 * graph / greatest(total, 1)) AS BIGINT) AS graph_pct, CAST(floor(100.0 * llm / greatest(total, 1)) AS BIGINT) AS llm_pct FROM ("
    + _cascade_counts(f"SELECT q.*, CAST(o.o_custkey % 15 AS INTEGER) AS repo FROM ({_CASCADE}) q JOIN orders o ON q.id = o.o_orderkey", "repo") + ") z",
    "risk_level": sql("""SELECT file_path, CASE WHEN bool_or(verdict = 'confirmed' AND severity IN ('critical', 'high')) THEN 'CRITICAL' WHEN bool_or(verdict = 'confirmed') THEN 'HIGH' WHEN bool_or(verdict = 'likely') THEN 'MEDIUM' WHEN bool_or(verdict = 'potential') THEN 'LOW' ELSE 'MINIMAL' END AS risk_level
        FROM vf GROUP BY file_path""", "findings", more=VERDICT),
    "binary_metrics": sql(_metrics("SELECT " + _COUNTS.format("label = 1", "(y > x)") + " FROM predictions"), "predictions"),
    "metrics_by_group": sql("SELECT *, tp + fp + fn + tn AS n FROM (" + _metrics("SELECT grp, " + _COUNTS.format("label = 1", "(y > x)") + " FROM predictions GROUP BY grp") + ") m WHERE tp + fp + fn + tn >= 3 ORDER BY n DESC, grp LIMIT 15", "predictions"),
    "metrics_rollup": sql(_metrics("SELECT coalesce(cwe_id, 'OVERALL') AS cwe_id, " + _COUNTS.format("verdict = 'confirmed'", "matched") + " FROM m GROUP BY ROLLUP (cwe_id)"), "findings", "ground_truth", more="""d AS (SELECT DISTINCT cwe_id, line FROM findings WHERE confidence >= 0.97),
        m AS (SELECT g.*, EXISTS (SELECT 1 FROM d WHERE d.cwe_id = g.cwe_id AND (g.lo IS NULL OR (d.line >= g.lo AND d.line <= g.hi))) AS matched FROM ground_truth g)"""),
    "class_weights": "SELECT quality, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1) t",
    "distinct_languages": sql("SELECT repo, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM findings GROUP BY 1", "findings"),
    "primary_language": sql("SELECT file_path, cwe_id, ['python','javascript','java','go','c'][min(array_position(['python','javascript','java','go','c'], language))] AS language FROM findings GROUP BY 1, 2", "findings"),
    "corpus_profile": sql("SELECT language, source, count(*) AS n, count(*) FILTER (label = 1) AS positive, round(CAST(count(*) FILTER (label = 1) AS DOUBLE) / count(*), 6) AS ratio FROM samples GROUP BY 1, 2", "samples"),
    "label_pivot": sql("SELECT language, count(*) FILTER (label = 0) AS safe, count(*) FILTER (label = 1) AS vulnerable FROM samples GROUP BY 1", "samples"),
    "histogram": sql("SELECT CAST(least(floor(confidence / 1.0 * 40) + 1, 40) AS INTEGER) AS bin, count(*) AS n FROM findings GROUP BY 1", "findings"),
    "usage_report": f"""WITH t AS (SELECT conv_id % 3 AS k, role = 'assistant' AS o, greatest(1, length(text) // 4) AS n FROM conversations)
        SELECT coalesce(CAST(k AS VARCHAR), 'total') AS api_key, count(*) AS requests, CAST(sum(CASE WHEN o THEN 0 ELSE n END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN o THEN n ELSE 0 END) AS BIGINT) AS tokens_out,
        round(CAST(sum(CASE WHEN o THEN 0 ELSE n END) AS DOUBLE) / 1000 * {D(0.0001875)} + CAST(sum(CASE WHEN o THEN n ELSE 0 END) AS DOUBLE) / 1000 * {D(0.00075)}, 6) AS cost FROM t GROUP BY ROLLUP (k)""",
    "estimate_tokens": "SELECT conv_id, turn, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM conversations",
    "verdict_tier_order": sql("SELECT id, verdict, severity, row_number() OVER (ORDER BY " + _ORDER.format("','".join(fixed.VERDICTS), "verdict") + ", " + _ORDER.format("','".join(fixed.SEVERITIES), "severity") + ", id) AS place FROM vf", "findings", more=VERDICT),
    "table_sort": sql("SELECT id, confidence, file_path, row_number() OVER (ORDER BY confidence DESC, id DESC) AS place FROM findings", "findings"),
    "top_cwes": sql("SELECT cwe_id, count(*) AS n FROM findings WHERE cwe_id <> '' GROUP BY 1 ORDER BY n DESC, cwe_id LIMIT 8", "findings"),
    "findings_filter": sql("SELECT id, verdict, file_path FROM vf WHERE verdict IN ('confirmed', 'likely') AND contains(lower(cwe_id || ' ' || file_path || ' ' || severity), 'f12')", "findings", more=VERDICT),
    "export_projection": sql(f"SELECT id, round(confidence, 3) AS score, {triage.case('severity', fixed.LEVEL_BY_SEVERITY, 'NULL')} AS level, substr(repeat(file_path, 300), 1, 2000) AS path, '{{\"rule_id\":\"' || rule_id || '\",\"cwe_id\":\"' || cwe_id || '\",\"line\":' || line || '}}' AS properties FROM findings", "findings"),
    "cap_per_source": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t WHERE rn <= 7",
    "distinct_content": "SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "early_stop_epoch": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS ep, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ep) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
        b AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN n END) OVER (PARTITION BY user_id ORDER BY ep) AS best_at FROM n)
        SELECT user_id, CAST(min(CASE WHEN n - best_at >= 5 THEN n END) AS INTEGER) AS stop_at, max(value) AS best, max(n) AS epochs FROM b GROUP BY 1""",
    "rank_lists": sql("SELECT repo, CAST(rank AS INTEGER) AS rank, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, id) AS rank FROM findings) t WHERE rank <= 10", "findings"),
    "scan_result": f"SELECT string_agg(DISTINCT ['python','javascript','java','c','go'][CAST(id % 5 + 1 AS INTEGER)], ',' ORDER BY ['python','javascript','java','c','go'][CAST(id % 5 + 1 AS INTEGER)]) AS languages, count(*) AS findings, count(*) FILTER (stage_resolved = 'sast') AS sast, count(*) FILTER (stage_resolved = 'graph') AS graph, count(*) FILTER (stage_resolved = 'llm') AS llm FROM ({_CASCADE}) q",
    "attention_summary": "SELECT label, round(avg(CAST(w AS DOUBLE)), 6) AS mean, round(max(CAST(w AS DOUBLE)), 6) AS max FROM (SELECT label, unnest(embedding) AS w FROM embeddings) t WHERE w > 0 GROUP BY 1",
}
