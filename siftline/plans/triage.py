"""Queries over findings and verdicts: scalar functions, joins, routing, the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions import scoring as s
from siftline.operators import findings as op
from siftline.plans import views as v
from siftline.plans.views import sql

D = "CAST({} AS DOUBLE)".format


def case(key: str, values: dict, otherwise: str) -> str:
    """A CASE over literal values."""
    text = lambda x: f"'{x}'" if isinstance(x, str) else D(x)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {text(x)}" for k, x in values.items()) + f" ELSE {otherwise} END"


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- uncertainty and routing

COMMON = ", ".join(f"'{c}'" for c in fixed.COMMON_CWES)
SCORED = f"""scored AS (SELECT f.*, coalesce(w.len, 0) AS flow_length, coalesce(w.len >= 2 AND w.files > 1, FALSE) AS crosses_files,
  greatest(0, least(1, 1 - f.confidence)) AS conf,
  (greatest(0, least(1, {D("(coalesce(w.len, 0) - 1)")} / 4)) + CASE WHEN coalesce(w.len >= 2 AND w.files > 1, FALSE) THEN {D(0.4)} ELSE {D(0)} END) / 2 AS comp,
  CASE WHEN f.cwe_id = '' THEN {D(1)} WHEN f.cwe_id IN ({COMMON}) THEN {D(0.15)} ELSE {D(0.85)} END AS nov,
  CASE WHEN tool = 'F' THEN {D(0)} WHEN tool = 'P' THEN {D(0.5)} WHEN custkey % 2 = 0 THEN {D(0.1)} ELSE {D(1)} END AS confl,
  {case("f.severity", fixed.SEVERITY_ADJUSTMENT, D(0))} AS sev_adj FROM findings f LEFT JOIN flows w ON f.id = w.id),
totalled AS (SELECT *, greatest(0, least(1, conf * {D(0.4)} + comp * {D(0.3)} + nov * {D(0.2)} + confl * {D(0.1)} + sev_adj)) AS total FROM scored),
routed AS (SELECT *, round(total, 9) >= {D(0.5)} AS by_score, flow_length > 3 AS by_length, round(total, 9) >= {D(0.5)} OR flow_length > 3 OR crosses_files AS escalated FROM totalled)"""
FULL = ("flows", "findings")


def scored(spark, sf):
    return op.with_uncertainty(v.findings(spark, sf, flow=True))


def uncertainty(spark, sf):
    return scored(spark, sf).select("id", "flow_length", "crosses_files", *[r6(c) for c in ("conf", "comp", "nov", "confl", "sev_adj", "total")])


def route_sast(spark, sf):
    return op.route_sast(scored(spark, sf)).select("id", r6("total"), F.array_join("reasons", ",").alias("reasons"), "escalated", "stage_resolved", "verdict")


def routing_stats(spark, sf):
    from siftline.operators import reports

    return reports.routing_stats(op.route_sast(scored(spark, sf)))


def graphs(spark, sf):
    """Prediction sets and risks for the findings whose key is an embedding's: sets by the logits' margin."""
    p, wide = v.predictions(spark, sf), F.abs(F.col("logits")[0] - F.col("logits")[1])
    top = F.when(F.col("logits")[1] > F.col("logits")[0], "vulnerable").otherwise("safe")
    sets = F.when(wide < 0.5, F.array(F.lit("safe"), F.lit("vulnerable"))).when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(top))
    return p.select("id", sets.alias("pred_set"), ((F.col("id") * 29 % 101) / 100).alias("graph_risk"))


GRAPHS = """graphs AS (SELECT id, CASE WHEN abs(x - y) < 0.5 THEN ['safe','vulnerable'] WHEN id % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN y > x THEN ['vulnerable'] ELSE ['safe'] END AS pred_set,
  CAST(id * 29 % 101 AS DOUBLE) / 100 AS graph_risk FROM predictions)"""


def route_graph(spark, sf):
    up = op.route_sast(scored(spark, sf)).where("escalated").drop("escalated")
    return op.route_graph(up.join(graphs(spark, sf), "id", "left")).select("id", F.coalesce(F.array_join("pred_set", ","), F.lit("-")).alias("pred_set"), "escalated", "stage_resolved", "verdict")


CONSENSUS = f"""agreed AS (SELECT *,
  CASE WHEN exploitable AND coverage < 0.5 THEN 'confirmed' WHEN NOT exploitable AND coverage > 0.7 THEN 'safe' WHEN NOT feasible AND NOT exploitable THEN 'safe' WHEN exploitable THEN 'likely' ELSE 'potential' END AS llm_verdict,
  CASE WHEN exploitable AND coverage < 0.5 THEN least(greatest(confidence, 1 - coverage), 1) WHEN NOT exploitable AND coverage > 0.7 THEN least(greatest(coverage, 1 - confidence), 1)
    WHEN NOT feasible AND NOT exploitable THEN {D(0.8)} WHEN exploitable THEN least(greatest({D(0.5)} + {D(0.3)} * (confidence - coverage), {D(0.3)}), {D(0.85)})
    ELSE least(greatest({D(0.4)} + {D(0.2)} * (1 - coverage), {D(0.2)}), {D(0.6)}) END AS llm_confidence FROM verdicts)"""


def cvss_sql(av, ac, pr, ui, scope, c, i, a) -> str:
    t = fixed.CVSS
    iss = f"(1 - (1 - {case(c, t['impact'], D(0))}) * (1 - {case(i, t['impact'], D(0))}) * (1 - {case(a, t['impact'], D(0))}))"
    ease = f"({D(8.22)} * {case(av, t['av'], D(0.85))} * {case(ac, t['ac'], D(0.77))} * (CASE WHEN {scope} = 'changed' THEN {case(pr, t['pr_changed'], D(0.85))} ELSE {case(pr, t['pr'], D(0.85))} END) * {case(ui, t['ui'], D(0.85))})"
    changed, plain = f"({D(7.52)} * ({iss} - {D(0.029)}) - {D(3.25)} * pow({iss} - {D(0.02)}, 15))", f"({D(6.42)} * {iss})"
    return f"(CASE WHEN {iss} <= 0 THEN {D(0)} WHEN {scope} = 'changed' THEN CASE WHEN {changed} <= 0 THEN {D(0)} ELSE ceil(least({D(1.08)} * ({changed} + {ease}), 10) * 10) / 10 END ELSE ceil(least({plain} + {ease}, 10) * 10) / 10 END)"


SEVERITY_OF = "CASE WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 4 THEN 'medium' WHEN {0} >= 0.1 THEN 'low' ELSE 'none' END"
METRICS = ("av", "ac", "pr", "ui", "scope", "c", "i", "a")
VECTOR = "'CVSS:3.1/' || " + " || '/' || ".join(f"'{k}:' || upper(substr({{{n}}}, 1, 1))" for n, k in enumerate(("AV", "AC", "PR", "UI", "S", "C", "I", "A")))


def cvss_base(spark, sf):
    m = [F.col(c) for c in METRICS]
    out = v.verdicts(spark, sf).select("id", s.cvss_base(*m).alias("base"), s.cvss_vector(*m).alias("vector"))
    return out.withColumn("severity", s.cvss_severity(F.col("base")))


def cvss_cwe_default(spark, sf):
    return op.with_cvss(v.findings(spark, sf)).select("id", "cwe_id", "cvss_base", "cvss_vector", "cvss_severity")


_DEFAULTS = "defaults(cwe_id, av, ac, pr, ui, scope, c, i, a) AS (VALUES " + ", ".join("('" + "', '".join([k, *w]) + "')" for k, w in fixed.CVSS_BY_CWE.items()) + ")"
_OTHERWISE = dict(zip(METRICS, fixed.CVSS_OTHERWISE, strict=True))
_DEFAULTED = _DEFAULTS + ", m AS (SELECT f.*, " + ", ".join(f"coalesce(d.{n}, '{_OTHERWISE[n]}') AS {n}" for n in METRICS) + " FROM findings f LEFT JOIN defaults d ON f.cwe_id = d.cwe_id)"


def consensus_rules(spark, sf):
    c = s.consensus(F.col("exploitable"), F.col("confidence"), F.col("coverage"), F.col("feasible"))
    return v.verdicts(spark, sf).select("id", c.alias("x")).select("id", F.col("x.verdict").alias("llm_verdict"), F.round("x.confidence", 6).alias("llm_confidence"))


_WEIGHTS = "weights(cwe_id, w_sast, w_graph, w_llm) AS (VALUES " + ", ".join(f"('{k}', {D(a)}, {D(b)}, {D(c)})" for k, (a, b, c) in fixed.WEIGHTS.items()) + ")"
_W = ", ".join(f"coalesce(w.{n}, (SELECT {n} FROM weights WHERE cwe_id = 'default')) AS {n}" for n in ("w_sast", "w_graph", "w_llm"))


def weights_with_default(spark, sf):
    return op.with_weights(v.findings(spark, sf)).select("id", "cwe_id", "w_sast", "w_graph", "w_llm")


def cascade_rows(spark, sf, stage="llm"):
    return op.cascade(v.findings(spark, sf, flow=True), graphs(spark, sf), v.verdicts(spark, sf), stage)


def cascade(spark, sf, stage="llm"):
    return cascade_rows(spark, sf, stage).select("id", "stage_resolved", "verdict", r6("fused_score"), "cvss_base", "cvss_severity")


def cascade_sql(stage: str = "llm") -> str:
    up = "r.escalated" if stage != "sast" else "FALSE"
    third = f"({up} AND (g.pred_set IS NULL OR len(g.pred_set) > 1))" if stage == "llm" else "FALSE"
    resolved = f"CASE WHEN NOT {up} THEN 'sast' WHEN g.pred_set IS NOT NULL AND len(g.pred_set) <= 1 THEN 'graph' ELSE '{'llm' if stage == 'llm' else 'unresolved'}' END"
    defaults = _DEFAULTS.replace("defaults(", "defaults(", 1)
    metrics = ", ".join(f"coalesce(CASE WHEN {third} THEN a.{n} END, d.{n}, '{_OTHERWISE[n]}') AS m_{n}" for n in METRICS)
    joined = f"""joined AS (SELECT r.id, r.confidence, {resolved} AS stage_resolved, CASE WHEN {up} THEN g.graph_risk END AS gr, CASE WHEN {third} THEN a.llm_confidence END AS lc,
      CASE WHEN {third} THEN a.exploitable END AS ex, CASE WHEN {third} THEN a.coverage END AS cov, {_W}, {metrics}
      FROM routed r LEFT JOIN graphs g ON r.id = g.id LEFT JOIN agreed a ON r.id = a.id LEFT JOIN weights w ON r.cwe_id = w.cwe_id LEFT JOIN defaults d ON r.cwe_id = d.cwe_id),
    fused AS (SELECT *, greatest(0, least(1, (confidence * w_sast + coalesce(gr * w_graph, 0) + coalesce(lc * w_llm, 0)) / (w_sast + CASE WHEN gr IS NOT NULL THEN w_graph ELSE 0 END + CASE WHEN lc IS NOT NULL THEN w_llm ELSE 0 END))) AS f,
      {cvss_sql(*[f"m_{n}" for n in METRICS])} AS base FROM joined)"""
    tier = f"CASE WHEN ex AND cov < 0.3 THEN 'confirmed' WHEN NOT ex AND cov > 0.8 THEN 'safe' WHEN round(f, 9) >= {D(0.85)} THEN 'confirmed' WHEN round(f, 9) >= {D(0.5)} THEN 'likely' WHEN f > 0 THEN 'potential' ELSE 'unknown' END"
    return sql(f"SELECT id, stage_resolved, {tier} AS verdict, round(f, 6) AS fused_score, base AS cvss_base, {SEVERITY_OF.format('base')} AS cvss_severity FROM fused", "flows", "findings", "verdicts", "predictions", more=", ".join([SCORED, GRAPHS, CONSENSUS, _WEIGHTS, defaults, joined]))


def fuse_classify(spark, sf):
    f = v.findings(spark, sf).withColumn("graph_risk", F.when(F.col("id") % 3 != 0, (F.col("id") * 29 % 101) / 100))
    out = op.fuse_scores(op.with_weights(op.attach_verdicts(f, v.verdicts(spark, sf).where("id % 4 <> 0"))))
    return out.select("id", r6("fused_score"), "verdict", "llm_verdict", r6("llm_confidence"))


_FUSE = f"""j AS (SELECT f.id, f.confidence, CASE WHEN f.id % 3 <> 0 THEN CAST(f.id * 29 % 101 AS DOUBLE) / 100 END AS gr, a.llm_confidence AS lc, a.llm_verdict, a.exploitable AS ex, a.coverage AS cov, {_W}
  FROM findings f LEFT JOIN weights w ON f.cwe_id = w.cwe_id LEFT JOIN (SELECT * FROM agreed WHERE id % 4 <> 0) a ON f.id = a.id),
fu AS (SELECT *, greatest(0, least(1, (confidence * w_sast + coalesce(gr * w_graph, 0) + coalesce(lc * w_llm, 0)) / (w_sast + CASE WHEN gr IS NOT NULL THEN w_graph ELSE 0 END + CASE WHEN lc IS NOT NULL THEN w_llm ELSE 0 END))) AS f FROM j)"""


# --- further scalar functions

def flow_properties(spark, sf):
    x = v.findings(spark, sf, flow=True)
    flow = F.col("taint_flow")
    return x.select("id", s.flow_length(flow).alias("length"), s.crosses_files(flow).alias("crosses_files"), s.flow_source(flow)["file_path"].alias("source"), s.flow_sink(flow)["file_path"].alias("sink"), F.coalesce(F.array_join(F.transform(flow, lambda x, i: F.concat(i + 1, F.lit("."), x["file_path"], F.lit(":"), x["line"])), " -> "), F.lit("")).alias("summary"))


def finding_scalars(spark, sf):
    x = v.findings(spark, sf)
    cwe = F.col("cwe_id")
    return x.select(
        "id", s.finding_id(F.col("rule_id"), F.col("file_path"), F.col("line")).alias("hash"), F.concat_ws(":", "file_path", "line").alias("place"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "cwe_id", F.lit(" at "), "file_path", F.lit(":"), "line").alias("summary"),
        s.owasp_category(cwe).alias("owasp"), s.cwe_category(cwe).alias("category"), s.sast_verdict(F.col("confidence")).alias("sast_verdict"),
        s.lookup(F.col("severity"), fixed.LEVEL_BY_SEVERITY).alias("level"), s.normal_cwe(F.regexp_replace(cwe, "CWE-", "")).alias("normal_cwe"),
    )


_OWASP = case("cwe_id", {f"CWE-{n}": k for k, ns in fixed.OWASP.items() for n in ns}, "NULL")
_CATEGORY = case("cwe_id", {f"CWE-{n}": k for k, ns in fixed.CATEGORIES.items() for n in ns}, "'default'")


def severity_maps(spark, sf):
    """Levels and verdicts by closed maps, with the default for unknown words."""
    x = v.findings(spark, sf).withColumn("word", F.element_at(F.array(*map(F.lit, ["error", "WARNING", "note", "none", "odd"])), (F.col("id") % 5 + 1).cast("int")))
    x = x.withColumn("said", F.element_at(F.array(*map(F.lit, fixed.VERDICTS)), (F.col("id") % 5 + 1).cast("int")))
    return x.select("id", s.lookup(F.lower("word"), fixed.SEVERITY_BY_LEVEL, "medium").alias("severity"), s.lookup(F.col("said"), fixed.KIND_BY_VERDICT, "open").alias("kind"))


def complexity_route(spark, sf):
    x = scored(spark, sf)
    score = s.complexity_score(F.col("flow_length"), F.col("crosses_files"), F.col("line"), F.col("cwe_id"), F.col("severity"), F.col("total"), F.col("id") % 3 == 0)
    return x.select("id", s.prompt_tier(F.round("total", 9)).alias("tier"), F.round(score, 6).alias("score"), F.when(F.round(score, 9) >= 0.7, "large").otherwise("small").alias("model"))


_ROUTINE = ", ".join(f"'{c}'" for c in fixed.ROUTINE_CWES)


def parse_verdict_json(spark, sf):
    from siftline.sources import verdict_json

    return verdict_json.parse(verdict_json.documents(v.verdicts(spark, sf))).select("id", "exploitable", r6("confidence"), r6("coverage"), "feasible", "parsed", F.length("reasoning").alias("reasoning_length"))


def validate_ranges(spark, sf):
    """Findings whose confidence, raised by a fifth, is outside 0..1."""
    x = v.findings(spark, sf).withColumn("raised", F.round(F.col("confidence") + 0.2, 6))
    return x.where((F.col("raised") > 1) | (F.col("raised") < 0)).select("id", "raised")


# --- joins, sets and windows

def tools(spark, sf):
    x = v.findings(spark, sf).select("id", "file_path", "line", "cwe_id", "confidence", "tool")
    return x.where("id % 3 <> 0"), x.where("id % 3 <> 1").withColumn("confidence", F.col("confidence") + 0.05)


def merge_findings(spark, sf):
    a, b = tools(spark, sf)
    return op.merge_tools(a, b).select("id", r6("confidence"), F.array_join("tags", ",").alias("tags"), F.array_join("tools", ",").alias("tools"))


AB = """a AS (SELECT id, file_path, line, cwe_id, confidence, tool FROM findings WHERE id % 3 <> 0), b AS (SELECT id, file_path, line, cwe_id, confidence + CAST(0.05 AS DOUBLE) AS confidence, tool FROM findings WHERE id % 3 <> 1),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line, cwe_id ORDER BY id DESC) AS rn FROM a) WHERE rn = 1)"""


def uncorroborated(spark, sf):
    a, b = tools(spark, sf)
    return a.join(b, ["file_path", "line", "cwe_id"], "left_anti").select("id")


def union_findings(spark, sf):
    a, b = tools(spark, sf)
    return a.unionByName(b).groupBy("tool").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def finding_dedup(spark, sf):
    return op.first_per_key(v.findings(spark, sf), ["cwe_id", "file_path"], [F.col("line"), F.col("id")]).select("id", "cwe_id", "file_path", "line")


def ground_truth_join(spark, sf):
    return op.matched_truth(v.ground_truth(spark, sf), v.findings(spark, sf)).select("label", "verdict", "matched")


def cve_upsert(spark, sf):
    """All orders' records, upserted by new versions of those that are finished."""
    o = v.table(spark, sf, "orders")
    stored = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.col("o_totalprice").alias("score"))
    changes = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(2).alias("version"), (F.col("o_totalprice") + 1).alias("score"))
    return op.upsert(stored, changes, "id", "version").select("id", "version", F.round("score", 2).alias("score"))


def retain_uncalibrated(spark, sf):
    x = v.findings(spark, sf)
    new = x.where("id % 2 = 0 AND cwe_id IN ('CWE-89', 'CWE-78')").groupBy("cwe_id").agg(F.round(F.avg("confidence"), 6).alias("w"))
    old = x.groupBy("cwe_id").agg(F.round(F.max("confidence"), 6).alias("w"))
    return op.retain_missing(new, old, "cwe_id")


def batch_chunks(spark, sf):
    return op.batches(v.findings(spark, sf), "id", "repo").groupBy("repo", "chunk").agg(F.min("id").alias("first"), F.count("*").alias("n"))


def lookup_enrich(spark, sf):
    x = v.findings(spark, sf)
    names = spark.createDataFrame([(f"CWE-{n}", k) for k, ns in fixed.OWASP.items() for n in ns], "cwe_id string, owasp string")
    return x.join(F.broadcast(names), "cwe_id", "left").select("id", "owasp", s.cwe_category(F.col("cwe_id")).alias("category"))  # a row a CWE of a fixed list


QUERIES = {
    "uncertainty": uncertainty, "route_sast": route_sast, "routing_stats": routing_stats, "route_graph": route_graph, "cvss_base": cvss_base, "cvss_cwe_default": cvss_cwe_default,
    "consensus_rules": consensus_rules, "weights_with_default": weights_with_default, "fuse_classify": fuse_classify, "cascade": cascade,
    "sast_only": lambda spark, sf: cascade(spark, sf, "sast"), "cascade_to_graph": lambda spark, sf: cascade(spark, sf, "graph"), "flow_properties": flow_properties,
    "finding_scalars": finding_scalars, "severity_maps": severity_maps, "complexity_route": complexity_route, "parse_verdict_json": parse_verdict_json, "validate_ranges": validate_ranges,
    "merge_findings": merge_findings, "uncorroborated": uncorroborated, "union_findings": union_findings, "finding_dedup": finding_dedup, "ground_truth_join": ground_truth_join,
    "cve_upsert": cve_upsert, "retain_uncalibrated": retain_uncalibrated, "batch_chunks": batch_chunks, "lookup_enrich": lookup_enrich,
}

SQL = {
    "uncertainty": sql("SELECT id, flow_length, crosses_files, round(conf, 6) AS conf, round(comp, 6) AS comp, round(nov, 6) AS nov, round(confl, 6) AS confl, round(sev_adj, 6) AS sev_adj, round(total, 6) AS total FROM totalled", *FULL, more=SCORED),
    "route_sast": sql("""SELECT id, round(total, 6) AS total, concat_ws(',', CASE WHEN by_score THEN 'uncertainty' END, CASE WHEN by_score AND sev_adj > 0 THEN 'severity_adjusted' END, CASE WHEN by_length THEN 'taint_length' END, CASE WHEN crosses_files THEN 'interprocedural' END) AS reasons,
        escalated, CASE WHEN NOT escalated THEN 'sast' END AS stage_resolved, CASE WHEN NOT escalated THEN 'safe' END AS verdict FROM routed""", *FULL, more=SCORED),
    "routing_stats": sql("""SELECT count(*) AS total_processed, count(*) FILTER (NOT escalated) AS resolved_count, count(*) FILTER (escalated) AS escalated_count, count(*) FILTER (by_score) AS by_uncertainty, count(*) FILTER (by_score AND sev_adj > 0) AS by_severity_adjusted,
        count(*) FILTER (by_length) AS by_taint_length, count(*) FILTER (crosses_files) AS by_interprocedural, CAST(0 AS BIGINT) AS by_interprocedural_critical FROM routed""", *FULL, more=SCORED),
    "route_graph": sql("""SELECT r.id, coalesce(array_to_string(g.pred_set, ','), '-') AS pred_set, g.pred_set IS NULL OR len(g.pred_set) > 1 AS escalated, CASE WHEN len(g.pred_set) <= 1 THEN 'graph' END AS stage_resolved,
        CASE WHEN len(g.pred_set) = 0 THEN 'unknown' WHEN len(g.pred_set) = 1 THEN CASE WHEN g.pred_set[1] = 'vulnerable' THEN 'likely' ELSE 'safe' END END AS verdict FROM routed r LEFT JOIN graphs g ON r.id = g.id WHERE r.escalated""", *FULL, "predictions", more=SCORED + ", " + GRAPHS),
    "cvss_base": sql(f"SELECT id, base, vector, {SEVERITY_OF.format('base')} AS severity FROM (SELECT id, {cvss_sql(*METRICS)} AS base, {VECTOR.format(*METRICS)} AS vector FROM verdicts)", "verdicts"),
    "cvss_cwe_default": sql(f"SELECT id, cwe_id, cvss_base, cvss_vector, {SEVERITY_OF.format('cvss_base')} AS cvss_severity FROM (SELECT id, cwe_id, {cvss_sql(*METRICS)} AS cvss_base, {VECTOR.format(*METRICS)} AS cvss_vector FROM m)", "findings", more=_DEFAULTED),
    "consensus_rules": sql("SELECT id, llm_verdict, round(llm_confidence, 6) AS llm_confidence FROM agreed", "verdicts", more=CONSENSUS),
    "weights_with_default": sql(f"SELECT f.id, f.cwe_id, {_W} FROM findings f LEFT JOIN weights w ON f.cwe_id = w.cwe_id", "findings", more=_WEIGHTS),
    "fuse_classify": sql(f"""SELECT id, round(f, 6) AS fused_score, CASE WHEN ex AND cov < 0.3 THEN 'confirmed' WHEN NOT ex AND cov > 0.8 THEN 'safe' WHEN round(f, 9) >= {D(0.85)} THEN 'confirmed' WHEN round(f, 9) >= {D(0.5)} THEN 'likely' WHEN f > 0 THEN 'potential' ELSE 'unknown' END AS verdict,
        llm_verdict, round(lc, 6) AS llm_confidence FROM fu""", "findings", "verdicts", more=", ".join([CONSENSUS, _WEIGHTS, _FUSE])),
    "cascade": cascade_sql(), "sast_only": cascade_sql("sast"), "cascade_to_graph": cascade_sql("graph"),
    "flow_properties": sql("""SELECT f.id, coalesce(w.len, 0) AS length, coalesce(w.len >= 2 AND w.files > 1, FALSE) AS crosses_files, (SELECT file_path FROM steps s WHERE s.id = f.id AND n = 1) AS source,
        (SELECT file_path FROM steps s WHERE s.id = f.id AND n = w.len) AS sink, coalesce((SELECT string_agg(n || '.' || file_path || ':' || line, ' -> ' ORDER BY n) FROM steps s WHERE s.id = f.id), '') AS summary FROM findings f LEFT JOIN flows w ON f.id = w.id""", "flows", "steps", "findings"),
    "finding_scalars": sql(f"""SELECT id, substr(sha256(rule_id || ':' || file_path || ':' || line), 1, 16) AS hash, file_path || ':' || line AS place, '[' || upper(severity) || '] ' || cwe_id || ' at ' || file_path || ':' || line AS summary, {_OWASP} AS owasp, {_CATEGORY} AS category,
        CASE WHEN confidence >= 0.9 THEN 'confirmed' WHEN confidence >= 0.8 THEN 'likely' ELSE 'potential' END AS sast_verdict, {case("severity", fixed.LEVEL_BY_SEVERITY, "NULL")} AS level, cwe_id AS normal_cwe FROM findings""", "findings"),
    "severity_maps": sql("SELECT id, ['high','medium','low','info','medium'][CAST(id % 5 + 1 AS INTEGER)] AS severity, ['fail','fail','review','pass','open'][CAST(id % 5 + 1 AS INTEGER)] AS kind FROM findings", "findings"),
    "complexity_route": sql(f"""SELECT id, CASE WHEN round(total, 9) < {D(0.3)} THEN 'minimal' WHEN round(total, 9) < {D(0.6)} THEN 'standard' ELSE 'full' END AS tier, round(score, 6) AS score, CASE WHEN round(score, 9) >= {D(0.7)} THEN 'large' ELSE 'small' END AS model FROM (SELECT id, total,
        CASE WHEN crosses_files THEN {D(0.4)} ELSE {D(0)} END + CASE WHEN flow_length > 3 THEN {D(0.2)} ELSE {D(0)} END + CASE WHEN line > 200 THEN {D(0.3)} WHEN line > 50 THEN {D(0.1)} ELSE {D(0)} END + CASE WHEN cwe_id <> '' AND cwe_id NOT IN ({_ROUTINE}) THEN {D(0.2)} ELSE {D(0)} END
        + {case("severity", fixed.COMPLEXITY_BY_SEVERITY, D(0))} + total * {D(0.15)} + CASE WHEN id % 3 = 0 THEN {D(0.2)} ELSE {D(0)} END AS score FROM totalled)""", *FULL, more=SCORED),
    "parse_verdict_json": sql("SELECT id, CASE WHEN id % 17 = 0 THEN FALSE ELSE exploitable END AS exploitable, CASE WHEN id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE round(confidence, 6) END AS confidence, CASE WHEN id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE round(coverage, 6) END AS coverage, CASE WHEN id % 17 = 0 THEN TRUE ELSE feasible END AS feasible, id % 17 <> 0 AS parsed, CASE WHEN id % 17 = 0 THEN 34 ELSE 0 END AS reasoning_length FROM verdicts", "verdicts"),
    "validate_ranges": sql("SELECT id, round(confidence + CAST(0.2 AS DOUBLE), 6) AS raised FROM findings WHERE round(confidence + CAST(0.2 AS DOUBLE), 6) > 1", "findings"),
    "merge_findings": sql("""SELECT b.id, round(CASE WHEN la.id IS NOT NULL THEN least(b.confidence + CAST(0.1 AS DOUBLE), 1) ELSE b.confidence END, 6) AS confidence, CASE WHEN la.id IS NOT NULL THEN 'corroborated' ELSE '' END AS tags, CASE WHEN la.id IS NOT NULL THEN la.tool || ',' || b.tool ELSE b.tool END AS tools
        FROM b LEFT JOIN la ON b.file_path = la.file_path AND b.line = la.line AND b.cwe_id = la.cwe_id
        UNION ALL SELECT id, round(confidence, 6), '', tool FROM la WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file_path = la.file_path AND b.line = la.line AND b.cwe_id = la.cwe_id)""", "findings", more=AB),
    "uncorroborated": sql("SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file_path = a.file_path AND b.line = a.line AND b.cwe_id = a.cwe_id)", "findings", more=AB),
    "union_findings": sql("SELECT tool, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY tool", "findings", more=AB),
    "finding_dedup": sql("SELECT id, cwe_id, file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY cwe_id, file_path ORDER BY line, id) AS rn FROM findings) WHERE rn = 1", "findings"),
    "ground_truth_join": sql("SELECT g.label, g.verdict, EXISTS (SELECT 1 FROM d WHERE d.cwe_id = g.cwe_id AND (g.lo IS NULL OR (d.line >= g.lo AND d.line <= g.hi))) AS matched FROM ground_truth g", "findings", "ground_truth", more="d AS (SELECT DISTINCT cwe_id, line FROM findings)"),
    "cve_upsert": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS score FROM orders",
    "retain_uncalibrated": sql("SELECT cwe_id, round(avg(confidence), 6) AS w FROM findings WHERE id % 2 = 0 AND cwe_id IN ('CWE-89', 'CWE-78') GROUP BY cwe_id UNION ALL SELECT cwe_id, round(max(confidence), 6) FROM findings WHERE cwe_id NOT IN (SELECT cwe_id FROM findings WHERE id % 2 = 0 AND cwe_id IN ('CWE-89', 'CWE-78')) GROUP BY cwe_id", "findings"),
    "batch_chunks": sql("SELECT repo, CAST((rn - 1) // 5 AS BIGINT) AS chunk, min(id) AS first, count(*) AS n FROM (SELECT id, repo, row_number() OVER (PARTITION BY repo ORDER BY id) AS rn FROM findings) GROUP BY 1, 2", "findings"),
    "lookup_enrich": sql(f"SELECT id, {_OWASP} AS owasp, {_CATEGORY} AS category FROM findings", "findings"),
}
