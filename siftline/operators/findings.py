"""Operators over findings: scoring, routing, merging, enrichment, verdicts, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions import scoring as s
from siftline.tables import small_side


def with_uncertainty(findings: DataFrame) -> DataFrame:
    """findings with flow_length, crosses_files, the factors conf, comp, nov, confl, sev_adj, and total."""
    flow = F.col("taint_flow")
    out = findings.withColumns({"flow_length": s.flow_length(flow), "crosses_files": s.crosses_files(flow)})
    out = out.withColumns({
        "conf": s.confidence_uncertainty(F.col("confidence")), "comp": s.complexity_uncertainty(F.col("flow_length"), F.col("crosses_files")),
        "nov": s.novelty_uncertainty(F.col("cwe_id")), "confl": s.conflict_uncertainty(F.col("corroborating_tools"), F.col("tool_verdicts")), "sev_adj": s.severity_adjustment(F.col("severity")),
    })
    return out.withColumn("total", s.uncertainty_total(*[F.col(c) for c in ("conf", "comp", "nov", "confl", "sev_adj")]))


def route_sast(findings: DataFrame, threshold: float = fixed.ESCALATE_AT, long_flow: int = fixed.LONG_FLOW) -> DataFrame:
    """findings with uncertainty, reasons (array), escalated, and for the others stage_resolved and verdict.

    Totals are compared at nine decimals, so that sums that stand on the threshold count as reaching it in every engine.
    """
    out = findings if "total" in findings.columns else with_uncertainty(findings)
    scored, longer, crosses = F.round("total", 9) >= threshold, F.col("flow_length") > long_flow, F.col("crosses_files")
    critical = crosses & (F.col("severity") == "critical") & ~(scored | longer | crosses)
    reasons = F.filter(F.array(F.when(scored, "uncertainty"), F.when(scored & (F.col("sev_adj") > 0), "severity_adjusted"), F.when(longer, "taint_length"), F.when(crosses, "interprocedural"), F.when(critical, "interprocedural_critical")), lambda r: r.isNotNull())
    out = out.withColumn("reasons", reasons).withColumn("escalated", F.size("reasons") > 0)
    return out.withColumns({"stage_resolved": F.when(~F.col("escalated"), "sast"), "verdict": F.when(~F.col("escalated"), "safe")})


def route_graph(findings: DataFrame) -> DataFrame:
    """findings(pred_set) with escalated, stage_resolved and verdict: a missing or ambiguous prediction set escalates."""
    up = F.col("pred_set").isNull() | (F.size("pred_set") > 1)
    return findings.withColumns({"escalated": up, "stage_resolved": F.when(~up, "graph"), "verdict": F.when(~up, s.graph_verdict(F.col("pred_set")))})


def weights_table(spark) -> DataFrame:
    """(cwe_id, w_sast, w_graph, w_llm), with a row `default`."""
    return spark.createDataFrame([(k, *v) for k, v in fixed.WEIGHTS.items()], "cwe_id string, w_sast double, w_graph double, w_llm double")


def with_weights(findings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """findings with the stage weights of their CWE, else of the row `default`, else .3, .3, .4. The weight table has a row a CWE; a caller's is
    counted before it is broadcast. Its default row is read when the plan is made."""
    table = weights_table(findings.sparkSession) if weights is None else weights
    found = table.where("cwe_id = 'default'").first()
    names = {"w_sast": 0.3, "w_graph": 0.3, "w_llm": 0.4}
    side = table.where("cwe_id <> 'default'")
    out = findings.join(F.broadcast(side) if weights is None else small_side(side), "cwe_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(found[n] if found else v)) for n, v in names.items()})


def attach_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings with the attacker's and defender's record by id (null where there is none), consensus, and CVSS for all."""
    v = verdicts.select("id", "exploitable", F.col("confidence").alias("attacker_confidence"), "coverage", "feasible", F.struct("av", "ac", "pr", "ui", "scope", "c", "i", "a").alias("metrics"))
    out = findings.join(v, "id", "left")
    agreed = F.when(F.col("exploitable").isNotNull(), s.consensus(F.col("exploitable"), F.col("attacker_confidence"), F.col("coverage"), F.col("feasible")))
    return out.withColumn("agreed", agreed).withColumns({"llm_verdict": F.col("agreed.verdict"), "llm_confidence": F.col("agreed.confidence")}).drop("agreed")


def with_cvss(findings: DataFrame) -> DataFrame:
    """findings(cwe_id[, metrics]) with cvss_base, cvss_vector, cvss_severity; without metrics those of the CWE."""
    names = ("av", "ac", "pr", "ui", "scope", "c", "i", "a")
    default = s.cvss_metrics(F.col("cwe_id"))
    m = [F.coalesce(F.col("metrics")[n], d) if "metrics" in findings.columns else d for n, d in zip(names, default, strict=True)]
    out = findings.withColumns({"cvss_base": s.cvss_base(*m), "cvss_vector": s.cvss_vector(*m)})
    return out.withColumn("cvss_severity", s.cvss_severity(F.col("cvss_base")))


def fuse_scores(findings: DataFrame) -> DataFrame:
    """findings(confidence, graph_risk, llm_confidence, exploitable, coverage and weights) with fused_score and verdict."""
    fused = s.fuse(F.col("confidence"), F.col("graph_risk"), F.col("llm_confidence"), F.col("w_sast"), F.col("w_graph"), F.col("w_llm"))
    out = findings.withColumn("fused_score", fused)
    return out.withColumn("verdict", s.classify(F.round("fused_score", 9), F.col("exploitable"), F.col("coverage")))


def cascade(findings: DataFrame, graphs: DataFrame, verdicts: DataFrame, max_stage: str = "llm", weights: DataFrame | None = None) -> DataFrame:
    """The whole cascade in one plan: route by score, then by prediction set, then by verdicts, then fuse.

    graphs(id, pred_set, graph_risk) and verdicts(id, ...) are joined by id, with the escalation as a condition of the join: findings
    are read and scored once, stay where the first join has put them, and those that are resolved meet no row. Returns findings with
    stage_resolved, verdict, fused_score and CVSS; max_stage `sast` or `graph` stops there.
    """
    x = route_sast(findings).withColumn("_up", F.col("escalated") & F.lit(max_stage != "sast"))
    if max_stage == "sast":
        x = x.withColumns({"pred_set": F.lit(None).cast("array<string>"), "graph_risk": F.lit(None).cast("double")})
    else:
        g = graphs.select(F.col("id").alias("_g"), "pred_set", "graph_risk")
        x = x.join(g, (F.col("id") == F.col("_g")) & F.col("_up"), "left")
    unsure = F.col("pred_set").isNull() | (F.size("pred_set") > 1)
    x = x.withColumn("_last", F.col("_up") & unsure & F.lit(max_stage == "llm"))
    metrics = ("av", "ac", "pr", "ui", "scope", "c", "i", "a")
    if max_stage == "llm":
        v = verdicts.select(F.col("id").alias("_v"), "exploitable", F.col("confidence").alias("_sure"), "coverage", "feasible", F.struct(*metrics).alias("metrics"))
        x = x.join(v, (F.col("id") == F.col("_v")) & F.col("_last"), "left")
        agreed = F.when(F.col("exploitable").isNotNull(), s.consensus(F.col("exploitable"), F.col("_sure"), F.col("coverage"), F.col("feasible"))["confidence"])
    else:
        x = x.withColumns({"exploitable": F.lit(None).cast("boolean"), "coverage": F.lit(None).cast("double"), "metrics": F.lit(None).cast("struct<" + ",".join(f"{m}:string" for m in metrics) + ">")})
        agreed = F.lit(None).cast("double")
    stage = F.when(~F.col("_up"), "sast").when(~unsure, "graph").when(F.col("exploitable").isNotNull(), "llm").otherwise("unresolved")
    x = x.withColumns({"llm_confidence": agreed, "stage_resolved": stage})
    keep = [*findings.columns, "total", "reasons", "pred_set", "graph_risk", "stage_resolved", "exploitable", "coverage", "llm_confidence", "metrics"]
    return with_cvss(fuse_scores(with_weights(x.select(*keep), weights)))


def merge_tools(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("file_path", "line", "cwe_id")) -> DataFrame:
    """Findings of two tools merged by place: the second tool's row stays; where both found it its confidence grows by .1
    (1 at most) and it is tagged. Rows of the first tool alone stay, of repeats the last by id."""
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))).where("_n = 1").drop("_n")
    both = second.join(last.select(*keys, F.col("tool").alias("_tool"), F.lit(True).alias("_both")), list(keys), "left")
    raised = both.withColumns({"confidence": F.when(F.col("_both"), F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence")), "tags": F.when(F.col("_both"), F.array(F.lit("corroborated"))).otherwise(F.array().cast("array<string>")), "tools": F.when(F.col("_both"), F.array("_tool", "tool")).otherwise(F.array("tool"))})
    alone = last.join(second, list(keys), "left_anti").withColumns({"tags": F.array().cast("array<string>"), "tools": F.array("tool")})
    columns = [*first.columns, "tags", "tools"]
    return raised.select(*columns).unionByName(alone.select(*columns))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, the one with the latest version; of equal versions the change."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_per_key(both, [key], [F.desc(version), F.desc("_new")]).drop("_new")


def matched_truth(truth: DataFrame, findings: DataFrame, width: int = 65_536) -> DataFrame:
    """truth(label, cwe_id, verdict, lo, hi) with `matched`: a finding of its CWE overlaps lo..hi, or there is one at all if there is no range.

    A range is met if the findings that start at or before `hi` reach at least `lo`, so a sweep over the lines of a CWE that carries the
    largest end so far answers all ranges; no finding and no range becomes more than one row, however wide. Findings and ranges are
    first reduced to a row a (CWE, line). The lines of a CWE are swept in stretches of `width`, each on its own, with the
    largest end of the stretches before.
    """
    end = F.coalesce("end_line", "line") if "end_line" in findings.columns else F.col("line")
    starts = findings.select("cwe_id", F.col("line").cast("long").alias("at"), end.cast("long").alias("end"), F.lit(False).alias("asked"))
    asked = truth.where("lo IS NOT NULL").select("cwe_id", F.col("hi").cast("long").alias("at"), F.lit(None).cast("long").alias("end"), F.lit(True).alias("asked"))
    lines = starts.unionByName(asked).groupBy("cwe_id", "at").agg(F.max("end").alias("end"), F.max("asked").alias("asked")).withColumn("_s", F.floor(F.col("at") / width))
    before = Window.partitionBy("cwe_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.groupBy("cwe_id", "_s").agg(F.max("end").alias("_end")).select("cwe_id", "_s", F.max("_end").over(before).alias("_carried"))
    so_far = F.max("end").over(Window.partitionBy("cwe_id", "_s").orderBy("at"))
    swept = lines.withColumn("_far", so_far).where("asked").join(carried, ["cwe_id", "_s"])
    reach = swept.select("cwe_id", F.col("at").alias("hi"), F.greatest("_far", "_carried").alias("_reach"))
    anywhere = findings.select("cwe_id").distinct()
    ranged = truth.where("lo IS NOT NULL").join(reach, ["cwe_id", "hi"], "left").withColumn("matched", F.col("_reach") >= F.col("lo")).drop("_reach")
    loose = truth.where("lo IS NULL").join(anywhere.withColumn("matched", F.lit(True)), "cwe_id", "left")
    return ranged.unionByName(loose).withColumn("matched", F.coalesce("matched", F.lit(False))).select(*truth.columns, "matched")


def retain_missing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new doesn't have."""
    return new.unionByName(old.join(new, key, "left_anti"))


def batches(rows: DataFrame, order: str, group: str, size: int = 5, stretch: int = 50_000) -> DataFrame:
    """rows with `chunk`: groups of `size` in order of a whole-number column within `group`.

    Rows are numbered in stretches of the order, about `stretch` rows each, and shifted by the rows of the stretches before, so a
    group that holds most rows is numbered by many tasks.
    """
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * stretch // max(n, 1))
    x = rows.withColumn("_s", F.floor((F.col(order) - (low or 0)) / width))
    sizes = x.groupBy(group, "_s").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_s", (F.sum("_n").over(Window.partitionBy(group).orderBy("_s")) - F.col("_n")).alias("_before"))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_s").orderBy(order))).join(before, [group, "_s"])
    return x.withColumn("chunk", F.floor((F.col("_k") + F.col("_before") - 1) / size)).drop("_s", "_k", "_before")


def cap_per_key(rows: DataFrame, key: str, order: Column | str, cap: int) -> DataFrame:
    """The first `cap` rows of each key in a given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= cap).drop("_n")
