"""Boundary cases of scoring, routing, verdicts and fusion, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import scoring as s
from siftline.functions import texts
from siftline.operators import findings as op
from siftline.operators import reports as rep

FINDING = "id long, cwe_id string, severity string, confidence double, taint_flow array<struct<file_path:string,line:int>>, corroborating_tools array<string>, tool_verdicts map<string,string>"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def finding(spark, *rows):
    base = {"id": 1, "cwe_id": "CWE-89", "severity": "medium", "confidence": 0.9, "taint_flow": None, "corroborating_tools": None, "tool_verdicts": None}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], FINDING)


@pytest.mark.parametrize(("metrics", "score"), [
    (("network", "low", "none", "none", "unchanged", "high", "high", "high"), 9.8), (("network", "low", "none", "required", "changed", "low", "low", "none"), 6.1),
    (("local", "high", "low", "none", "unchanged", "high", "high", "high"), 7.0), (("network", "low", "none", "none", "unchanged", "none", "none", "none"), 0.0), (("NETWORK", "odd", "none", "none", "unchanged", "high", "none", "none"), 7.5),
])
def test_cvss(spark, metrics, score):
    assert one(spark, s.cvss_base(*map(F.lit, metrics))) == pytest.approx(score)


def test_cvss_vector_and_labels(spark):
    assert one(spark, s.cvss_vector(*map(F.lit, ("network", "low", "none", "required", "changed", "low", "low", "none")))) == "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"
    assert [one(spark, s.cvss_severity(F.lit(x))) for x in (0.0, 0.1, 3.9, 4.0, 6.9, 7.0, 8.9, 9.0)] == ["none", "low", "low", "medium", "medium", "high", "high", "critical"]


@pytest.mark.parametrize(("case", "verdict", "confidence"), [
    ((True, 0.9, 0.2, True), "confirmed", 0.9), ((True, 0.1, 0.49, True), "confirmed", 0.51), ((False, 0.1, 0.71, True), "safe", 0.9), ((False, 0.5, 0.7, False), "safe", 0.8),
    ((True, 0.9, 0.5, True), "likely", 0.62), ((True, 0.0, 1.0, True), "likely", 0.3), ((False, 0.2, 0.7, True), "potential", 0.46), ((False, 0.2, 0.0, True), "potential", 0.6),
])
def test_consensus(spark, case, verdict, confidence):
    got = one(spark, s.consensus(*map(F.lit, case)))
    assert got.verdict == verdict and got.confidence == pytest.approx(confidence)


def test_fuse_drops_absent_stages(spark):
    none = F.lit(None).cast("double")
    w = [F.lit(0.3), F.lit(0.3), F.lit(0.4)]
    assert one(spark, s.fuse(F.lit(0.8), none, none, *w)) == pytest.approx(0.8)
    assert one(spark, s.fuse(F.lit(0.8), F.lit(0.2), none, *w)) == pytest.approx(0.5)
    assert one(spark, s.fuse(F.lit(0.8), F.lit(0.2), F.lit(1.0), *w)) == pytest.approx(0.7)
    assert one(spark, s.fuse(F.lit(0.8), none, none, F.lit(0.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.8)


@pytest.mark.parametrize(("score", "exploitable", "coverage", "tier"), [(0.85, None, None, "confirmed"), (0.5, None, None, "likely"), (0.49, None, None, "potential"), (0.0, None, None, "unknown"), (0.1, True, 0.29, "confirmed"), (0.9, False, 0.81, "safe"), (0.9, False, 0.8, "confirmed")])
def test_classify(spark, score, exploitable, coverage, tier):
    assert one(spark, s.classify(F.lit(score), F.lit(exploitable).cast("boolean"), F.lit(coverage).cast("double"))) == tier


def test_uncertainty_factors(spark):
    flow = [("a", 1), ("a", 2), ("b", 3)]
    x = op.with_uncertainty(finding(spark, {"taint_flow": flow}, {"id": 2, "cwe_id": ""}, {"id": 3, "cwe_id": "CWE-9999", "corroborating_tools": ["a", "b"], "tool_verdicts": {"a": "safe", "b": "likely"}}, {"id": 4, "corroborating_tools": ["a"], "tool_verdicts": {}}, {"id": 5, "corroborating_tools": ["a"], "tool_verdicts": {"a": "likely", "b": "potential"}}))
    got = {r.id: r for r in x.collect()}
    assert got[1].comp == pytest.approx((0.5 + 0.4) / 2) and got[1].crosses_files and got[1].nov == 0.15
    assert (got[2].nov, got[2].confl, got[3].nov, got[3].confl, got[4].confl, got[5].confl) == (1.0, 0.0, 0.85, 1.0, 0.5, 0.5)


def test_route_reasons(spark):
    long = [("a", k) for k in range(4)]
    rows = [{"id": 1}, {"id": 2, "taint_flow": long}, {"id": 3, "taint_flow": [("a", 1), ("b", 2)], "severity": "critical"}, {"id": 4, "confidence": 0.0, "cwe_id": "", "severity": "critical"}]
    got = {r.id: r for r in op.route_sast(finding(spark, *rows)).collect()}
    assert not got[1].escalated and got[1].stage_resolved == "sast" and got[1].verdict == "safe"
    assert got[2].reasons == ["taint_length"] and got[3].reasons == ["interprocedural"] and got[4].reasons == ["uncertainty", "severity_adjusted"]
    stats = rep.routing_stats(op.route_sast(finding(spark, *rows))).first()
    assert stats.total_processed == stats.resolved_count + stats.escalated_count == 4


@pytest.mark.parametrize(("sets", "escalated", "verdict"), [(["Vulnerable"], False, "likely"), (["safe"], False, "safe"), (["safe", "vulnerable"], True, None), ([], False, "unknown"), (None, True, None)])
def test_route_graph(spark, sets, escalated, verdict):
    got = op.route_graph(spark.createDataFrame([(1, sets)], "id long, pred_set array<string>")).first()
    assert got.escalated == escalated and got.verdict == verdict


def test_truth_intervals(spark):
    truth = spark.createDataFrame([("a", "X", "confirmed", 10, 20), ("b", "X", "safe", 100, 140), ("c", "X", "safe", None, None), ("d", "Y", "safe", None, None)], "label string, cwe_id string, verdict string, lo int, hi int")
    found = spark.createDataFrame([("X", 5, 10), ("X", 141, 150), ("X", 90, 99)], "cwe_id string, line int, end_line int")
    assert {r.label: r.matched for r in op.matched_truth(truth, found).collect()} == {"a": True, "b": False, "c": True, "d": False}
    wide = spark.createDataFrame([("X", 1, 1000)], "cwe_id string, line int, end_line int")
    assert {r.label: r.matched for r in op.matched_truth(truth, wide).collect()}["b"]


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_swept_intervals_match_brute_force(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice("XYZ"), at := rng.randrange(300), rng.choice([None, at, at + rng.randrange(40)])) for _ in range(40)] + [("W", 5, 10_000_000), ("V", 20_000_000, 20_000_001)]
    ranges = [(n, rng.choice("XYZUVW"), lo := rng.randrange(400), lo + rng.choice([0, 3, 30, 10_000_000])) for n in range(200)] + [(900, "X", None, None), (901, "U", None, None), (902, None, 1, 400)]
    truth = spark.createDataFrame(ranges, "label int, cwe_id string, lo int, hi int")
    found = spark.createDataFrame(spans, "cwe_id string, line int, end_line int")
    want = {n: any(c == cwe and (lo is None or (s <= hi and (e if e is not None else s) >= lo)) for c, s, e in spans) for n, cwe, lo, hi in ranges}
    got = op.matched_truth(truth, found, width)
    assert got.columns == [*truth.columns, "matched"] and {r.label: r.matched for r in got.collect()} == want


def test_wide_ranges_make_no_rows(spark):
    truth = spark.createDataFrame([(1, "X", 0, 2_000_000_000)], "label int, cwe_id string, lo int, hi int")
    found = spark.createDataFrame([("X", 7, 2_100_000_000)], "cwe_id string, line int, end_line int")
    got = op.matched_truth(truth, found)
    assert got.first().matched and "Generate" not in got._jdf.queryExecution().toString()


def test_empty_rates_are_zero(spark):
    none = spark.createDataFrame([], "stage_resolved string, verdict string, severity string")
    got = rep.cascade_stats(none).first()
    assert (got.total, got.efficiency, got.graph_rate, got.llm_rate) == (0, 0.0, 0.0, 0.0)
    assert rep.risk_level(none).first().risk_level == "MINIMAL"


@pytest.mark.parametrize(("path", "strict", "wide", "scanned"), [("src/a.py", "python", "python", True), ("src/a.mts", None, "typescript", False), ("x/node_modules/a.js", "javascript", "javascript", False), ("bin/a.js", "javascript", "javascript", False), ("bin/a.py", "python", "python", True), ("a/b.min.js", "javascript", "javascript", False), ("a/Gruntfile.js", "javascript", "javascript", False), ("a/README", None, "python", False)])
def test_paths(spark, path, strict, wide, scanned):
    p = F.lit(path)
    assert (one(spark, s.file_language(p)), one(spark, s.file_language(p, wide=True)), one(spark, s.scannable(p))) == (strict, wide, scanned)


def test_explanation_names_the_stages_that_ran(spark):
    none = F.lit(None).cast("double")
    text = one(spark, texts.fusion_explanation(F.lit("CWE-89"), F.lit("m"), F.lit(0.5), none, F.lit(0.25), F.lit(0.4), F.lit("potential")))
    assert text.split("\n") == ["CWE-89: m", "SAST confidence: 50%", "LLM consensus confidence: 25%", "Fused score: 0.40 -> Verdict: potential"]
