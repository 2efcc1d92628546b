"""Queries of calibration, evaluation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import calibration as cal
from siftline.plans import triage
from siftline.plans import views as v
from siftline.plans.views import sql

D = triage.D
P = "p AS (SELECT *, exp(x - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))) AS p0, exp(y - greatest(x, y)) / (exp(x - greatest(x, y)) + exp(y - greatest(x, y))) AS p1 FROM predictions)"
S = P + ", s AS (SELECT *, CASE WHEN label = (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) THEN greatest(p0, p1) ELSE p0 + p1 END AS score FROM p)"


def _p(spark, sf):
    return v.predictions(spark, sf).withColumn("p", cal.tempered_softmax(F.col("logits")))


def _scored(spark, sf):
    return _p(spark, sf).withColumn("score", cal.aps_score(F.col("p"), F.col("label"))).withColumn("key", F.lit(1))


def tempered_softmax(spark, sf):
    x = v.predictions(spark, sf).withColumn("p", cal.tempered_softmax(F.col("logits"), 0.5))
    return x.select("id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


def aps_scores(spark, sf):
    return _scored(spark, sf).select("id", F.round("score", 6).alias("score"))


def conformal_threshold(spark, sf):
    return cal.conformal_thresholds(_scored(spark, sf).select("key", "score"), "key").select(F.round("threshold", 6).alias("threshold"))


def quantile_higher(spark, sf):
    """The 90 % order statistic of order prices by status, at ceil(.9 (n - 1))."""
    o = v.table(spark, sf, "orders")
    wanted = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", F.ceil(F.round(0.9 * (F.col("n") - 1), 9)).alias("k"))
    return cal.order_statistics(o, "o_orderstatus", "o_totalprice", wanted).select("o_orderstatus", F.round("x", 2).alias("x"))


def _sets(spark, sf):
    x = _scored(spark, sf)
    cut = cal.conformal_thresholds(x.select("key", "score"), "key")
    return x.join(F.broadcast(cut), "key").withColumn("classes", cal.prediction_set(F.col("p"), F.col("threshold")))  # one row


def prediction_sets(spark, sf):
    return _sets(spark, sf).select("id", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


def coverage_report(spark, sf):
    return cal.coverage_report(_sets(spark, sf), "grp").select("grp", *[F.round(c, 6).alias(c) for c in ("coverage", "singleton", "ambiguous", "mean_size")])


def temperature_search(spark, sf):
    x = cal.temperature_search(v.predictions(spark, sf))
    return x.select("t", *[F.round(c, 6).alias(c) for c in ("threshold", "coverage", "mean_size")], "best")


def threshold_search(spark, sf):
    rows = _p(spark, sf).select(F.col("p")[1].alias("p"), "label")
    return cal.threshold_search(rows).select("k", F.round("f1", 6).alias("f1"), "best")


def calibration_curve(spark, sf):
    """Coverage for 50 levels."""
    x = cal.coverage_curve(_scored(spark, sf), [k / 100 for k in range(1, 51)])
    return x.select((F.col("i") + 1).alias("percent"), F.round("coverage", 6).alias("coverage"))


def calibration_summary(spark, sf):
    s = F.col("score")
    return _scored(spark, sf).agg(F.count("*").alias("n"), *[F.round(x, 6).alias(n) for n, x in (("mean", F.avg(s)), ("std", F.stddev_pop(s)), ("min", F.min(s)), ("max", F.max(s)), ("median", F.median(s)))])


def weight_grid_search(spark, sf):
    from siftline.operators import findings as op

    return cal.weight_grid(op.weights_table(spark).join(v.findings(spark, sf).select("cwe_id").distinct(), "cwe_id")).select("cwe_id", *[F.round(c, 2).alias(c) for c in "abc"], F.round("score", 6).alias("score"))


def roc_auc(spark, sf):
    return cal.roc_auc(_p(spark, sf).select(F.col("p")[1].alias("p"), "label")).select(F.round("auc", 6).alias("auc"))


def roc_curve(spark, sf):
    return cal.roc_points(_p(spark, sf).select(F.round(F.col("p")[1], 2).alias("p"), "label")).select("p", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def min_lines_filter(spark, sf):
    return v.samples(spark, sf).where(F.size(F.split(F.trim(F.regexp_replace("code", r"^\s+|\s+$", "")), "\n")) >= 3).select("id")


def content_dedup(spark, sf):
    d = v.samples(spark, sf).select(F.md5("code").alias("hash"), "id", "label")
    return d.groupBy("hash").agg(F.min_by("label", "id").alias("label"), F.min("id").alias("id"))


def balance_1to1(spark, sf):
    return cal.balance(v.samples(spark, sf), most=60).select("id", "language", "label")


def stratified_split(spark, sf):
    parts = {"train": 0.6, "val": 0.15, "cal": 0.15, "test": 0.1}
    return cal.stratified_split(v.samples(spark, sf), parts, ["label", "language"]).select("id", "part")


QUERIES = {
    "tempered_softmax": tempered_softmax, "aps_scores": aps_scores, "conformal_threshold": conformal_threshold, "quantile_higher": quantile_higher, "prediction_sets": prediction_sets,
    "coverage_report": coverage_report, "temperature_search": temperature_search, "threshold_search": threshold_search, "calibration_curve": calibration_curve, "calibration_summary": calibration_summary,
    "weight_grid_search": weight_grid_search, "roc_auc": roc_auc, "roc_curve": roc_curve, "min_lines_filter": min_lines_filter, "content_dedup": content_dedup, "balance_1to1": balance_1to1, "stratified_split": stratified_split,
}

_CUT = "c AS (SELECT least(score, 1) AS t FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM s) q WHERE k = ceil(round(least(ceil((n + 1) * (1 - {a})) / n, 1) * (n - 1), 9)))".format(a=D(0.1))
_SETS = S + ", " + _CUT + ", z AS (SELECT s.*, CASE WHEN greatest(p0, p1) < t THEN '0,1' WHEN p1 > p0 THEN '1' ELSE '0' END AS classes FROM s, c)"
_TEMPS = ", ".join(f"({D(t)})" for t in cal.temperature_grid())
_TEMPERED = f"""g(t) AS (VALUES {_TEMPS}), p AS (SELECT t, label, 1 / (1 + exp(-abs(x / t - y / t))) AS big, CASE WHEN y > x THEN 1 ELSE 0 END AS top FROM predictions, g),
s AS (SELECT *, CASE WHEN label = top THEN big ELSE 1 END AS score FROM p),
c AS (SELECT t, least(score, 1) AS cut FROM (SELECT t, score, row_number() OVER (PARTITION BY t ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY t) AS n FROM s) q WHERE k = ceil(round(least(ceil((n + 1) * (1 - {D(0.1)})) / n, 1) * (n - 1), 9))),
r AS (SELECT s.t, any_value(c.cut) AS threshold, avg(CASE WHEN round(big, 12) < round(cut, 12) OR label = top THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN round(big, 12) < round(cut, 12) THEN 2.0 ELSE 1.0 END) AS mean_size FROM s JOIN c ON s.t = c.t GROUP BY s.t)"""
SQL = {
    "tempered_softmax": sql("SELECT id, round(1 / (1 + exp(2 * y - 2 * x)), 6) AS p0, round(1 / (1 + exp(2 * x - 2 * y)), 6) AS p1 FROM predictions", "predictions"),
    "aps_scores": sql("SELECT id, round(score, 6) AS score FROM s", "predictions", more=S),
    "conformal_threshold": sql("SELECT round(t, 6) AS threshold FROM c", "predictions", more=S + ", " + _CUT),
    "quantile_higher": f"SELECT o_orderstatus, round(o_totalprice, 2) AS x FROM (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) q WHERE k = ceil(round({D(0.9)} * (n - 1), 9))",
    "prediction_sets": sql("SELECT id, classes FROM z", "predictions", more=_SETS),
    "coverage_report": sql("SELECT grp, round(avg(CASE WHEN contains(classes, CAST(label AS VARCHAR)) THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN length(classes) = 1 THEN 1.0 ELSE 0.0 END), 6) AS singleton, round(avg(CASE WHEN length(classes) > 1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous, round(avg(CASE WHEN length(classes) > 1 THEN 2.0 ELSE 1.0 END), 6) AS mean_size FROM z GROUP BY 1", "predictions", more=_SETS),
    "temperature_search": sql(f"SELECT t, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, round(mean_size, 6) AS mean_size, round(coverage, 9) >= {D(0.9)} AND row_number() OVER (ORDER BY CASE WHEN round(coverage, 9) >= {D(0.9)} THEN 0 ELSE 1 END, round(mean_size, 9), t) = 1 AS best FROM r", "predictions", more=_TEMPERED),
    "threshold_search": sql(f"SELECT CAST(k AS INTEGER) AS k, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, k) = 1 AS best FROM (SELECT k, 2 * pr * re / (pr + re + 1e-9) AS f1 FROM m) q", "predictions", more=P + f""", g AS (SELECT unnest(range(81)) AS k), h AS (SELECT p1, label, floor((p1 - {D(0.05)}) / {D(0.9)} * 80 + 1e-9) + 1 AS r FROM p),
        t AS (SELECT k, count(*) FILTER (r > k AND label = 1) AS tp, count(*) FILTER (r > k AND label <> 1) AS fp, count(*) FILTER (label = 1) AS ap FROM g, h GROUP BY k), m AS (SELECT k, tp / (tp + fp + 1e-9) AS pr, tp / (ap + 1e-9) AS re FROM t)"""),
    "calibration_curve": sql("SELECT CAST(c.a AS INTEGER) AS percent, round(avg(CASE WHEN label = (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) OR greatest(p0, p1) < c.t THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM s, c GROUP BY 1", "predictions", more=S + """, g AS (SELECT unnest(range(1, 51)) AS a),
        q AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM s), c AS (SELECT a, least(score, 1) AS t FROM q, g WHERE k = ceil(round(least(ceil((n + 1) * (1 - CAST(a AS DOUBLE) / 100)) / n, 1) * (n - 1), 9)))"""),
    "calibration_summary": sql("SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median FROM s", "predictions", more=S),
    "weight_grid_search": sql("SELECT cwe_id, round(a, 2) AS a, round(b, 2) AS b, round(c, 2) AS c, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cwe_id ORDER BY round(score, 9) DESC, i, j) AS rn FROM x) q WHERE rn = 1", "findings", more=triage._WEIGHTS + f""",
        g AS (SELECT i, j, CAST(i AS DOUBLE) / 10 AS a, CAST(j AS DOUBLE) / 10 AS b, CAST(10 - i - j AS DOUBLE) / 10 AS c FROM range(11) t1(i), range(11) t2(j) WHERE i + j <= 10),
        x AS (SELECT w.cwe_id, i, j, a, b, c, {D(0.3)} * (1 - greatest(abs(a - b), abs(b - c), abs(a - c))) + {D(0.7)} * (1 - (abs(a - w_sast) + abs(b - w_graph) + abs(c - w_llm)) / 2) AS score FROM weights w, g WHERE w.cwe_id IN (SELECT cwe_id FROM findings))"""),
    "roc_auc": sql("SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - CAST(count(*) FILTER (label = 1) AS DOUBLE) * (count(*) FILTER (label = 1) + 1) / 2) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label <> 1)), 6) AS auc FROM (SELECT label, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS r FROM p) q", "predictions", more=P),
    "roc_curve": sql("SELECT p, round(CAST(sum(neg) OVER (ORDER BY p DESC) AS DOUBLE) / sum(neg) OVER (), 6) AS fpr, round(CAST(sum(pos) OVER (ORDER BY p DESC) AS DOUBLE) / sum(pos) OVER (), 6) AS tpr FROM (SELECT round(p1, 2) AS p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM p GROUP BY 1) q", "predictions", more=P),
    "min_lines_filter": sql(r"SELECT id FROM samples WHERE len(string_split(regexp_replace(regexp_replace(code, '^\s+', ''), '\s+$', ''), chr(10))) >= 3", "samples"),
    "content_dedup": sql("SELECT md5(code) AS hash, arg_min(label, id) AS label, min(id) AS id FROM samples GROUP BY 1", "samples"),
    "balance_1to1": sql("SELECT id, language, label FROM r JOIN n USING (language) WHERE rn <= least(one, zero, 30)", "samples", more="n AS (SELECT language, count(*) FILTER (label = 1) AS one, count(*) FILTER (label = 0) AS zero FROM samples GROUP BY 1 HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY md5(id || '42'), id) AS rn FROM samples)"),
    "stratified_split": sql(f"SELECT id, CASE WHEN place < {D(0.6)} THEN 'train' WHEN place < {D(0.75)} THEN 'val' WHEN place < {D(0.9)} THEN 'cal' ELSE 'test' END AS part FROM r", "samples", more="r AS (SELECT id, round(CAST(row_number() OVER (PARTITION BY label, language ORDER BY md5(id || '42'), id) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY label, language), 9) AS place FROM samples)"),
}
