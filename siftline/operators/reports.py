"""Counts and rates over findings: what reports print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.tables import written

REASONS = ["uncertainty", "severity_adjusted", "taint_length", "interprocedural", "interprocedural_critical"]


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 if whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def counted(findings: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """(key, n); with values exactly these, 0 where there is none."""
    found = findings.groupBy(key).agg(F.count("*").alias("n"))
    if values is None:
        return found
    given = findings.sparkSession.createDataFrame([(x,) for x in values], f"{key} string")
    return F.broadcast(given).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def routing_stats(routed: DataFrame) -> DataFrame:
    """One row of counters over routed findings; a finding counts once, its reasons each."""
    by = [F.count_if(F.array_contains("reasons", r)).alias(f"by_{r}") for r in REASONS]
    return routed.agg(F.count("*").alias("total_processed"), F.count_if(~F.col("escalated")).alias("resolved_count"), F.count_if("escalated").alias("escalated_count"), *by)


def cascade_stats(resolved: DataFrame, by: str | None = None) -> DataFrame:
    """Findings by the stage that resolved them, and the rates; per `by` if one is named. No findings give zeros."""
    stage = lambda s: F.count_if(F.col("stage_resolved") == s)
    sums = [F.count("*").alias("total"), stage("sast").alias("sast"), stage("graph").alias("graph"), stage("llm").alias("llm"), stage("unresolved").alias("unresolved")]
    out = resolved.groupBy(by).agg(*sums) if by else resolved.agg(*sums)
    up, third = F.col("total") - F.col("sast"), F.col("total") - F.col("sast") - F.col("graph")
    return out.withColumns({"efficiency": F.round(rate(F.col("sast"), F.col("total")), 6), "graph_rate": F.round(rate(F.col("graph"), up), 6), "llm_rate": F.round(rate(F.col("llm"), third), 6)})


def binary_metrics(rows: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of two booleans, overall or by groups (or both); 0 for 0 / 0."""
    counts = [F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")]
    grouped = (rows.rollup(*by) if rollup else rows.groupBy(*by)) if by else rows
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "accuracy": rate(tp + tn, tp + fp + fn + tn)}
    return grouped.agg(*counts).withColumns({k: F.round(x, 6) for k, x in values.items()})


def risk_level(findings: DataFrame, by: str | None = None) -> DataFrame:
    """One of five levels for all findings, or for each group."""
    bad = F.max(((F.col("verdict") == "confirmed") & F.col("severity").isin("critical", "high")).cast("int"))
    has = lambda w: F.count_if(F.col("verdict") == w) > 0
    level = F.when(F.coalesce(bad, F.lit(0)) == 1, "CRITICAL").when(has("confirmed"), "HIGH").when(has("likely"), "MEDIUM").when(has("potential"), "LOW").otherwise("MINIMAL")
    return (findings.groupBy(by) if by else findings).agg(level.alias("risk_level"))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `place`, their number from 1 in the given order, however many they are.

    Rows are sorted in ranges, one a task, and numbered within them; the ranges' sizes, a row a task, give the number that each begins with.
    """
    sorted_rows = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part).agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return sorted_rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(begins), "_part").withColumn("place", F.col("_before") + within + 1).drop("_part", "_before", "_at")
