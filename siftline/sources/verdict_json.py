"""Verdict records as JSON text, as a provider answers: perhaps in a code fence, perhaps cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "exploitable boolean, confidence double, coverage double, feasible boolean, reasoning string"


def documents(verdicts: DataFrame) -> DataFrame:
    """(id, body) from verdict columns: every tenth in a fence, every seventeenth cut off after 20 characters."""
    body = F.to_json(F.struct("exploitable", "confidence", "coverage", "feasible"))
    fenced = F.when(F.col("id") % 10 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return verdicts.select("id", F.when(F.col("id") % 17 == 0, F.substring(body, 1, 20)).otherwise(fenced).alias("body"))


def strip_fence(body):
    """The text without lines that begin with a fence."""
    return F.trim(F.regexp_replace(body, r"(?m)^```.*$", ""))


def parse(documents: DataFrame) -> DataFrame:
    """(id, exploitable, confidence, coverage, feasible, reasoning, parsed): missing fields get defaults, numbers are clamped to 0..1;
    text that is no JSON object gives the defaults with its first 500 characters as the reasoning."""
    ok = F.try_parse_json(strip_fence(F.col("body"))).isNotNull()
    x = documents.withColumn("parsed", F.coalesce(ok, F.lit(False))).withColumn("r", F.when(F.col("parsed"), F.from_json(strip_fence(F.col("body")), SCHEMA)))
    number = lambda c: F.least(F.greatest(F.coalesce(F.col(f"r.{c}"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias(c)
    raw = F.concat(F.lit("Raw response: "), F.substring("body", 1, 500))
    return x.select("id", F.coalesce("r.exploitable", F.lit(False)).alias("exploitable"), number("confidence"), number("coverage"), F.coalesce("r.feasible", F.lit(True)).alias("feasible"), F.when(F.col("parsed"), F.coalesce("r.reasoning", F.lit(""))).otherwise(raw).alias("reasoning"), "parsed")
