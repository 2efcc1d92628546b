"""Documents of findings are made by as many tasks as hold a bounded number of results each."""

import json

from pyspark.sql import functions as F

from siftline.sources import sarif


def _findings(spark, n):
    flow = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit('a "b".py').alias("file_path"), F.lit(4).alias("line"))))
    return spark.range(n).select("id", F.lit("r1").alias("rule_id"), F.lit("CWE-89").alias("cwe_id"), F.lit("high").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line"), F.lit(3).alias("repo"), flow.alias("taint_flow"))


def test_tasks_hold_a_bounded_number_of_results(spark, monkeypatch):
    monkeypatch.setattr(sarif, "RESULTS_A_TASK", 20, raising=False)
    got = sarif.documents(_findings(spark, 400), "repo", most=10)
    each = got.select(F.spark_partition_id().alias("k"), F.size(F.from_json("body", "runs array<struct<results:array<struct<ruleId:string>>>>")["runs"][0]["results"]).alias("n"))
    held = [r["n"] for r in each.groupBy("k").agg(F.sum("n").alias("n")).collect()]
    assert sum(held) == 400 and len(held) > 8 and max(held) < 90


def test_documents_are_whole(spark):
    rows = sarif.documents(_findings(spark, 30), "repo", most=1000).collect()
    assert [r["doc"] for r in rows] == ["3#0"]
    run = json.loads(rows[0]["body"])["runs"][0]
    assert [r["message"]["text"] for r in run["results"]] == [f"finding {k}" for k in range(30)]
    assert run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"][0]["location"]["physicalLocation"]["artifactLocation"]["uri"] == 'a "b".py'
    assert "codeFlows" not in run["results"][1]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1"] and run["invocations"] == [{"executionSuccessful": True, "properties": {"findings": 30}}]
