"""CVE records with texts of any length, and with none."""

import json
from hashlib import md5

from pyspark.sql import functions as F

from siftline.plans import scans
from siftline.sources import knowledge


def test_texts_of_any_length_and_none(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "x\x00 ￾"), (5, ""), (7, "short")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).select(F.lit(6).cast("long").alias("doc_id"), F.expr("repeat('ab', 10500000)").alias("text")).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"].removeprefix("CVE-2024-"): r["hash"] for r in scans.nvd_json_scan(spark, str(tmp_path)).collect()}
    of = lambda s: md5(s.encode()).hexdigest()
    assert got == {"1": None, "2": of(""), "3": of("x\x00 ￾"), "5": of("otro"), "6": of("ab" * 10500000), "7": of("short")}


def test_the_parser_still_falls_back(spark):
    record = lambda n, *d: (json.dumps({"id": n, "descriptions": [{"lang": x, "value": y} for x, y in d]}),)
    rows = spark.createDataFrame([record("a", ("es", "otro"), ("en", "")), record("b"), record("c", ("en", "")), ("no JSON",)], "json string")
    assert [tuple(r) for r in knowledge.parse_cve(rows).select("id", "description").collect()] == [("a", "otro")]
    assert sorted(tuple(r) for r in knowledge.parse_cve(rows, blank=True).select("id", "description").collect()) == [("a", ""), ("c", "")]
