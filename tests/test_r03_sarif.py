"""Tables of rows of about a megabyte are written so that a reader's batch holds few of them."""

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siftline.sources import sarif
from siftline.tables import written


def test_wide_rows_end_their_row_group(spark):
    x = spark.range(0, 60, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda k: F.sha2(F.concat_ws(" ", "id", k).cast("string"), 256)), "").alias("body"))
    back = written(x, "wide", wide=True)
    files = [f for d in {os.path.dirname(f.removeprefix("file://")) for f in back.inputFiles()} for f in glob.glob(f"{d}/*.parquet")]
    rows = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(rows) == 60 and max(rows) < 30
    assert back.exceptAll(x).isEmpty() and back.count() == 60


def test_documents_are_not_gathered_by_group(spark):
    """Rules of a group go to its documents; the documents aren't dealt by their group again."""
    f = spark.range(40).select("id", F.lit("r1").alias("rule_id"), F.lit("CWE-89").alias("cwe_id"), F.lit("high").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line"), F.lit(3).alias("repo"), F.lit(None).cast("array<struct<file_path:string,line:int>>").alias("taint_flow"))
    got = sarif.documents(f, "repo", most=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().split("Join")[1].split("\n")[0].find("broadcast") >= 0
    assert sarif.scan(got).count() == 40
