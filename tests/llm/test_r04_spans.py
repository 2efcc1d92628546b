"""Chunks of spans, rows of some megabytes, end their row groups, so that a reader's batch holds few of them."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siftline.llm import sentence_spans as sp
from siftline.llm.common import numbered


def test_a_row_group_holds_few_chunks(spark, monkeypatch):
    kept, write = {}, sp.written
    monkeypatch.setattr(sp, "written", lambda df, name, *a, **b: kept.setdefault(name, write(df, name, *a, **b)))
    sentence = lambda k: F.concat_ws(" ", F.lit("so"), F.sha1(F.concat_ws(" ", "id", k).cast("string")), F.lit("says b c d e f."))
    docs = spark.range(0, 24, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6000)), sentence), " ").alias("text"))
    sp.candidate_spans(numbered(docs.unionByName(docs.where("id = 3").withColumn("id", F.lit(99).cast("long"))).coalesce(1)), chunk_spans=20_000)
    files = [f for x in kept["span_chunks"].inputFiles() for f in glob.glob(x.removeprefix("file://"))]
    groups = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) >= 6 and max(groups) <= 4
    assert kept["candidate_spans"].groupBy("id").count().where("id IN (3, 99)").select(F.countDistinct("count"), F.min("count")).first()[0] == 1
