"""A task hands on the edges of many files at once."""

import time

from pyspark.sql import functions as F

from siftline.operators import detection as det


def test_indents_of_many_files(spark):
    lines = spark.range(20_000).select(F.concat(F.lit("f"), "id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit(0).alias("indent")), F.struct(F.lit(1).alias("idx"), F.lit(4).alias("indent")))).alias("l")).select("file", "l.*")
    began = time.monotonic()
    got = det.indent_edges(lines).agg(F.count("*").alias("n"), F.min("src").alias("src"), F.max("dst").alias("dst")).first()
    assert tuple(got) == (20_000, 0, 1) and time.monotonic() - began < 12
