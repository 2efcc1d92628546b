"""A model gets texts a few megabytes at a time, however many rows a batch has."""

from pyspark.sql import functions as F

from siftline import plugins


def test_texts_of_a_batch_come_in_parts(spark):
    size = F.when(F.col("id") == 7, 9 << 20).when(F.col("id") % 50 == 0, 0).otherwise(20_000)
    texts = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") != 9, F.repeat(F.lit("x"), size.cast("int"))).alias("text"))
    given = plugins.model_scorer(lambda t: t.str.len().fillna(0).max() + 0.0 * t.str.len())
    assert given(texts).agg(F.max("score")).first()[0] == 9 << 20
    held = plugins.model_scorer(lambda t: 0.0 * t.str.len() + t.str.len().fillna(0).sum())
    got = {r.id: r.score for r in held(texts).select("id", "score").collect()}
    assert len(got) == 1000 and got[9] is None and sorted(x for x in got.values() if x)[-1] >= 9 << 20
    assert max(got[k] for k in range(500, 1000)) <= (4 << 20) + 20_000
