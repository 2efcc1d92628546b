"""Components that round to zero keep their sign."""

import math

from siftline.plans import retrieval


def test_rounded_to_negative_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, -1e-6, 1e-6, -0.5]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.v for r in retrieval.l2_normalize(spark, str(tmp_path)).collect()}
    assert got[1] == [0.89443, 0.0, 0.0, -0.44721] and [math.copysign(1, x) for x in got[1]] == [1, -1, 1, -1]
    assert got[2] == [0.0, 1.0] and math.copysign(1, got[2][0]) == 1
