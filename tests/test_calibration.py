import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import calibration as cal


def plain(rows, t, alpha=0.1):
    """Threshold, coverage and mean size at one temperature, row by row."""
    scored = []
    for logits, label in rows:
        e = [math.exp(x / t - max(logits) / t) for x in logits]
        p = [x / sum(e) for x in e]
        order = sorted(range(len(p)), key=lambda j: (-p[j], j))
        before = {j: sum(p[i] for i in order[:k]) for k, j in enumerate(order)}
        scored.append((before[label] + p[label], before, label))
    n = len(rows)
    cut = min(sorted(s for s, *_ in scored)[math.ceil(round(min(math.ceil((n + 1) * (1 - alpha)) / n, 1) * (n - 1), 9))], 1)
    sets = [({j for j, b in before.items() if round(b, 12) < round(cut, 12) or b == 0}, label) for _, before, label in scored]
    return cut, sum(label in s for s, label in sets) / n, sum(len(s) for s, _ in sets) / n, sum(len(s) == 1 for s, _ in sets) / n


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [([float(x) for x in rng.normal(size=m) * 2], int(rng.integers(0, m))) for m in (3, 5) for _ in range(150)]
    return out + [([1.0, 1.0, 1.0], k % 3) for k in range(30)] + [([0.5], 0), ([900.0, -900.0], 1)]


def test_all_temperatures_in_the_same_passes(spark, rows):
    grid = [0.1, 0.5, 1.0, 2.5]
    df = spark.createDataFrame([*rows, (None, 1), ([1.0], None), ([], 0), ([1.0], 4)], "logits array<double>, label int").repartition(3)
    plan = cal.temperature_search(df, grid=grid)
    got = {r.t: r for r in plan.collect()}
    for t in grid:
        assert (got[t].threshold, got[t].coverage, got[t].mean_size, got[t].singleton) == pytest.approx(plain(rows, t), abs=1e-12)
    fits = [t for t in grid if round(got[t].coverage, 9) >= 0.9]
    assert [t for t in grid if got[t].best] == [min(fits, key=lambda t: (round(got[t].mean_size, 9), t))]
    assert "Generate" not in plan._jdf.queryExecution().toString()
    assert cal.temperature_search(df.limit(0)).count() == 0


def test_all_levels_in_the_same_passes(spark, rows):
    df = spark.createDataFrame(rows, "logits array<double>, label int").withColumn("p", cal.tempered_softmax(F.col("logits")))
    levels = [0.5, 0.02, 0.1, 0.1]
    scored = df.withColumn("score", cal.aps_score(F.col("p"), F.col("label")))
    got = sorted(cal.coverage_curve(scored, levels).collect())
    assert [r.level for r in got] == levels
    for r in got:
        assert (r.threshold, r.coverage) == pytest.approx(plain(rows, 1.0, r.level)[:2], abs=1e-12)
    assert cal.coverage_curve(scored.limit(0), levels).count() == 0
