"""Conformal calibration, threshold searches, sampling and splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.tables import small_side, written


def tempered_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """softmax(logits / temperature), shifted by the largest."""
    z = F.transform(logits, lambda x: x / temperature)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _before(p: Column, j: Column, own: bool) -> Column:
    """Sum of the probabilities of the classes before class j (from 0) by falling probability, ties by number; with its own if `own`."""
    pj = F.element_at(p, (j + 1).cast("int"))
    taken = F.transform(p, lambda x, k: F.when((x > pj) | ((x == pj) & ((k < j) | (F.lit(own) & (k == j)))), x).otherwise(0.0))
    return F.aggregate(taken, F.lit(0.0), lambda s, y: s + y)


def aps_score(p: Column, label: Column) -> Column:
    """Cumulative probability at the true class."""
    return _before(p, label, own=True)


def prediction_set(p: Column, threshold: Column) -> Column:
    """Class numbers, by number, that are taken until the cumulative probability reaches the threshold (both at twelve decimals); never empty."""
    before = lambda j: F.round(_before(p, j, own=False), 12)
    return F.filter(F.transform(p, lambda x, j: F.when((before(j) < F.round(threshold, 12)) | (before(j) == 0), j)), lambda j: j.isNotNull())


def conformal_level(n: int, alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return min(math.ceil((n + 1) * (1 - alpha)) / n, 1.0)


def order_statistics(rows: DataFrame, key: str, value: str, wanted: DataFrame, bins: int = 1024) -> DataFrame:
    """(key, x): of each key's values the one with number k (from 0) by size, for wanted(key, k). No interpolation.

    Each round counts the values by bins between bounds, then sets the bounds to the least and largest value of the bin that has the
    wanted one, until they are equal: rows are only counted, never sorted or gathered. wanted holds few keys.
    """
    ends = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    bounds = written(wanted.join(ends, key), "bounds")
    done = bounds.where("lo = hi")
    todo = bounds.where("lo < hi")
    while todo.limit(1).count():
        bin_of = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        inside = rows.select(key, value).join(small_side(todo), key).where(F.col(value).between(F.col("lo"), F.col("hi"))).withColumn("bin", bin_of)
        counts = inside.groupBy(key, "k", "bin").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        w = Window.partitionBy(key).orderBy("bin")
        counts = counts.withColumn("upto", F.sum("n").over(w)).where("upto > k AND upto - n <= k")
        bounds = written(counts.select(key, (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi"), "bounds")
        done = done.unionByName(bounds.where("lo = hi"))
        todo = bounds.where("lo < hi")
    return done.select(key, F.col("lo").alias("x"))


def conformal_thresholds(scored: DataFrame, key: str, alpha: float | Column = 0.1) -> DataFrame:
    """(key, threshold): of scored(key, score) the score at ceil(level * (n - 1)), 1 at most; alpha may be a column of the key."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    level = F.least(F.ceil((F.col("n") + 1) * (1 - a)) / F.col("n"), F.lit(1.0))
    wanted = scored.groupBy(key).agg(F.count("*").alias("n")).select(key, F.ceil(F.round(level * (F.col("n") - 1), 9)).alias("k"))
    return order_statistics(scored, key, "score", wanted).select(key, F.least("x", F.lit(1.0)).alias("threshold"))


def coverage_report(rows: DataFrame, by: str) -> DataFrame:
    """rows(by, classes, label) -> coverage, singleton and ambiguous rate and mean size of the sets."""
    size = F.size("classes")
    return rows.groupBy(by).agg(F.avg(F.array_contains("classes", F.col("label")).cast("double")).alias("coverage"), F.avg((size == 1).cast("double")).alias("singleton"), F.avg((size > 1).cast("double")).alias("ambiguous"), F.avg(size).alias("mean_size"))


def temperature_grid() -> list[float]:
    """Sharpening below .5, fine steps around 1, softening up to 3."""
    return [round(0.05 * k, 2) for k in range(1, 10)] + [round(0.5 + 0.02 * k, 2) for k in range(50)] + [round(1.5 + 0.1 * k, 1) for k in range(16)]


def batched_order_statistics(rows: DataFrame, prepare: Callable, scores: Callable, wanted: list[int], low: float, high: float, bins: int = 1024) -> list[float]:
    """For each k = wanted[i], the value with number k (from 0) by size among scores(prepare(batch), i), which lie in [low, high].

    A pass reads the rows once for all i: a task counts values by i and bin, with each bin's least and largest value, which is all that leaves it. The next pass
    counts within the bin that has the wanted value, until that bin holds one value. No row is repeated for an i.
    """
    found: dict[int, float] = {}
    bounds = {i: (low, high, k) for i, k in enumerate(wanted)}
    while bounds:

        def count(batches: Iterator[pd.DataFrame], bounds=bounds) -> Iterator[pd.DataFrame]:
            n = {i: np.zeros(bins, dtype=np.int64) for i in bounds}
            least, largest = {i: np.full(bins, np.inf) for i in bounds}, {i: np.full(bins, -np.inf) for i in bounds}
            for batch in batches:
                ready = prepare(batch)
                for i, (lo, hi, _) in bounds.items():
                    x = scores(ready, i)
                    x = x[(x >= lo) & (x <= hi)]
                    at = np.minimum(((x - lo) / (hi - lo) * bins).astype(np.int64), bins - 1)
                    n[i] += np.bincount(at, minlength=bins)
                    np.minimum.at(least[i], at, x)
                    np.maximum.at(largest[i], at, x)
            for i in bounds:
                (at,) = np.nonzero(n[i])
                yield pd.DataFrame({"i": i, "bin": at, "n": n[i][at], "lo": least[i][at], "hi": largest[i][at]})

        binned = rows.mapInPandas(count, "i int, bin long, n long, lo double, hi double").groupBy("i", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("bin"))
        places = rows.sparkSession.createDataFrame([(i, k) for i, (_, _, k) in bounds.items()], "i int, k long")
        hit = binned.withColumn("upto", upto).join(F.broadcast(places), "i").where("upto > k AND upto - n <= k").collect()  # a row an i
        bounds = {r.i: (r.lo, r.hi, r.k - r.upto + r.n) for r in hit}
        found |= {i: lo for i, (lo, hi, _) in bounds.items() if lo == hi}
        bounds = {i: b for i, b in bounds.items() if b[0] < b[1]}
    return [found[i] for i in range(len(wanted))] if found else []


def _padded(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits as a matrix, where classes that a row lacks are -inf; number of classes; label) of a batch's rows."""
    size = batch["logits"].str.len().to_numpy(dtype=np.int64)
    z = np.full((len(batch), int(size.max(initial=1))), -np.inf)
    z[np.arange(z.shape[1]) < size[:, None]] = np.concatenate([np.empty(0), *batch["logits"]])
    return z, size[:, None], batch["label"].to_numpy()[:, None]


def _tempered(ready: tuple, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities by falling size, the sums before each, and the classes they are of. Classes that a row lacks have -1."""
    z, size, _ = ready
    z = z / t
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    p = np.take_along_axis(p, order, axis=1)
    upto = np.cumsum(p, axis=1)
    return p, np.hstack([np.zeros((len(p), 1)), upto[:, :-1]]), np.where(order < size, order, -1)


def temperature_search(rows: DataFrame, alpha: float = 0.1, grid: list[float] | None = None) -> DataFrame:
    """rows(logits, label) -> (t, threshold, coverage, singleton, ambiguous, mean_size, best): best is the first temperature of least
    mean size among those that keep the coverage. Rows without logits or label take no part; no rows give none.

    Softmax and scores of all temperatures are worked out in the batch that holds a row; only counts by temperature leave it.
    """
    temperatures = grid or temperature_grid()
    rows = rows.select("logits", "label").where("size(logits) > 0 AND label >= 0 AND label < size(logits)")
    n, spark = rows.count(), rows.sparkSession

    def scores(ready: tuple, i: int) -> np.ndarray:
        p, before, classes = _tempered(ready, temperatures[i])
        at = classes == ready[2]
        return before[at] + p[at]

    k = math.ceil(round(conformal_level(n, alpha) * (n - 1), 9)) if n else 0
    cuts = [min(x, 1.0) for x in batched_order_statistics(rows, _padded, scores, [k] * len(temperatures), 0.0, 1.0 + 1e-6)] if n else []

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(cuts), 4))
        for batch in batches:
            ready = _padded(batch)
            for i, cut in enumerate(cuts):
                _, before, classes = _tempered(ready, temperatures[i])
                taken = ((np.round(before, 12) < np.round(cut, 12)) | (np.round(before, 12) == 0)) & (classes >= 0)
                size = taken.sum(axis=1)
                sums[i] += [(taken & (classes == ready[2])).sum(), (size == 1).sum(), (size > 1).sum(), size.sum()]
        yield pd.DataFrame({"i": range(len(cuts)), "covered": sums[:, 0], "single": sums[:, 1], "more": sums[:, 2], "taken": sums[:, 3]})

    known = spark.createDataFrame([(i, float(temperatures[i]), float(c)) for i, c in enumerate(cuts)], "i int, t double, threshold double")
    summed = rows.mapInPandas(report, "i int, covered double, single double, more double, taken double").groupBy("i").agg(*[(F.sum(c) / max(n, 1)).alias(c) for c in ("covered", "single", "more", "taken")])
    out = known.join(summed, "i").select("t", "threshold", F.col("covered").alias("coverage"), F.col("single").alias("singleton"), F.col("more").alias("ambiguous"), F.col("taken").alias("mean_size"))
    fit = F.round("coverage", 9) >= 1 - alpha
    order = Window.orderBy(F.when(fit, 0).otherwise(1), F.round("mean_size", 9), "t")  # over the grid's few rows
    return out.withColumn("best", (F.row_number().over(order) == 1) & fit)


def coverage_curve(scored: DataFrame, levels: list[float]) -> DataFrame:
    """scored(p, label, score) -> (i, level, threshold, coverage): the threshold of each level alpha and the share of rows whose set has their label.

    All thresholds come from the same passes; a row counts once, at the number of thresholds that reach its label, as thresholds fall while alpha grows.
    """
    n, spark = scored.count(), scored.sparkSession
    if not n:
        return spark.createDataFrame([], "i int, level double, threshold double, coverage double")
    wanted = [math.ceil(round(conformal_level(n, a) * (n - 1), 9)) for a in levels]
    cuts = [min(x, 1.0) for x in batched_order_statistics(scored.select("score"), lambda batch: batch["score"].to_numpy(), lambda x, i: x, wanted, 0.0, 1.0 + 1e-6)]
    before = F.round(_before(F.col("p"), F.col("label"), own=False), 12)
    steps = F.array(*[F.lit(c) for c in sorted(cuts)])
    missed = F.when(before == 0, 0).otherwise(F.size(F.filter(steps, lambda c: F.round(c, 12) <= before)))
    counts = scored.groupBy(missed.alias("missed")).agg(F.count("*").alias("rows"))
    rank = {c: r for r, c in reversed(list(enumerate(sorted(cuts))))}
    known = spark.createDataFrame([(i, float(a), float(c), rank[c]) for i, (a, c) in enumerate(zip(levels, cuts, strict=True))], "i int, level double, threshold double, rank int")
    return known.join(F.broadcast(counts), F.col("missed") <= F.col("rank")).groupBy("i", "level", "threshold").agg((F.sum("rows") / n).alias("coverage"))  # a row a level by a row a level


def threshold_search(rows: DataFrame, steps: int = 81, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """rows(p, label) -> (k, threshold, precision, recall, f1, best) for evenly spaced thresholds; best is the first of the largest f1."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    # Each row counts at the number of thresholds that it reaches; then counts are summed over the few steps.
    reach = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((F.col("p") - low) / (high - low) * (steps - 1) + 1e-9) + 1))
    hist = rows.groupBy(reach.alias("r")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    at = hist.select("*", grid.alias("k")).groupBy("k").agg(F.sum(F.when(F.col("r") > F.col("k"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("r") > F.col("k"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("all_pos"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9), F.col("tp") / (F.col("all_pos") + 1e-9)
    out = at.select("k", (low + F.col("k") * ((high - low) / (steps - 1))).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "k")) == 1)  # over the grid's few rows


def weight_grid(weights: DataFrame, step: int = 10) -> DataFrame:
    """weights(cwe_id, w_sast, w_graph, w_llm) -> the best of all weights in steps of 1 / step: .3 balance, .7 nearness; first of equals."""
    n = F.sequence(F.lit(0), F.lit(step))
    x = weights.select("*", F.explode(n).alias("i")).select("*", F.explode(n).alias("j")).where(F.col("i") + F.col("j") <= step)
    a, b, c = F.col("i") / step, F.col("j") / step, (step - F.col("i") - F.col("j")) / step
    balance = 1 - F.greatest(F.abs(a - b), F.abs(b - c), F.abs(a - c))
    near = 1 - (F.abs(a - F.col("w_sast")) + F.abs(b - F.col("w_graph")) + F.abs(c - F.col("w_llm"))) / 2
    x = x.withColumn("score", F.round(0.3 * balance + 0.7 * near, 9))
    first = Window.partitionBy("cwe_id").orderBy(F.desc("score"), "i", "j")
    return x.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("cwe_id", a.alias("a"), b.alias("b"), c.alias("c"), "score")


def _hash_number(id_col: str, seed: str) -> Column:
    """The first 52 bits of a row's keyed hash, as an exact double: a random order that is the same each time."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))), 1, 13), 16, 10).cast("double")


def _first_of_stratum(rows: DataFrame, strata: list[str], cuts: DataFrame, number: str) -> DataFrame:
    """rows(strata, number) with `below`: the slots of cuts(strata, slot, k) for which the row is among the first k of its stratum by number.

    The number with place k in its stratum is found by counting, so a stratum that holds most rows is never gathered or sorted.
    """
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in strata], F.col("slot").cast("string"))
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    asked = cuts.join(sizes, strata).withColumn("key", key)
    inner = asked.where("k < n").select("key", "k")
    asked = written(asked, "cuts")
    each = rows.join(small_side(asked.where("k < n").select(*strata, "slot")), strata).withColumn("key", key)
    limits = order_statistics(each, "key", number, inner).withColumnRenamed("x", "limit")
    table = asked.join(limits, "key", "left").groupBy(*strata).agg(F.collect_list(F.struct("slot", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))).alias("limits"))
    marked = rows.join(small_side(written(table, "limits")), strata, "left")
    return marked.withColumn("below", F.transform(F.filter("limits", lambda x: F.col(number) < x["limit"]), lambda x: x["slot"])).drop("limits")


def balance(samples: DataFrame, most: int = 5000, seed: str = "42") -> DataFrame:
    """Equal numbers of both labels in each language: the smaller class decides, up to most / 2; languages with one class go.
    Rows are taken in the order of a keyed hash."""
    n = samples.groupBy("language").agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") == 0).alias("zero"))
    n = n.where("one > 0 AND zero > 0").select("language", F.least("one", "zero", F.lit(most // 2)).alias("k"))
    cuts = n.select("language", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), F.lit(0).alias("slot"), "k")
    rows = samples.withColumn("_number", _hash_number("id", seed))
    return _first_of_stratum(rows, ["language", "label"], cuts, "_number").where("size(below) > 0").drop("_number", "below")


def stratified_split(samples: DataFrame, parts: dict[str, float], strata: list[str], seed: str = "42") -> DataFrame:
    """samples with `part`: within each stratum rows in hash order are cut at the running shares, so each part has its share of each stratum."""
    names, upto, bounds = list(parts), 0.0, []
    for k, name in enumerate(names[:-1]):
        upto += parts[name]
        bounds.append((k, round(upto, 9)))
    rows = samples.withColumn("_number", _hash_number("id", seed))
    n = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(share).alias("share")) for k, share in bounds]))
    cuts = n.select(*strata, "n", slots.alias("s")).select(*strata, F.col("s.slot").alias("slot"), F.ceil(F.round(F.col("s.share") * F.col("n"), 9)).alias("k"))
    marked = _first_of_stratum(rows, strata, cuts, "_number")
    part = F.element_at(F.array(*map(F.lit, names)), F.coalesce(F.array_min("below"), F.lit(len(names) - 1)) + 1)
    return marked.withColumn("part", part).drop("_number", "below")


def roc_points(rows: DataFrame) -> DataFrame:
    """rows(p, label) -> (p, fpr, tpr) at each distinct score, from the highest down.

    Rows are counted by score first. Scores are then cut into ranges that are summed on their own and shifted by the sums before them.
    """
    each = rows.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    each = each.withColumn("range", F.least(F.greatest(F.floor(F.col("p") * 256), F.lit(-1)), F.lit(256)))  # scores outside 0 to 1 share the outer two
    sums = each.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    down = Window.orderBy(F.desc("range"))  # over at most 258 ranges
    everything = Window.partitionBy(F.lit(1))
    sums = sums.select("range", (F.sum("rp").over(down) - F.col("rp")).alias("bp"), (F.sum("rn").over(down) - F.col("rn")).alias("bn"), F.sum("rp").over(everything).alias("ap"), F.sum("rn").over(everything).alias("an"))
    w = Window.partitionBy("range").orderBy(F.desc("p"))
    x = each.join(F.broadcast(sums), "range")  # at most 258 rows
    return x.select("p", ((F.col("bn") + F.sum("neg").over(w)) / F.col("an")).alias("fpr"), ((F.col("bp") + F.sum("pos").over(w)) / F.col("ap")).alias("tpr"), (F.col("pos") / F.col("ap")).alias("dp"), (F.col("neg") / F.col("an")).alias("dn"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row with the area under the curve, by trapezoids (equal scores count half)."""
    return roc_points(rows).agg(F.sum(F.col("dn") * (F.col("tpr") - F.col("dp") / 2)).alias("auc"))
