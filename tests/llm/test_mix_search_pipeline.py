import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import metric_tree as tree
from siftline.llm import temperature_mix as mix


def entropy(p, a):
    w = p**a / (p**a).sum()
    return -(w * np.log(w)).sum(), (w / p).max()


def brute_exponent(p, goal, repeats):
    def last(condition):
        low, high = 0.0, 1.0
        if condition(1.0) or not condition(0.0):
            return 1.0 if condition(1.0) else 0.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if condition(mid) else (low, mid)
        return low

    return max(last(lambda a: entropy(p, a)[0] >= goal * np.log(len(p)) - 1e-12), last(lambda a: entropy(p, a)[1] > repeats))


@pytest.mark.parametrize(("tokens", "goal", "repeats"), [([900, 50, 30, 20], 0.8, 50.0), ([900, 50, 30, 20], 0.99, 3.0), ([5, 5, 5], 0.9, 4.0), ([7], 0.9, 4.0), ([1000, 1], 1.0, 100.0)])
def test_exponent_matches_plain_bisection(spark, tokens, goal, repeats):
    p = np.array(tokens) / sum(tokens)
    df = spark.createDataFrame([(float(x),) for x in p], "p double")
    assert mix.bisect_exponent(df, goal, repeats) == pytest.approx(brute_exponent(p, goal, repeats) if len(p) > 1 else 1.0, abs=1e-8)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "t" * int(rng.integers(4, 400)), "hot" if i % 3 else f"s{i % 7}", "x", i) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _rid string, _times long")


def test_sources_get_their_budget(skewed, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_ROWS", 16)
    weights = {r.src: r for r in mix.source_weights(skewed, entropy=0.97).collect()}
    got, longest = Counter(), max(len(r.text) // 4 for r in skewed.collect())
    seen = defaultdict(set)
    for r in mix.mixture(skewed, entropy=0.97).collect():
        got[r.src] += r.tokens
        assert (r.id, r.epoch) not in seen[r.src] and 0 <= r.place <= 1
        seen[r.src].add((r.id, r.epoch))
    for src, w in weights.items():
        assert w.target - longest < got[src] <= w.target
        whole = w.target // w.tokens
        assert all(Counter(i for i, _ in seen[src])[i] in (whole, whole + 1) for i, _ in seen[src])
    assert sum(w.weight for w in weights.values()) == pytest.approx(1)


def test_every_prefix_of_the_mixture_has_the_weights(skewed):
    rows = mix.mixture(skewed, entropy=0.97).orderBy("place").collect()
    half = rows[: len(rows) // 2]
    share = Counter()
    for r in half:
        share[r.src] += r.tokens
    for r in {r.src: r for r in rows}.values():
        assert share[r.src] / sum(share.values()) == pytest.approx(r.weight, abs=0.1)


def test_mixed_documents_repeat_rows_as_planned(skewed):
    plan = {r.id: r.copies for r in mix.mixture_plan(skewed, entropy=0.97).collect()}
    got = mix.mixed_documents(skewed, entropy=0.97)
    assert got.columns == skewed.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_mix_odd_rows(docs, empty):
    assert mix.mixture(empty).count() == 0 and mix.mixed_documents(empty).columns == empty.columns
    got = mix.mixture(docs)
    assert got.where("tokens < 1").count() == 0 and "" in {r.src for r in got.collect()}


def test_repeated_and_null_ids_fill_no_block(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_ROWS", 50)
    rows = [(None if k % 2 else 7, "one", "a text of some words " * (1 + k % 3)) for k in range(2400)] + [(k, "two", "some other words") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    placed = mix.written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("source").alias("src"), F.xxhash64("doc_id").alias("key"), F.lit(3).cast("long").alias("block")).where("src = 'one'"), "placed")
    sizes = [r["count"] for r in mix.dealt(placed).groupBy("src", "block", "sub").count().collect()]
    assert sum(sizes) == 2400 and max(sizes) < 100 and len(sizes) == 48
    budget = 9000
    weights = {r.src: r for r in mix.source_weights(docs, budget=budget).collect()}
    got = mix.mixture(docs, budget=budget).collect()
    used = Counter()
    for r in got:
        used[r.src] += r.tokens
    assert all(w.target - 15 < used[src] <= w.target for src, w in weights.items())


def test_offsets_are_those_of_one_sort(spark):
    rows = [(src, b, sub, 1 + (b * 7 + sub) % 11) for src in ("x", "y") for b in range(500) for sub in range(1 + (b == 3) * 4)]
    blocks = spark.createDataFrame(rows, "src string, block long, sub long, size long")
    hashed = {r.block: r.h for r in blocks.select("block", F.xxhash64("block", F.lit(mix.SEED)).alias("h")).distinct().collect()}
    want = {}
    for src in ("x", "y"):
        at = 0
        for _, b, sub, size in sorted((r for r in rows if r[0] == src), key=lambda r: (hashed[r[1]], r[1], r[2])):
            want[src, b, sub], at = at, at + size
    assert {(r.src, r.block, r["sub"]): r.offset for r in mix.block_offsets(blocks).collect()} == want


def test_mixed_documents_in_the_order_of_the_mixture(skewed, spark, tmp_path):
    got = mix.mixed_documents(skewed, entropy=0.97, place_col="place")
    rows = got.collect()
    assert got.columns == [*skewed.columns, "place"] and [r.place for r in rows] == sorted(r.place for r in rows)
    assert Counter((r.doc_id, r.place) for r in rows) == Counter((r.id, r.place) for r in mix.mixture(skewed, entropy=0.97).collect())
    with pytest.raises(ValueError, match="TEXT"):
        mix.mixed_documents(skewed, place_col="TEXT")


def brute_top(rows, k):
    vectors = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in vectors), default=0)
    q = [[math.floor(64 * float(x)) for x in v] + [0] * (dim - len(v)) for _, v in vectors]
    out = []
    for n, (i, _) in enumerate(vectors):
        if i % 20 == 0:
            score = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, q[n], strict=True)))) for x in q]
            order = sorted((m for m in range(len(vectors)) if m != n), key=lambda m: (-score[m], vectors[m][0]))[:k]
            out += [(i, r + 1, vectors[m][0], int(score[m])) for r, m in enumerate(order)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    for name, n in (("TREE_ROWS", 64), ("LEAF_ROWS", 8), ("QUERY_ROWS", 4), ("CHUNK_TREES", 2), ("PILOT_ROWS", 30), ("DIRECTORY_TREES", 3)):
        monkeypatch.setattr(tree, name, n)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 12))
    rows = [(i, [float(x) for x in centres[i % 5] * (0.1 + i % 3) + rng.normal(size=12) * 0.2]) for i in range(400)]
    rows += [(i, [0.5] * 12) for i in range(400, 520)]  # one vector that many rows share
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 12), (603, [float("inf")] * 12), (604, []), (605, [2.0]), (None, [1.0] * 12)]
    rows += [(620, [2.0**40] + [1.0] * 11), (621, [2.0**40 + 2.0**20] + [1.0] * 11), (622, [-(2.0**40)] * 12), (640, [1e30] * 12), (641, [-1e30] * 12), (660, [200000.0, 1.0])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rid string").repartition(3)
    got = tree.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 20)


def test_top_k_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert tree.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = tree.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


def test_bounds_save_scores(monkeypatch):
    monkeypatch.setattr(tree, "LEAF_ROWS", 10)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 300
    v = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(1200, 16)))
    part = np.arange(1200) % 1200 // 100
    trees = [tree.build_tree(np.flatnonzero(part == p), np.flatnonzero(part == p), v[part == p]) for p in range(12)]
    counts = {}
    tree.search(trees, np.arange(20), v[:20], np.full(20, -np.inf), 5, counts)
    assert counts["scores"] < 20 * 1200 * 0.6


def test_only_trees_within_the_bounds_are_sent(spark, monkeypatch):
    """Far groups of vectors: a block of queries gets few of the trees, and no query a wrong row."""
    for name, n in (("TREE_ROWS", 64), ("QUERY_ROWS", 16)):
        monkeypatch.setattr(tree, name, n)
    sent, plain = [], tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: sent.append((name, plain(df, name))) or sent[-1][1])
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in 20.0 * np.eye(16)[i % 16] + rng.normal(size=16) * 0.1]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = tree.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 20)
    tables = dict(sent)
    assert tables["tree_pairs"].count() < 0.6 * tables["trees"].count() * tables["query_blocks"].count()


def test_pipeline_stages(spark, sf, docs):
    """Each stage on its own input: the columns stay, and run() is the stages one after another."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]
    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, source, sf)
    assert kept.columns == source.columns
    clean = labels.where("quality = 1").select("doc_id").join(source, "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    final = corpus_pipeline.run(spark, sf)
    assert final.columns == ["doc_id", "ids", "n_tokens"] and 0 < final.count() <= 1.2 * source.count()
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_pipeline_on_odd_rows(spark, sf, docs, empty):
    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() <= 3 * max(1, rows.count())
