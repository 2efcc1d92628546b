"""The whole pipeline against plain loops over the same rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import quality, unigram
from siftline.llm import temperature_mix as mix
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(8, 30)) for _ in range(90)]
    texts += [texts[k] + " \n" for k in range(6)] + [" ".join(w if j % 97 else "other" for j, w in enumerate(texts[k].split())) for k in range(10, 20)]
    texts += ["#|9 $x;" * rng.randrange(20, 200) for _ in range(60)] + [None, "", "x"]
    rng.shuffle(texts)
    rows = [(k, t, "en", rng.choice(["hot", "hot", "hot", "b", "c"]), len(t or "")) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(k, 0 if (t or "").startswith("#") else 1, 0) for k, t, *_ in rows if t and len(t) > 1]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def plain_copies(spark, rows):
    """How often the mixture has each (doc_id): weights by plain bisection, rounds through one block in the order of the keyed hash."""
    tokens = {r[0]: 0 if r[1] is None else max(1, len(r[1]) // 4) for r in rows}
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += tokens[r[0]]
    total = sum(by_source.values())
    p = {k: n / total for k, n in by_source.items() if n}

    def weights(a):
        u = {k: x**a for k, x in p.items()}
        return {k: x / sum(u.values()) for k, x in u.items()}

    def bisect(holds):
        low, high = 0.0, 1.0
        if holds(1.0) or not holds(0.0):
            return 1.0 if holds(1.0) else 0.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    a = max(bisect(lambda a: entropy(a) >= mix.ENTROPY * math.log(len(p)) - 1e-12), bisect(lambda a: max(w / p[k] for k, w in weights(a).items()) > mix.REPEATS)) if len(p) > 1 else 1.0
    keys = {r.id: r.key for r in spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.xxhash64("id", F.lit(mix.SEED)).alias("key")).collect()}
    out = Counter()
    for source, w in weights(a).items():
        target, own = math.floor(w * total + 1e-6), sorted((r[0] for r in rows if r[3] == source and tokens[r[0]]), key=lambda i: (keys[i] % (1 << 20), keys[i]))
        rounds, rest = divmod(target, by_source[source])
        at = 0
        for i in own:
            at += tokens[i]
            out[i] = rounds + (at <= rest)
    return +out


def test_the_pipeline_matches_plain_loops(spark, folder):
    path, rows = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.score_quality(docs, quality.learn_quality(docs, labels)).collect()}
    left = [r for r in rows if score[r[0]] >= quality.THRESHOLD]
    assert sum((r[1] or "").startswith("#") for r in left) == 0 and sum(len(r[1] or "") > 200 for r in left) >= 100

    same = defaultdict(list)
    for r in left:
        same[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    exact = [min(group, key=lambda r: (-len(r[1] or ""), r[0])) for group in same.values()]
    assert len(exact) <= len(left) - 6

    def shingles(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = {r[0]: shingles(r[1]) for r in exact}, {r[0]: r[0] for r in exact}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    near = [r for r in exact if find(r[0]) == r[0]]
    assert len(near) <= len(exact) - 8

    copies = plain_copies(spark, near)
    encoder = unigram.load(unigram.MODEL)
    want = Counter({(r[0], tuple(encoder.encode([r[1]])[0])): copies[r[0]] for r in near if copies[r[0]]})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want
