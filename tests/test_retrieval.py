import math
import re
from collections import Counter

import numpy as np
import pytest

from siftline import fixed
from siftline.operators import retrieval as ret
from siftline.operators import keyword_index

TEXTS = ["the quick brown fox", "the lazy dog and the fox", "", None, "quick quick quick", "an old dog, an old fox", "fox", "zebra x y zz", "the the the the"]


def words(text):
    return [t for t in re.sub(r"[^\w\s-]", " ", (text or "").lower()).split() if len(t) >= 2]


def plain_bm25(query, texts=dict(enumerate(TEXTS)), k=5):
    docs = {i: words(t) for i, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = fixed.BM25_EPSILON * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    k1, b = fixed.BM25_K1, fixed.BM25_B
    scores = {i: sum(idf[t] * Counter(d)[t] * (k1 + 1) / (Counter(d)[t] + k1 * (1 - b + b * len(d) / mean)) for t in words(query) if t in d) for i, d in docs.items()}
    return [(r + 1, i) for r, (i, s) in enumerate(sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:k])]


def test_keyword_search_matches_plain_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    asked = {1: "quick fox", 2: "old old dog", 3: "nothing here", 4: "the zebra", 5: None}
    found = ret.bm25_topk(docs, spark.createDataFrame(list(asked.items()), "q long, text string")).collect()
    for q, text in asked.items():
        assert sorted((r.rank, r.id) for r in found if r.q == q) == plain_bm25(text)


@pytest.mark.parametrize(("block", "most"), [(3, ret.BROADCAST_BYTES), (1024, ret.BROADCAST_BYTES), (3, 0), (1, 0), (1024, 0)])
def test_vector_search_matches_plain_products(spark, monkeypatch, block, most):
    monkeypatch.setattr(ret, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(i, [1.0] * 6) for i in range(60, 75)] + [(75, [0.0] * 6), (76, None)]
    asked = [(100 + k, rows[k][1]) for k in range(8)] + [(200, [2.0] * 6)]
    found = ret.dense_topk(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), spark.createDataFrame(asked, "q long, v array<double>"), 5, block).collect()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in asked:
        best = sorted(((i, float(unit(v) @ unit(x))) for i, x in rows if x is not None), key=lambda r: (-round(r[1], 9), r[0]))[:5]
        got = sorted((r.rank, r.id, r.score) for r in found if r.q == q)
        assert [(r, i) for r, i, _ in got] == [(k + 1, i) for k, (i, _) in enumerate(best)] and [s for *_, s in got] == pytest.approx([s for _, s in best])


def test_empty_searches(spark):
    docs, vectors = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, v array<double>")
    assert ret.bm25_topk(docs, spark.createDataFrame([(1, "a fox")], "q long, text string")).count() == 0
    assert ret.dense_topk(vectors, spark.createDataFrame([(1, [1.0])], "q long, v array<double>")).count() == 0
    assert ret.dense_topk(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), spark.createDataFrame([], "q long, v array<double>")).count() == 0


def test_kept_index_finds_what_the_plain_search_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SHARDS", 3)
    monkeypatch.setattr(keyword_index, "SPREAD", 2)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{n}" for n in range(60)]
    share = 1 / np.arange(1, 61)
    text = lambda: " ".join(rng.choice(vocabulary, size=rng.integers(0, 30), p=share / share.sum()))
    docs = {i: text() for i in range(300)} | {300: None, 301: "", 302: "w0 w0 w0"} | {i: "w5 w9 w1" for i in range(303, 320)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, text string")
    asked = {q: text() for q in range(30)} | {50: None, 51: "none of them", 52: "w0", 53: "w9 w5 w0 w0"}
    queries = spark.createDataFrame(list(asked.items()), "q long, text string")

    def agrees(k=5):
        found = index.search(queries, k).collect()
        for q, query in asked.items():
            assert sorted((r.rank, r.id) for r in found if r.q == q) == plain_bm25(query, docs, k)

    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index")
    assert index.search(queries).count() == 0
    index.add(frame(docs), 0)
    agrees()
    changes = {i: text() for i in range(0, 300, 7)} | {900: "w59 new", 302: None}
    docs |= changes
    index.add(frame(changes), 1)
    index.add(frame({1: "not read again"}), 1)  # a repeated part changes nothing
    again = {7: "w1 w2 again", 901: "again"}
    docs |= again
    for gone in (14, 900):
        del docs[gone]
    index.add(frame(again), 4, removed=spark.createDataFrame([(14,), (900,), (5555,)], "id long"))
    assert index.parts() == [0, 1, 4]
    agrees(k=1)
    agrees()
    df = {r.term: r.df for r in index.terms().collect()}
    assert df == dict(Counter(t for d in docs.values() for t in set(words(d)))) and index.size()[0] == len(docs)
    index.merge()
    assert index.parts() == [4] and {r.term: r.df for r in index.terms().collect()} == df
    index.add(frame({3: "w3"}), 5)
    docs[3] = "w3"
    agrees()
    with pytest.raises(ValueError, match="before"):
        index.add(frame({1: "x"}), 2)


def test_kept_index_of_texts_without_words(spark, tmp_path):
    index = keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index", "string")
    index.add(spark.createDataFrame([("a", None), ("b", ""), (None, "left out")], "id string, text string"), 0)
    assert index.size() == (2, 0.0) and index.search(spark.createDataFrame([(1, "left")], "q long, text string")).count() == 0
