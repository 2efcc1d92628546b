import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.llm import language_mixture as lm
from siftline.llm import quality


def test_quality_on_held_out_documents(spark, sf):
    found = quality.op4_quality_attention(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    j = found.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score")).first()
    assert j[0] >= 0.85 and 0 <= j[1] and j[2] <= 1


def test_held_out_fold(spark):
    import zlib

    got = spark.range(200).select("id", lm.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(lm.held_out("id")).first()[0] is False


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 4))
    starts, y = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.normal(size=(4, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.1), "mean": np.zeros(4), "spread": np.ones(4)}

    def loss():
        logit = quality._forward(w, x, starts)[0]
        p = 1 / (1 + np.exp(-logit))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got = quality._gradients(w, x, starts, y, 0.0)
    for k in "WbVUwcd":
        flat = w[k].reshape(-1)
        for i in range(flat.size):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert np.asarray(got[k]).reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_odd_rows(spark, docs, empty):
    model = quality.learn_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    found = quality.score_quality(docs, model)
    assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score_quality(empty, model).count() == 0
    assert found.where("passages < 1").count() == 0


def test_every_passage_is_encoded():
    long = "word " * 100_000
    parts = list(quality.encode_passages(["", None, long, "a"]))
    doc = np.concatenate([d for d, _ in parts])
    assert np.bincount(doc).tolist() == [1, 1, -(-len(long) // quality.PASSAGE), 1]


def test_a_long_text_is_encoded_alike_in_parts(monkeypatch):
    texts = ["ab, Cd. 12 " * 300, "", "short", "x y z " * 1000]
    whole = list(quality.encode_passages(texts))
    monkeypatch.setattr(quality, "CHUNK", 2 * quality.PASSAGE)
    pieces = list(quality.encode_passages(texts))
    for k in (0, 1):
        assert (np.concatenate([w[k] for w in whole]) == np.concatenate([p[k] for p in pieces])).all()


def test_language_on_held_out_documents(spark, sf):
    found = lm.op10_language_mixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert found.count() == docs.count() and got >= 0.95


def test_language_odd_rows(spark, docs, empty):
    model = lm.learn(docs)
    found = {r.doc_id: r for r in lm.predict(docs.where("doc_id IS NOT NULL"), model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in found.items():
        lettered = any(c.isalpha() for c in texts[i] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1, texts[i]
    assert lm.predict(empty, model).count() == 0
    none = lm.predict(docs, lm.learn(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_mixture_finds_both_languages(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["kaka", "tata", "papa", "mama"], "ee": ["zeze", "weve", "lele", "nene"], "oo": ["rojo", "bobo", "dodo", "gogo"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    train = spark.createDataFrame([(text(k, 300), k) for k in words], "text string, lang string")
    mixed = spark.createDataFrame([(1, text("aa", 200) + " " + text("ee", 100)), (2, text("oo", 50)), (3, text("ee", 60) + " 123")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.predict(mixed, lm.learn(train)).collect()}
    assert got[1].languages == ["aa", "ee"] and got[1].proportions[0] == pytest.approx(2 / 3, abs=0.05)
    assert got[2].languages == ["oo"] and got[3].languages == ["ee"] and got[2].score == 1


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "abc déf, ghi 12 jkl " * 40
    whole = list(lm.gram_counts([text]))[0]
    monkeypatch.setattr(lm, "CHUNK", 64)
    pieces = list(lm.gram_counts([text]))[0]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_every_letter_counts(spark):
    """U+2BA3C stands in the bucket of three spaces, and is a letter like any other."""
    docs = spark.createDataFrame([(1, "\U0002ba3c", "zz"), (2, "abc abd", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in lm.predict(docs, lm.learn(docs)).collect()}
    assert got == {1: "zz", 2: "aa"}


def plain_em(grams: dict, model: np.ndarray) -> dict:
    """The method written out for one document: EM over all languages orders them, then sets of the first ones are fitted while they pay."""

    def fit(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(lm.ROUNDS if len(chosen) > 1 else 0):
            total = [0.0] * len(chosen)
            for b, n in grams.items():
                r = [share[j] * float(model[b, k]) for j, k in enumerate(chosen)]
                for j in range(len(chosen)):
                    total[j] += n * r[j] / sum(r)
            share = [t / sum(grams.values()) for t in total]
        return share, sum(n * np.log(sum(share[j] * float(model[b, k]) for j, k in enumerate(chosen))) for b, n in grams.items())

    langs = list(range(model.shape[1]))
    order = sorted(langs, key=lambda k: -fit(langs)[0][k])
    best, (share, last) = order[:1], fit(order[:1])
    for k in range(2, len(langs) + 1):
        more, ll = fit(order[:k])
        if ll - last <= lm.PENALTY * np.log1p(sum(grams.values())):
            break
        best, share, last = order[:k], more, ll
    return dict(zip(best, share, strict=True))


def test_inference_matches_plain_em(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CELLS", 64)
    rng = np.random.default_rng(1)
    words = {k: ["".join(rng.choice(list(k), 4)) for _ in range(30)] for k in ("abcde", "defgh", "ghija")}
    train = spark.createDataFrame([(" ".join(w), k) for k, w in words.items()], "text string, lang string")
    langs, model = lm.learn(train)
    texts = [" ".join([*rng.choice(words[a], 20 + k), *rng.choice(words[b], 3 * k)]) for k, (a, b) in enumerate([("abcde", "defgh"), ("defgh", "ghija"), ("ghija", "ghija"), ("abcde", "ghija"), ("abcde", "abcde")] * 2)]
    found = {r.doc_id: r for r in lm.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (langs, model)).collect()}
    for k, t in enumerate(texts):
        _, bucket, n = next(lm.gram_counts([t]))
        want = plain_em(dict(zip(bucket.tolist(), n.tolist(), strict=True)), model)
        got = dict(zip(found[k].languages, found[k].proportions, strict=True))
        assert {langs[j] for j in want} == set(got) and all(got[langs[j]] == pytest.approx(p, abs=1e-6) for j, p in want.items())


def plain_score(w: dict, passages: np.ndarray) -> float:
    """The model's formulas for one document, passage by passage."""
    h, e = [], []
    for x in passages:
        h.append([np.tanh(sum((x[i] - w["mean"][i]) / w["spread"][i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(w["W"].shape[1])])
        gate = [np.tanh(sum(h[-1][j] * w["V"][j, g] for j in range(len(h[-1])))) / (1 + np.exp(-sum(h[-1][j] * w["U"][j, g] for j in range(len(h[-1]))))) for g in range(w["V"].shape[1])]
        e.append(sum(a * b for a, b in zip(gate, w["w"], strict=True)))
    weight = [np.exp(x) / sum(np.exp(e)) for x in e]
    z = [sum(a * v[j] for a, v in zip(weight, h, strict=True)) for j in range(len(h[0]))]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"])))


def test_scores_match_a_plain_forward_pass(spark, docs, sf):
    model = quality.learn_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.rid: r.text for r in docs.where("rid < 34").collect()}
    found = {r.rid: r for r in quality.score_quality(docs.where("rid < 34"), model, id_col="rid").collect()}
    for rid, text in texts.items():
        passages = np.concatenate([x for _, x in quality.encode_passages([text])])
        assert found[rid].passages == len(passages) and found[rid].score == pytest.approx(plain_score(model.weights, passages), abs=2e-4)


def test_long_labelled_documents_are_fitted_on(spark):
    """Two labelled texts of 1 MB decide; nothing is left out for its length."""
    noise, prose = "x#|9$" * 210_000, "The old house stood near the river. " * 29_000
    docs = spark.createDataFrame([(k, noise if k % 2 else prose) for k in range(1, 9)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.learn_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all(got[k] < 0.3 if k % 2 else got[k] > 0.7 for k in got)


def test_labelled_documents_are_fitted_on_whole_or_not_at_all(spark):
    texts = {k: "word " * (300 * k) for k in range(1, 9)}
    sizes = {k: -(-len(t) // quality.PASSAGE) for k, t in texts.items()}
    got = quality._within(pd.DataFrame({"id": list(sizes), "n": list(sizes.values())}), pd.Series([8, 3, 7, 1, 2, 99]), sizes[8] + sizes[1] + sizes[2])
    assert got == [8, 3] if sizes[8] + sizes[3] == sizes[8] + sizes[1] + sizes[2] else got == [8, 1, 2]
    seen = {}
    real = quality.fit_attention

    def spy(doc, x, labels):
        seen["doc"], seen["x"] = doc, x
        return real(doc, x, labels)

    quality.fit_attention = spy
    try:
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        quality.learn_quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality"))
    finally:
        quality.fit_attention = real
    fold = [r[0] for r in docs.where(~quality.held_out("doc_id")).orderBy("doc_id").collect()]
    want = [np.concatenate([x for _, x in quality.encode_passages([texts[k]])]) for k in fold]
    assert np.bincount(seen["doc"]).tolist() == [len(x) for x in want]
    assert (seen["x"] == np.concatenate(want).astype("<f2")).all()
