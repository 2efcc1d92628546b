"""A kept index sends and stores a term's postings many at a time."""

from pyspark.sql import functions as F

from siftline.operators import keyword_index as ki
from siftline.operators import retrieval


def test_postings_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ki, "SHARDS", 2)
    monkeypatch.setattr(ki, "SPREAD", 1)
    docs = spark.range(0, 200, 1, 2).select("id", F.concat(F.repeat(F.lit("alpha beta "), 20), F.lit("w"), F.col("id") % 3, F.when(F.col("id") % 2 == 0, " gamma gamma").otherwise("")).alias("text"))
    index = ki.KeywordIndex(spark, f"file://{tmp_path}/index")
    index.add(docs, 0)
    assert index._read("postings").count() <= 2 * 6
    index.add(docs.where("id < 10").select("id", F.lit("gamma w1").alias("text")), 1)
    now = docs.withColumn("text", F.when(F.col("id") < 10, "gamma w1").otherwise(F.col("text")))
    asked = spark.createDataFrame([(1, "w1 alpha"), (2, "gamma w1 beta"), (3, "none"), (4, "w2 alpha beta gamma")], "q long, text string")
    want = [(r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieval.bm25_topk(now, asked, 7).orderBy("q", "rank").collect()]
    got = lambda: [(r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in index.search(asked, 7).orderBy("q", "rank").collect()]
    assert got() == want and len(want) == 21
    index.merge()
    assert index._read("postings").count() < 200 and got() == want


def test_a_long_batch_is_cut(monkeypatch):
    """Documents of one batch, one of more words than are held at once, and one without any."""
    import pyarrow as pa

    monkeypatch.setattr(ki, "WORDS_HELD", 3)
    b = pa.RecordBatch.from_arrays([pa.array([4, 5, 6, 7]), pa.array([["a", "b", "a", "c"], [], ["c"], ["c", "b"]])], ["id", "t"])
    counted = list(ki._counted(iter([b.slice(1), b])))
    rows = [r for x in counted for r in x.to_pylist()]
    assert [(r["id"], r["len"], dict(zip(r["terms"], r["tf"], strict=True))) for r in rows[3:]] == [(4, 4, {"a": 2, "b": 1, "c": 1}), (5, 0, {}), (6, 1, {"c": 1}), (7, 2, {"c": 1, "b": 1})]
    assert rows[:3] == rows[4:]
    packed = [r for x in ki._packed(iter(counted[2:])) for r in x.to_pylist()]
    assert sorted((r["term"], i, n, m) for r in packed for i, n, m in zip(r["ids"], r["tfs"], r["lens"], strict=True)) == sorted((w, r["id"], n, r["len"]) for x in counted[2:] for r in x.to_pylist() for w, n in zip(r["terms"], r["tf"], strict=True))
