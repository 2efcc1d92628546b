"""Search over a corpus: tokens, BM25, dense top-k, and their fusion. Indexes are tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import fixed
from siftline.tables import dealt, small_side, written

#: Bytes of query vectors up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Documents whose scores a task sums and ranks.
DOCS_A_TASK = 10_000


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, _ and -, of at least two characters."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 2)


def l2_normalize(vector: Column) -> Column:
    """The vector in doubles with length 1; a zero vector unchanged."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def bm25_index(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(id, text) -> words(id, len, t), idf(term, df, idf) and one row (n, mean_len). A negative idf becomes a quarter of the mean idf.

    Texts are cut into words once, into a written table. Document frequencies come from each document's distinct words, counted by term
    before the shuffle; postings aren't made.
    """
    words = written(docs.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("len"), "t"), "words")
    size = words.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    df = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = words.count()
    raw = written(df.select("term", "df", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")), "frequencies")
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, fixed.BM25_EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    return words, idf, size


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """queries(q, text) -> (q, rank, id, score): the k documents of the largest positive BM25 score, ties to the smaller id.

    Only words that some query asks for leave a document's row. They are dealt by document, DOCS_A_TASK to a task; there they are counted, meet
    the queries by term, and are summed by query and document, of which the k best a query leave the task.
    """
    words, idf, size = bm25_index(docs)
    asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    weight = written(idf.join(small_side(written(asked, "asked")), "term").select("q", "term", (F.col("times") * F.col("idf")).alias("w")), "query_terms")
    n, mean_len = size.first()
    k1, b, mean_len = fixed.BM25_K1, fixed.BM25_B, mean_len or 1.0
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean_len))
    wanted = small_side(written(weight.select("term").distinct(), "asked_terms"))
    met = words.select("id", "len", F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    counts = dealt(met, n, DOCS_A_TASK, "id").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    scores = counts.join(small_side(weight), "term").groupBy("q", "id").agg(F.sum(F.col("w") * part).alias("score")).where("score > 0")
    return ranked(scores, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """vectors(id, v), queries(q, v) -> (q, rank, id, score) by cosine, ties at nine decimals to the smaller id.

    Queries are packed in blocks, which are rows. Batches of vectors are packed where they lie and meet the blocks by number; each such
    pair is one matrix product, of which the k best rows a query leave the task. No row is a pair of a vector and a query.
    Up to BROADCAST_BYTES of queries are broadcast, and vectors stay where they lie. Past that the join has a tile as its key, a block of
    queries and a slice of the batches, with as many slices as give every shuffle partition about two tiles.
    """
    id_kind, q_kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["q"]
    n, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // block))
    packed = queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"), "q", l2_normalize(F.col("v")).alias("qv")).groupBy("block").agg(F.collect_list("q").alias("q"), F.collect_list("qv").alias("qv"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"ids": [b["id"].tolist()], "m": [np.concatenate(b["v"].tolist()).astype("<f8").tobytes()]})

    parts = vectors.select("id", l2_normalize(F.col("v")).alias("v")).where("v IS NOT NULL").mapInPandas(pack, f"ids array<{id_kind}>, m binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    if 8 * numbers <= BROADCAST_BYTES:
        met = parts.join(F.broadcast(packed), "block")
    else:
        slices = max(1, -(-2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
        tiles = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        met = parts.withColumn("slice", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(slices))).join(tiles.hint("shuffle_hash"), ["block", "slice"])
    met = met.select("ids", "m", "q", "qv")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, m, q, qv in b.itertuples(index=False):
                ids, scores = np.asarray(ids), np.frombuffer(m).reshape(len(ids), -1) @ np.stack(qv).T
                rounded = np.round(scores, 9)
                # all rows that reach the k-th best score, so that ties are settled by id afterwards
                least = np.partition(rounded, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(scores.shape[1], -np.inf)
                row, col = np.nonzero(rounded >= least)
                yield pd.DataFrame({"q": np.asarray(q)[col], "id": ids[row], "score": scores[row, col]})

    return ranked(met.mapInPandas(best, f"q {q_kind}, id {id_kind}, score double"), k)


def rrf(dense: DataFrame, keyword: DataFrame, k: int = 5, weight: float = fixed.RRF_DENSE) -> DataFrame:
    """Two ranked lists(q, rank, id) fused: sum of weight / (60 + rank)."""
    part = lambda df, w: df.select("q", "id", (F.lit(w) / (fixed.RRF_K + F.col("rank"))).alias("s"))
    return ranked(part(dense, weight).unionByName(part(keyword, 1 - weight)).groupBy("q", "id").agg(F.sum("s").alias("score")), k)


def term_vectors(docs: DataFrame, size: int = 512) -> DataFrame:
    """docs(id, text) -> (id, term number, weight): counts of the first `size` distinct words in order of appearance, as unit vectors."""
    words = docs.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    seen = words.groupBy("term").agg(F.min(F.struct("id", "pos")).alias("at"))
    vocabulary = seen.orderBy("at", "term").limit(size).select("term", (F.row_number().over(Window.orderBy("at", "term")) - 1).alias("k"))
    n = words.join(F.broadcast(vocabulary), "term").groupBy("id", "k").agg(F.count("*").alias("n"))  # `size` rows
    norm = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "id").select("id", "k", (F.col("n") / F.col("norm")).alias("w"))


def score_distinct_once(rows: DataFrame, text: str, scorer) -> DataFrame:
    """rows with `score` from scorer(df with hash, text), called on each distinct text once; empty text gets 0."""
    keyed = rows.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = keyed.where(F.col(text) != "").select("hash", F.col(text).alias("text")).dropDuplicates(["hash"])
    return keyed.join(scorer(once).select("hash", "score"), "hash", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).drop("hash")
