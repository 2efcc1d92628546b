"""Queries of corpus search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import fixed
from siftline.operators import retrieval as ret
from siftline.plans import triage
from siftline.plans import views as v
from siftline.plugins import model_scorer
from siftline.tables import small_side, written

D = triage.D


def _docs(spark, sf):
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, sf):
    return v.table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")


def _vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def tokenize(spark, sf):
    return _docs(spark, sf).select("id", F.size(ret.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(ret.tokens(F.col("text")), " ")).alias("hash"))


def bm25_stats(spark, sf):
    idf = ret.bm25_index(_docs(spark, sf))[1]
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_size(spark, sf):
    return ret.bm25_index(_docs(spark, sf))[2].select("n", F.round("mean_len", 6).alias("mean_len"))


def keyword_topk(spark, sf):
    return ret.bm25_topk(_docs(spark, sf), _asked(spark, sf)).select("q", "rank", "id", F.round("score", 5).alias("score"))


def _dense(spark, sf):
    x = _vectors(spark, sf)
    return ret.dense_topk(x, x.join(small_side(_asked(spark, sf).select(F.col("q").alias("id"))), "id", "left_semi").withColumnRenamed("id", "q"))


def dense_topk(spark, sf):
    return _dense(spark, sf).select("q", "rank", "id", F.round("score", 5).alias("score"))


def rrf_fusion(spark, sf):
    return ret.rrf(_dense(spark, sf), ret.bm25_topk(_docs(spark, sf), _asked(spark, sf))).select("q", "rank", "id", F.round("score", 6).alias("score"))


def hybrid_query(spark, sf):
    """The fused list for each query, with the documents' language beside it, as one record."""
    hits = written(rrf_fusion(spark, sf), "hits")
    lang = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").join(small_side(hits.select("id").distinct()), "id", "left_semi")
    x = hits.join(lang, "id", "left")
    return x.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "lang"))), lambda r: F.concat_ws(":", r["rank"].cast("string"), r["id"].cast("string"), r["lang"])), " ").alias("hits"))


def l2_normalize(spark, sf):
    """Rounded to five decimals as its SQL does it: what rounds to zero keeps its sign."""
    rounded = lambda x: F.when((x < 0) & (F.round(x, 5) == 0), F.lit(-0.0)).otherwise(F.round(x, 5))
    return _vectors(spark, sf).select("id", F.transform(ret.l2_normalize(F.col("v")), rounded).alias("v"))


def term_vectors(spark, sf):
    return ret.term_vectors(_docs(spark, sf)).select("id", "k", F.round("w", 6).alias("w"))


def embed_distinct_once(spark, sf):
    """A score by text length, worked out once a distinct text."""
    out = ret.score_distinct_once(_docs(spark, sf), "text", model_scorer(lambda texts: texts.str.len().astype(float) % 97))
    return out.select("id", "score")


def corpus_build(spark, sf):
    """CWE and CVE rows as (type, id, text)."""
    from siftline.sources import knowledge

    return knowledge.corpus(knowledge.known_cwes(spark), v.cve_docs(spark, sf).withColumn("score", F.lit(None).cast("double"))).select("type", "id", F.md5("text").alias("hash"))


QUERIES = {
    "tokenize": tokenize, "bm25_stats": bm25_stats, "bm25_size": bm25_size, "keyword_topk": keyword_topk, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion, "hybrid_query": hybrid_query,
    "l2_normalize": l2_normalize, "term_vectors": term_vectors, "embed_distinct_once": embed_distinct_once, "kb_corpus_build": corpus_build,
}


def _tok(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2)"


_TERMS = f"""w AS (SELECT doc_id AS id, {_tok('text')} AS t FROM documents), size AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM w), terms AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM w) q GROUP BY 1, 2, 3),
raw AS (SELECT term, count(*) AS df, ln(((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM terms GROUP BY 1), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {D(0.25)} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_KEY = f"""asked AS (SELECT q, term, count(*) AS times FROM (SELECT item_id AS q, unnest({_tok('text')}) AS term FROM benchmark) z GROUP BY 1, 2),
ks AS (SELECT a.q, t.id, sum(a.times * i.idf * t.tf * {D(2.5)} / (t.tf + {D(1.5)} * ({D(0.25)} + {D(0.75)} * t.len / (SELECT mean_len FROM size)))) AS score FROM asked a JOIN idf i ON a.term = i.term JOIN terms t ON a.term = t.term GROUP BY 1, 2),
kr AS (SELECT * FROM (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, score FROM ks WHERE score > 0) z WHERE rank <= 5)"""
_DENSE = """ev AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
ds AS (SELECT q.id AS q, c.id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score FROM ev q, ev c WHERE q.id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT * FROM (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, score FROM ds) z WHERE rank <= 5)"""
_RRF = f"""fs AS (SELECT q, id, sum(s) AS score FROM (SELECT q, id, {D(0.6)} / (60 + rank) AS s FROM dr UNION ALL SELECT q, id, (1 - {D(0.6)}) / (60 + rank) FROM kr) z GROUP BY 1, 2),
fr AS (SELECT * FROM (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, score FROM fs) z WHERE rank <= 5)"""
SQL = {
    "tokenize": f"SELECT doc_id AS id, CAST(len({_tok('text')}) AS INTEGER) AS n, md5(array_to_string({_tok('text')}, ' ')) AS hash FROM documents",
    "bm25_stats": f"""WITH f AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tok('text')})) AS term FROM documents) q GROUP BY 1), r AS MATERIALIZED (SELECT term, df, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS raw FROM f)
        SELECT term, df, round(CASE WHEN raw < 0 THEN {D(0.25)} * avg(raw) OVER () ELSE raw END, 6) AS idf FROM r""",
    "bm25_size": f"WITH {_TERMS} SELECT n, round(mean_len, 6) AS mean_len FROM size",
    "keyword_topk": f"WITH {_TERMS}, {_KEY} SELECT q, rank, id, round(score, 5) AS score FROM kr",
    "dense_topk": f"WITH {_DENSE} SELECT q, rank, id, round(score, 5) AS score FROM dr",
    "rrf_fusion": f"WITH {_TERMS}, {_KEY}, {_DENSE}, {_RRF} SELECT q, rank, id, round(score, 6) AS score FROM fr",
    "hybrid_query": f"WITH {_TERMS}, {_KEY}, {_DENSE}, {_RRF} SELECT q, string_agg(concat_ws(':', CAST(rank AS VARCHAR), CAST(fr.id AS VARCHAR), lang), ' ' ORDER BY rank) AS hits FROM fr LEFT JOIN documents d ON fr.id = d.doc_id GROUP BY q",
    "l2_normalize": "SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 5)) AS v FROM embeddings",
    "term_vectors": f"WITH w AS (SELECT doc_id AS id, {_tok('text')} AS t FROM documents), p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM w), f AS (SELECT term, id, pos FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY id, pos) = 1), vo AS (SELECT term, row_number() OVER (ORDER BY id, pos) - 1 AS k FROM f), n AS (SELECT p.id, vo.k, count(*) AS n FROM p JOIN vo ON p.term = vo.term WHERE k < 512 GROUP BY 1, 2) SELECT id, CAST(k AS INTEGER) AS k, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS w FROM n",
    "embed_distinct_once": "SELECT doc_id AS id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) % 97 END AS DOUBLE) AS score FROM documents",
    "kb_corpus_build": "SELECT 'cwe' AS type, id, md5(id || ' ' || category || ': ' || category) AS hash FROM (VALUES " + ", ".join(f"('CWE-{n}', '{k}')" for k, ns in fixed.OWASP.items() for n in ns) + ") z(id, category) UNION ALL " + v.sql("SELECT 'cve', id, md5(id || ' (' || cwe || ', CVSS: ): ' || description) FROM cve_docs", "cve_docs").replace("WITH", "SELECT * FROM (WITH", 1) + ") y",
}
