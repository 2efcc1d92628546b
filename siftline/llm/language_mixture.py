"""Language identification by expectation-maximisation over mixtures of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letter trigrams are hashed into this many buckets; a model is languages x BUCKETS numbers.
BUCKETS = 1 << 16
#: Languages that one model may have (128 MB of 32-bit numbers); more are refused.
MOST_LANGUAGES = 512
#: Characters that are counted at once.
CHUNK = 1 << 20
#: Grams x languages whose likelihoods are held at once.
CELLS = 1 << 22
SMOOTHING = 0.3
ROUNDS = 12
#: What another language must gain in log likelihood, for each unit of log(1 + trigrams).
PENALTY = 3.0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def _slices(texts: list[tuple[int, str]]) -> Iterator[tuple[str, np.ndarray]]:
    """The texts in lower case with a space at either end, one after another, and the document of each character; a long text in parts."""
    if len(texts) == 1 and len(texts[0][1]) > CHUNK:
        i, t = texts[0]
        for at in range(0, len(t), CHUNK):
            part = (" " if at == 0 else "") + t[at : at + CHUNK].lower() + (" " if at + CHUNK >= len(t) else "")
            yield part, np.full(len(part), i, np.int64)
        return
    parts = [f" {t} ".lower() for _, t in texts]
    yield "".join(parts), np.repeat(np.array([i for i, _ in texts], np.int64), [len(p) for p in parts])


def _count(texts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document << 16 | bucket) of the texts, and their counts; texts are given in order of their documents.

    Texts are lower-cased, runs of anything but letters become one space, and each has a
    space at either end. A text of over CHUNK characters is read in pieces, the last two letters carried over.
    """
    keys, counts, before, owner = [], [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for part, docs in _slices(texts):
        c = np.concatenate([before, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)])
        d = np.concatenate([owner, docs])
        c = np.where(_letters()[c], c, np.uint32(32))
        keep = np.append(True, (c[1:] != 32) | (c[:-1] != 32) | (d[1:] != d[:-1]))
        c, d = c[keep], d[keep]
        whole = (d[2:] == d[:-2]) if len(d) > 2 else np.zeros(0, bool)
        k, n = np.unique((d[2:] << 16 | _hash(c[:-2], c[1:-1], c[2:]))[whole], return_counts=True)
        keys.append(k)
        counts.append(n)
        before, owner = c[-2:], d[-2:]
    if len(keys) == 1:
        return keys[0], counts[0]
    both, n = np.concatenate(keys), np.concatenate(counts)
    k, where = np.unique(both, return_inverse=True)
    return k, np.bincount(where, n, len(k)).astype(np.int64)


def gram_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, count) of the texts, some whole texts at a time."""
    part, held = [], 0
    for i, t in enumerate([*texts, None]):
        if t and part and len(t) > CHUNK:
            k, n = _count(part)
            yield k >> 16, k & 0xFFFF, n
            part, held = [], 0
        if t:
            part.append((i, t))
            held += len(t)
        if part and (held >= CHUNK or i == len(texts)):
            k, n = _count(part)
            yield k >> 16, k & 0xFFFF, n
            part, held = [], 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, [bucket, language] probabilities) counted over all rows of docs that have a language.

    Tasks count their own rows and send a row for each language and bucket, which Spark adds up; the
    driver gets the finished table, whose size does not depend on the rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for x in batches:
            for lang, group in x.groupby("lang"):
                got = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket, n in gram_counts(list(group["text"])):
                    got += np.bincount(bucket, n, BUCKETS).astype(np.int64)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    table = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def likelihoods(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(pdf["bucket"], pdf["n"], BUCKETS)
        return pd.DataFrame({"lang": [key[0]], "p": [((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)).astype(np.float32).tobytes()]})

    # A language has at most BUCKETS rows; what comes to the driver is a row a language.
    found = table.groupBy("lang").applyInPandas(likelihoods, "lang string, p binary").limit(MOST_LANGUAGES + 1).toPandas().sort_values("lang")
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return found["lang"].tolist(), np.column_stack([np.frombuffer(p, np.float32) for p in found["p"]]) if len(found) else np.zeros((BUCKETS, 0), np.float32)


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, total: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ROUNDS rounds from `share`, and their log likelihood. p: [gram, language]; starts: a document's first gram."""
    sizes = np.diff(np.append(starts, len(n)))
    for _ in range(ROUNDS if p.shape[1] > 1 else 0):
        r = p * np.repeat(share, sizes, axis=0)
        r *= (n / r.sum(1))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log((p * np.repeat(share, sizes, axis=0)).sum(1)), starts)


def infer(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, [document, language] proportions; 0 for languages outside the chosen set).

    EM over all languages orders them by their proportion. Sets of the first one, two ... of them
    are then fitted by EM; another language is taken in while it raises the log likelihood by
    more than PENALTY * log(1 + trigrams).
    """
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    langs = model.shape[1]
    n = n.astype(np.float64)
    total = np.add.reduceat(n, starts)
    p = model[bucket].astype(np.float64)
    share, _ = _em(p, n, starts, total, np.full((len(starts), langs), 1 / langs))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    np.put_along_axis(best, order[:, :1], 1.0, axis=1)
    sizes = np.diff(np.append(starts, len(n)))
    open_docs = np.arange(len(starts))
    first = np.repeat(order[:, 0], sizes)
    last = np.add.reduceat(n * np.log(p[np.arange(len(p)), first]), starts)
    for k in range(2, langs + 1):
        if not len(open_docs):
            break
        rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(starts)), sizes), open_docs))
        own = np.repeat(np.arange(len(open_docs)), sizes[open_docs])
        chosen = order[open_docs, :k]
        fitted, ll = _em(np.take_along_axis(p[rows], chosen[own], axis=1), n[rows], np.cumsum(sizes[open_docs]) - sizes[open_docs], total[open_docs], np.full((len(open_docs), k), 1 / k))
        better = ll - last[open_docs] > PENALTY * np.log1p(total[open_docs])
        open_docs = open_docs[better]
        best[open_docs] = 0
        best[open_docs[:, None], chosen[better]] = fitted[better]
        last[open_docs] = ll[better]
    return doc[starts], best


def _stretches(doc: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole documents of about `most` rows; a document has at most BUCKETS."""
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    ends, begin = np.append(starts[1:], len(doc)), 0
    for start, end in zip(starts.tolist(), ends.tolist(), strict=False):
        if end - begin > most and start > begin:
            yield begin, start
            begin = start
    if begin < len(doc):
        yield begin, len(doc)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (<id_col>, lang_pred, score, languages, proportions).

    lang_pred has the largest proportion (the first in alphabetical order of equals), score is that proportion;
    languages are the chosen set, largest proportion first. Null text, text without a letter, or
    a model without languages give `und`, score 0 and empty lists. Other columns are ignored.
    """
    langs = np.array(model[0], object)
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # languages x BUCKETS, checked in learn()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            pred, score = np.full(len(x), "und", object), np.zeros(len(x))
            sets, parts = [[] for _ in range(len(x))], [[] for _ in range(len(x))]
            for doc, bucket, n in gram_counts(list(x["text"])) if len(langs) else []:
                for a, b in _stretches(doc, max(1, CELLS // len(langs))):
                    rows, share = infer(doc[a:b], bucket[a:b], n[a:b], shared.value)
                    top = share.argmax(1)
                    pred[rows], score[rows] = langs[top], share.max(1)
                    for i, s in zip(rows, share, strict=True):
                        at = [j for j in np.argsort(-s, kind="stable") if s[j] > 0]
                        sets[i], parts[i] = [langs[j] for j in at], [float(s[j]) for j in at]
            yield pd.DataFrame({"id": x["id"], "lang_pred": pred, "score": np.clip(score, 0, 1), "languages": sets, "proportions": parts})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")
    return found.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """True for the fold that nothing is learned from: crc32 of the id as text, mod 4, is 2 (false for null ids, which are not learned from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")
