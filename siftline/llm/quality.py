"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.language_mixture import held_out

#: Bytes of a passage; a text is cut into passages of this size, the last may be shorter.
PASSAGE = 512
#: Labelled documents that the fit may use, the first by a hash of their id, and passages that these may have together.
SAMPLE_ROWS = 4_000
SAMPLE_PASSAGES = 160_000
THRESHOLD = 0.7
#: Bytes whose passages are encoded at once.
CHUNK = 1 << 20

CLASSES = 16
FEATURES = CLASSES * CLASSES + 2


def _byte_classes() -> np.ndarray:
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#*", b"$%&", b"\"'()[]{}<>", b":;-_/\\@=+~^`"]
    table = np.full(256, 15, np.uint8)
    for k, group in enumerate(groups):
        table[list(group)] = k
    table[0xC0:] = 13
    table[0x80:0xC0] = 14
    return table


_CLASS = _byte_classes()


def encode_passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each passage, [passage, FEATURES]) of whole texts, about CHUNK bytes at a time.

    Features of a passage are the square roots of the shares of each pair of adjacent byte classes, the
    share of its 8-byte strings that the passage has more than once, and its length. An empty or null text is
    one passage without bytes.
    """
    part: list[tuple[int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:  # a long text is encoded in parts of whole passages
            if part:
                yield _encode(part)
            pieces = [_encode([(i, data[at : at + CHUNK])]) for at in range(0, len(data), CHUNK)]
            yield np.concatenate([d for d, _ in pieces]), np.concatenate([x for _, x in pieces])
            part, held = [], 0
            continue
        part.append((i, data))
        held += len(data)
        if held >= CHUNK:
            yield _encode(part)
            part, held = [], 0
    if part:
        yield _encode(part)


def _encode(part: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for _, b in part], np.int64)
    passages = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.array([i for i, _ in part], np.int64), passages)
    first = np.cumsum(passages) - passages
    flat = np.frombuffer(b"".join(b for _, b in part), np.uint8)
    x = np.zeros((len(doc), FEATURES), np.float32)
    if not len(flat):
        return doc, x
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.repeat(first, sizes) + within // PASSAGE
    kinds = _CLASS[flat].astype(np.int64)
    same = own[1:] == own[:-1]
    pairs = np.bincount((own[:-1] * CLASSES * CLASSES + kinds[:-1] * CLASSES + kinds[1:])[same], minlength=len(doc) * CLASSES * CLASSES).reshape(len(doc), -1)
    length = np.bincount(own, minlength=len(doc))
    x[:, :-2] = np.sqrt(pairs / np.maximum(1, length - 1)[:, None])
    if len(flat) >= 8:
        strings = np.lib.stride_tricks.sliding_window_view(flat, 8)[::1].copy().view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
        inside = own[7:] == own[:-7]
        keys = np.sort((own[7:].astype(np.uint64) << np.uint64(20) | strings)[inside])
        again = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(20)).astype(np.int64)
        x[:, -2] = np.bincount(again, minlength=len(doc)) / np.maximum(1, length)
    x[:, -1] = length / PASSAGE
    return doc, x


@dataclass
class AttentionModel:
    """h = tanh(x W + b); attention = softmax over a document of (tanh(h V) * sigmoid(h U)) w; logit = (sum of attention * h) c + d."""

    weights: dict[str, np.ndarray]

    def scores(self, doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, scores in (0, 1), attention of each passage); doc is sorted."""
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        logit, attention, *_ = _forward(self.weights, x, starts)
        return doc[starts], 1 / (1 + np.exp(-np.clip(logit, -30, 30))), attention


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> tuple:
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(((x - w["mean"]) / w["spread"]) @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[own])
    a = e / np.add.reduceat(e, starts)[own]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ w["c"] + w["d"], a, z, h, t, s, own


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    logit, a, z, h, t, s, own = _forward(w, x, starts)
    g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    dz = g[:, None] * w["c"]
    da = (dz[own] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[own])
    dts = de[:, None] * w["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (a[:, None] * dz[own] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    out = {"c": z.T @ g, "d": g.sum(), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": ((x - w["mean"]) / w["spread"]).T @ dh, "b": dh.sum(0)}
    return {k: v + (decay * w[k] if k in "cwVUW" else 0) for k, v in out.items()}


def fit_attention(doc: np.ndarray, x: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, rate: float = 0.01, batch: int = 128, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Fit by Adam on the cross entropy of document labels; doc is sorted, labels are those of its distinct values in order.

    Without labels of both kinds every score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    mean, square = x.mean(0, dtype=np.float64), np.zeros(x.shape[1])
    for at in range(0, len(x), 4096):
        square += np.square(x[at : at + 4096].astype(np.float64)).sum(0)
    spread = np.maximum(np.sqrt(np.maximum(0, square / len(x) - mean * mean)), 0.02)
    w = {"W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "w": rng.normal(0, 0.3, gate), "c": np.zeros(hidden), "d": np.array(0.0)}
    w = {k: v.astype(np.float32) for k, v in (w | {"mean": mean, "spread": spread}).items()}
    share = (labels.sum() + 1) / (len(labels) + 2)
    w["d"] = np.float32(np.log(share / (1 - share)))
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(starts[1:], len(doc))
    m, v, step = {}, {}, 0
    for epoch in range(epochs if 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = ends[rows] - starts[rows]
            take = np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            step += 1
            for k, g in _gradients(w, x[take].astype(np.float32), np.cumsum(sizes) - sizes, labels[rows], decay).items():
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.999 * v.get(k, 0) + 0.001 * g * g
                w[k] = (w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return AttentionModel(w)


def _within(sizes: pd.DataFrame, order: pd.Series, most: int) -> list:
    """The ids, in the given order, of sizes(id, n) that together have at most `most` passages; one that doesn't fit is passed over."""
    n, total, out = dict(zip(sizes["id"].tolist(), sizes["n"].tolist(), strict=True)), 0, []
    for x in order.tolist():
        if x in n and total + n[x] <= most:
            total += n[x]
            out.append(x)
    return out


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """Fit on at most sample_rows labelled documents outside the held-out fold, the first by a hash of their id.

    A document's label is 1 if all its labels are; null labels and ids count for nothing. The fit sees every passage of a document or
    none: documents are taken in that order, but for those with which there would be over sample_passages passages together. The features
    come to the driver as 16-bit floats, at most 83 MB. Rows that share an id count as the one whose features are first.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) == 1).cast("int")).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = named.join(texts.select("id").distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    kind = dict(docs.dtypes)[id_col]
    size = F.max(F.greatest(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE), F.lit(1))).alias("n")
    sizes = texts.join(F.broadcast(sample), "id").groupBy("id").agg(size).toPandas()  # sample_rows at most
    chosen = _within(sizes, sample.select("id").toPandas()["id"], sample_passages)
    sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in chosen], f"id {kind}")), "id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, y, text in zip(b["id"], b["y"], b["text"], strict=True):
                x = np.concatenate([p[1].astype("<f2") for p in encode_passages([text])])
                yield pd.DataFrame({"id": [i], "y": [y], "n": [len(x)], "x": [x.tobytes()]})

    once = texts.join(F.broadcast(sample), "id").mapInPandas(encode, f"id {kind}, y int, n long, x binary").groupBy("id").agg(F.min(F.struct("x", "y", "n")).alias("r"))
    got = once.select("id", "r.*").toPandas().sort_values("id", kind="stable")  # sample_passages at most
    x = np.frombuffer(b"".join(got["x"]), "<f2").reshape(-1, FEATURES) if len(got) else np.zeros((1, FEATURES), "<f2")
    doc = np.repeat(np.arange(len(got)), got["n"].to_numpy(np.int64))
    return fit_attention(doc, x, got["y"].to_numpy(np.float32))


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (<id_col>, score, passages, top_passage, top_attention).

    score is that of the attention-weighted passages of the whole text, from 0 to 1; top_passage is the
    number of the passage with most attention, from 0. A null or empty text is one passage without bytes. Repeated
    rows each get a row, an empty table gives none; columns other than the two named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for doc, x in encode_passages(list(b["text"])):
                rows, score, attention = shared.value.scores(doc, x)
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                most = np.maximum.reduceat(attention, starts)
                size = np.diff(np.append(starts, len(doc)))
                top = np.minimum.reduceat(np.where(attention == np.repeat(most, size), np.arange(len(doc)), len(doc)), starts) - starts
                yield pd.DataFrame({"id": ids[rows], "score": score.astype(float), "passages": size, "top_passage": top, "top_attention": most.astype(float)})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double, passages long, top_passage long, top_attention double")
    return found.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all columns stay, and no row is shuffled."""
    model = learn_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(np.concatenate([shared.value.scores(doc, x)[1] for doc, x in encode_passages(list(text))] or [np.zeros(0)]).astype(float))

    return docs.where(score("text") >= threshold)


def op4_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score_quality(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages", "top_passage", "top_attention")
