"""Substring dedup: sliding spans of sentences, joined over all documents by their hash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import BROADCAST_ROWS, numbered, written

#: A span is a run of at least SENTENCES sentences and at least WORDS words.
SENTENCES = 3
WORDS = 16
#: Sentences of more than LONG words are cut behind commas and behind one in CUT of all words, chosen by their
#: hash, so that a passage inside a long sentence is cut alike wherever it begins; each piece counts as a sentence.
LONG, CUT = 16, 12
#: Spans that a chunk holds at least, and a block of all chunks about; bits of a hash by which spans are counted first.
CHUNK_SPANS, BLOCK_SPANS, PREFIX = 200_000, 1 << 20, 48
#: Bytes of marks up to which they are broadcast.
MARKS = 32 << 20

# Sentence ends of other scripts, which no space need follow, and the ranges of scripts that are written without spaces.
ENDS = "。！？｡．।॥؟۔"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_SENTENCE = re.compile(rf"[^.!?\n{ENDS}]*(?:[.!?]+(?![\s.!?]|\Z)[^.!?\n{ENDS}]*)*(?:[.!?]+(?:\s|\Z)|[{ENDS}]+\s?|\n|\Z)")
#: A word, or a character of a script without spaces.
_WORD = re.compile(rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)\s*")
_UNSPACED = re.compile(f"[{UNSPACED}]")


def sentences(text: str | None) -> list[str]:
    """The text cut behind each line feed, behind each . ! ? that white space follows, and behind the sentence ends of other
    scripts; joined they are the text again."""
    out = []
    for s in _SENTENCE.findall(text or ""):
        if len(s) <= 2 * LONG or len(words := _WORD.findall(s)) <= LONG:
            out.append(s)
            continue
        start = 0
        for k, w in enumerate(words, 1):
            w = w.strip()
            if w[-1] == "," or crc32(w.lower().encode("utf-8", "surrogatepass")) % CUT == 0:
                out.append("".join(words[start:k]))
                start = k
        out.append("".join(words[start:]))
    return [s for s in out if s]


def spans(parts: list[str], sentences: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, a, b) of each span: positions among parts, and 128 bits of hash.

    From each sentence the shortest run forward and to each sentence the shortest run
    backward that has `sentences` sentences and `words` words, each run once; two characters of a script without spaces count as one
    word more. Case and white space don't count,
    nor do sentences without any word; a length is that among all parts.
    """
    norm = [" ".join(p.lower().split()) for p in parts]
    at = np.array([i for i, p in enumerate(norm) if p], np.int64)
    n = len(at)
    if n < sentences:
        return (np.zeros(0, np.int64),) * 4
    digests = [xxhash.xxh3_128_digest(norm[i].encode("utf-8", "surrogatepass")) for i in at.tolist()]
    total = np.append(0, np.cumsum([norm[i].count(" ") + 1 + len(_UNSPACED.findall(norm[i])) // 2 for i in at.tolist()]))
    forward = np.maximum(np.arange(n) + sentences, np.searchsorted(total, total[:-1] + words))
    backward = np.minimum(np.arange(1, n + 1) - sentences, np.searchsorted(total, total[1:] - words, side="right") - 1)
    begin = np.concatenate([np.arange(n)[forward <= n], backward[backward >= 0]])
    end = np.concatenate([forward[forward <= n], np.arange(1, n + 1)[backward >= 0]])
    both = np.unique(begin * (n + 1) + end)
    begin, end = both // (n + 1), both % (n + 1)
    flat = b"".join(digests)
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(flat[16 * a : 16 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    return at[begin], at[end - 1] - at[begin] + 1, hashes[:, 0], hashes[:, 1]


_LISTS = {"rid": ("long", pa.int64()), "first": ("int", pa.int32()), "length": ("int", pa.int32()), "a": ("long", pa.int64()), "b": ("long", pa.int64())}


def _chunks(rows: DataFrame, least: int) -> DataFrame:
    """Written rows(rid, id, text) -> (chunk, ids, rid, first, length, a, b): the spans of many rows as one row of lists, in order of a without sign."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, part, rids, ids, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            n = [len(p[0]) for p in part]
            first, length, a, b = (np.concatenate([p[k] for p in part]) for k in range(4))
            order = np.argsort(a.view(np.uint64), kind="stable")
            own = np.repeat(np.arange(len(part)), n)[order]
            found = {"rid": np.array(rids, np.int64)[own], "first": first[order], "length": length[order], "a": a[order], "b": b[order]}
            whole = pa.array([0, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, pa.array(found[k], t)) for k, (_, t) in _LISTS.items()]
            id_list = pa.ListArray.from_arrays(whole, pa.concat_arrays(ids).take(pa.array(own)))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), id_list, *lists], ["chunk", "ids", *_LISTS])

        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                part.append(spans(sentences(text.as_py())))
                rids.append(batch.column(0)[i].as_py())
                ids.append(batch.column(1).slice(i, 1))
                held += len(part[-1][0])
                if held >= least:
                    yield flush()
                    chunk, part, rids, ids, held = chunk + 1, [], [], [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, " + ", ".join(f"{k} array<{t}>" for k, (t, _) in _LISTS.items()))


def _prefixes(a: np.ndarray, bits: int) -> np.ndarray:
    return a.view(np.uint64) >> np.uint64(64 - bits)


def _counted_twice(chunks: DataFrame, block_bits: int, bits: int) -> DataFrame:
    """Written chunks -> (chunk, block, marks): of a chunk's distinct prefixes in a block, in order, a bit whether another chunk has it too.

    A chunk sends its distinct prefixes, six bytes each, cut into blocks by their high bits; so a span sends one prefix a chunk however often it stands
    there. Blocks without any mark are left out.
    """
    shift, size = np.uint64(bits - block_bits), bits // 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, a in zip(*batch.columns, strict=True):
                keys = np.unique(_prefixes(a.values.to_numpy(), bits))
                block = (keys >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                data = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                edges = [*cuts.tolist(), len(keys)]
                bodies = [data[size * x : size * y] for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(cuts), pa.int64()), pa.array(block[cuts], pa.int32()), pa.array(bodies, pa.binary())], ["chunk", "block", "keys"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for body in pdf["keys"]:
            wide = np.zeros((len(body) // size, 8), np.uint8)
            wide[:, :size] = np.frombuffer(body, np.uint8).reshape(-1, size)
            lists.append(wide.view("<u8").ravel())
        keys, n = np.unique(np.concatenate(lists), return_counts=True)
        many = keys[n > 1]
        marks = [np.isin(x, many, assume_unique=True) for x in lists]
        some = [k for k, m in enumerate(marks) if m.any()]
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[some], "block": pdf["block"].to_numpy()[some], "marks": [np.packbits(marks[k]).tobytes() for k in some]})

    return chunks.select("chunk", "a").mapInArrow(send, "chunk long, block int, keys binary").groupBy("block").applyInPandas(count, "chunk long, block int, marks binary")


def candidate_spans(rows: DataFrame, chunk_spans: int = CHUNK_SPANS, bits: int = PREFIX) -> DataFrame:
    """Written rows(rid, id, text) -> written (rid, id, first, length, a, b) of all spans of which another may exist: every span that stands twice is
    among them, and of the others one in 2^bits for each span of the table. bits is a multiple of eight.

    Spans are hashed once and written in chunks. Prefixes of their hashes are counted first, so that only spans that repeat are shuffled whole. Blocks
    of prefixes follow the size of the table, up to 65,536 of them.
    """
    kind = dict(rows.dtypes)["id"]
    chunks = written(_chunks(rows, chunk_spans), "span_chunks", wide=True, dictionary=True)  # a chunk is a row of some megabytes
    total = chunks.agg(F.sum(F.size("a"))).first()[0] or 0
    block_bits = min(16, max(6, (total // BLOCK_SPANS).bit_length()))
    marks = written(_counted_twice(chunks, block_bits, bits), "span_marks")
    by_chunk = marks.groupBy("chunk").agg(F.collect_list(F.struct("block", "marks")).alias("found"))  # a bit a prefix of the chunk at most
    weight = marks.agg(F.sum(F.octet_length("marks") + 32)).first()[0] or 0
    joined = chunks.join(F.broadcast(by_chunk) if weight <= MARKS else by_chunk, "chunk", "left").select("found", "ids", *_LISTS)
    shift = np.uint64(bits - block_bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, at, n = np.unique(_prefixes(batch.column("a")[row].values.to_numpy(), bits), return_inverse=True, return_counts=True)
                many, block = n > 1, (keys >> shift).astype(np.int64)
                for f in batch.column("found")[row].as_py() or []:
                    here = np.flatnonzero(block == f["block"])
                    many[here] |= np.unpackbits(np.frombuffer(f["marks"], np.uint8), count=len(here)).view(bool)
                take = pa.array(np.flatnonzero(many[at]))
                yield pa.RecordBatch.from_arrays([batch.column(k)[row].values.take(take) for k in ("rid", "ids", "first", "length", "a", "b")], ["rid", "id", "first", "length", "a", "b"])

    return written(joined.mapInArrow(pick, f"rid long, id {kind}, first int, length int, a long, b long"), "candidate_spans")


def repeated_spans(table: DataFrame) -> DataFrame:
    """(rid, first, length) of every span that stands earlier, in a smaller id or before in the same document.

    The repeated spans are a written table of their own, so that the join deals out both sides anew and Spark may split a span
    that a large share of the documents has.
    """
    seen = written(table.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1").drop("n"), "shared_spans")
    found = written(table.join(seen, ["a", "b"]).withColumn("own", F.col("id").eqNullSafe(F.col("least"))), "repeated_spans")
    starts = found.where("own").groupBy("rid", "a", "b").agg(F.min("first").alias("start"))
    own = found.where("own").join(starts, ["rid", "a", "b"]).where("first > start")
    return found.where("not own").select("rid", "first", "length").unionByName(own.select("rid", "first", "length"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (<id_col>, <text_col>, n_sentences, n_removed, removed array<int>).

    A sentence goes if some span over it stands earlier: in a document of a smaller id, or earlier in the same one. What
    stays is the text as it was, byte for byte. Spans are runs of at least SENTENCES sentences and WORDS
    words, compared without case and white space. Null text stays null; texts of fewer sentences stay as they are. Rows that share an id count as one
    document, whose copies all keep a first span; null ids come after all others, and among
    themselves count as one document.

    Each span is hashed once; what may repeat is found by counts of prefixes, and only that is sent (candidate_spans). A span that many documents share is counted before the
    shuffle. Texts are moved once: up to BROADCAST_ROWS rows that lose a sentence only those, past it all.
    """
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = repeated_spans(candidate_spans(rows))
    gone = written(found.select("rid", F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("k")).groupBy("rid").agg(F.array_sort(F.collect_set("k")).alias("removed")), "removed")
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "text", "n_sentences", "n_removed", "removed"]

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, removed in zip(b["id"], b["text"], b["removed"], strict=True):
                parts = sentences(text)
                lost = set() if removed is None else set(removed.tolist())
                out.append((i, text if text is None or not lost else "".join([p for k, p in enumerate(parts) if k not in lost]), len(parts), len(lost), sorted(lost)))
            yield pd.DataFrame(out, columns=names)

    schema = f"id {kind}, text string, n_sentences long, n_removed long, removed array<int>"
    touched = gone.count()
    if touched > BROADCAST_ROWS:
        joined = rows.join(gone, "rid", "left").select("id", "text", "removed")
    else:
        names_only = F.broadcast(gone.select("rid"))  # counted
        lose = rows.join(names_only, "rid", "left_semi").join(gone, "rid").select("id", "text", "removed")
        joined = lose.unionByName(rows.join(names_only, "rid", "left_anti").select("id", "text", F.lit(None).cast("array<int>").alias("removed")))
    return joined.mapInPandas(rebuild, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
