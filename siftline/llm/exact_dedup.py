"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import fresh, numbered, small_side, written

#: Characters that don't count: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Fingerprints that one block of a merged filter should hold at most, about; decoded they take 16 bytes each.
BLOCK_ROWS = 1 << 20
#: Fingerprints that a partition's filter of one block should hold at least, about, where partitions are that large.
FILTER_ROWS = 4096
#: 2 ** FAN_BITS partitions' filters are merged before blocks are cut again.
FAN_BITS = 8
#: Bits of a fingerprint beyond the logarithm of the rows: about one row in 2 ** SPARE_BITS goes to byte verification in vain.
SPARE_BITS = 12
#: Least bits that blocks are cut by, so that small tables are merged by several tasks too.
LEAST_BITS = 6
#: Numbers packed at once; a multiple of eight, so that every piece ends at a byte.
PIECE = 1 << 16

_HEAD = struct.Struct("<QBBQBB")


def _pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers in `width` bits each."""
    pieces = [values[k : k + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8) for k in range(0, len(values), PIECE)]
    return b"".join(np.packbits(np.unpackbits(x, axis=1)[:, 64 - width :]).tobytes() for x in pieces)


def _unpack(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    """n numbers of `width` bits that begin at a byte."""
    out = np.zeros(n, np.uint64)
    for k in range(0, n if width else 0, PIECE):
        m = min(PIECE, n - k)
        bits = np.zeros((m, 64), np.uint8)
        bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, m * width + 7 >> 3, at + k * width // 8), count=m * width).reshape(m, width)
        out[k : k + m] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints, each of `bits` bits.

    The quotient is the high part, of as many bits as keep the load under 0.9. Stored are one
    `occupied` bit a quotient, one `run end` bit a slot, the sorted remainders in the bits that
    the quotient leaves, and the counters above one with their slots, both in as many bits as the largest needs.
    """
    n = len(fingerprints)
    q = min(bits, max(3, math.ceil(math.log2(max(n, 1) / 0.9))))
    r = bits - q
    quotient = fingerprints >> np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
    remainder = fingerprints & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    many = np.flatnonzero(counts > 1)
    slot_bits, count_bits = n.bit_length(), int(counts.max(initial=0)).bit_length()
    parts = [np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), _pack(remainder, r), _pack(many, slot_bits), _pack(counts[many], count_bits)]
    return b"".join([_HEAD.pack(n, q, r, len(many), slot_bits, count_bits), *parts])


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted fingerprints, counts) of a filter, without loss."""
    n, q, r, many, slot_bits, count_bits = _HEAD.unpack_from(data)
    at = _HEAD.size
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << q) + 7 >> 3, at), count=1 << q)
    at += (1 << q) + 7 >> 3
    run_end = np.unpackbits(np.frombuffer(data, np.uint8, n + 7 >> 3, at), count=n)
    at += n + 7 >> 3
    remainder = _unpack(data, at, n, r)
    at += n * r + 7 >> 3
    slots = _unpack(data, at, many, slot_bits).astype(np.int64)
    counts = np.ones(n, np.int64)
    counts[slots] = _unpack(data, at + (many * slot_bits + 7 >> 3), many, count_bits).astype(np.int64)
    run = np.cumsum(run_end) - run_end
    return (np.flatnonzero(occupied).astype(np.uint64)[run] << np.uint64(r)) | remainder, counts


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct fingerprints with counts as one; counts of equal ones are added. Nothing is sorted again."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    keys, counts = a[0], a[1].copy()
    at = np.searchsorted(keys, b[0])
    equal = at < len(keys)
    equal[equal] = keys[at[equal]] == b[0][equal]
    counts[at[equal]] += b[1][equal]
    return np.insert(keys, at[~equal], b[0][~equal]), np.insert(counts, at[~equal], b[1][~equal])


def _merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All runs as one, in pairs of about one size, so that a fingerprint moves once a doubling."""
    while len(runs) > 1:
        runs = sorted(runs, key=lambda r: len(r[0]))
        runs = [_merged(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0] if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merge_filters(filters: list[bytes], bits: int) -> bytes:
    """One filter with the fingerprints of all, counts of equal ones added. A filter's remainders are sorted within their quotients,
    so filters are merged as sorted runs."""
    return encode_filter(*_merge_runs([decode_filter(x) for x in filters]), bits)


def _cut(part: int, block: int, run: tuple[np.ndarray, np.ndarray], bits: int, more: int) -> pd.DataFrame:
    """(part, block, filter) of a sorted run of fingerprints of `bits` bits in a block, cut into smaller blocks by their `more` high bits."""
    keys, counts = run
    low = bits - more
    sub = (keys >> np.uint64(low)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
    rest = keys & np.uint64((1 << low) - 1)
    filters = [encode_filter(rest[a:b], counts[a:b], low) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    return pd.DataFrame({"part": part, "block": (block << more) | sub[starts], "filter": filters})


_FILTERS = "part long, block long, filter binary"


def partition_filters(fingerprints: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """fingerprints(h long, of `bits` < 64 bits) -> (part, block, filter): a filter of each partition, cut into blocks by the high bits."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for x in batches:
            runs.append(np.unique(x["h"].to_numpy(np.int64).astype(np.uint64), return_counts=True))
            while len(runs) > 1 and len(runs[-2][0]) <= 2 * len(runs[-1][0]):  # runs at least halve from first to last
                runs.append(_merged(runs.pop(), runs.pop()))
        run = _merge_runs(runs)
        if len(run[0]):
            yield _cut(TaskContext.get().partitionId(), 0, run, bits, block_bits)

    return fingerprints.mapInPandas(build, _FILTERS)


def _merging(bits: int, more: int):
    """Merges a group's filters of fingerprints of `bits` bits and cuts the result by `more` bits."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _cut(int(pdf["part"].iloc[0]), int(pdf["block"].iloc[0]), _merge_runs([decode_filter(x) for x in pdf["filter"]]), bits, more)

    return merge


def merged_filters(parts: DataFrame, bits: int, block_bits: int, final_bits: int) -> DataFrame:
    """(part, block, filter) of all partitions -> (block, filter): one filter a block of `final_bits` high bits.

    Filters are merged as a tree: a level merges each block over 2 ** FAN_BITS partitions and cuts it into as many smaller
    blocks, so that filters keep their size however many blocks the table needs. A block's fingerprints are spread evenly by hash.
    """
    while block_bits < final_bits:
        more = min(FAN_BITS, final_bits - block_bits)
        grouped = parts.withColumn("part", F.shiftright("part", FAN_BITS)).groupBy("block", "part")
        parts = grouped.applyInPandas(_merging(bits - block_bits, more), _FILTERS)
        block_bits += more
    return parts.groupBy("block").applyInPandas(_merging(bits - final_bits, 0), _FILTERS).select("block", "filter")


def repeated_fingerprints(merged: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """Fingerprints with a count above one: (h, n)."""
    low_bits = bits - block_bits

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for block, data in zip(x["block"], x["filter"], strict=True):
                low, counts = decode_filter(data)
                many = counts > 1
                yield pd.DataFrame({"h": (low[many] | np.uint64(int(block) << low_bits)).astype(np.int64), "n": counts[many]})

    return merged.mapInPandas(read, "h long, n long")


def _bits(n: int, partitions: int, block_rows: int) -> tuple[int, int, int]:
    """Bits of a fingerprint, of the blocks that partitions cut their filters by, and of the merged blocks, for n rows."""
    whole = min(63, math.ceil(math.log2(max(n, 2))) + SPARE_BITS)
    final = min(whole, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / block_rows))))
    first = max(LEAST_BITS, math.floor(math.log2(max(n / max(partitions, 1) / FILTER_ROWS, 1))))
    return whole, min(first, final), final


def _rows(rows: DataFrame) -> DataFrame:
    """Written numbered rows(rid, id, text) -> (rid, id, text, norm, h)."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("norm", F.regexp_replace("text", WHITE, "")).withColumn("h", F.xxhash64("norm"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs: (rid, <id_col>, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are after white space is deleted. The row with the most
    code points in its original text stays, then the smallest id (null last), then the
    first row of the scan. Null text counts as empty; empty texts equal each other.
    Other columns are ignored whatever their names; an empty table gives no rows.

    Texts are fingerprinted where they lie; partitions send quotient filters, not
    rows; a fingerprint has only SPARE_BITS bits more than rows need, which a filter
    stores in about two bytes. Only rows whose fingerprint is counted more than once are compared, byte by
    byte, as a grouping by the text itself, of which every task first makes one row
    a distinct text. The numbered rows are written once and only they are read.
    """
    return _groups(numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), id_col, block_rows)


def _groups(rows: DataFrame, id_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """exact_groups of written rows(rid, id, text)."""
    rows = _rows(rows)
    seen = written(rows.select("rid", "id", "h", F.sha2("norm", 256).alias("sha")), "digests")
    n = seen.count()
    bits, first, final = _bits(n, seen.rdd.getNumPartitions(), block_rows)
    short = F.shiftrightunsigned("h", 64 - bits)
    merged = merged_filters(partition_filters(seen.select(short.alias("h")), bits, first), bits, first, final)
    many = written(repeated_fingerprints(merged, bits, final).select(F.col("h").alias("short")), "repeated")
    rank = F.struct((-F.char_length("text")).alias("n"), F.col("id").isNull().alias("none"), "id", "rid")
    groups = (
        rows.withColumn("short", short)
        .join(small_side(many), "short", "left_semi")
        .select("h", "norm", rank.alias("rank"))
        .groupBy("h", "norm")
        .agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("size"))
        .select("h", F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("best_id"), F.col("best.rid").alias("best_rid"), "size")
    )
    alone = F.col("size").isNull()
    return seen.join(groups, ["h", "sha"], "left").select(
        "rid",
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("best_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; all columns stay as they are."""
    (rid,) = fresh(docs, "_rid")
    rows = numbered(docs, rid)
    groups = _groups(rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col)
    gone = written(groups.where("not kept").select(F.col("rid").alias(rid)), "copies")
    return rows.join(small_side(gone), rid, "left_anti").select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("rid").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size FROM d GROUP BY norm),
k AS (SELECT norm, doc_id AS keep_id FROM (SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS rn FROM d) WHERE rn = 1)
SELECT d.doc_id, k.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm JOIN k ON d.norm = k.norm
"""
