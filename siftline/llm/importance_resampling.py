"""Target-distribution importance resampling: hashed n-gram features from running CRCs, weights by two corpora's buckets, a keyed draw."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import written
from siftline.operators.reports import placed

SIZES, BUCKETS, SEED, SHARE, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: The reversed generator polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words whose CRCs are held at once, and bytes of a text whose words are.
HELD, CHUNK = 1 << 19, 4 << 20
SPACE = 0x20

#: Bytes of words: digits, letters (A-Z lower-cased) and everything past ASCII; all others separate.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or chr(b).islower() else SPACE for b in range(256))
_GAP = re.compile(b" ")


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """What one byte does to a CRC of zero, for each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


@lru_cache(maxsize=64)
def _shift_tables(k: int) -> np.ndarray:
    """4 x 256 words: the contribution of each of a CRC's four bytes after 2^k zero bytes. Such shifts are linear over GF(2), and the one of 2^k
    bytes is the one of 2^(k-1) bytes done twice."""
    values = np.arange(256, dtype=np.uint32)
    each = np.stack([values << np.uint32(8 * p) for p in range(4)])
    if k == 0:
        return _byte_table()[each & 255] ^ (each >> np.uint32(8))
    return _looked_up(_looked_up(each, k - 1), k - 1)


def _looked_up(crc: np.ndarray, k: int) -> np.ndarray:
    t = _shift_tables(k)
    return t[0][crc & 255] ^ t[1][(crc >> np.uint32(8)) & 255] ^ t[2][(crc >> np.uint32(16)) & 255] ^ t[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC carried over as many bytes as its entry of n_bytes says."""
    out, k, longest = crc.astype(np.uint32), 0, int(n_bytes.max(initial=0))
    while longest >> k:
        here = np.flatnonzero((n_bytes >> k) & 1)
        out[here] = _looked_up(out[here], k)
        k += 1
    return out


def _after_space(crc: np.ndarray) -> np.ndarray:
    c = ~crc.astype(np.uint32)
    return ~(_byte_table()[(c ^ np.uint32(SPACE)) & 255] ^ (c >> np.uint32(8)))


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about CHUNK bytes at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)
    at = 0
    while len(data) - at > CHUNK:
        gap = _GAP.search(data, at + CHUNK)
        if not gap:
            break
        yield data[at : gap.start()].split()
        at = gap.end()
    yield data[at:].split()


class _Runs:
    """CRCs of all runs of 1 to `sizes` words of many texts, HELD words at a time.

    Of each text, its words joined by one space, the running CRC is known after each word; a word begins one space later than the word
    before it ends. The CRC of a run is the running one at its end xor that at its start, shifted by the run's bytes.
    """

    def __init__(self, sizes: int):
        self.sizes, self.carried, self.found = sizes, None, []
        self._clear()

    def _clear(self) -> None:
        self.ends, self.lengths, self.owners, self.counts = [], [], [], []

    def add(self, doc: int, text: str | None) -> int:
        """The number of words of text `doc`; texts come in order of their numbers."""
        crc, n, checksum = 0, 0, zlib.crc32
        for words in _words(text):
            for w in words:
                crc = checksum(w, checksum(b" ", crc)) if n else checksum(w)
                n += 1
                self.ends.append(crc)
            self.lengths += map(len, words)
            self.owners.append(doc)
            self.counts.append(len(words))
            if len(self.ends) >= HELD:
                self.flush()
        return n

    def flush(self) -> None:
        ends, lengths = np.array(self.ends, np.uint32), np.array(self.lengths, np.int64)
        owner = np.repeat(np.array(self.owners, np.int64), np.array(self.counts, np.int64))
        first = 0
        if self.carried is not None:
            first = len(self.carried[0])
            ends, lengths, owner = (np.concatenate([a, b]) for a, b in zip(self.carried, (ends, lengths, owner), strict=True))
        self._clear()
        if not len(ends):
            return
        starts = np.zeros_like(ends)  # a text's first word begins at CRC 0, no bytes before it
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        starts[inner] = _after_space(ends[inner - 1])
        total = np.cumsum(lengths + 1)
        for size in range(1, self.sizes + 1):
            last = np.arange(max(first, size - 1), len(ends))
            last = last[owner[last] == owner[last - size + 1]]
            begin = last - size + 1
            n_bytes = total[last] - total[begin] + lengths[begin]
            self.found.append((owner[last], ends[last] ^ shifted(starts[begin], n_bytes)))
        keep = self.sizes  # one more than a run's earlier words, so that the first of them knows where it begins
        self.carried = (ends[-keep:], lengths[-keep:], owner[-keep:])

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, crc) of all runs so far, in order of their texts."""
        self.flush()
        owner, crc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.found, self.carried = [], None
        order = np.argsort(owner, kind="stable")
        return owner[order], crc[order]


def run_crcs(text: str | None, sizes: int = SIZES) -> np.ndarray:
    """Unsigned CRC-32 of every run of 1 to `sizes` words of a text."""
    runs = _Runs(sizes)
    runs.add(0, text)
    return runs.taken()[1]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: int = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """(rid long, id, n_words long, n_features long, buckets binary) of every row: the bucket of each run as a 16-bit number. Each text is read once."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    kind = dict(docs.dtypes)[id_col]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, words, runs = 0, [], _Runs(sizes)
            for k, text in enumerate(batch.column(2)):
                words.append(runs.add(len(words), text.as_py()))
                if sum(words) >= HELD or k == batch.num_rows - 1:
                    owner, crc = runs.taken()
                    data = (crc % np.uint32(buckets)).astype("<u2").tobytes()
                    n = np.bincount(owner, minlength=len(words))
                    cuts = np.append(0, 2 * np.cumsum(n)).tolist()
                    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
                    done = batch.slice(begin, len(words))
                    yield pa.RecordBatch.from_arrays([done.column(0), done.column(1), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], ["rid", "id", "n_words", "n_features", "buckets"])
                    begin, words, runs = k + 1, [], _Runs(sizes)

    x = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return x.mapInArrow(build, f"rid long, id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """features() -> (bucket int, n long) of the buckets that occur; a task adds up its rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return found.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths of the smoothed log ratio of target to corpus; both given as bucket_counts(), at most a row a bucket."""
    s, t = (dict(map(tuple, x.collect())) for x in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weighted(found: DataFrame, gain: list[int]) -> DataFrame:
    """features() -> (rid, id, n_words, n_features, weight long): the sum of the gains of a row's features."""
    by_bucket = np.array(gain, np.int64)
    kinds = dict(found.dtypes)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(by_bucket[np.frombuffer(x.as_py(), "<u2")].sum()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["rid", "id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, f"rid long, id {kinds['id']}, n_words long, n_features long, weight long")


def keyed_noise(id: Column, seed: int = SEED) -> Column:
    """A whole number of thousandths from Gumbel's distribution, by the hash of the seed and the id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", sizes: int = SIZES, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's (<id_col>, n_features, weight, score, rank), all long but the id: the `share` percent (rounded down) of rows with at least
    `least_words` words that have the highest scores are drawn, with ranks from 1; the others' rank is null.

    A text's words are runs of digits, letters and characters past ASCII, A-Z lower-cased; its features are all runs of 1 to `sizes` words
    joined by a space, hashed to CRC-32 modulo `buckets`. A score is the sum of its features' gains and a keyed draw, so repeated draws
    without replacement follow the weights. Null, empty and wordless texts have no features and weight 0. Of equal scores the
    smaller id comes first (null last), of equal ids the fewer features, then the scan's order, so repeated rows each have a
    place. Empty tables give no rows, an empty target zero counts. Other columns are ignored whatever their names.

    Each text is read once; its buckets are written. Counts are added up in tasks, and only a gain a bucket goes through the driver. Ranks
    come from sorted ranges.
    """
    found = written(features(docs, id_col, text_col, sizes, buckets), "features")
    aim = features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", sizes, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    scored = weighted(found, gain).withColumn("score", F.col("weight") + keyed_noise(F.col("id"), seed))
    scored = written(scored, "scored")
    drawn = scored.where(F.col("n_words") >= least_words).count() * share // 100
    ordered = placed(scored.where(F.col("n_words") >= least_words), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("rid"))
    ranked = ordered.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH step AS (SELECT list(v ORDER BY k) AS tbl FROM (SELECT k, list_reduce([k::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(k))),
words AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
used AS (SELECT side, id, unnest(w) AS word FROM words),
crc AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || [('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(octet_length(encode(word)))],
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM used), step),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used JOIN crc USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM n),
weight AS (SELECT id AS doc_id, sum(g) AS weight FROM used JOIN crc USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
d AS (SELECT id AS doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weight ON id = doc_id WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND rn <= 10 * n // 100 THEN rn::BIGINT END AS rank FROM r
"""
