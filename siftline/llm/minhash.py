"""Document fingerprints by MinHash: least values of many universal hash permutations over word shingles; near copies by bands, verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import simhash
from siftline.llm.common import components, numbered, small_side, written

#: Words of a shingle, permutations, bands of four permutations each, and the seed of both hashes.
SHINGLE, PERMUTATIONS, BANDS, SEED = 5, 128, 32, 12
#: Bytes of texts and of results that a task holds at once, beside a text itself.
HELD = 4 << 20
#: Shingles whose permuted values are held at once.
STEP = 1024


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of n permutations x -> a x + b of the 64-bit numbers; a is odd, so none has collisions."""
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


_A, _B = permutations()


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the hashes; the largest number where there are none."""
    least = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), STEP):
        x = hashes[at : at + STEP, None] * _A
        x += _B
        np.minimum(least, x.min(0), out=least)
    return least


def signature(text: str | None) -> np.ndarray:
    """16 bits of the least value of each permutation over the text's five-word shingles (words: runs of other characters than ASCII white
    space, A-Z lower-cased; fewer words: the whole sequence; none: all bits set). The bits are low ones, as the high ones of a least value are mostly zero."""
    return (least_values(simhash.shingle_hashes(text, SHINGLE, SEED)) >> np.uint64(16)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal values of two signatures: an unbiased estimate of the Jaccard similarity of their shingle sets, up to 1 in 65,536."""
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by as many of the first of `after`, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class _Rows:
    """Rows of results, handed out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.size += 1024 + sum(len(row.get(c) or "") for c in ("first_text", "last_text"))

    def full(self, least: int = HELD) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.size = [], 0


def _compared(text: str, mine: np.ndarray, after: str, its: np.ndarray) -> dict:
    """What is said of a text and the one behind it."""
    new = edited(text, after)
    print_of_new = signature(new)
    return {
        "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": mine.tobytes(), "edited_fingerprint": print_of_new.tobytes(),
        "near_edited": likeness(mine, print_of_new), "near_next": likeness(mine, its),
    }


RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SEAM = [("part", pa.int64()), ("first_text", pa.string()), ("first_print", pa.binary()), ("last_text", pa.string()), ("last_print", pa.binary())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The fingerprints are 512 lowercase hex digits, four a permutation. A text's edited text has its last half (rounded down, in code
    points) replaced by the beginning of the next document's, by descending id; after the last comes the first, so a single row follows
    itself. Null ids come last; rows of one id are in order of a hash of their text, equal rows are the same in any order. Null text
    counts as empty; texts without words have a fingerprint of their own. An empty table gives no rows; other columns are ignored
    whatever their names.

    Texts are sorted in ranges, one shuffle, and a text is held against the next in the stream of its range. A range's last text meets the
    first of the next range in a join of two rows a range. The third part of the order spreads a hot id, or a hot row, over ranges.
    """
    kind = dict(docs.dtypes)[id_col]
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    x = x.select("*", order[1].alias("_h"), order[2].alias("_at"))
    order = [F.col("id").desc_nulls_last(), F.col("_h"), F.col("_at")]
    ranges = x.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, first, last, id_type = TaskContext.get().partitionId(), None, None, None, pa.null()
        for batch in batches:
            if out is None:
                id_type = batch.schema.field(0).type
                out = _Rows(pa.schema([("id", id_type), *_RESULT, *_SEAM]))
            for at in range(batch.num_rows):
                id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                mine = signature(text)
                if last is None:
                    first = (text, mine)
                else:
                    out.add({"id": last[0]} | _compared(last[1], last[2], text, mine))
                    yield from out.full()
                last = (id, text, mine)
        if last is not None:
            out.add({"id": last[0], "part": part, "first_text": first[0], "first_print": first[1].tobytes(), "last_text": last[1], "last_print": last[2].tobytes()})
            yield from out.full(0)

    seam = "part long, first_text string, first_print binary, last_text string, last_print binary"
    done = written(ranges.mapInArrow(stream, f"id {kind}, {RESULT}, {seam}"), "fingerprints")
    seams = done.where("part IS NOT NULL")
    numbers = seams.select("part")  # a row a range
    behind = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("behind"))
    ends = seams.select("part", "id", "last_text", "last_print").join(behind, "part").join(seams.select(F.col("part").alias("behind"), "first_text", "first_print"), "behind").select("id", "last_text", "last_print", "first_text", "first_print")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(pa.schema([("id", batch.schema.field(0).type), *_RESULT]))
            for row in batch.to_pylist():
                mine, its = (np.frombuffer(row[c], "<u2") for c in ("last_print", "first_print"))
                out.add({"id": row["id"]} | _compared(row["last_text"], mine, row["first_text"], its))
            yield from out.full(0)

    both = done.where("part IS NULL").drop("part", "first_text", "first_print", "last_text", "last_print").unionByName(ends.mapInArrow(joined, f"id {kind}, {RESULT}"))
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", text_of("fingerprint"), text_of("edited_fingerprint"), "near_edited", "near_next")


def _banded(rows: DataFrame) -> DataFrame:
    """rows(rid, text) -> (rid, n, fp, keys): the number of distinct shingles, a hash of all least values, and one of each band's."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column(1):
                hashes = np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE, simhash.SEED))
                least = least_values(hashes)
                sizes.append(len(hashes))
                prints.append(xxhash.xxh64_intdigest(least.tobytes()))
                keys.append([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, -1))] if len(hashes) else [0])
            flat = pa.array(np.array([k for x in keys for k in x], np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in keys])), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["rid", "n", "fp", "keys"])

    return rows.mapInArrow(build, "rid long, n long, fp long, keys array<long>")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, class_id) of every row: the smallest id (nulls are passed over) of those that links connect it with, itself included.

    Texts link when their sets of five-word shingles have a Jaccard similarity of at least 0.8. Candidates share one of 32 bands of four
    least values (a pair at 0.8 shares none with a probability of 5 in 100 million) and are verified exactly. Null and wordless
    texts are alike. Repeated rows each get a row; an empty table gives none; other columns are ignored whatever their names.
    """
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    texts = rows.select("rid", "text")
    found = written(components(simhash.banded_links(texts, written(_banded(texts), "banded"))), "components")
    named = rows.select("rid", "id").join(small_side(found), F.col("rid") == F.col("node"), "left").select("rid", "id", "root")
    named = written(named, "named")
    least = small_side(written(named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")), "classes"))
    return named.join(least, "root", "left").select(F.col("id").alias(id_col), F.coalesce("least", "id").alias("class_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
