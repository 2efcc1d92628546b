"""Token counts by a separator scan of flat token files that have no index."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import new_path, written

#: Ranks of a public byte-level vocabulary of 50,256 ids; the next id is free and ends a document.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
# Fixed value: how the public vocabulary cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bytes of a token file's block that is searched at once, and of a file after which the writer begins another.
BLOCK = 4 << 20
SHARD = 32 << 20
#: White space that the pattern's \\s stands for, and the length of a run of it from which the run is cut out before the pattern is searched.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1024


@lru_cache(maxsize=2)
def _tokenizer(ranks: str, pattern: str) -> tiktoken.Encoding:
    lines = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def encode_whole(encoding: tiktoken.Encoding, text: str, pattern: str = PATTERN, long_run: int = LONG_RUN) -> np.ndarray:
    """Ids of a whole text. The library's search of the pattern goes back once for each character of a run of white space before another
    character, and fails on a million of them, so with the fixed pattern long runs are cut as it cuts them: a word ends before a run; of n > 1
    characters of white space before another character the first n - 1 are a word; the last one begins the next word."""
    if pattern != PATTERN:
        return encoding.encode_to_numpy(text)
    parts, at = [], 0
    for run in re.finditer(f"[{WHITE}]{{{max(2, long_run)},}}", text):
        if run.end() < len(text):  # a run that ends the text is one word, found without going back
            parts += [encoding.encode_to_numpy(text[at : run.start()]), encoding.encode_to_numpy(text[run.start() : run.end() - 1])]
            at = run.end() - 1
    parts.append(encoding.encode_to_numpy(text[at:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_token_files(docs: DataFrame, folder: str, ranks: str = RANKS, pattern: str = PATTERN, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files of 16-bit tokens, each document followed by `end`; returns (<id_col>, file, ordinal) of the documents.

    Each text is encoded whole, however long. Each task writes shards of about SHARD bytes to `folder`, in any file system that pyarrow knows. A shard is written under
    another name and renamed when it is whole, so a task that runs again replaces it. Null and empty texts have no tokens.
    """
    with open(ranks, encoding="ascii") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # of the size of the vocabulary
    kind = dict(docs.dtypes)[id_col]
    where, base_path = pafs.FileSystem.from_uri(folder)
    where.create_dir(base_path, recursive=True)  # an empty table leaves an empty folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _tokenizer(shared.value, pattern)  # used without special tokens
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        shard, parts, held, ids = 0, [], 0, []

        def flush():
            name = f"{task.partitionId():06d}-{shard:06d}.bin"
            draft = f"{base}/_draft-{task.taskAttemptId()}-{name}"
            with fs.open_output_stream(draft) as out:
                for p in parts:
                    out.write(p.tobytes())
            fs.move(draft, f"{base}/{name}")
            column = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([column, pa.array([name] * len(column), pa.string()), pa.array(np.arange(len(column)))], ["id", "file", "ordinal"])

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1)):
                parts.append(np.append(encode_whole(encoding, text.as_py() or "", pattern), np.uint32(end)).astype("<u2"))
                held += parts[-1].nbytes
                if held >= SHARD:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    yield flush()
                    shard, parts, held, ids, start = shard + 1, [], 0, [], i + 1
            ids.append(batch.column(0).slice(start))
        if parts:
            yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, file string, ordinal long").withColumnRenamed("id", id_col)


def scan_token_files(spark: SparkSession, folder: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document of flat token files without an index.

    Tokens are little-endian numbers of `width` bytes (1, 2, 4 or 8), a document ends with the token `end`. Files are only listed;
    each of their blocks of `block` bytes is a row, is read where that row is, and is searched for separators on its own, so a
    large file is read by many tasks. A prefix scan over the blocks' separator counts and last
    positions then says which document of its file a block begins in and where that one began. Tokens after the last
    separator of a file are a document too; an empty file has none. A file must hold whole tokens.
    """
    block -= block % width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block)))).repartition("file", "block")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, length, number in zip(b["file"], b["length"], b["block"], strict=True):
                if length % width:
                    raise ValueError(f"{name} doesn't hold whole tokens of {width} bytes")
                with fs.open_input_file(f"{base}/{name}") as file:
                    data = file.read_at(min(block, length - number * block), number * block)
                hits = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end) + number * (block // width)
                yield pd.DataFrame({"file": [name], "tokens": [length // width], "block": [number], "n": [len(hits)], "last": [int(hits[-1]) if len(hits) else None], "hits": [hits.astype(np.int64)]}).astype({"last": "Int64"})

    found = written(blocks.mapInPandas(find, "file string, tokens long, block long, n long, last long, hits array<long>"), "separators")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select(
        "file", "block", "tokens",
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("seen"),
        (F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")) + 1).alias("open"),
        F.coalesce(F.lead("block").over(order).isNull(), F.lit(False)).alias("closing"),
    )
    # A block's documents: those that its separators end, and in the closing block what follows the file's last separator.
    joined = found.select("file", "block", "hits").join(scan, ["file", "block"])
    ends = F.when(F.col("closing") & (F.coalesce(F.try_element_at("hits", F.lit(-1)), F.col("open") - 1) < F.col("tokens") - 1), F.concat("hits", F.array("tokens"))).otherwise(F.col("hits"))
    begins = F.concat(F.array("open"), F.transform("hits", lambda x: x + 1))
    pairs = joined.withColumn("ends", ends).withColumn("begins", begins).select("file", "seen", F.posexplode(F.arrays_zip("ends", F.slice("begins", 1, F.size("ends")).alias("begins"))).alias("k", "d"))
    return pairs.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), F.col("d.begins").alias("start"), (F.col("d.ends") - F.col("d.begins")).alias("n_tokens"))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in token files that are written from `documents`; and where it stands in them."""
    folder = new_path(spark, "tokens")
    listed = written(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "token_list")
    return listed.join(scan_token_files(spark, folder), ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal", "start")
