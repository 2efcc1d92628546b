"""A BM25 index that is kept as tables: built once, extended by parts, merged now and then, and searched without reading texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline import fixed
from siftline.operators.retrieval import DOCS_A_TASK, ranked, tokens
from siftline.tables import dealt, small_side, written

#: Folders by a term's hash, of which a search reads those of its terms; and the least number of files in each, so that a term of every document fills
#: no single task.
SHARDS, SPREAD = 32, 4
#: Words of texts that a task counts and sorts into one file: a larger part has more files, not larger ones.
WORDS_A_FILE = 500_000
#: Words of documents, or postings, that a task holds at once to count them or to pack them by term.
WORDS_HELD = 1 << 20
#: What two sums of the same parts in other orders may differ by, and the rounding of ranks.
SLACK = 1e-7


def _spread(words: int) -> int:
    """Files of each shard for so many words."""
    return max(SPREAD, -(-words // (SHARDS * WORDS_A_FILE)))


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _held(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a list column has about WORDS_HELD values in each."""
    for b in batches:
        ends = np.cumsum(b.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_HELD, side="right")))
            yield b.slice(at, to - at)
            at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t) -> (id, len, terms, tf): each document's distinct words and how often it has them."""
    for b in _held(batches, "t"):
        size = b.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = b.column("t").flatten().dictionary_encode()
        many = max(1, len(words.dictionary))
        keys, tf = np.unique(np.repeat(np.arange(b.num_rows), size) * many + words.indices.to_numpy(), return_counts=True)
        cuts = np.searchsorted(keys // many, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int32()), _lists(words.dictionary.take(pa.array(keys % many)), cuts), _lists(pa.array(tf, pa.int32()), cuts)], ["id", "len", "terms", "tf"])


def _by_term(terms: pa.Array, ids: pa.Array, tf: pa.Array, size: pa.Array) -> pa.RecordBatch:
    """A row for each term, with lists of what its postings hold."""
    terms = terms.dictionary_encode()
    codes = terms.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(terms.dictionary) + 1))
    return pa.RecordBatch.from_arrays([terms.dictionary, *[_lists(x.take(pa.array(order)), cuts) for x in (ids, tf, size)]], ["term", "ids", "tfs", "lens"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, len, terms, tf) of documents -> (term, ids, tfs, lens)."""
    for b in _held(batches, "terms"):
        own = pa.array(np.repeat(np.arange(b.num_rows), b.column("terms").value_lengths().to_numpy(zero_copy_only=False)))
        if len(own):
            yield _by_term(b.column("terms").flatten(), b.column("id").take(own), b.column("tf").flatten(), b.column("len").take(own))


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (term, id, tf, len) -> (term, ids, tfs, lens)."""
    for b in batches:
        if b.num_rows:
            yield _by_term(*[b.column(k) for k in ("term", "id", "tf", "len")])


def _postings(rows: DataFrame) -> DataFrame:
    """Packed rows as a row for each posting: (id, tf, len) and the other columns."""
    each = rows.withColumn("p", F.explode(F.arrays_zip("ids", "tfs", "lens"))).drop("ids", "tfs", "lens")
    return each.withColumns({"id": F.col("p.ids"), "tf": F.col("p.tfs"), "len": F.col("p.lens")}).drop("p")


class KeywordIndex:
    """An index of (id, text) in a folder that driver and executors share. One writer at a time.

    Parts follow each other. A part holds its documents (id, len, distinct terms, their counts), their postings in folders by the term's hash
    and sorted by term, a row for a term and some documents (term, ids, tfs, lens), and what it changes in sums: documents, words, and documents by term, negative for those that it replaces. Sums
    of all parts are the corpus's statistics, so a part reads the texts of its own documents only. Rows of an earlier part that a later
    one replaces are listed with it. A part counts once its last table is written whole, and a number that is there already is passed over, so a repeated
    part changes nothing. `merge` writes all parts as one; the parts before stay until the next merge, for readers under way.

    Ids are distinct within a part and not null; rows of null ids are left out. A null text has no words. An empty index finds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._schemas = {
            "documents": f"id {id_type}, len int, terms array<string>, tf array<int>, part int", "postings": f"term string, ids array<{id_type}>, tfs array<int>, lens array<int>, part int, shard int",
            "gone": f"id {id_type}, until int, part int", "terms": "term string, df bigint, most bigint, shortest int, part int", "size": "n bigint, total bigint, part int",
        }
        self._pack = f"term string, ids array<{id_type}>, tfs array<int>, lens array<int>"

    def _names(self, folder: str, prefix: str) -> list[int]:
        at = self._hadoop(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _folder(self, generation: int, table: str) -> str:
        return f"{self.path}/generation-{generation}/{table}"

    def _parts(self, generation: int) -> list[int]:
        sizes = self._folder(generation, "size")
        return [n for n in self._names(sizes, "part=") if self._fs.exists(self._hadoop(f"{sizes}/part={n}/_SUCCESS"))]

    def generation(self) -> int:
        """The latest generation that has a whole part; 0 for an empty index."""
        return next((g for g in reversed(self._names(self.path, "generation-")) if self._parts(g)), 0)

    def parts(self) -> list[int]:
        """Numbers of the live parts."""
        return self._parts(self.generation())

    def _read(self, table: str, generation: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table of the live parts, or of the parts named, with each row's part."""
        g = self.generation() if generation is None else generation
        parts = self._parts(g) if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self._schemas[table])
        return self.spark.read.schema(self._schemas[table]).parquet(self._folder(g, table)).where(F.col("part").isin(parts))

    def _save(self, rows: DataFrame, generation: int, number: int, table: str, *by: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self._folder(generation, table)}/part={number}")

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows(id, part) that no later part has replaced."""
        if len(self.parts()) < 2:
            return rows
        gone = self._read("gone").groupBy("id").agg(F.max("until").alias("until"))
        n = gone.count()
        return rows.join(small_side(gone, n), "id", "left").where("until IS NULL OR part >= until").drop("until") if n else rows

    def add(self, changes: DataFrame, number: int, removed: DataFrame | None = None) -> None:
        """Put changes(id, text) in, in place of earlier rows of their ids, and take the ids of removed(id) out, as part `number`."""
        if number in (known := self.parts()):
            return
        if known and number < max(known):
            raise ValueError(f"part {number} comes before part {max(known)}")
        g = self.generation()
        words = changes.where("id IS NOT NULL").select(F.col("id").cast(self.id_type).alias("id"), tokens(F.col("text")).alias("t"))
        self._save(words.mapInArrow(_counted, f"id {self.id_type}, len int, terms array<string>, tf array<int>"), g, number, "documents")  # doesn't count before the part is whole
        words = self._read("documents", g, [number]).drop("part")
        ids = words.select("id") if removed is None else words.select("id").unionByName(removed.where("id IS NOT NULL").select("id")).distinct()
        old = None
        if known:
            old = written(self._live(self._read("documents").join(small_side(ids), "id", "left_semi")).drop("part", "tf"), "replaced")
        self._write(g, number, words, old)

    def _save_postings(self, packed: DataFrame, words: int, generation: int, number: int) -> None:
        """Packed rows dealt over files by their term's shard, those of a term by their first document, and sorted by term."""
        spread = _spread(words)
        shard, salt = F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(spread)).cast("int")
        rows = packed.withColumn("shard", shard).repartition(SHARDS * spread, "shard", salt)
        self._save(rows.sortWithinPartitions("shard", "term"), generation, number, "postings", "shard")

    def _write(self, generation: int, number: int, words: DataFrame, old: DataFrame | None) -> None:
        save = partial(self._save, generation=generation, number=number)
        total = words.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        self._save_postings(words.mapInArrow(_packed, self._pack), total, generation, number)
        df = self._bounds(generation, number)
        size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total"))
        if old is None:
            gone = words.select("id").limit(0)
        else:
            less = old.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            df = df.unionByName(less, allowMissingColumns=True).groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
            size = size.unionByName(old.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).cast("long").alias("total")))
            gone = old.select("id")
        save(gone.withColumn("until", F.lit(number)), table="gone")
        save(df, table="terms")
        save(size.agg(F.sum("n").alias("n"), F.sum("total").alias("total")), table="size")  # last: the part counts from here

    def _bounds(self, generation: int, number: int) -> DataFrame:
        found = self._read("postings", generation, [number]).groupBy("term")
        return found.agg(F.sum(F.size("ids")).alias("df"), F.max(F.array_max("tfs").cast("bigint")).alias("most"), F.min(F.array_min("lens")).alias("shortest"))

    def merge(self) -> None:
        """Write the live rows of all parts as the one part of a new generation, whose number is that of the last part."""
        generation, known = self.generation(), self.parts()
        if len(known) < 2:
            return
        to, number = generation + 1, known[-1]
        self._save(self._live(self._read("documents")).drop("part"), to, number, "documents")
        total = self._read("size").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        live = self._live(_postings(self._read("postings"))).select("term", "id", "tf", "len")
        self._save_postings(live.mapInArrow(_repacked, self._pack), total, to, number)
        self._save(self._bounds(to, number), to, number, "terms")
        self._save(self._read("gone").limit(0).drop("part"), to, number, "gone")
        self._save(self._read("size").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), to, number, "size")
        for g in self._names(self.path, "generation-"):
            if g < generation:
                self._fs.delete(self._hadoop(f"{self.path}/generation-{g}"), True)

    def terms(self) -> DataFrame:
        """(term, df, most, shortest): documents that have a term, and bounds of its counts and of their lengths."""
        found = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        return found.where("df > 0")

    def size(self) -> tuple[int, float]:
        """Documents and their mean length in words."""
        n, total = self._read("size").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        return n, (total / n if n else 0.0)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """queries(q, text) -> (q, rank, id, score) as `retrieval.bm25_topk` gives them.

        A term's most is bounded by its largest count in the shortest document. A query's strongest terms, of half its bounds at least, are
        added up first; the k-th best sum is a floor. Terms whose bounds together don't reach the floor can lift no document that lacks all others, so their
        postings, those of frequent words, only meet documents that the others found and that can still reach the floor.
        """
        n, mean_len = self.size()
        asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
        k1, b, mean_len = fixed.BM25_K1, fixed.BM25_B, mean_len or 1.0
        part = lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_len))
        raw = self.terms().withColumn("raw", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        idf = F.when(F.col("raw") < 0, fixed.BM25_EPSILON * mean).otherwise(F.col("raw"))
        weights = raw.join(small_side(asked), "term").select("q", "term", (F.col("times") * idf).alias("w"), part(F.col("most"), F.col("shortest")).alias("top"))
        weights = written(weights.select("q", "term", "w", (F.col("w") * F.col("top")).alias("bound")), "query_terms")
        strong = Window.partitionBy("q").orderBy(F.desc("bound"), "term")
        weak = Window.partitionBy("q").orderBy("bound", F.desc("term"))
        every = Window.partitionBy("q")
        # negative weights bound nothing: such a query has strong terms only
        plan = weights.withColumn("first", F.coalesce(F.sum("bound").over(strong.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * 2 < F.sum("bound").over(every)).withColumn("below", F.sum("bound").over(weak.rowsBetween(Window.unboundedPreceding, 0))).withColumn("signed", F.min("w").over(every) < 0)
        plan = written(plan.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int")), "term_plan")
        numbers = written(plan.select("shard", "term").distinct().withColumn("k", F.monotonically_increasing_id()), "term_numbers")
        plan = written(plan.join(small_side(numbers), ["shard", "term"]), "numbered_plan")
        q_type = dict(queries.dtypes)["q"]

        def sums(terms: DataFrame, before: DataFrame | None = None, only: bool = False) -> DataFrame:
            """(q, id, s): what documents get for terms, and had before; with only, of those that had some. A posting is dealt by its document
            once, whatever number of queries ask for its term, and meets them there."""
            met = postings.join(small_side(terms.select("shard", "term", "k").distinct()), ["shard", "term"])
            sent = self._live(_postings(met)).select("id", "k", "tf", "len", F.lit(None).cast(q_type).alias("q"), F.lit(None).cast("double").alias("s"))
            if before is not None:
                sent = sent.unionByName(before.select("q", "id", "s"), allowMissingColumns=True)
            asked = small_side(terms.select("k", F.col("q").alias("for"), "w"))
            each = dealt(sent, n, DOCS_A_TASK, "id").join(asked, "k", "left").select(F.coalesce("q", "for").alias("q"), "id", F.coalesce("s", F.col("w") * part(F.col("tf"), F.col("len"))).alias("s"), F.col("k").isNull().alias("had"))
            added = each.groupBy("q", "id").agg(F.sum("s").alias("s"), F.max("had").alias("had"))
            return (added.where("had") if only else added).drop("had")

        postings = self._read("postings")
        start = written(sums(plan.where("first OR signed")), "strong_sums")
        kth = Window.partitionBy("q").orderBy(F.desc("s"))
        floors = start.withColumn("rn", F.row_number().over(kth)).where(F.col("rn") == k).select("q", (F.col("s") - SLACK).alias("floor"))
        floors = small_side(written(floors, "floors"))
        later = plan.where("NOT first AND NOT signed").join(floors, "q", "left").withColumn("weak", F.coalesce(F.col("below") < F.col("floor"), F.lit(False)))
        later = written(later, "later_terms")
        found = sums(later.where("NOT weak"), start)
        rest = later.where("weak").groupBy("q").agg(F.max("below").alias("rest"))
        can = F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("floor", F.lit(float("-inf")))
        found = written(found.join(floors, "q", "left").join(small_side(rest), "q", "left").where(can).select("q", "id", "s"), "candidates")
        return ranked(sums(later.where("weak"), found, only=True).withColumnRenamed("s", "score").where("score > 0"), k)
