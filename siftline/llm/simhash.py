"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import components, fresh, numbered, small_side, written

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one bucket that are compared with each other; larger buckets are covered anew.
BUCKET = 256
#: Near copies of drop_near_copies: words of a shingle, bands, and least shingles of a band; rows of a bucket that a task compares.
SET_SHINGLE, BANDS, MINS = 5, 24, 4
PART_ROWS = 512

#: Bytes of a text whose words are held at once.
CHUNK = 4 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about CHUNK bytes at a time."""
    at = 0
    while len(data) - at > CHUNK:
        gap = _GAP.search(data, at + CHUNK)
        if not gap:
            break
        yield data[at : gap.start()].split()
        at = gap.end()
    yield data[at:].split() if at else data.split()


def _runs(words: list[bytes], size: int, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-size]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `size` words; of the whole word sequence if it is shorter; none without words.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    """
    carried: list[bytes] = []
    found = []
    for words in _word_lists((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = carried + words
        if len(words) >= size:
            found.append(_runs(words, size, seed))
            words = words[1 - size :] if size > 1 else []
        carried = words
    if not found:
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)] if carried else [], np.uint64)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the word whose bits are those set in over half of it (0 for none).

    Bits are counted eight at a time in the byte lanes of a word, over runs of at most 255 hashes.
    """
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, n = np.concatenate([hashes[i] for i in full]), sizes[full]
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + 255 * within
    got = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            got |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = got
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits. Null and wordless texts get 0."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            found, part, held = [], [], 0
            for text in texts:
                part.append(shingle_hashes(text.as_py()))
                held += len(part[-1])
                if held > 1_000_000:
                    found.append(majority_bits(part))
                    part, held = [], 0
            found.append(majority_bits(part))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(build, f"id {kind}, fp long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 bit masks over the given bits, such that any `radius` bits are all outside some mask.

    Bit i gets a non-zero vector of radius + 1 bits; mask v holds the bits whose
    vector has an odd inner product with v. The vectors of `radius` bits don't span the
    space, so some v is orthogonal to all of them.
    """
    vectors = (1 << radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(positions) if (v & (i % vectors + 1)).bit_count() & 1) for v in range(1, vectors + 1)]


def _tables(levels: int, radius: int = RADIUS) -> list[list[tuple[int, int, int]]]:
    """For each level the rows (path, new path, mask): the mask holds the bits of the path's masks so far and of one that
    covers the bits outside. The number of rows depends on the radius and the level alone."""
    tables, paths = [], {0: 0}
    vectors = (1 << radius + 1) - 1
    for _ in range(levels):
        rows = []
        for path, held in paths.items():
            free = [p for p in range(BITS) if not held >> p & 1]
            rows += [(path, path * (vectors + 1) + v + 1, held | m) for v, m in enumerate(covering_masks(free, radius))]
        paths = {new: mask for _, new, mask in rows}
        tables.append(rows)
    return tables


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (path, key, fp) -> links (u, v) that join what lies within the radius in a bucket: every
    linked fingerprint with the smallest one reachable, so no more rows than were read."""
    left = None
    for x in _with_end(batches):
        if x is not None and left is not None:
            x = pd.concat([left, x], ignore_index=True)
        last = x is None
        x = left if last else x
        if x is None or not len(x):
            continue
        path, key = x["path"].to_numpy(), x["key"].to_numpy()
        new = np.append(True, (path[1:] != path[:-1]) | (key[1:] != key[:-1]))
        cut = len(x) if last else int(np.flatnonzero(new)[-1])
        left = None if last else x.iloc[cut:]
        fp, bucket = x["fp"].to_numpy(np.int64)[:cut], np.cumsum(new)[:cut]
        bits, a, b = fp.view(np.uint64), [], []
        for step in range(1, cut):
            same = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(same):
                break
            near = same[np.bitwise_count(bits[same] ^ bits[same + step]) <= radius]
            a.append(near)
            b.append(near + step)
        if not a:
            continue
        a, b = np.concatenate(a), np.concatenate(b)
        low = np.arange(cut)
        while True:
            was = low.copy()
            m = np.minimum(low[a], low[b])
            np.minimum.at(low, a, m)
            np.minimum.at(low, b, m)
            low = low[low]
            if (was == low).all():
                break
        linked = np.flatnonzero(low != np.arange(cut))
        yield pd.DataFrame({"u": fp[linked], "v": fp[low[linked]]})


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) among distinct fingerprints(fp long) that have the same components as all pairs within the radius.

    Every fingerprint goes to one bucket a mask, so each pair within the radius meets
    in a bucket. A bucket of over `bucket` fingerprints is covered anew over the bits
    that its mask leaves open, at most three times: then a mask leaves at most eight
    bits open, so a bucket has at most 256 distinct fingerprints. Nothing is dropped.
    """
    spark = prints.sparkSession
    todo, found = None, None
    for level, table in enumerate(_tables(3, radius), 1):
        if level == 1:
            masked = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("new"), F.lit(_signed(m)).alias("mask")) for _, n, m in table])).alias("m")).select("fp", "m.*")
        else:
            masks = spark.createDataFrame([(p, n, _signed(m)) for p, n, m in table], "path long, new long, mask long")
            masked = todo.join(F.broadcast(masks), "path")  # of fixed size
        keyed = masked.select(F.col("new").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = written(keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"buckets{level}")
        rows = keyed.join(sizes, ["path", "key"])
        ready = rows if level == 3 else rows.where(F.col("n") <= bucket)
        made = ready.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInPandas(lambda it: _bucket_links(it, radius), "u long, v long").distinct()
        made = written(made, f"links{level}")
        found = made if found is None else found.unionByName(made)
        if level == 3 or not sizes.where(F.col("n") > bucket).limit(1).count():
            return found
        todo = written(rows.where(F.col("n") > bucket).select("path", "fp"), f"hot{level}")
    return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: (<id_col>, fp long, component_id).

    A fingerprint's bit is 1 if it is set in over half of the hashes of the text's
    three-word shingles. Fingerprints link at `radius` or fewer differing bits; the
    component is named by the smallest id in it (nulls are passed over). Null, empty
    and blank texts have fingerprint 0, which links like any other. Repeated rows
    each get a row. An empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = written(components(links(nodes.select("fp"), radius)), "components")
    roots = written(found.join(nodes, found["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = nodes.join(found, nodes["fp"] == found["node"], "left").join(small_side(roots), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _sketches(rows: DataFrame) -> DataFrame:
    """rows(rid, text) -> (rid, n, fp, keys) of the distinct shingles of SET_SHINGLE words: how many, their fingerprint, and a hash of each band's
    MINS least ones."""
    draw = np.random.default_rng(SEED)
    flips, odd = (draw.integers(0, 1 << 64, BANDS * MINS, np.uint64) for _ in range(2))
    odd |= np.uint64(1)

    def keys(hashes: np.ndarray) -> list[int]:
        if not len(hashes):
            return [0]
        least = np.full(BANDS * MINS, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 4096):
            np.minimum(least, ((hashes[at : at + 4096, None] ^ flips) * odd).min(0), out=least)
        return [_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, MINS))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, found, part, held = [], [], [], [], 0
            for text in batch.column(1):
                part.append(np.unique(shingle_hashes(text.as_py(), SET_SHINGLE)))
                sizes.append(len(part[-1]))
                found.append(keys(part[-1]))
                held += sizes[-1]
                if held > 1_000_000:
                    prints.append(majority_bits(part))
                    part, held = [], 0
            prints.append(majority_bits(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(prints).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], ["rid", "n", "fp", "keys"])

    return rows.mapInArrow(build, "rid long, n long, fp long, keys array<long>")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """rows(rid, text) -> (rid, hashes): the distinct shingles of SET_SHINGLE words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, part, held = 0, [], 0
            for k, text in enumerate(batch.column(1), 1):
                part.append(np.unique(shingle_hashes(text.as_py(), SET_SHINGLE)).view(np.int64))
                held += len(part[-1])
                if held > 1_000_000 or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k - start), pa.array(part, pa.list_(pa.int64()))], ["rid", "hashes"])
                    start, part, held = k, [], 0

    return rows.mapInArrow(build, "rid long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose shingle sets have a Jaccard similarity of at least 4/5, in whole numbers; two empty sets are alike."""
    both = pairs.join(sets.select(F.col("rid").alias("v"), F.col("hashes").alias("b")), "v").join(sets.select(F.col("rid").alias("u"), F.col("hashes").alias("a")), "u")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows(rid, root, hashes, asks) of a part of a bucket -> links (u, v) of rows that ask with rows of other roots at a Jaccard similarity of at
    least 4/5, one less than the rows that they join: pairs stay in here."""
    asks = pdf["asks"].to_numpy(bool)
    rid, root, sets = pdf["rid"].to_numpy(), pdf["root"].to_numpy(), pdf["hashes"].to_numpy()
    other = np.flatnonzero(~asks)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *sets[other]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(other)), sizes[other])[order]
    low: dict[int, int] = {}  # each row or root to one before it

    def first(x: int) -> int:
        while low.get(x, x) != x:
            low[x] = low.get(low[x], low[x])
            x = low[x]
        return x

    out = []
    for i in np.flatnonzero(asks).tolist():
        a, b = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
        n = b - a
        take = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[take], minlength=len(other))
        for j in other[np.flatnonzero((9 * common >= 4 * (sizes[i] + sizes[other])) & (root[other] != root[i]))].tolist():
            x, y = first(int(root[i])), first(int(root[j]))
            if x != y:
                low[max(x, y)] = min(x, y)
                out.append((rid[i], rid[j]))
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["u", "v"])


def similar_links(rows: DataFrame) -> DataFrame:
    """rows(rid, text) -> links (u, v) with the components of all candidate pairs of Jaccard similarity 4/5 or more.

    First come the pairs that covering masks give: equal fingerprints, and a forest of those within RADIUS bits. At 4/5 most pairs are
    farther apart than masks can reach, so candidates also share a band: of 24 such a pair shares none with a probability of
    (1 - 0.8^4)^24, 3 in a million.
    """
    return banded_links(rows, written(_sketches(rows), "sketches"), masks=True)


def banded_links(rows: DataFrame, sketches: DataFrame, masks: bool = False) -> DataFrame:
    """rows(rid, text) and their written sketches(rid, n, fp, keys) -> links (u, v) with the components of all pairs of Jaccard similarity 4/5 or more that
    share fp or one of keys, or, with masks, whose fp differ by at most RADIUS bits.

    Rows are held against the smallest row of a bucket, first against the one that they meet
    in most bands, then against the others unless a link has joined them. What a bucket then still has of other components than
    its largest is held against all its rows within tasks of PART_ROWS rows, which return a forest of links, never pairs.
    """
    nodes = written(sketches.groupBy("fp").agg(F.min(F.struct("rid", "n")).alias("at")), "prints")
    alike = sketches.join(small_side(nodes), "fp").where("rid <> at.rid").select(F.col("at.rid").alias("u"), F.col("at.n").alias("un"), F.col("rid").alias("v"), F.col("n").alias("vn"))
    if masks:
        end = lambda name: nodes.select(F.col("fp").alias(name), F.col("at.rid").alias(f"r{name}"), F.col("at.n").alias(f"n{name}"))
        masked = links(nodes.select("fp")).join(end("u"), "u").join(end("v"), "v").select(F.col("ru").alias("u"), F.col("nu").alias("un"), F.col("rv").alias("v"), F.col("nv").alias("vn"))
        alike = alike.unionByName(masked)

    bands = sketches.select("rid", "n", F.explode("keys").alias("key"))
    buckets = written(bands.groupBy("key").agg(F.min(F.struct("rid", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "buckets")
    members = written(bands.join(small_side(buckets), "key"), "members")
    meet = (5 * F.col("un") >= 4 * F.col("vn")) & (5 * F.col("vn") >= 4 * F.col("un"))
    hubs = members.where("rid <> hub.rid").groupBy(F.col("hub.rid").alias("u"), F.col("hub.n").alias("un"), F.col("rid").alias("v"), F.col("n").alias("vn")).agg(F.count(F.lit(1)).alias("times"))
    hubs = written(hubs.where(meet), "hub_pairs")
    most = hubs.groupBy("v").agg(F.min(F.struct((-F.col("times")).alias("times"), "u")).alias("m")).select(F.col("m.u").alias("u"), "v")
    begin = written(alike.where(meet).select("u", "v").unionByName(most).distinct(), "first_pairs")

    asked = members.select("rid").unionByName(begin.select(F.col("u").alias("rid"))).unionByName(begin.select(F.col("v").alias("rid"))).distinct()
    sets = written(_shingle_sets(rows.join(small_side(written(asked, "candidates")), "rid", "left_semi").select("rid", "text")), "shingle_sets")
    found = written(_verified(begin, sets), "first_links")
    joined = written(components(found), "first_components")
    root = lambda of: joined.select(F.col("node").alias(of), F.col("root").alias(f"r{of}"))
    open_pairs = hubs.select("u", "v").join(begin, ["u", "v"], "left_anti").join(small_side(root("u")), "u", "left").join(small_side(root("v")), "v", "left")
    more = written(_verified(open_pairs.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), sets), "hub_links")
    found = found.unionByName(more)

    joined = written(components(found), "hub_components")
    named = written(members.join(small_side(joined), F.col("rid") == F.col("node"), "left").select("key", "rid", F.coalesce("root", "rid").alias("root")), "named")
    tally = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("major"))
    mixed = tally.where(F.col("all") > F.col("most")).select("key", "major", F.ceil(F.col("all") / PART_ROWS).alias("parts"), F.ceil((F.col("all") - F.col("most")) / PART_ROWS).alias("asking"))
    x = named.join(small_side(written(mixed, "mixed")), "key")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = x.select("key", "rid", "root", F.pmod(F.xxhash64("rid"), "parts").alias("i"), number("asking").alias("j"), F.lit(False).alias("asks"))
    asks = x.where("root <> major").select("key", "rid", "root", number("parts").alias("i"), F.pmod(F.xxhash64("rid", F.lit(1)), "asking").alias("j"), F.lit(True).alias("asks"))
    parts = every.unionByName(asks).join(sets, "rid")
    return found.unionByName(written(parts.groupBy("key", "i", "j").applyInPandas(_compared, "u long, v long"), "other_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of texts whose sets of five-word shingles have a Jaccard similarity of at least
    0.8: that of the smallest id, of its repeats the first in scan order. Texts of fewer words are one shingle; null and
    wordless texts are alike. The numbered rows are written once and only they are read."""
    (rid,) = fresh(docs, "_rid")
    rows = numbered(docs, rid)
    found = written(components(similar_links(rows.select(F.col(rid).alias("rid"), F.col(text_col).alias("text")))), "components")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid")).alias("key")
    named = rows.select(key).join(small_side(found), F.col("key.rid") == F.col("node"))
    best = named.groupBy("root").agg(F.min("key").alias("best")).select("root", F.col("best.rid").alias("best"))
    gone = written(found.join(small_side(written(best, "kept")), "root").where("node <> best").select(F.col("node").alias(rid)), "near_copies")
    return rows.join(small_side(gone), rid, "left_anti").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
