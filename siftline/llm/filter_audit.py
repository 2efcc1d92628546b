"""Filter interaction audit: a relation of failing ids for each filter, and what every order of the filters removes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import fresh, numbered, small_side, written

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Orders and prefixes of more filters than these would not be a small fixed table (7! = 5,040 orders).
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text (null: empty): under 100 words; under 80 distinct words in 100; over 10 capitals of A-Z in
    100 code points; any of #$%&*|."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, WORD_GAP), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 10 * F.char_length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """rows(rid, id, digest) -> (rid) of those whose digest a smaller id has. A null id is no smaller than any and larger than every other;
    rows that share the smallest id are no later copies. A digest is grouped to its smallest id before the shuffle."""
    first = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 AND least IS NOT NULL").drop("n")
    first = small_side(written(first, "first_ids"))
    return rows.join(first, "digest").where(F.col("id").isNull() | (F.col("id") > F.col("least"))).select("rid")


def failing_atoms(failing: dict[str, DataFrame]) -> DataFrame:
    """Relations of failing ids (rid), one a filter -> (rid, mask) of every id in any of them; bit k is set if it is in the k-th relation.

    Every relation splits what the earlier ones left together: a left semi join has the ids that fail here too, a left anti join
    those that survive here, and the relation without the ids known so far begins a new part. So an id moves once a filter, and no row
    that passes all filters is joined at all. Equal prefixes of all orders share these parts.
    """
    known: DataFrame | None = None
    for k, (name, ids) in enumerate(failing.items()):
        if known is None:
            known = ids.select("rid", F.lit(1 << k).alias("mask"))
            continue
        removed = known.join(ids, "rid", "left_semi").select("rid", F.col("mask").bitwiseOR(F.lit(1 << k)).alias("mask"))
        survivors = known.join(ids, "rid", "left_anti")
        new = ids.join(known, "rid", "left_anti").select("rid", F.lit(1 << k).alias("mask"))
        known = written(removed.unionByName(survivors).unionByName(new), f"atoms_{name}")
    return known


def audit(docs: DataFrame, conditions: dict[str, Column], labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", copies: str | None = "E") -> DataFrame:
    """What each of some filters removes at each place of each order of them.

    conditions: by name of one letter the condition under which a row fails, null counts as false; `copies` names one more filter, of
    rows whose text a smaller id has in the whole table. labels has (id_col, quality, toxic); a row is good or toxic if any label of
    its id says 1. Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row per
    value of part_col (null: empty string), order and step; zeros too. An empty table has no parts and gives no rows.

    Rows with a null id carry no label; repeated rows count each. Other columns are ignored whatever their names.

    The texts are read once. Each filter has a written relation of the ids that fail it, and only these are joined (failing_atoms). Prefixes
    with the same filters in any order have the same survivors, so a part's rows are summed by (filters of the prefix, filter) and these
    sums, of a fixed number, are given to the orders.
    """
    names = [*conditions, *([copies] if copies else [])]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders")
    id_type = dict(docs.dtypes)[id_col]
    flags = [F.coalesce(c, F.lit(False)).alias(f"fails_{k}") for k, c in enumerate(conditions.values())]
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), digest, *flags))
    failing = {name: rows.where(f"fails_{k}").select("rid") for k, name in enumerate(conditions)}
    if copies:
        failing[copies] = later_copies(rows.select("rid", "id", "digest"))
    failing = {name: written(ids, f"failing_{name}") for name, ids in failing.items()}
    atoms = failing_atoms(failing)

    marked = {c: labels.where(F.col(c) == 1).select(F.col(id_col).cast(id_type).alias("id")).where("id IS NOT NULL").distinct() for c in ("quality", "toxic")}
    failed = written(rows.select("rid", "id", "part").join(atoms, "rid"), "failed")
    plain = failed.select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    lost = [failed.join(ids, "id", "left_semi").select("part", "mask", F.lit(0).alias("n"), F.lit(int(c == "quality")).alias("good"), F.lit(int(c == "toxic")).alias("toxic")) for c, ids in marked.items()]
    clean = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = plain.unionByName(lost[0]).unionByName(lost[1]).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return _orders(written(clean, "parts"), written(counts, "atom_counts"), names)


def _orders(parts: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """parts(part, n) of all rows and counts(part, mask, n, good, toxic) of failing ones -> the audit. Each count meets the fixed pairs of (filters
    before, filter) as an array of its own row."""
    spark, bits = parts.sparkSession, {name: 1 << k for k, name in enumerate(names)}
    pairs = [(before, bit) for bit in bits.values() for before in range(1 << len(names)) if not before & bit]
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in pairs]))
    # a part's own row with mask 0 brings the number of all rows and the pairs that no row fails
    every = counts.select("part", "mask", "n", "good", "toxic", F.lit(0).alias("rows")).unionByName(parts.select("part", F.lit(0).alias("mask"), F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.col("n").alias("rows")))
    x = every.select("*", pair.alias("p")).select("part", "mask", "n", "good", "toxic", "rows", "p.before", "p.bit")
    here, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0))
    sums = x.groupBy("part", "before", "bit").agg(
        (F.sum("rows") - total(here | earlier)).alias("kept"), total(here & ~earlier).alias("removed"), total(here & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & ~earlier, "good").alias("good_lost"), total(here & ~earlier, "toxic").alias("toxic_lost"),
    )
    orders = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            orders.append(("".join(order), step, before, bits[name]))
            before |= bits[name]
    fixed = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    out = sums.join(F.broadcast(fixed), ["before", "bit"])  # a row a step of an order, at most 7 x 7!
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def survivors(docs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """docs without the rows that fail any condition (null: false); all columns stay as they are."""
    (gone,) = fresh(docs, "_gone")
    failed = F.lit(False)
    for c in conditions.values():
        failed = failed | F.coalesce(c, F.lit(False))
    return docs.withColumn(gone, failed).where(~F.col(gone)).drop(gone)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(docs, text_filters(F.col("text")), labels)


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
d AS (SELECT x.doc_id, x.part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t),
    regexp_matches(x.t, '[#$%&*|]'), f.least IS NOT NULL AND (x.doc_id IS NULL OR x.doc_id > f.least)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND l.toxic = 1) AS toxic
    FROM words x JOIN first f ON x.t = f.t),
m AS (SELECT part, list_sum([CASE WHEN fails[k] THEN 1 << (k - 1) ELSE 0 END FOR k IN range(1, 6)])::BIGINT AS mask, good, toxic FROM d),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT k - 1 AS k, 'ABCDE'[k] AS c FROM range(1, 6) t(k)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, s::INT AS step, 1 << ks[s] AS bit, coalesce(list_sum([1 << k FOR k IN ks[1:s - 1]]), 0)::BIGINT AS before FROM orders, range(1, 6) t(s)),
r AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
    FROM g, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
