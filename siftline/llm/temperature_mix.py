"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.llm.common import fresh, numbered, small_side, written

#: Target entropy as a share of the largest possible, log(sources), and how often a source's tokens may be repeated on average.
ENTROPY = 0.95
REPEATS = 4.0
#: Rows of one block of a permutation.
BLOCK_ROWS = 4096
SEED = 11
#: Points that one step of the bisection tries inside the interval, and steps: 16^10 parts.
POINTS, STEPS = 15, 10


def token_estimate(text_col: str = "text") -> Column:
    """A quarter of the characters, at least 1; 0 for null."""
    n = F.char_length(F.col(text_col))
    return F.when(n.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def _measures(sources: DataFrame, exponents: list[float], budget_share: float) -> DataFrame:
    """For each exponent a: entropy of the weights p^a / sum p^a, and the largest repetition weight * budget / tokens."""
    u = F.pow(F.col("p"), F.col("a"))
    sums = sources.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).groupBy("a").agg(F.sum(u).alias("z"), F.sum(u * F.ln(u)).alias("e"), F.max(u / F.col("p")).alias("r"))
    return sums.select("a", (F.ln("z") - F.col("e") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z") * budget_share).alias("repeats"))


def bisect_exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget_share: float = 1.0) -> float:
    """The exponent in [0, 1] for sources(p): the largest that reaches the target entropy, or, if that
    repeats a source more than `repeats` times, the smallest that doesn't; 1 if the shares as they are
    reach the target, or repeat too much already.

    Entropy falls and repetition falls as the exponent grows, so each condition changes once. A step narrows the
    interval to one of POINTS + 1 parts; only POINTS sums come to the driver.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    goal = F.ln(F.lit(float(n))) * entropy - 1e-12

    def last_true(condition: Column) -> float:
        low, high = 0.0, 1.0  # the condition holds at low, and not at high
        ends = {a: ok for a, ok in _measures(sources, [0.0, 1.0], budget_share).select("a", condition).collect()}
        if ends[1.0] or not ends[0.0]:
            return 1.0 if ends[1.0] else 0.0
        for _ in range(STEPS):
            step = (high - low) / (POINTS + 1)
            held = _measures(sources, [low + step * k for k in range(1, POINTS + 1)], budget_share).where(condition).agg(F.max("a")).first()[0]
            low = low if held is None else held
            high = low + step
        return low

    wanted = last_true(F.col("entropy") >= goal)
    allowed = last_true(F.col("repeats") > repeats)
    return max(wanted, allowed)


def source_weights(docs: DataFrame, source_col: str = "source", tokens: Column | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """(src, tokens, rows, p, weight, exponent, target): a row for each source that has tokens; target is the source's part of the budget
    (by default all tokens). Null is one source with the empty name."""
    sized = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), (token_estimate() if tokens is None else tokens).alias("tokens"))
    by_source = written(sized.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).where("tokens > 0"), "sources")
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    shares = by_source.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    budget = total if budget is None else budget
    exponent = bisect_exponent(shares, entropy, repeats, budget / max(total, 1))
    raised = shares.withColumn("u", F.pow("p", F.lit(exponent)))
    z = raised.agg(F.sum("u")).first()[0] or 1.0
    return raised.select("src", "tokens", "rows", "p", (F.col("u") / F.lit(z)).alias("weight"), F.lit(exponent).alias("exponent"), F.floor(F.col("u") / F.lit(z) * F.lit(float(budget)) + 1e-6).cast("long").alias("target"))


def dealt(placed: DataFrame) -> DataFrame:
    """placed(rid, src, key, block) with `sub`: 0 but in blocks of over two times BLOCK_ROWS rows. Those hold one id over and over, or null, and are
    dealt once more by row number. placed is a written table, so row numbers stay."""
    rows = placed.groupBy("src", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK_ROWS)
    full = written(rows.select("src", "block", F.ceil(F.col("n") / BLOCK_ROWS).alias("subs")), "full_blocks")
    n = full.count()
    if not n:
        return placed.withColumn("sub", F.lit(0).cast("long"))
    sub = F.pmod(F.xxhash64("key", "rid"), F.col("subs"))
    return placed.join(small_side(full, n), ["src", "block"], "left").withColumn("sub", F.coalesce(sub, F.lit(0))).drop("subs")


def block_offsets(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """blocks(src, block, sub, size) with `offset`: the tokens before it in the order of the source's blocks by hash.

    The hashes are cut into 1,024 ranges. A source's ranges are added up first, then the blocks of each range on their own, so no task sorts all of a source's blocks.
    """
    blocks = blocks.withColumn("h", F.xxhash64("block", F.lit(seed))).withColumn("part", F.shiftright("h", 54))
    before = lambda w: F.sum("size").over(w) - F.col("size")
    parts = blocks.groupBy("src", "part").agg(F.sum("size").alias("size")).select("src", "part", before(Window.partitionBy("src").orderBy("part")).alias("base"))
    inside = blocks.withColumn("inside", before(Window.partitionBy("src", "part").orderBy("h", "block", "sub")))
    return inside.join(parts, ["src", "part"]).select("src", "block", "sub", "size", (F.col("base") + F.col("inside")).alias("offset"))


def mixture_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, seed: int = SEED, rid_col: str | None = None, **target) -> DataFrame:
    """(rid, id, src, tokens, copies, position, span, weight, exponent) for each row of docs that has tokens.

    A source's rows are dealt by a keyed hash into blocks of about BLOCK_ROWS rows; the blocks follow each other in the
    order of a keyed hash of their numbers, the rows of a block in that of their own. The source's
    target is met by whole rounds through this permutation and a last one that stops before the row that would exceed it, so
    a source gets at most its target, and less than it by under one row. `position` is where the
    row's first token stands in a round, `span` the source's tokens. A hot source has
    more blocks, not larger ones, and where repeated or null ids fill a block their rows are dealt again by row number; only the block in which a last round stops is ordered row by row. In the other blocks, which are taken whole, a
    row's position is its hash's share of the block, so two rows can have one; rows of one position come in order of their ids.
    """
    weights = source_weights(docs, source_col, tokens, **target).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS))
    weights = written(weights.select("src", F.col("tokens").alias("span"), "weight", "exponent", "target", "blocks"), "weights")
    sized = docs.select((F.monotonically_increasing_id() if rid_col is None else F.col(rid_col)).alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), (token_estimate() if tokens is None else tokens).alias("tokens"))
    rows = sized.where("tokens > 0").join(small_side(weights), "src")
    rows = rows.withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("block", F.pmod(F.shiftright("key", 20), F.col("blocks")))
    placed = dealt(written(rows.select("rid", "id", "src", "tokens", "key", "block"), "placed"))
    blocks = written(block_offsets(placed.groupBy("src", "block", "sub").agg(F.sum("tokens").alias("size")), seed), "blocks")
    known = placed.join(small_side(blocks), ["src", "block", "sub"]).join(small_side(weights), "src")
    rest = F.col("target") % F.col("span")
    rounds = F.floor(F.col("target") / F.col("span")).cast("long")
    known = known.withColumn("rest", rest).withColumn("rounds", rounds)
    split = (F.col("offset") < F.col("rest")) & (F.col("offset") + F.col("size") > F.col("rest"))
    within = Window.partitionBy("src", "block", "sub").orderBy(F.pmod("key", F.lit(1 << 20)), "key", "rid")
    cut = known.where(split).withColumn("position", F.col("offset") + F.sum("tokens").over(within) - F.col("tokens"))
    cut = cut.withColumn("extra", (F.col("position") + F.col("tokens") <= F.col("rest")).cast("long"))
    # elsewhere a row's place in its block follows from its hash alone, without a sort
    spread = (F.pmod(F.col("key"), F.lit(1 << 20)) / float(1 << 20) * F.greatest(F.lit(0), F.col("size") - F.col("tokens"))).cast("long")
    whole = known.where(~split).withColumn("position", F.col("offset") + spread).withColumn("extra", (F.col("offset") + F.col("size") <= F.col("rest")).cast("long"))
    return cut.unionByName(whole).select("rid", "id", "src", "tokens", (F.col("rounds") + F.col("extra")).alias("copies"), "position", "span", "target", "weight", "exponent")


def _rounds(plan: DataFrame) -> DataFrame:
    """A row for each row of the plan and round it takes part in, with epoch and place."""
    out = plan.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.withColumn("place", (F.col("epoch") * F.col("span") + F.col("position")) / F.greatest("target", F.lit(1)))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """One row for each row of docs and round it takes part in: (id, src, tokens, epoch from 0, place, weight, exponent).

    Sorted by `place`, from 0 to 1, the rows are the mixture: at every point each source has given about its weight.
    Rows without tokens (null text) are in no round; ties and repeated rows are separate rows; an
    empty table gives none.
    """
    return _rounds(mixture_plan(docs, id_col, source_col, **options)).select("id", "src", "tokens", "epoch", "place", "weight", "exponent")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", place_col: str | None = None, **options) -> DataFrame:
    """docs with every row as often as the mixture has it; all columns stay as they are.

    Of the plan only the rows that don't come exactly once are joined to docs. With `place_col` each row also has its place in the mixture under
    that name, and the rows come in ranges of it, sorted: written, they are the mixture in order. The name must be new, else a ValueError.
    """
    rid, times = fresh(docs, "_rid", "_times")
    rows = numbered(docs, rid)
    if place_col is not None:
        if place_col.lower() in {c.lower() for c in rows.columns}:
            raise ValueError(f"docs have a column {place_col} already")
        places = _rounds(mixture_plan(rows, id_col, source_col, rid_col=rid, **options)).select(F.col("rid").alias(rid), F.col("place").alias(place_col))
        return rows.join(places, rid).drop(rid).repartitionByRange(place_col).sortWithinPartitions(place_col)
    plan = written(mixture_plan(rows, id_col, source_col, rid_col=rid, **options).where("copies <> 1").select(F.col("rid").alias(rid), F.col("copies").cast("int").alias(times)), "copies")
    sized = rows.where((token_estimate() if options.get("tokens") is None else options["tokens"]) > 0)
    joined = sized.join(small_side(plan), rid, "left")
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(1))))).select(*docs.columns)


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "tokens", "epoch", "place", "weight", "exponent")
