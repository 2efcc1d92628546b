"""What the operators of this subpackage share: numbered rows and components, beside the library's written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.tables import BROADCAST_ROWS, new_path, shared_dir, small_side, written

__all__ = ["BROADCAST_ROWS", "components", "fresh", "new_path", "numbered", "shared_dir", "small_side", "written"]


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """df with the numbers of a scan, written once: another scan may split files otherwise (splits follow the cores registered)
    and number the rows otherwise, so only this table may be joined on the numbers."""
    return written(df.select(F.monotonically_increasing_id().alias(name), "*"), "numbered")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v) by alternating large and small stars.

    Returns (node, root), root being the smallest node of the component; nodes that
    stand in no edge are not returned. Self loops and nulls are ignored, repeated
    edges count once. Every round is a written table, so a lost executor costs one
    round; a hub of many edges is pre-aggregated to its smallest neighbour before
    the shuffle and only meets its edges in a sort-merge join, which Spark splits.
    """
    stars = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(stars)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = written(small.distinct(), "stars")
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
