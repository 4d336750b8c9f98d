"""Connected components by alternating stars over shuffles; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and all its v, counted before the shuffle."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``node, root`` for every node with an edge to another; root is the smallest node reachable.

    Large and small stars by turns, each round written to the shared folder, until nothing changes. A path of n nodes
    takes about log n rounds.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    for _ in range(rounds):
        count, mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not count or (count, mark) == seen:
            break
        seen = (count, mark)
        both = pairs.union(pairs.select("v", "u"))
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large.where(F.col("u") != F.col("v")).distinct())
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        pairs = materialize(linked.where(F.col("u") != F.col("v")).distinct(), "stars")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
