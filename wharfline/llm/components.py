"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import HOT_ROWS, discard, join_per_key, stage


def _checked(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60, hub: int = HOT_ROWS) -> DataFrame:
    """edges (u, v) of long nodes -> (node, component: the smallest node it reaches).

    Every round rewires all edges towards smaller nodes and is written to the
    shared folder, so lineage stays short and an executor lost costs one round.
    The number of rounds grows with the logarithm of the longest path. Minima are
    aggregates with map-side combination, and the minima of nodes with very many
    neighbours (over `hub`, and a thousandth of all edges) are broadcast.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _checked(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")).select("u", F.least("u", "_m").alias("m"), "_n")
        large = join_per_key(both, low, ["u"], "_n", 2 * seen[0], hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = (
            join_per_key(large, low, ["u"], "_n", seen[0], hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        after = stage(small.distinct(), "small-star")
        discard(large)
        discard(now)
        now, before = after, seen
        seen = _checked(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
