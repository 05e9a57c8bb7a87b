"""Sharding by balanced label propagation.

Documents with equal texts are linked. All documents first get shards in the
order of hash-random keys, so counts differ by one at most (law `rows`). In every
round the members of a group look at where their neighbours are: the shard that
holds most of the group is its home, and members elsewhere want to move there.
How many want to go from each shard to each other is a table of shards x shards
numbers. From it the driver sets quotas: an inflow beyond the outflow has to be
paid for by documents without links that leave the full shard for those that lost
rows. So each round keeps every shard's count, and moves only ever mend cut edges. Rounds end
when no wish is granted; `cut_share` measures what stays cut.

A group of more than a quarter of a shard is cut into parts of that size by its
members' keys, as no shard could hold it with the rest.

Defined results: null texts count as empty, and null ids as the empty text for the
key; repeated rows are documents of their own; of equal keys the smaller id and crc come
first; very long texts are hashed whole; with fewer rows than shards some shards are
empty; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm.common import discard, documents, join_per_key, prefix_sum, random_key, stage

SHARDS = 40
#: Rounds go on until no wish is granted any more; a safeguard against a fault.
ROUNDS = 50
#: Bytes that a row costs besides its text.
OVERHEAD = 16


def quotas(wish: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], list[tuple[int, int, int]]]:
    """wish: rows that want to go from a to b; free: rows without links in each shard.
    -> how many of each wish may go, and (from, to, n) of unlinked rows, so that all counts stay."""
    allow = dict(wish)
    while True:
        inflow, outflow = [0] * len(free), [0] * len(free)
        for (a, b), n in allow.items():
            outflow[a] += n
            inflow[b] += n
        over = [(inflow[h] - outflow[h] - free[h], h) for h in range(len(free))]
        if max(over)[0] <= 0:
            break
        for excess, h in over:
            for key in sorted(k for k in allow if k[1] == h):
                if excess <= 0:
                    break
                cut = min(excess, allow[key])
                allow[key] -= cut
                excess -= cut
    short = [[h, outflow[h] - inflow[h]] for h in range(len(free)) if outflow[h] > inflow[h]]
    paid = []
    for h in range(len(free)):
        due = inflow[h] - outflow[h]
        while due > 0:
            n = min(due, short[0][1])
            paid.append((h, short[0][0], n))
            due -= n
            short[0][1] -= n
            if not short[0][1]:
                short.pop(0)
    return {k: n for k, n in allow.items() if n}, paid


def propagate(rows: DataFrame, shards: int, n: int, rounds: int = ROUNDS) -> DataFrame:
    """rows: a staged table with key, unit (null: no links) and shard. Returns it with shard changed."""
    spark = rows.sparkSession
    for _ in range(rounds):
        held = rows.where(F.col("unit").isNotNull()).groupBy("unit", "shard").agg(F.count("*").alias("_n"))
        home = held.groupBy("unit").agg(F.max_by("shard", F.struct("_n", F.xxhash64("unit", "shard"))).alias("home"), F.sum("_n").alias("_rows"))
        single, linked = F.col("unit").isNull(), F.col("unit").isNotNull()
        wanting = (
            join_per_key(rows.where(linked), home, ["unit"], "_rows", n)
            .withColumn("_class", F.when(F.col("home") != F.col("shard"), F.col("shard") * shards + F.col("home")))
            .select(*rows.columns, "_class")
            .unionByName(rows.where(single).withColumn("_class", F.lit(shards * shards) + F.col("shard")))
        )
        wanting = stage(wanting, "shard-wishes")
        counts = {r[0]: r[1] for r in wanting.where("_class is not null").groupBy("_class").count().collect()}  # shards * (shards + 1) rows at most
        wish = {divmod(k, shards): c for k, c in counts.items() if k < shards * shards}
        allow, paid = quotas(wish, [counts.get(shards * shards + s, 0) for s in range(shards)])
        if not allow:
            discard(wanting)
            break
        plan, taken = [(a * shards + b, 0, c, b) for (a, b), c in allow.items()], [0] * shards
        for a, b, c in paid:
            plan.append((shards * shards + a, taken[a], taken[a] + c, b))
            taken[a] += c
        moves = spark.createDataFrame(plan, "_class int, _from long, _to long, _dest int")
        ranked = prefix_sum(wanting.where("_class is not null").withColumn("_one", F.lit(1)), "_class", "key", "_one", "_rank", n, ties=("id", "crc"))
        moved = ranked.join(
            F.broadcast(moves.withColumnRenamed("_class", "_moving")),
            (F.col("_class") == F.col("_moving")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
            "left",
        ).withColumn("shard", F.coalesce("_dest", "shard"))
        after = stage(moved.select(*rows.columns).unionByName(wanting.where("_class is null").select(*rows.columns)), "shard-round")
        discard(wanting)
        discard(rows)
        rows = after
    return rows


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """id, size, crc, shard, slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("g"),
            random_key(F.col(id_col), seed="shard").alias("key"),
            F.lit(0).alias("_all"),
            F.lit(1).alias("_one"),
        ),
        "shard-rows",
    )
    n = base.count()
    part = max(1, n // shards // 4)
    sizes = stage(base.groupBy("g").agg(F.count("*").alias("_members")), "shard-groups")
    first = prefix_sum(base, "_all", "key", "_one", "_at", n, ties=("id", "crc"))
    unit = F.when(F.col("_members") > 1, F.xxhash64("g", F.pmod(F.col("key"), F.ceil(F.col("_members") / part).cast("long"))))
    rows = stage(
        join_per_key(first, sizes, ["g"], "_members", n).select("id", "size", "crc", "key", unit.alias("unit"), (F.col("_at") % shards).cast("int").alias("shard")),
        "shard-start",
    )
    discard(base)
    rows = propagate(rows, shards, n, rounds)
    return prefix_sum(rows.withColumn("_one", F.lit(1)), "shard", "key", "_one", "slot", n, ties=("id", "crc")).select(
        F.col("id").alias(id_col), "size", "crc", "shard", "slot"
    )


def cut_share(sharded: DataFrame) -> DataFrame:
    """One row: groups of equal texts (by crc and size) of two rows or more, those in one shard, and the share of their members outside the group's main shard."""
    held = sharded.groupBy("crc", "size", "shard").agg(F.count("*").alias("n"))
    groups = held.groupBy("crc", "size").agg(F.sum("n").alias("rows"), F.max("n").alias("main"), F.count("*").alias("parts")).where("rows > 1")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("parts") == 1).alias("whole"), F.coalesce(F.try_divide(F.sum(F.col("rows") - F.col("main")), F.sum("rows")), F.lit(0.0)).alias("cut_share"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
