"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in the
order of their keys; a distributed prefix sum of their sizes says how many words
come before each. A target of k whole sources plus a rest is taken as k epochs of
every document and one more of those before the rest; the document on the
boundary gives just the words that are missing, so a source meets its budget to
the word.

Targets: weights share the words of all sources; a target stops at `epochs` times
its source, and the excess goes to the others by weight until none is above. With
sources in the order of (cap / weight) the level at which the rest stop follows
from running sums, so no loop is needed.

Defined results: a null text has size 0, and a document without words is never
taken; a null source is a source of its own, the last; a null id counts as the
empty text for the key; repeated rows are taken apart; of equal keys the smaller id
and size come first; very long texts are counted whole; an empty table gives an empty
result, and sources without words have target 0. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.llm.common import WORD, documents, prefix_sum, random_key, stage, wrapped

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: A table of sources of up to this many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, size) -> (source, src, source_size, target), a row for each source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    ranked = totals.withColumn("src", F.row_number().over(turn) - 1).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    )
    cap = (F.col("source_size") * epochs).cast("double")
    upto = Window.orderBy(cap / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    level = ranked.withColumns(
        {
            "all": F.sum("source_size").over(every).cast("double"),
            "capped": F.sum(cap).over(upto),
            "left": F.sum("w").over(every) - F.sum("w").over(upto),
        }
    )
    # the level after capping this source and all before it; the sources to cap are those below the level that holds before them
    level = level.withColumn("before", (F.col("all") - F.col("capped") + cap) / (F.col("left") + F.col("w")))
    level = level.withColumn("is_capped", cap <= F.col("before") * F.col("w"))
    # it falls from the first source that stays below its cap on
    final = F.max(F.when(~F.col("is_capped"), F.col("before"))).over(every)
    return level.withColumn("target", F.when(F.col("is_capped"), cap).otherwise(final * F.col("w"))).select("source", "src", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source_size, target, taken, whole_epochs (how often all of the source is taken) and the columns to carry."""
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            random_key(F.col(id_col), seed=seed).alias("key"),
            *carry,
        ),
        "mix-sizes",
    )
    targets = stage(source_targets(sized, weights, epochs), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    targets = F.broadcast(targets) if small else targets.hint("merge")
    keyed = sized.withColumnRenamed("source", "_source").join(targets, F.col("_source").eqNullSafe(F.col("source")))
    keyed = keyed.select("id", "size", "key", "src", "source_size", "target", *carry)
    placed = prefix_sum(keyed, "src", "key", "size", "before", sized.count(), ties=("id", "size"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"), whole.alias("whole_epochs"), *carry,
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("whole_epochs")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken: the part of the boundary document counts as a copy from half its size on."""
    # rows are joined by a key of their own: where ids repeat, each row has its own count
    rows = stage(wrapped(docs), "mix-rows")
    parts = rows.select("_row", *[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "text", "source")])
    taken = mix(parts, carry=("_row",)).where("taken > 0").select("_row", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("_copies")).where("_copies > 0")
    joined = rows.join(taken.hint("merge"), "_row")
    return joined.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 15))::BIGINT AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source
), ranked AS (
  SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM totals
), weighed AS (
  SELECT *, 3 * s AS cap, CASE src % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM ranked
), lvl AS (
  SELECT *, (sum(s) OVER () - sum(cap) OVER u + cap) / (sum(w) OVER () - sum(w) OVER u + w) AS before
  FROM weighed WINDOW u AS (ORDER BY cap / w, src ROWS UNBOUNDED PRECEDING)
), capped AS (
  SELECT *, cap <= before * w AS is_capped FROM lvl
), targets AS (
  SELECT source, s::BIGINT AS source_size,
         CASE WHEN is_capped THEN cap ELSE w * max(CASE WHEN NOT is_capped THEN before END) OVER () END AS target
  FROM capped
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM placed
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM parts
"""
