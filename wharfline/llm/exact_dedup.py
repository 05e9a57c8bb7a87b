"""Exact dedup with a split of heavy hitters.

Two texts are equal when they are identical after each run of white space
became one space. A frequent-items sketch of the Misra-Gries family (Spark's
approx_top_k: a bounded number of counters for each task, merged) proposes
frequent digests. An exact count over all rows verifies them. The verified
winners, a bounded table, are broadcast: copies of a heavy digest are decided on
the map side and only its winner goes on. All other digests are shuffled as usual:
least rows and sizes by an aggregation, which combines before the shuffle, and joined back
so that a digest with many rows isn't gathered either; whole rows are shuffled by
digest and id, for kept ones alone, so copies don't meet in a task.

Defined results: a null text counts as empty; very long texts are read whole; a null id
never wins over another id; of repeated rows (same id, equal text) one is kept, of equal
texts without any id too; an empty table gives an empty result. Other columns of the input
play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.llm.common import HOT_ROWS, SPACE, documents, join_per_key, stage

#: Digests proposed by the sketch (at most this many rows are broadcast), and its counters.
HEAVY = 256
COUNTERS = 4096
#: A digest is heavy from this many rows on.
HEAVY_ROWS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _digest, _row) of all rows, staged; _row tells repeated rows apart."""
    return stage(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest")).withColumn("_row", F.monotonically_increasing_id()), "digests")


def least_rows(digests: DataFrame) -> DataFrame:
    """(_digest, _least, _n): the row that stays and the number of rows."""
    return digests.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_row")).alias("_least"), F.count("*").alias("_n"))


def heavy_digests(digests: DataFrame, heavy: int, counters: int, heavy_rows: int) -> DataFrame:
    """least_rows() of the verified heavy hitters, at most `heavy` of them. digests: (_id, _digest, _row)."""
    proposed = digests.select(F.explode(F.expr(f"approx_top_k(_digest, {heavy}, {counters})")).alias("_t")).select(
        F.col("_t.item").alias("_digest")
    )
    candidates = stage(proposed, "heavy-candidates")
    return stage(least_rows(digests.join(F.broadcast(candidates), "_digest", "left_semi")).where(F.col("_n") >= heavy_rows), "heavy-winners")


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS, heavy_rows: int = HEAVY_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    base = digests_of(docs, id_col, text_col)
    winners = heavy_digests(base, heavy, counters, heavy_rows)
    rest = base.join(F.broadcast(winners), "_digest", "left_anti")
    least = stage(least_rows(rest), "least-rows")
    marked = base.join(F.broadcast(winners), "_digest").unionByName(join_per_key(rest, least, ["_digest"], "_n", base.count(), hot_rows))
    return marked.select(
        F.col("_id").alias(id_col),
        F.col("_least._id").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        (F.col("_row") == F.col("_least._row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """The kept rows with all their columns."""
    base = digests_of(docs, id_col, text_col)
    winners = heavy_digests(base, heavy, counters, heavy_rows)
    rest = base.join(F.broadcast(winners), "_digest", "left_anti")
    stays = winners.select("_digest", "_least._id").unionByName(least_rows(rest).select("_digest", "_least._id"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest"))
    beaten = winners.select("_digest", F.col("_least._id").alias("_keep"), F.lit(True).alias("_heavy"))
    row = row.join(F.broadcast(beaten), "_digest", "left").where(F.col("_heavy").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).select("_doc", "_id", "_digest")
    both = row.alias("a").join(stays.hint("merge").alias("b"), (F.col("a._digest") == F.col("b._digest")) & F.col("a._id").eqNullSafe(F.col("b._id")), "left_semi")
    # repeated rows alone still meet: same id, equal text
    first = Window.partitionBy("_digest", "_id").orderBy(F.lit(0))
    return both.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("_doc.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
