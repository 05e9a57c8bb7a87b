"""What the operators share: staging, folds, distributed prefix sums, text chunks."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java regex of one white-space character and of a word, as the contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Random keys are uniform over this many bits.
KEY_BITS = 60
#: Rows that a range of a prefix sum holds about.
RANGE_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a default of our own only where none is set and there is one machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "/tmp/wharfline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and
    gives Spark true sizes. The path is kept on the result for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def wrapped(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct `_doc` with a key of their own, `_row`: no name of theirs can clash, and repeated or null ids don't matter."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row"))


#: A key is hot when more rows than this hold it, and more than a part in this many of all rows.
HOT_ROWS, HOT_PART = 20_000, 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows to a table with a row for each key, where column `n` says how many rows hold the key. The hot keys
    (`HOT_PART` at most, as each holds that part of all rows) are broadcast, so their rows stay where they are; the others are shuffled."""
    bound = max(hot_rows, total // HOT_PART)
    hot = F.broadcast(per_key.where(F.col(n) > bound))
    rest = rows.join(F.broadcast(per_key.where(F.col(n) > bound).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(per_key.where(F.col(n) <= bound).hint("merge"), keys))


#: Distinct keys of 8 bytes that are broadcast at most.
BROADCAST_KEYS = 1 << 20


def with_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of rows to a staged table of distinct long keys. Up to `BROADCAST_KEYS` of them are broadcast, so that the rows stay where they are; more are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), key, how)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def random_key(*cols: Column, seed: str = "") -> Column:
    """A uniform, reproducible 60-bit key from the columns, the same in any SQL engine that has md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat(*parts, F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_sum(df: DataFrame, group: str, key: str, value: str, out: str, rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come
    before this one in the order of `key` and `ties`.

    Keys are random, so their leading bits cut every group into equal ranges.
    One task sorts a range and no task sees a group; the sums of the ranges
    (2^bits rows a group at most, one for each RANGE_ROWS rows of df) give each
    range its offset. df is read twice, so it has to be a staged table.
    """
    bits = min(24, max(0, math.ceil(math.log2(max(rows, 1) / RANGE_ROWS))))
    df = df.withColumn("_range", F.shiftright(F.col(key), KEY_BITS - bits).cast("int"))
    sums = df.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group), F.col("_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets.hint("merge"), [group, "_range"])
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_range", "_inside", "_offset")
    )


def give_back() -> None:
    """Workers are kept between tasks: what a task no longer holds goes back to the system, from Arrow's pool, Python's free lists and, where there is one, glibc's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator, limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of some rows of two-column Arrow batches, about `limit`
    characters at a time; null texts are empty. A longer text comes alone."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if held and held + len(text) > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
                pa.default_memory_pool().release_unused()
            ids.append(key)
            texts.append(text)
            held += len(text) + 64
    if ids:
        yield ids, texts
    del ids, texts
    give_back()
