"""SimHash near-dedup with covering locality-sensitive hashing.

A 64-bit fingerprint is the majority of the XXH64 hashes of a text's word
shingles. Fingerprints within `radius` differing bits link. Each bit gets a
nonzero vector of radius + 1 binary digits; the mask of a table v keeps the bits
whose vector has an odd product with v. Any `radius` bits have vectors that some
v is orthogonal to, so a pair within the radius agrees on the mask of some table:
the 2^(radius+1) - 1 tables miss no pair.

Work is done on distinct fingerprints. In a bucket of up to `pairwise` of them the
pairs are compared in a join. Fingerprints of larger buckets are compared through
their one-bit neighbours instead: two fingerprints are within two bits exactly
when they share a neighbour, and 65 neighbours each are linear in the input, so
no bucket is capped and no pair is lost.

Defined results: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; equal ids or rows repeat in
the result as often as in the input; null ids stay out of the choice of the
component's name unless all are null; very long texts are hashed whole, a slice of
shingles at a time; an empty table gives an empty result. Other columns play no part,
whatever their names.

The pipeline's stage links texts by the exact Jaccard similarity of their five-word
shingles instead, 0.8 or more (`similar_rows`): fingerprints give candidates within
the radius, a prefix join (`shingle_join`) all pairs beyond it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from wharfline.llm.common import chunks, discard, documents, join_per_key, stage, with_keys, wrapped
from wharfline.llm.components import connected_components
from wharfline.llm.shingle_join import crossing_pairs, dealt_pairs, shared_prefixes, similar, star_pairs, summaries
from wharfline.llm.shingles import majority, shingle_hashes

SHINGLE = 3
RADIUS = 2
#: Words of a shingle where the pipeline compares texts.
STAGE_SHINGLE = 5
#: Buckets of up to this many distinct fingerprints are compared pair by pair.
PAIRWISE = 24


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, shingle: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([fingerprint(x, shingle) for x in texts], pa.int64())], ["id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("fp", LongType())])
    return rows.mapInArrow(partial(_fingerprints, id_type=to_arrow_type(kind), shingle=shingle), schema)


def covering_masks(radius: int = RADIUS, seed: int = 42) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, as signed longs."""
    order = list(range(64))
    random.Random(seed).shuffle(order)
    tables = (1 << (radius + 1)) - 1
    vector = {bit: 1 + k % tables for k, bit in enumerate(order)}
    masks = [sum(1 << bit for bit in range(64) if (vector[bit] & v).bit_count() % 2) for v in range(1, tables + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_pairs(reps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """reps (fp, rep), fp distinct, staged -> (u, v): pairs of reps that hold together every set linked within the radius."""
    if radius != 2:
        raise ValueError("the neighbour form for large buckets is written for radius 2")
    keyed = reps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))])).alias("_b")
    ).select("_b.t", "_b.key", "fp", "rep")
    sizes = stage(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    shared = stage(join_per_key(keyed, sizes, ["t", "key"], "n", reps.count()), "simhash-buckets")
    few = shared.where(F.col("n") <= pairwise)
    pairs = (
        few.alias("a")
        .join(
            few.alias("b").hint("merge"),
            (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius),
        )
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    )
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)]
    stars = (
        shared.where(F.col("n") > pairwise).select("fp", "rep").distinct()
        .select("rep", F.explode(F.array(*flips)).alias("z"))
        .groupBy("z").agg(F.min("rep").alias("u"), F.collect_list("rep").alias("_members"))  # 65 neighbours at most
        .where(F.size("_members") > 1)
        .select("u", F.explode("_members").alias("v"))
        .where("u <> v")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """id, fp (signed long), component (smallest id reachable) of every row."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = stage(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "fingerprint-reps")
    named = reps.where(F.col("rep").isNotNull())
    found = connected_components(linked_pairs(named, radius, pairwise))
    classes = reps.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(classes.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def similar_rows(rows: DataFrame, text_col: str = "text", shingle: int = STAGE_SHINGLE, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """rows with a distinct long `_row`, staged -> (node, component) of the rows linked by a similarity of 0.8 or more, rows without a link left out.

    Fingerprints within the radius and the least row of each shared prefix shingle
    give first candidates, linear in the input. What they link isn't compared
    again; of all other pairs that share a prefix shingle a few for each row are
    compared first, and then all that are still apart.
    """
    texts = rows.select(F.col("_row").alias("row"), F.col(text_col).alias("text"))
    prints, counts = summaries(texts, shingle)
    reps = stage(prints.groupBy("fp").agg(F.min("row").alias("rep")), "stage-reps")
    equal = prints.join(reps.hint("merge"), "fp").where("row <> rep").select(F.col("rep").alias("u"), F.col("row").alias("v"))
    within = linked_pairs(reps, radius, pairwise).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    shared = shared_prefixes(texts, counts, shingle)
    first = stage(equal.unionByName(within).unionByName(star_pairs(shared)).distinct(), "first-pairs")
    links = similar(first, prints, texts, shingle)
    dealt = stage(dealt_pairs(shared, connected_components(links), first), "dealt-pairs")
    held = similar(dealt, prints, texts, shingle)
    rest = stage(crossing_pairs(shared, connected_components(links.unionByName(held)), first.unionByName(dealt)), "rest-pairs")
    for used in (shared, first, dealt, reps):
        discard(used)
    more = similar(rest, prints, texts, shingle)
    discard(rest)
    found = connected_components(links.unionByName(held).unionByName(more))
    for used in (links, held, more):
        discard(used)
    return found


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of similar texts the row with the least id; null ids come last, and rows are told apart by a key of their own."""
    rows = stage(wrapped(docs), "near-rows")
    found = stage(similar_rows(rows.select("_row", F.col(f"_doc.`{text_col}`").alias("text"))), "near-groups")
    named = found.join(rows.select("_row", F.col(f"_doc.`{id_col}`").alias("_id")).hint("merge"), F.col("node") == F.col("_row"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_row")).alias("_first")
    kept = named.groupBy("component").agg(first).select(F.col("_first._row").alias("node"))
    dropped = stage(found.join(kept.hint("merge"), "node", "left_anti").select(F.col("node").alias("_row")), "near-dropped")
    return with_keys(rows, dropped, "_row", "left_anti").select("_doc.*")
