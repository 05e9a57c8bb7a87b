"""All pairs of shingle sets with a Jaccard similarity of 0.8 or more, by a prefix join.

Shingles stand in one order for all sets. Of two sets that similar, the first
n - ceil(0.8 n) + 1 shingles of each hold a shingle of the other's: no pair is missed,
whatever the order. Rare shingles come first, so few sets meet. How rare a shingle is
is read from counts of 2^17 hash ranges: a fixed size to broadcast, and since it only
settles the order, its errors cost time and no pair.

A set whose shingles are nearly all frequent still meets many others. Hot shingles are
joined to their centre by a broadcast: the row that has fewest rarer shingles, as edits make
rare ones. The join of what isn't linked yet is a sort-merge join, which Spark splits where
one shingle is hot.

Candidates are first compared by sketches: for each of 2^11 hash values whether the set
holds an odd number of shingles there. Bits that differ are at most as many as shingles that
one set alone holds, so a pair whose sketches differ in more than the similarity allows is out
for certain, and whole sets are built and shuffled for the other pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.llm.common import HOT_PART, HOT_ROWS, chunks, discard, join_per_key, stage, with_keys
from wharfline.llm.shingles import shingle_set

COUNT_BITS = 17
#: Bits of a set's sketch, 8 bytes for 64 of them.
SKETCH_BITS = 1 << 11


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls on each bit, as longs."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _summaries(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    counts, shift = np.zeros(1 << COUNT_BITS, np.int64), np.uint64(64 - COUNT_BITS)

    def columns(rows: list | None, prints: list | None, sketches: list | None, ranges: np.ndarray | None, n: np.ndarray | list) -> pa.RecordBatch:
        kinds = (rows, pa.int64()), (prints, pa.int64()), (sketches, pa.list_(pa.int64())), (ranges, pa.int32()), (n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), k) if x is None else pa.array(x, k) for x, k in kinds], ["row", "fp", "sketch", "range", "n"])

    for rows, texts in chunks(batches):
        prints, sketches, sizes = [], [], []
        for text in texts:
            fp, hashes = shingle_set(text, shingle)
            prints.append(fp)
            sketches.append(sketch(hashes))
            sizes.append(len(hashes))
            ranges, n = np.unique((hashes >> shift).astype(np.int32), return_counts=True)
            counts[ranges] += n
        yield columns(rows, prints, sketches, None, sizes)
    ranges = np.flatnonzero(counts)
    yield columns(None, None, None, ranges, counts[ranges])


def summaries(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """texts (row, text) -> (row, fp, sketch, n shingles), and (range, n): how many shingles of all sets fall in each hash range. Each task adds up its own ranges."""
    kind = "row long, fp long, sketch array<long>, range int, n long"
    both = stage(texts.mapInArrow(partial(_summaries, shingle=shingle), kind), "shingle-summaries")
    ranges = both.where("range is not null").groupBy("range").agg(F.sum("n").alias("n"))
    return both.where("range is null").select("row", "fp", "sketch", "n"), ranges


def _prefixes(batches: Iterator[pa.RecordBatch], shingle: int, counts: Broadcast, many: int) -> Iterator[pa.RecordBatch]:
    table, shift = counts.value, np.uint64(64 - COUNT_BITS)
    for rows, texts in chunks(batches):
        sets = [shingle_set(text, shingle)[1] for text in texts]
        n, ids, hashes = np.fromiter(map(len, sets), np.int64, len(sets)), np.array(rows, np.int64), np.concatenate(sets)
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, table[hashes >> shift], of))
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        taken = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
        of = of[taken]
        prefix = hashes[order][taken]
        yield pa.RecordBatch.from_arrays(
            [pa.array(prefix.view(np.int64)), pa.array(ids[of]), pa.array(n[of].astype(np.int32)), pa.array(place[taken].astype(np.int32)), pa.array(table[prefix >> shift] > many)],
            ["shingle", "row", "n", "place", "busy"],
        )


def shared_prefixes(texts: DataFrame, ranges: DataFrame, shingle: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """texts (row, text) -> (shingle, row, n, place, least, least_n) of the prefix shingles that two rows or more hold; `least`: the row with the least place.

    A shingle of a hash range with few shingles is held by few rows, so a window finds that row with one shuffle.
    Those of busy ranges are aggregated with map-side combination first, and the hot ones among them broadcast.
    """
    found = ranges.toArrow()  # 2^17 rows of 12 bytes at most
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[found.column("range").to_numpy()] = found.column("n").to_numpy()
    counts = texts.sparkSession.sparkContext.broadcast(table)
    many = max(hot_rows, int(table.sum()) // 5 // HOT_PART)  # a prefix is a fifth of a set
    held = stage(texts.mapInArrow(partial(_prefixes, shingle=shingle, counts=counts, many=many), "shingle long, row long, n int, place int, busy boolean"), "prefixes")
    own, least_of = ["shingle", "row", "n", "place"], F.min(F.struct("place", "row", "n"))
    group = Window.partitionBy("shingle")
    calm = held.where("not busy").select(*own, least_of.over(group).alias("_l"), F.count("*").over(group).alias("_c")).where("_c > 1")
    calm = calm.select(*own, F.col("_l.row").alias("least"), F.col("_l.n").alias("least_n"))
    busy = held.where("busy").select(*own)
    least = busy.groupBy("shingle").agg(least_of.alias("_l"), F.count("*").alias("_c")).where("_c > 1")
    least = stage(least.select("shingle", F.col("_l.row").alias("least"), F.col("_l.n").alias("least_n"), "_c"), "least-rows")
    shared = stage(calm.unionByName(join_per_key(busy, least, ["shingle"], "_c", held.count(), hot_rows).drop("_c")), "shared-prefixes")
    counts.destroy()
    discard(held)
    discard(least)
    return shared


def near_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def star_pairs(shared: DataFrame) -> DataFrame:
    """(u, v): each row with the least edited row of each of its shingles."""
    pairs = shared.where((F.col("row") != F.col("least")) & near_in_size(F.col("n"), F.col("least_n")))
    return pairs.select(F.least("least", "row").alias("u"), F.greatest("least", "row").alias("v")).distinct()


#: How often the rows of a shingle are dealt into twos before all of them are compared.
DEALS = 12


def _mixed(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows, with their components, of shingles that rows of several components hold; `held`: how many rows hold it."""
    named = shared.join(linked.hint("merge"), F.col("row") == F.col("node"), "left").select("shingle", "row", "n", "place", F.coalesce("component", "row").alias("component"))
    named = stage(named, "named-prefixes")
    mixed = named.groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("held")).where("_a < _b").select("shingle", "held")
    mixed = stage(named.join(mixed.hint("merge"), "shingle"), "mixed-prefixes")
    discard(named)
    return mixed


def dealt_pairs(shared: DataFrame, linked: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v): the rows of each mixed shingle dealt into groups of about two, some times over: a few pairs for each row. What they link holds most of a large group
    of copies together, whose pairs needn't all be compared then. A group's pair is a least and a greatest row, so nothing is gathered."""
    mixed = _mixed(shared, linked)
    side = F.struct("row", "component", "n")
    turns = mixed.select("shingle", "held", side.alias("side"), F.explode(F.sequence(F.lit(1), F.lit(DEALS))).alias("turn"))
    group = F.pmod(F.xxhash64("side.row", "turn"), F.greatest(F.floor(F.col("held") / 2), F.lit(1)))
    met = turns.groupBy("shingle", "turn", group.alias("_g")).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    met = met.where((F.col("a.component") != F.col("b.component")) & near_in_size(F.col("a.n"), F.col("b.n")))
    pairs = met.select(F.col("a.row").alias("u"), F.col("b.row").alias("v")).distinct()
    return pairs.join(tried.hint("merge"), ["u", "v"], "left_anti")


def crossing_pairs(shared: DataFrame, linked: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v) of all rows that share a prefix shingle, can be similar by their sizes, aren't linked (node, component) and aren't in `tried`."""
    mixed = _mixed(shared, linked)
    a, b = mixed.alias("a"), mixed.alias("b")
    # at the first shingle two sets share, all they can have in common comes from there on
    common = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    met = a.join(
        b.hint("merge"),
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.component") != F.col("b.component"))
        & near_in_size(F.col("a.n"), F.col("b.n")) & (common * 9 >= (F.col("a.n") + F.col("b.n")) * 4),
    )
    return met.select(F.col("a.row").alias("u"), F.col("b.row").alias("v")).distinct().join(tried.hint("merge"), ["u", "v"], "left_anti")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        sets = [shingle_set(text, shingle)[1].view(np.int64) for text in texts]
        sizes = [len(s) for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), lists], ["row", "n", "set"])


def _paired(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """pairs (u, v) with the columns of sides (row, ...) for both, named with _u and _v."""
    u, v = (sides.select(F.col("row").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in sides.columns if x != "row"]) for c in "uv")
    return pairs.join(u.hint("merge"), "u").join(v.hint("merge"), "v")


def _rows_of(pairs: DataFrame) -> DataFrame:
    return stage(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "paired-rows")


def similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The staged pairs (u, v), staged again, whose texts have sets with a Jaccard similarity of 0.8 or more. Sets are built for pairs alone that sketches don't rule out."""
    wanted = _rows_of(pairs)
    both = _paired(pairs, with_keys(prints.select("row", "n", "sketch"), wanted, "row", "left_semi"))
    total = F.col("n_u") + F.col("n_v")
    apart = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    left = stage(both.where(near_in_size(F.col("n_u"), F.col("n_v")) & (apart * 9 <= total)).select("u", "v"), "pairs-by-sketch")
    discard(wanted)
    wanted = _rows_of(left)
    sets = stage(with_keys(texts, wanted, "row", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "row long, n int, set array<long>"), "shingle-sets")
    out = stage(_paired(left, sets).where(F.size(F.array_intersect("set_u", "set_v")) * 9 >= total * 4).select("u", "v"), "links")
    for used in (wanted, left, sets):
        discard(used)
    return out
