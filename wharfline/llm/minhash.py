"""MinHash near-dedup with HyperMinHash registers.

A document's set are the XXH64 hashes of its distinct word shingles. A hash's leading
bits choose one of 128 buckets; a bucket's register keeps the least of the remaining
bits in 16: the number of leading zeros (6 bits) and the bits after the first one (10).
A bucket without a hash takes the register of the first filled bucket in an order of
its own, the same for all sets, so that small sets have full rows too and two sets agree
on a register about as often as their Jaccard similarity says.

Registers stand in 32 bands of 4. Sets that agree on a band meet in a bucket of the
band; at a similarity of 0.8 a pair shares none with a probability of
(1 - 0.8^4)^32 = 5e-8. Pairs are first compared by their registers: the share of equal
ones, less what two unlike hashes give by chance, estimates the similarity, and pairs
below `LEAST_ESTIMATE` (over five standard deviations under 0.8) go. All others are
confirmed on their full sets.

Work is done on distinct sets, so copies meet once. A bucket's centre is the set whose
buckets hold most sets in all: among edited copies the one closest to their origin. A set
is compared with two centres, one that it shares most bands with and the most central one,
and what those pairs link isn't compared again. Buckets that still hold different
components are compared in full, by a prefix filter that is exact: of two sets that
similar, the rarest fifth of each holds a hash of the other's, and enough can follow it.
Edits are rare, so few heavily edited copies of one text meet there; those that share a hash
are dealt into twos first, some times over; then each meets some sets of its hash that have fewest
rarer hashes, the least edited ones, and what that links isn't compared again. Keys with very
many rows are broadcast, not shuffled.

Defined results: fewer words than a shingle make one shingle; null and wordless texts have
an empty set and are linked with nothing, not even each other; equal ids or rows repeat in
the result as often as in the input; a component is named by its least id that isn't null,
and its null ids only have null as a name where there is no other; very long texts are
hashed whole; an empty table gives an empty result. Other columns play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from wharfline.llm.common import HOT_ROWS, chunks, discard, documents, join_per_key, stage, with_keys
from wharfline.llm.components import connected_components
from wharfline.llm.shingles import shingle_hashes

SHINGLE = 4
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Registers of a band, 16 bits each, are one 64-bit number.
BAND = 4
LEAST_ESTIMATE = 0.6
#: Hashes are ordered by how many fall in the same of 2^19 ranges.
COUNT_BITS = 19
_REST = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
_EXACT = 53  # bits that a double holds
#: A bucket's own register comes first.
_PROBES = np.stack([np.append(k, np.random.default_rng(k).permutation(np.delete(np.arange(BUCKETS), k))) for k in range(BUCKETS)])
_SALTS = np.random.default_rng(42).integers(0, 1 << 64, BUCKETS // BAND, np.uint64)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in order; none for a wordless text."""
    slices = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a set that isn't empty; its hashes stand in order."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the least hash of each bucket
    fraction, exponent = np.frexp(((hashes[first] & _REST) >> np.uint64(64 - BUCKET_BITS - _EXACT)).astype(np.float64))
    mantissa = np.maximum(np.ldexp(fraction, MANTISSA_BITS + 1) - (1 << MANTISSA_BITS), 0).astype(np.int64)
    out, filled = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[bucket[first]] = (_EXACT - exponent) << MANTISSA_BITS | mantissa
    filled[bucket[first]] = True
    return out if filled.all() else out[_PROBES[np.arange(BUCKETS), filled[_PROBES].argmax(1)]]


def bands(packed: np.ndarray) -> np.ndarray:
    """A key for each band of rows of registers: a one-to-one mix of its bits, another one for each band."""
    keys = (packed.view("<u8") ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the share of equal registers. Unlike sets have equal ones by chance: least values with rates n_a and n_b fall in one
    cell, whose width is a 2^-10 part of the power of two below it, with probability 2^-10 n_a n_b / (n_a + n_b)^2 / (2 ln 2), the mean over scales."""
    chance = 2.0**-MANTISSA_BITS * n_a * n_b / (n_a + n_b) ** 2 / (2 * np.log(2))
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _prints(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, shingle: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches):
        n, digests, regs = [], [], []
        for text in texts:
            hashes = shingle_set(text, shingle)
            n.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            regs.append(registers(hashes).astype("<u2").tobytes() if len(hashes) else None)
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(n, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(regs, pa.binary())], ["id", "n", "d1", "d2", "regs"]
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = bands(np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, BUCKETS))
        nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS) for c in ("regs_u", "regs_v"))
        likely = estimates(a, b, batch.column("n_u").to_numpy().astype(float), batch.column("n_v").to_numpy().astype(float)) >= LEAST_ESTIMATE
        likely &= (bands(a) == bands(b)).any(axis=1)
        yield batch.select(["u", "v"]).filter(pa.array(likely))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches):
        sets = [shingle_set(text, shingle) for text in texts]
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["d1", "d2", "set"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - COUNT_BITS), minlength=len(counts))
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["range", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: Broadcast) -> Iterator[pa.RecordBatch]:
    """Each set's hashes, the rarest ranges first, up to where a similar set must have had one of them: hash, node, n, place."""
    for batch in batches:
        hashes, n = batch.column("set").flatten().to_numpy().view(np.uint64), batch.column("n").to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, counts.value[hashes >> np.uint64(64 - COUNT_BITS)], of))
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        taken = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
        of = of[taken]
        nodes = batch.column("node").to_numpy()[of]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[order][taken].view(np.int64)), pa.array(nodes), pa.array(n[of].astype(np.int32)), pa.array(place[taken].astype(np.int32))], ["hash", "node", "n", "place"]
        )


def _paired(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """pairs (u, v) with the columns of sides (node, ...) for both, named with _u and _v."""
    u, v = (sides.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in sides.columns if x != "node"]) for c in "uv")
    return pairs.join(u.hint("merge"), "u").join(v.hint("merge"), "v")


def _near_in_size(a: str, b: str) -> F.Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def full_sets(sets: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """node, n and the whole set of the staged nodes. Texts are found by their ids' hashes, and told apart by the digests of their sets."""
    wanted = stage(with_keys(sets.select("node", "d1", "d2", "n", F.xxhash64("id").alias("named")), nodes, "node", "left_semi"), "minhash-wanted")
    named = stage(wanted.select("named").distinct(), "minhash-named")
    found = with_keys(texts.withColumn("named", F.xxhash64("id")), named, "named", "left_semi").select("id", "text")
    built = found.mapInArrow(partial(_sets, shingle=shingle), "d1 long, d2 long, set array<long>").groupBy("d1", "d2").agg(F.first("set").alias("set"))
    full = stage(built.join(wanted.hint("merge"), ["d1", "d2"]).select("node", "n", "set"), "minhash-full")
    discard(wanted)
    discard(named)
    return full


def confirmed(pairs: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """Of pairs (u, v), staged, those whose registers and then whole sets are similar, staged."""
    nodes = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "minhash-nodes")
    both = _paired(pairs, with_keys(sets.select("node", "n", "regs"), nodes, "node", "left_semi"))
    likely = stage(both.where(_near_in_size("n_u", "n_v")).mapInArrow(_estimated, "u long, v long"), "minhash-likely")
    discard(nodes)
    nodes = stage(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "minhash-nodes")
    common = F.size(F.array_intersect("set_u", "set_v"))
    out = _paired(likely, with_keys(full, nodes, "node", "left_semi")).where(common * 9 >= (F.col("n_u") + F.col("n_v")) * 4)  # 100 i >= 80 (n_u + n_v - i)
    out = stage(out.select("u", "v"), "minhash-links")
    for used in (nodes, likely):
        discard(used)
    return out


def centre_pairs(shared: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """(u, v): each set with the centre that it shares most bands with, and with its most central one. shared: key, node, members."""
    degrees = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = shared.join(degrees.hint("merge"), "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("c"), F.count("*").alias("members"))
    centres = stage(centres.select("key", "members", F.col("c.degree").alias("degree"), F.col("c.node").alias("centre")), "minhash-centres")
    near = join_per_key(shared.select("key", "node"), centres, ["key"], "members", total, hot_rows).where("node <> centre")
    chosen = near.groupBy("node").agg(F.array(F.mode("centre", True), F.max_by("centre", F.struct("degree", "centre"))).alias("c"))
    return chosen.select("node", F.explode(F.array_distinct("c")).alias("c")).select(F.least("c", "node").alias("u"), F.greatest("c", "node").alias("v")).distinct()


def mixed_prefixes(shared: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """(hash, node, n, place, component, held) of the prefixes of all sets of mixed buckets, for the hashes that sets of several components (node, component) hold; `held`: how many do. Staged."""
    spark = full.sparkSession
    named = stage(shared.select("key", "node").join(found.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "minhash-components")
    mixed = named.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("key")
    nodes = stage(named.join(mixed.hint("merge"), "key").select("node", "component").distinct(), "minhash-mixed")
    sets = stage(with_keys(full, nodes.select("node"), "node", "left_semi"), "minhash-mixed-sets")
    ranges = sets.select("set").mapInArrow(_ranges, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).toArrow()  # 2^19 rows of 12 bytes at most
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[ranges.column("range").to_numpy()] = ranges.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(table)
    held = stage(sets.mapInArrow(partial(_prefixes, counts=counts), "hash long, node long, n int, place int").join(nodes.hint("merge"), "node"), "minhash-prefixes")
    counts.destroy()
    met = stage(_of_several(held), "minhash-met")
    for used in (named, nodes, sets, held):
        discard(used)
    return met


def _of_several(held: DataFrame) -> DataFrame:
    """The rows of hashes that sets of several components hold, with `held`."""
    several = held.groupBy("hash").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("held")).where("_a < _b").select("hash", "held")
    return held.join(several.hint("merge"), "hash")


def _can_be_near(a: str, b: str) -> F.Column:
    """Where two sets share their first hash, all they can have in common comes from there on."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (F.col(f"{a}.component") != F.col(f"{b}.component")) & _near_in_size(n_a, n_b) & (common * 9 >= (n_a + n_b) * 4)


#: How often the sets of a hash are dealt into twos before all of them are compared.
DEALS = 12


def dealt_pairs(met: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v): the sets of each hash of mixed_prefixes dealt into groups of about two, some times over: a few pairs for each set. What they link holds most of a
    large group of edited copies together, whose pairs needn't all be compared then. A group's pair is its least and its greatest set, so nothing is gathered."""
    side = F.struct("node", "component", "n", "place")
    turns = met.select("hash", "held", side.alias("side"), F.explode(F.sequence(F.lit(1), F.lit(DEALS))).alias("turn"))
    group = F.pmod(F.xxhash64("side.node", "turn"), F.greatest(F.floor(F.col("held") / 2), F.lit(1)))
    met_two = turns.groupBy("hash", "turn", group.alias("group")).agg(F.min("side").alias("a"), F.max("side").alias("b")).where(_can_be_near("a", "b"))
    pairs = met_two.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    return stage(pairs.join(tried.hint("merge"), ["u", "v"], "left_anti"), "minhash-dealt")


def still_mixed(met: DataFrame, found: DataFrame) -> DataFrame:
    """mixed_prefixes again, by the components (node, component) of the links so far. Staged."""
    named = met.drop("component", "held").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named, "minhash-met-named")
    mixed = stage(_of_several(named), "minhash-met-mixed")
    discard(named)
    return mixed


#: Least edited sets of a hash that the others meet before all of them are compared.
CENTRES = 8


def central_pairs(met: DataFrame, found: DataFrame, tried: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(u, v): each set of mixed_prefixes with those of its hash that have fewest rarer hashes, one for each of `CENTRES` parts of the sets, where they aren't linked
    (node, component): edits make rare hashes, so these are closest to what all are copies of. Few pairs for each set, whatever the size of the group; staged."""
    mixed = still_mixed(met, found)
    rows = mixed.select("hash", F.struct("place", "node", "component", "n").alias("a"))
    part = F.pmod(F.xxhash64("a.node"), F.lit(CENTRES))
    centres = rows.groupBy("hash", part.alias("part")).agg(F.min("a").alias("b"), F.count("*").alias("held")).groupBy("hash").agg(F.collect_list("b").alias("b"), F.sum("held").alias("held"))
    centres = stage(centres, "minhash-least-edited")
    near = join_per_key(rows, centres, ["hash"], "held", mixed.count(), hot_rows).select("a", F.explode("b").alias("b")).where(_can_be_near("a", "b"))
    pairs = near.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    out = stage(pairs.join(tried.hint("merge"), ["u", "v"], "left_anti"), "minhash-central")
    discard(mixed)
    discard(centres)
    return out


def crossing_pairs(met: DataFrame, found: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v) of all sets of mixed_prefixes that aren't linked (node, component), pass the prefix filter and aren't in `tried`; staged."""
    mixed = still_mixed(met, found)
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = a.join(b.hint("merge"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.node") < F.col("b.node")) & _can_be_near("a", "b"))
    out = stage(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(tried.hint("merge"), ["u", "v"], "left_anti"), "minhash-rest")
    discard(mixed)
    return out


def linked_sets(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Staged distinct sets (node, id, d1, d2, n, regs) -> (node, component) of those that are linked."""
    keyed = sets.select("node", "regs").mapInArrow(_bands, "key long, node long")
    total = sets.count() * (BUCKETS // BAND)
    buckets = stage(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "minhash-buckets")
    shared = stage(join_per_key(keyed, buckets, ["key"], "members", total, hot_rows), "minhash-shared")
    nodes = stage(shared.select("node").distinct(), "minhash-shared-nodes")
    full = full_sets(sets, nodes, texts, shingle)
    first = stage(centre_pairs(shared, total, hot_rows), "minhash-first")
    links = confirmed(first, sets, full)
    met = mixed_prefixes(shared, connected_components(links), full)
    dealt = dealt_pairs(met, first)
    held = confirmed(dealt, sets, full)
    linked, tried = links.unionByName(held), first.unionByName(dealt)
    central = central_pairs(met, connected_components(linked), tried, hot_rows)
    again = confirmed(central, sets, full)
    rest = crossing_pairs(met, connected_components(linked.unionByName(again)), tried.unionByName(central))
    more = confirmed(rest, sets, full)
    out = connected_components(linked.unionByName(again).unionByName(more))
    for used in (buckets, shared, nodes, full, first, met, dealt, central, rest, links, held, again, more):
        discard(used)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, n_shingles, component_id (least id reachable), kept of every row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("n", IntegerType()), StructField("d1", LongType()), StructField("d2", LongType()), StructField("regs", BinaryType())])
    prints = stage(texts.mapInArrow(partial(_prints, id_type=to_arrow_type(kind), shingle=shingle), schema), "minhash-prints")
    sets = prints.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    found = linked_sets(sets, texts, shingle, hot_rows)
    named = stage(
        sets.select("node", "d1", "d2", "docs", "id").join(found.hint("merge"), "node", "left").select("d1", "d2", "docs", "id", F.coalesce("component", "node").alias("component")),
        "minhash-named-sets",
    )
    names = named.groupBy("component").agg(F.min("id").alias("name"), F.count("*").alias("members"))
    classes = stage(join_per_key(named.drop("id"), names, ["component"], "members", sets.count(), hot_rows).select("d1", "d2", "docs", "name"), "minhash-classes")
    rows = prints.where("n > 0").select("id", "n", "d1", "d2")
    out = join_per_key(rows, classes, ["d1", "d2"], "docs", prints.count(), hot_rows).select("id", "n", "name")
    return out.unionByName(prints.where("n = 0").select("id", "n", F.col("id").alias("name"))).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("component_id"), F.col("id").eqNullSafe(F.col("name")).alias("kept")
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
