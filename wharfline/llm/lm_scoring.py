"""Language-model scores from a log-frequency Bloom filter.

All training tokens are counted: words exactly, and pairs of neighbouring words by a
64-bit key (32 bits of each word's hash). Pair counts, from 1 on, are quantised on a log
scale; level l of a pair is held as l members (pair, 1) to (pair, l) of a Bloom filter,
and a count is read by probing level after level until one is missing. A member sets five
bits in each of two 64-bit words of its block, at every level alike; with `BITS_A_MEMBER`
bits a member about one probe in 10,000 finds a member that isn't there.

P(word | previous) = (count - D) / c(previous) where the pair is in the filter, plus
the mass left over times the base probability of the word. c and the mass of the
frequent words are broadcast; those of all others come by a shuffled join.

The filter is made of blocks, and all members of a pair lie in one. Spark's tasks build
blocks apart. A filter of more than `FILTER_BITS` is broadcast in ranges of blocks, one
after the other: each range is a pass over the texts that scores the tokens whose pairs
lie in it, so all pairs are in the filter and scores don't depend on the bound.

Bounds of what is broadcast: `HOT` frequent words (the frequency a word is frequent from
is the lowest with which all fit), and `FILTER_BITS` of filter at a time. Words that
aren't frequent get their exact counts by a shuffled join; each of them has few training rows.

Defined results: a null text is empty and scores its end token; a null id counts as
the empty text for the fold; repeated rows are each counted and scored; very long texts
are read whole; an empty table gives an empty result; without training texts all tokens
are unknown. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from wharfline.llm.common import chunks, discard, documents, fold, stage

END = b"\n"  # no word holds white space
FOLDS = 10
HOT = 1 << 18
FILTER_BITS = 1 << 30
BLOCK_BITS = 20
BITS_A_MEMBER = 24
#: Counts up to this have a level each; from there on levels go in steps of the factor.
EXACT = 3
STEP = 1.4
DISCOUNT = 0.75
#: Pair keys that a task holds before it hands on their counts.
HELD_KEYS = 1 << 22
HELD_WORDS = 1 << 18


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def level_of(counts: np.ndarray) -> np.ndarray:
    above = np.floor(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(STEP) + 1e-9).astype(np.int64)
    return np.minimum(counts, EXACT) + above


def level_counts(levels: int) -> np.ndarray:
    """The count that each level stands for; 0 for none."""
    low = np.arange(1, levels + 2, dtype=float)
    low[EXACT:] = np.ceil(EXACT * STEP ** np.arange(1, len(low) - EXACT + 1) - 1e-9)
    return np.concatenate([[0.0], np.sqrt(low[:-1] * np.maximum(low[:-1], low[1:] - 1))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Both halves of a key are hashes; with an odd number of blocks both of them settle the remainder."""
    return keys.view(np.int64) % blocks


def _masks() -> np.ndarray:
    """2^16 words with five bits set."""
    h, masks = _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)), np.zeros(1 << 16, np.uint64)
    for k in range(12):
        few = np.bitwise_count(masks) < 5
        masks[few] |= np.uint64(1) << (_mix(h + np.uint64(k))[few] & np.uint64(63))
    return masks


MASKS = _masks()
#: 64-bit words of a block.
BLOCK_WORDS = 1 << (BLOCK_BITS - 6)


def _member(mixed: np.ndarray, level: int) -> np.ndarray:
    """30 bits of a member's hash say the first word and its mask, the next 30 the second; mixed: hashes of the keys."""
    return _mix(mixed + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))


def _half(member: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(word within the block, mask) of a member's first or second half."""
    h = member >> np.uint64(30 * half)
    return (h & np.uint64(BLOCK_WORDS - 1)).astype(np.int64), MASKS[(h >> np.uint64(BLOCK_BITS - 6)) & np.uint64(0xFFFF)]


def build_block(keys: np.ndarray, levels: np.ndarray) -> bytes:
    words, mixed = np.zeros(BLOCK_WORDS, np.uint64), _mix(keys)
    for level in range(1, int(levels.max(initial=0)) + 1):
        member = _member(mixed[levels >= level], level)
        for half in (0, 1):
            at, mask = _half(member, half)
            order = np.argsort(at.astype(np.uint16), kind="stable")
            at = at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] |= np.bitwise_or.reduceat(mask[order], first)
    return words.tobytes()


def read_levels(bits: np.ndarray, keys: np.ndarray, most: int, blocks: int = 0, first: int = 0) -> np.ndarray:
    """Levels of the keys: probes go on with level 1, 2, ... until a member is missing. bits: bytes of blocks, a row each, of `blocks` in all from the `first` on."""
    levels = np.zeros(len(keys), np.int64)
    mixed, flat, rows = _mix(keys), bits.reshape(-1).view(np.uint64), np.arange(len(keys))
    base = (block_of(keys, blocks or len(bits)) - first) * BLOCK_WORDS
    for level in range(1, most + 1):
        member = _member(mixed, level)
        for half in (0, 1):
            at, mask = _half(member, half)
            held = np.flatnonzero((flat[base + at] & mask) == mask)
            rows, base, mixed, member = rows[held], base[held], mixed[held], member[held]
        if not len(rows):
            break
        levels[rows] = level
    return levels


class Words:
    """The frequent words: index, hash, count and kept pair mass."""

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        self.index = {w: k for k, w in enumerate(words)}
        self.hash = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))
        self.count = counts.astype(np.float64)
        self.mass = np.zeros(len(words))
        self.history = self.count  # what pair counts are divided by

    def of(self, stream: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index, -1 for others; hash) of each token."""
        index = np.fromiter(map(self.index.get, stream, repeat(-1)), np.int64, len(stream))
        hashes = self.hash[index] if len(self.hash) else np.zeros(len(stream), np.uint64)
        cold = np.flatnonzero(index < 0)
        hashes[cold] = np.fromiter(map(xxhash.xxh32_intdigest, map(stream.__getitem__, cold.tolist())), np.uint64, len(cold))
        return index, hashes

    def pairs(self, stream: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, index of the token before, pair key) of each token; before the first stands an end."""
        index, hashes = self.of([END, *stream])
        return index[1:], index[:-1], (hashes[:-1] << np.uint64(32)) | hashes[1:]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(map(xxhash.xxh32_intdigest, held), pa.int64()), pa.array(held.values(), pa.int64())], ["token", "h", "n"])
    for _, texts in chunks(batches):
        for text in texts:
            held.update(tokens(text))
        if len(held) > HELD_WORDS:
            yield pack()
            held.clear()
    if held:
        yield pack()


def _count_pairs(batches: Iterator[pa.RecordBatch], words: Broadcast) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def pack() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for _, texts in chunks(batches):
        _, _, keys = words.value.pairs([t for text in texts for t in tokens(text)])
        held.append(keys)
        if sum(map(len, held)) > HELD_KEYS:
            yield pack()
    if held:
        yield pack()


def _build(key: tuple, table: pa.Table) -> pa.Table:
    bits = build_block(table.column("key").to_numpy().view(np.uint64), table.column("level").to_numpy())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.binary())})


#: rare: tokens that a join has still to complete. A null token is frequent and has its count c; a null h (hash of
#: the word before) stands for a frequent word, whose history and mass are given; held is the discounted pair count.
SCORED = "n_tokens long, known long, base double, score double, rare array<struct<token: binary, c: double, h: long, history: double, mass: double, held: double>>"


def _score(batches: Iterator[pa.RecordBatch], words: Broadcast, part: Broadcast, first: int, blocks: int, most: int, scale: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens whose pairs lie in this part of the filter."""
    table, bits = words.value, part.value
    values = level_counts(most)
    log_base = np.log10((table.count + 0.1) / scale)
    for ids, texts in chunks(batches):
        lists = [tokens(text) for text in texts]
        stream = [t for x in lists for t in x]
        doc = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
        index, before, keys = table.pairs(stream)
        names = np.arange(len(stream))
        if len(bits) < blocks:
            names = np.flatnonzero((block_of(keys, blocks) - first).view(np.uint64) < np.uint64(len(bits)))
            index, before, keys, doc = index[names], before[names], keys[names], doc[names]
        levels = read_levels(bits, keys, most, blocks, first)
        held = np.where(levels > 0, values[levels] - DISCOUNT, 0.0)
        hot, after = index >= 0, before >= 0
        total = lambda x, at: np.bincount(doc[at], x, len(lists)).astype(np.float64)  # noqa: B023, E731
        base = total(log_base[index[hot]], hot)
        known = np.bincount(doc[hot], minlength=len(lists))
        done = hot & after
        history, mass = table.history[before[done]], table.mass[before[done]]
        score = total(np.log10(held[done] / history + (1 - mass / history) * 10.0 ** log_base[index[done]]), done)
        rare = np.flatnonzero(~done)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(lists)))])
        cold, lone = hot[rare], ~after[rare]
        of = lambda x, at, none: pa.array(x[at[rare]] if len(x) else np.zeros(len(rare)), mask=none)  # noqa: B023, E731
        fields = {
            "token": pa.array([None if h else stream[k] for k, h in zip(names[rare].tolist(), cold.tolist(), strict=True)], pa.binary()), "c": of(table.count, index, ~cold),
            "h": pa.array((keys[rare] >> np.uint64(32)).astype(np.int64), mask=~lone), "history": of(table.history, before, lone), "mass": of(table.mass, before, lone),
            "held": pa.array(held[rare]),
        }
        inner = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
        sizes = np.bincount(doc, minlength=len(lists))
        columns = [pa.array(ids, schema.field("id").type), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), column.cast(schema.field("rare").type)]
        yield pa.RecordBatch.from_arrays(columns, schema.names)


def frequent_words(counts: DataFrame, hot: int) -> pa.Table:
    """Words (token, c) from the lowest eighth of an octave of counts on with which at most `hot` words come."""
    octave = F.floor(F.log2(F.col("c")) * 8)
    sizes = {r[0]: r[1] for r in counts.groupBy(octave.alias("o")).count().collect()}  # 8 * 63 rows at most
    taken, lowest = 0, None
    for o in sorted(sizes, reverse=True):
        taken += sizes[o]
        if taken > hot:
            break
        lowest = o
    return counts.where(F.lit(False) if lowest is None else octave >= lowest).select("token", "c").toArrow()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = rows.where(fold("id", FOLDS) != 0)

    counts = stage(train.mapInArrow(_count_words, "token binary, h long, n long").groupBy("token").agg(F.first("h").alias("h"), F.sum("n").alias("c")), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    scale = n + 0.1 * (v + 1)
    found = frequent_words(counts, hot)
    words = Words(found.column("token").to_pylist(), found.column("c").to_numpy())
    del found

    sent = spark.sparkContext.broadcast(words)
    pairs = train.mapInArrow(partial(_count_pairs, words=sent), "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("c"))
    level = (F.least("c", F.lit(EXACT)) + F.floor(F.ln(F.greatest("c", F.lit(EXACT)) / EXACT) / float(np.log(STEP)) + 1e-9)).cast("int")
    pairs = stage(pairs.select("key", level.alias("level")), "lm-pairs")
    sizes = {r[0]: r[1] for r in pairs.groupBy("level").count().collect()}
    top = max(sizes, default=0)
    blocks = -(-sum(m * k for k, m in sizes.items()) * BITS_A_MEMBER // (1 << BLOCK_BITS)) | 1
    values = level_counts(top)
    value = F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("level") + 1)
    mass = pairs.groupBy(F.shiftrightunsigned("key", 32).alias("h")).agg(F.sum(value - DISCOUNT).alias("mass"))
    # quantised counts may add up to more than the word's own count; words whose hashes meet have one history
    histories = counts.groupBy("h").agg(F.sum("c").cast("double").alias("c")).join(mass.hint("merge"), "h")
    histories = stage(histories.select("h", F.greatest("c", F.col("mass") / 0.999).alias("history"), "mass"), "lm-histories")
    frequent = spark.createDataFrame(pa.table({"h": pa.array(np.unique(words.hash).astype(np.int64))}))
    found = histories.join(F.broadcast(frequent), "h", "left_semi").orderBy("h").toArrow()  # `hot` rows at most
    hashes = found.column("h").to_numpy().astype(np.uint64)
    at = np.minimum(np.searchsorted(hashes, words.hash), max(0, len(hashes) - 1))
    if len(hashes):
        there = hashes[at] == words.hash
        words.history, words.mass = (np.where(there, found.column(c).to_numpy()[at], other) for c, other in (("history", words.count), ("mass", 0.0)))
    built = pairs.select(F.pmod("key", F.lit(blocks)).alias("block"), "key", "level").groupBy("block").applyInArrow(_build, "block long, bits binary")
    built = stage(built, "lm-filter")
    discard(pairs)
    table = spark.sparkContext.broadcast(words)

    # a row is known by its number: ids may repeat
    rows = rows.select(F.struct("id", F.monotonically_increasing_id().alias("row")).alias("id"), "text")
    size = max(1, filter_bits >> BLOCK_BITS)
    if blocks > size:
        rows = stage(rows, "lm-texts")  # so that a row has the same number in each pass
    schema = StructType([StructField("id", rows.schema["id"].dataType), *_parse_datatype_string(SCORED).fields])
    passes = []
    for first in range(0, blocks, size):
        bits = np.zeros((min(size, blocks - first), 8 * BLOCK_WORDS), np.uint8)
        found = built.where((F.col("block") >= first) & (F.col("block") < first + size)).toArrow()  # `filter_bits` at most
        for block, part in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
            bits[block - first] = np.frombuffer(part.as_buffer(), np.uint8)
        del found
        sent_bits = spark.sparkContext.broadcast(bits)
        passes.append(stage(rows.mapInArrow(partial(_score, words=table, part=sent_bits, first=first, blocks=blocks, most=top, scale=scale, schema=to_arrow_schema(schema)), schema), "lm-scores"))
        sent_bits.destroy()  # no later plan reads it
    for used in (sent, table):
        used.destroy()
    scored = reduce(DataFrame.unionByName, passes)
    rare = scored.select(F.col("id.row").alias("_row"), F.explode("rare").alias("r")).select("_row", "r.*")
    scored = scored.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score")]) if len(passes) > 1 else scored.drop("rare")
    scored = scored.select("id.id", F.col("id.row").alias("_row"), "n_tokens", "known", "base", "score")
    # what needs no join on a column is spread by keys that meet nothing: no word starts with white space, no hash is negative
    rare = rare.withColumns({"_rare": F.col("token").isNotNull(), "token": F.coalesce("token", F.concat(F.lit("\n "), F.col("_row").cast("string")).cast("binary")), "h": F.coalesce("h", -1 - F.col("_row"))})
    rare = rare.join(counts.select("token", F.col("c").alias("_c")).hint("merge"), "token", "left")
    rare = rare.join(histories.select("h", F.col("history").alias("_history"), F.col("mass").alias("_mass")).hint("merge"), "h", "left")
    base = (F.coalesce("c", "_c", F.lit(0)) + 0.1) / F.lit(float(scale))
    history, mass = F.coalesce("history", "_history"), F.coalesce("mass", "_mass")
    p, left = F.coalesce(F.col("held") / history, F.lit(0.0)), F.coalesce(1 - mass / history, F.lit(1.0))
    sums = rare.groupBy("_row").agg(F.count("_c").alias("_known"), F.sum(F.when(F.col("_rare"), F.log10(base))).alias("_base"), F.sum(F.log10(p + left * base)).alias("_score"))
    zero = F.lit(0.0)
    return scored.join(sums.hint("merge"), "_row", "left").select(
        F.col("id").alias(id_col), (fold("id", FOLDS) == 0).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
