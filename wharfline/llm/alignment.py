"""Cross-tokenizer alignment by products of sparse incidence matrices.

Both tokenizers cut the same bytes into tokens. A and B are the matrices of tokens by
bytes, with a one where a token holds a byte, as compressed sparse rows built here. A·Bᵀ
has an entry for each pair of tokens that overlap, whose value is the number of bytes
they share. It is worked out row by row after Gustavson: a row is the sum of those
rows of Bᵀ that the row of A names. Places where tokens of both end cut the bytes into
groups; G and H are the matrices of tokens by groups, G·Hᵀ links tokens of the same
group, and the rows of Gᵀ and Hᵀ list the groups' tokens. The texts of a chunk stand
in one matrix as blocks along the diagonal: every text ends a token on both sides.

How many documents hold a pair of ids linked is counted over the whole corpus. The most
frequent pairs, `HOT_PAIRS` at most, are broadcast as arrays; documents' other pairs are
joined to their counts by a shuffle, where each pair stands in few documents.

A's encoder is the tiktoken library over the vocabulary's ranks, with the ids of the
tokenizers library at a quarter of its time. B's pieces never hold a space after another
character, so words with the spaces before them are encoded apart from each other, and
their ids kept.

Defined results: null and empty texts, and those whose tokens don't spell out a space and
the text, have no tokens: zeros and an empty digest; equal ids or rows repeat in the result
as often as in the input, and count as documents of their own; ties for the highest count
all count; very long texts are encoded whole; an empty table gives an empty result. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from wharfline.llm.bpe import Pieces
from wharfline.llm.common import chunks, documents, stage

TOKENIZER_A = "byte_bpe_50k.tiktoken"
TOKENIZER_B = "piece_bpe_32k.model"
#: Pairs of ids that are broadcast with their counts at most, 16 bytes each.
HOT_PAIRS = 1 << 20
#: Characters of a chunk, and entries of a product that are worked out at a time.
CHUNK, SLICE = 1 << 20, 1 << 21
#: The pattern's look-ahead overflows on longer runs of white space.
LONG_RUN = 100_000


class Csr(NamedTuple):
    """A sparse matrix of ones: columns of row i at starts[i]:starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Tokens of the given sizes, one after the other, by bytes."""
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def group_incidence(groups: np.ndarray, width: int) -> Csr:
    """Tokens by the one group each is in."""
    return Csr(np.arange(len(groups) + 1), groups, width)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    if (m.columns[1:] < m.columns[:-1]).any():
        rows = rows[np.argsort(m.columns, kind="stable")]
    return Csr(starts, rows, len(m.starts) - 1)


def product(a: Csr, b: Csr, at_once: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a·b as (row, column, value) of its entries in order, some rows at a time."""
    wide = np.diff(b.starts)
    work = np.concatenate([[0], np.cumsum(wide[a.columns])])[a.starts]
    row, rows = 0, len(a.starts) - 1
    while row < rows:
        upto = max(row + 1, int(np.searchsorted(work, work[row] + at_once, "right")) - 1)
        named = a.columns[a.starts[row] : a.starts[upto]]
        n = wide[named]
        taken = np.arange(work[upto] - work[row]) + np.repeat(b.starts[named] - (np.cumsum(n) - n), n)
        keys = np.repeat(np.arange(row, upto), work[row + 1 : upto + 1] - work[row:upto]) * b.width + b.columns[taken]
        if (keys[1:] < keys[:-1]).any():
            keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield *np.divmod(keys[first], max(b.width, 1)), np.diff(first, append=len(keys))
        row = upto


class Aligned(NamedTuple):
    """What the texts of a chunk have: tokens of both sides, one text after the other, and the groups."""

    texts: np.ndarray  # places in the chunk of the texts that have tokens
    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray  # where each text's tokens start
    b_starts: np.ndarray
    by_bytes: tuple[Csr, Csr]
    by_group: tuple[Csr, Csr]
    group_starts: np.ndarray  # where each text's groups start


class Tokenizers:
    """Ids and bytes of both tokenizers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = {"mergeable_ranks": ranks, "special_tokens": {}}
        self.encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, **own)
        self.piecewise = tiktoken.Encoding("a-pieces", pat_str=r"[\s\S]+", **own)
        self.long_run = regex.compile(rf"\s{{{LONG_RUN}}}")
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        apart = not any(regex.search("[^▁]▁", p) for p in names)
        self.units = re.compile(r" +[^ ]*" if apart else r"(?s).+").findall
        lone = (model.piece_to_id("▁"),)
        self.pieces = Pieces(lambda unit: tuple(model.encode(unit[1:].decode())) if len(unit) > 1 else lone)
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b)]
        #: what each token adds to a text of groups: A's inside a group and at the end of its part, then B's
        self.shown = [f"{k}{end}" for size, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for k in range(size)]

    def encode_a(self, text: str) -> list[int]:
        if self.long_run.search(text):
            return list(chain.from_iterable(map(self.piecewise.encode_ordinary, regex.findall(public_tokenizers.PATTERN, text))))
        return self.encoding.encode_ordinary(text)

    def encode_b(self, text: str) -> list[int]:
        """text with the space before it."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.units(text))))

    def align(self, texts: list[str]) -> Aligned:
        kept, sides = [], ([], [])
        for k, text in enumerate(texts):
            if text:
                text = f" {text}"
                raw, ids = text.encode(), (self.encode_a(text), self.encode_b(text))
                if all(b"".join(map(of.__getitem__, x)) == raw for of, x in zip((self.bytes_a, self.bytes_b), ids, strict=True)):
                    kept.append(k)
                    for side, x in zip(sides, ids, strict=True):
                        side.append(np.array(x, np.int64))
        a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in sides)
        a_starts, b_starts = (np.concatenate([[0], np.cumsum([len(x) for x in side], dtype=np.int64)]) for side in sides)
        by_bytes = tuple(byte_incidence(sizes[ids]) for sizes, ids in zip(self.sizes, (a, b), strict=True))
        ends = np.ones(by_bytes[0].width + 1, bool)
        for m in by_bytes:
            here = np.zeros(len(ends), bool)
            here[m.starts[1:]] = True
            ends &= here
        number = np.cumsum(ends)  # groups that end up to a place
        by_group = tuple(group_incidence(number[m.starts[1:]] - ends[m.starts[1:]], int(number[-1])) for m in by_bytes)
        return Aligned(np.array(kept, np.int64), a, b, a_starts, b_starts, by_bytes, by_group, number[by_bytes[0].starts[a_starts]])

    def shown_groups(self, x: Aligned) -> list[str]:
        """The groups' tokens of each text: parts joined by |, groups by ;"""
        (g, h), (gt, ht) = x.by_group, map(transposed, x.by_group)
        last_a, last_b = (np.diff(m.columns, append=m.width) > 0 for m in (g, h))
        codes = np.zeros(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + ht.starts[g.columns]] = x.a + last_a * len(self.bytes_a)
        codes[np.arange(len(x.b)) + gt.starts[h.columns + 1]] = x.b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        starts, shown = (x.a_starts + x.b_starts).tolist(), self.shown.__getitem__
        return ["".join(map(shown, codes[s:e].tolist()))[:-1] for s, e in zip(starts, starts[1:], strict=False)]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _summaries(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, key_type: pa.DataType, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    own = tokenizers(*paths)
    size = len(own.bytes_b)
    for ids, texts in chunks(batches, CHUNK):
        x = own.align(texts)
        counts = np.zeros((5, len(texts)), np.int64)  # n_a, n_b, n_groups, n_links, n_shared
        counts[0, x.texts], counts[1, x.texts], counts[2, x.texts] = np.diff(x.a_starts), np.diff(x.b_starts), np.diff(x.group_starts)
        of_a = np.repeat(x.texts, np.diff(x.a_starts))
        keys = [np.zeros(0, np.int64)]
        for row, column, _ in product(x.by_bytes[0], transposed(x.by_bytes[1])):
            keys.append((of_a[row] * len(own.bytes_a) + x.a[row]) * size + x.b[column])
            counts[3] += np.bincount(of_a[row], minlength=len(texts))
        g, h = x.by_group
        np.add.at(counts[4], of_a, np.bincount(h.columns, minlength=h.width)[g.columns])  # row sums of G·Hᵀ, as G·(Hᵀ·1)
        keys, times = np.unique(np.concatenate(keys), return_counts=True)
        of, keys = np.divmod(keys, len(own.bytes_a) * size)
        starts = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        shown = dict(zip(x.texts.tolist(), own.shown_groups(x), strict=True))
        digests = [hashlib.sha256(shown[k].encode()).hexdigest() if k in shown else "" for k in range(len(texts))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *map(pa.array, counts), pa.array(digests), pa.ListArray.from_arrays(starts, pa.array(keys, key_type)), pa.ListArray.from_arrays(starts, pa.array(times, pa.int32()))],
            ["id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"],
        )
    own.pieces.forget()


def summaries(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """Staged rows (row, id, counts, groups_sha256, pairs of ids as a * size of B + b, times each is linked)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, own = rows.schema["id"].dataType, tokenizers(*paths)
    key = IntegerType() if len(own.bytes_a) * len(own.bytes_b) < 1 << 31 else LongType()
    schema = StructType(
        [StructField("id", kind), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], StructField("groups_sha256", StringType())]
        + [StructField("pairs", ArrayType(key)), StructField("times", ArrayType(IntegerType()))]
    )
    out = rows.mapInArrow(partial(_summaries, id_type=to_arrow_type(kind), key_type=to_arrow_type(key), paths=paths), schema)
    return stage(out.withColumn("row", F.monotonically_increasing_id()), "alignments")


def _counted(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    keys, docs, highest, size = table.value
    for batch in batches:
        lists = batch.column("pairs")
        pairs, times = lists.flatten().to_numpy().astype(np.int64), batch.column("times").flatten().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        count = docs[at[known]]
        best, total = np.zeros((2, len(batch)), np.int64)
        np.add.at(total, of[known], times[known] * count)
        np.add.at(best, of[known], times[known] * (count == highest[pairs[known] // size]))
        starts = pa.array(np.searchsorted(of[~known], np.arange(len(batch) + 1)), pa.int32())
        rest = [pa.ListArray.from_arrays(starts, pa.array(v[~known])) for v in (pairs, times)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best), pa.array(total), *rest], ["row", "best", "total", "pairs", "times"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """A row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared (pairs of tokens of a group)."""
    paths = paths or (public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
    own, spark = tokenizers(*paths), docs.sparkSession
    size = len(own.bytes_b)
    found = summaries(docs, paths, id_col, text_col)
    counts = stage(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    octaves = {r["o"]: r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).alias("o")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    while least and held + octaves.get(least - 1, 0) <= hot_pairs:
        least -= 1
        held += octaves.get(least, 0)
    rare = held < sum(octaves.values())
    hot = counts.where(F.floor(F.log2("docs")) >= least).toArrow() if held else None
    order = np.argsort(hot.column("pair").to_numpy()) if held else None
    keys, n = (hot.column(c).to_numpy().astype(np.int64)[order] for c in ("pair", "docs")) if held else np.zeros((2, 0), np.int64)
    a_id = F.expr(f"pair div {size}")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("highest"))
    highest = np.zeros(len(own.bytes_a), np.int64)
    most = top.toArrow()  # a row for each id of A at most
    highest[most.column("a").to_numpy()] = most.column("highest").to_numpy()
    table = spark.sparkContext.broadcast((keys, n, highest, size))
    counted = stage(found.select("row", "pairs", "times").mapInArrow(partial(_counted, table=table), "row long, best long, total long, pairs array<long>, times array<long>"), "pair-sums")
    table.destroy()
    both = found.drop("pairs", "times").join(counted.select("row", "best", "total").hint("merge"), "row")
    if rare:
        rest = counted.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        known = counts.where(F.floor(F.log2("docs")) < least).join(F.broadcast(top), a_id == F.col("a"))
        sums = rest.join(known.hint("merge"), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("docs") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_total")
        )
        both = both.join(sums.hint("merge"), "row", "left").withColumns({"best": F.col("best") + F.coalesce("more_best", F.lit(0)), "total": F.col("total") + F.coalesce("more_total", F.lit(0))})
    return both.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.col("best").alias("n_best"), F.col("total").alias("count_sum"), "groups_sha256", "n_shared")


def _links(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, paths: tuple[str, str], shared: bool) -> Iterator[pa.RecordBatch]:
    own = tokenizers(*paths)
    for ids, texts in chunks(batches, CHUNK):
        x = own.align(texts)
        left, right = x.by_group if shared else x.by_bytes
        of_a = np.repeat(np.arange(len(x.texts)), np.diff(x.a_starts))
        for row, column, value in product(left, transposed(right)):
            of = of_a[row]
            values = pa.array(row - x.a_starts[of]), pa.array(column - x.b_starts[of]), pa.array(x.a[row]), pa.array(x.b[column]), pa.array(value)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in x.texts[of].tolist()], id_type), *values], ["id", "a_place", "b_place", "a", "b", "value"])
    own.pieces.forget()


def token_links(docs: DataFrame, shared_groups: bool = False, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """A row for each linked pair of tokens: id, places of the tokens in their text, their ids, and the number of bytes they share; with
    shared_groups all pairs of a group are linked, and the number is 1."""
    paths = paths or (public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), *[StructField(c, LongType()) for c in ("a_place", "b_place", "a", "b", "value")]])
    out = rows.mapInArrow(partial(_links, id_type=to_arrow_type(kind), paths=paths, shared=shared_groups), schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("value", "n_groups" if shared_groups else "n_bytes")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
