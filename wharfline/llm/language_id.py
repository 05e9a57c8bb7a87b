"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier (log-odds of
hashed 1- to 3-byte grams, smoothed, each language of a side weighing the same)
tells the languages with that bit from the rest. Decoding takes the codeword with
the least logistic loss over the bits, weighted by how far each classifier parts
its sides; a small lead over the second codeword flags the text as ambiguous.

Gram counts are learnt from labelled texts outside the held-out fold, up to
`per_language` whole texts for each language, those with the lowest random keys (a
bounded sample). There is no bound on the number of languages; the model has a codeword
for each, and sums for 2^GRAM_BITS grams and each bit (bits grow with the logarithm).

Defined results: a null text, or one without a letter, is `und` with score 0; a
null lang is not learnt (an empty one is a language like others); with no language
learnt all is `und`, with one all texts with letters are that language; of equal losses
the first language in order wins; repeated rows get equal results; very long texts are
read whole, a slice at a time; an empty table gives an empty result. Other columns play
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from wharfline.llm.common import KEY_BITS, chunks, documents, fold, random_key, stage

PER_LANGUAGE = 10_000
GRAM_BITS = 14
FOLDS = 3
HELD_OUT = 1
#: Lead in loss below which a text is ambiguous.
LEAD = 0.5
SLICE = 1 << 15
#: ASCII bytes that aren't letters become spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(languages: int, seed: int = 42) -> np.ndarray:
    """A row of -1 and 1 for each language: all splits in two for up to five, else random columns far apart."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)], float)
    random = np.random.default_rng(seed)
    length, best, far = 16 + 4 * int(np.ceil(np.log2(languages))), None, -1
    for _ in range(50 if languages <= 1024 else 1):
        code = random.choice([-1.0, 1.0], (languages, length))
        code[:, np.abs(code.sum(0)) == languages] *= np.where(np.arange(languages) % 2, 1, -1)[:, None]
        if languages > 1024:  # so many that a table of all distances is too large; random words are far apart at this length
            return code
        apart = (length - code @ code.T) / 2 + length * np.eye(languages)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def grams(text: str, bits: int = GRAM_BITS) -> Iterator[np.ndarray]:
    """Hashed grams of a whole text, a slice at a time."""
    raw = b" ".join(text.lower().encode().translate(LETTERS).split())
    codes = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    shift = np.uint32(32 - bits)
    for at in range(0, len(codes), SLICE):
        a = codes[at : at + SLICE + 2]
        one, two, three = a * np.uint32(0x9E3779B1), a * np.uint32(0x85EBCA6B), a * np.uint32(0xC2B2AE35)
        pair = one[:-1] ^ (two[1:] + np.uint32(0x165667B1))
        yield np.concatenate([one[:SLICE], pair[:SLICE] * np.uint32(0x27D4EB2F), ((pair[:-1] ^ three[2:]) * np.uint32(0x2C1B3C6D))[:SLICE]]) >> shift


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): sums of this task."""
    counts: dict[str, np.ndarray] = {}
    for langs, texts in chunks(batches):
        for lang, text in zip(langs, texts, strict=True):
            held = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
            for g in grams(text, bits):
                held += np.bincount(g, minlength=1 << bits)
    for lang, held in counts.items():
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(held[there])], ["lang", "gram", "n"])


class Decoder:
    def __init__(self, langs: list[str], code: np.ndarray, ones: np.ndarray, every: np.ndarray, bits: int) -> None:
        """code: a row for each language; ones: for each gram and bit the sum of the gram's shares in the languages with 1;
        every: for each gram the sum in all languages."""
        self.langs, self.bits, self.code = langs, bits, code
        if len(langs) > 1:
            with_bit = (code > 0).sum(0)
            others = every[:, None] - ones
            self.odds = np.log((ones / with_bit) / (others / (len(langs) - with_bit))).astype(np.float32)
            apart = ((ones - others) * self.odds).sum(0) / len(langs)  # each classifier's mean margin
            self.weight = apart / apart.mean()
        self.gain = 4.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text, self.bits):
            total += self.odds[g].sum(0)
            n += len(g)
        margin = total / np.sqrt(n) * self.gain
        loss = (self.weight * np.logaddexp(0, -self.code * margin)).sum(1)
        first, second = np.argsort(loss, kind="stable")[:2]
        likely = np.exp(loss[first] - loss)
        return self.langs[first], float(likely[first] / likely.sum()), bool(loss[second] - loss[first] < LEAD)


def _decode(batches: Iterator[pa.RecordBatch], decoder: Decoder, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches):
        lang, score, ambiguous = zip(*map(decoder, texts), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(lang), pa.array(score), pa.array(ambiguous)], ["id", "lang_pred", "score", "ambiguous"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, bits: int = GRAM_BITS) -> Decoder:
    """Learns from all given rows. Gram counts stay in Spark; what comes back is a codeword for each language and sums for each gram and bit."""
    spark = docs.sparkSession
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), random_key(F.col(id_col), seed="language").alias("key"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), per_language / F.col("rows")) * (1 << KEY_BITS)
    some = known.join(F.broadcast(sizes), "lang").where(F.col("key") <= share.cast("long")).select("lang", "text")
    counts = stage(some.mapInArrow(partial(_count, bits=bits), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # a row for each language
    langs = sorted(totals)
    code = codewords(len(langs))
    whole = [totals[x] + 0.5 * (1 << bits) for x in langs]
    table = spark.createDataFrame([(x, w, (c > 0).tolist()) for x, w, c in zip(langs, whole, code, strict=True)], "lang string, whole double, ones array<boolean>")
    shares = counts.join(F.broadcast(table), "lang").select("gram", (F.col("n") / F.col("whole")).alias("p"), "ones")
    sums = shares.groupBy("gram").agg(F.sum("p").alias("every"), *[F.sum(F.when(F.col("ones")[k], F.col("p"))).alias(f"b{k}") for k in range(code.shape[1])]).toPandas()  # 2^bits rows
    smooth = 0.5 / np.array(whole)  # what a gram that a language never shows has there
    ones, every = np.tile((code > 0).T @ smooth, (1 << bits, 1)), np.full(1 << bits, smooth.sum())
    at = sums["gram"].to_numpy(np.int64)
    every[at] += sums["every"].to_numpy(np.float64)
    for k in range(code.shape[1]):
        ones[at, k] += sums[f"b{k}"].fillna(0).to_numpy(np.float64)
    return Decoder(langs, code, ones, every, bits)


def predict(docs: DataFrame, decoder: Decoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    return rows.mapInArrow(partial(_decode, decoder=decoder, id_type=to_arrow_type(kind)), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    decoder = learn(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    return predict(docs, decoder).select(F.col("id").alias("doc_id"), (fold("id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
