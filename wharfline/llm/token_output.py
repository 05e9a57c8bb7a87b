"""Token ids in a file format of its own: an adaptive context-mixing range coder.

A frame holds whole documents: their ids and token counts, and the token ids in
blocks of `BLOCK` ids. Blocks are coded apart from each other: each starts with a
fresh model, and has its own length and crc32, so one can be read or found damaged
without the others. The blocks of a frame are coded in step, a numpy operation for
the same position of all of them.

The model of a block predicts the next id by order 2 (the two ids before), order 1
(the id before) and order 0 (the id seen most). Each prediction has a confidence,
the run of its hits, and an adaptive weight for each confidence; the weights of
predictions that name the same id add up. They and an escape share the range. An
escaped id is coded in four nibbles by adaptive order-0 counts.

The range coder keeps 48 bits, gives out words of 16 and settles carries at the end
of a block. Frames are rows of a Parquet table that is sorted by document id; Spark
writes and reads it, so it works in any store.

Defined results: a null text is empty and holds the end id alone; a null id comes
first; rows with one id stand in any order; a very long text has a frame of its own; a
table without rows gives no frames. Ids have to be whole numbers. Other columns play no
part, whatever their names.
A damaged or cut block raises an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from wharfline.llm.bpe import Pieces
from wharfline.llm.common import chunks, documents, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 2048
#: ids of a frame, unless one document has more.
FRAME = 1 << 22
MAGIC = b"WFT1"
HEAD = struct.Struct("<4sIIII")  # magic, documents, ids, ids of a block, crc32 of the index
BLOCK_HEAD = struct.Struct("<II")  # words, crc32 of the ids
SLOTS = 1024  # contexts of each order, and of the last nibble
LIMIT = 1 << 32
TOTAL = 1 << 14  # the predictions' share of the range is out of this
STEP = 24  # what a nibble's count grows by
CONFIDENCES = 8


class Model:
    """The models of all blocks that are coded in step."""

    def __init__(self, blocks: int) -> None:
        self.lanes = np.arange(blocks)
        self.guess = [np.zeros((blocks, SLOTS), np.uint16) for _ in range(2)]
        self.runs = [np.zeros((blocks, SLOTS), np.uint8) for _ in range(2)]
        self.seen = np.zeros((blocks, SLOTS), np.uint16)
        self.most, self.most_seen = np.zeros(blocks, np.uint16), np.zeros(blocks, np.uint16)
        start = np.array([[600, 6000, 9000, 11000, 12000, 13000, 13500, 14000], [300, 3000, 5000, 7000, 8000, 9000, 10000, 11000], [700] * 8], np.int32)
        self.weight = np.tile(start, (blocks, 1, 1))
        self.nibbles = [np.ones((blocks, n, 16), np.uint16) for n in (1, 16, 256, SLOTS)]
        self.last, self.before = np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint32)

    def keep(self, n: int) -> None:
        """Goes on with the first n blocks."""
        self.lanes = self.lanes[:n]

    def predict(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The three predicted ids, and the upper ends of their shares of TOTAL, three columns; the rest is the escape's."""
        n = len(self.lanes)
        self.slot = [((self.last[:n] * np.uint32(0x9E3779B1) ^ self.before[:n] * np.uint32(0x85EBCA6B)) >> np.uint32(22)), ((self.last[:n] * np.uint32(0x9E3779B1)) >> np.uint32(22))]
        ids = [self.guess[k][self.lanes, self.slot[k]] for k in range(2)] + [self.most[:n]]
        self.sure = [self.runs[k][self.lanes, self.slot[k]] for k in range(2)] + [np.zeros(n, np.uint8)]
        w2, w1, w0 = (self.weight[self.lanes, k, self.sure[k]] for k in range(3))
        same12, same0 = ids[0] == ids[1], ids[2] == ids[0]
        also0 = (ids[2] == ids[1]) & ~same0
        first = w2 + np.where(same12, w1, 0) + np.where(same0, w0, 0)
        second = np.where(same12, 0, w1) + np.where(also0, w0, 0)
        third = np.where(same0 | also0, 0, w0)
        # shares of three predictions and an escape, each at least 1, out of TOTAL
        whole = first + second + third + (TOTAL - np.minimum(TOTAL - 1500, np.maximum(w2, np.maximum(w1, w0))))
        a = 1 + first * (TOTAL - 4) // whole
        b = a + 1 + second * (TOTAL - 4) // whole
        return ids, np.stack([a, b, b + 1 + third * (TOTAL - 4) // whole], axis=1)

    def nibble(self, which: int, rows: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Cumulated counts of the 16 values."""
        return np.cumsum(self.nibbles[which][rows, context], axis=1, dtype=np.uint32)

    def count(self, which: int, rows: np.ndarray, context: np.ndarray, value: np.ndarray) -> None:
        self.nibbles[which][rows, context, value] += np.uint16(STEP)

    def learn(self, ids: np.ndarray, predicted: list[np.ndarray]) -> None:
        n = len(self.lanes)
        for k in range(3):
            hit = predicted[k] == ids
            w = self.weight[self.lanes, k, self.sure[k]]
            self.weight[self.lanes, k, self.sure[k]] = w + ((np.where(hit, TOTAL - 64, 64) - w) >> 5)
            if k < 2:
                self.runs[k][self.lanes, self.slot[k]] = np.where(hit, np.minimum(self.sure[k] + 1, CONFIDENCES - 1), np.where(self.sure[k] > 2, self.sure[k] >> 1, 0))
                self.guess[k][self.lanes, self.slot[k]] = np.where(hit | (self.sure[k] > 2), predicted[k], ids)
        slot = ids & np.uint16(SLOTS - 1)
        seen = self.seen[self.lanes, slot] + np.uint16(1)
        self.seen[self.lanes, slot] = seen
        more = seen > self.most_seen[:n]
        self.most[:n], self.most_seen[:n] = np.where(more, ids, self.most[:n]), np.where(more, seen, self.most_seen[:n])
        self.before[:n], self.last[:n] = self.last[:n], ids


def nibble_contexts(ids: np.ndarray) -> list[np.ndarray]:
    """Where each nibble's counts are: by the nibbles before it, hashed for the last."""
    high = ids.astype(np.uint32)
    return [np.zeros(len(ids), np.int64), (high >> 12).astype(np.int64), (high >> 8).astype(np.int64), ((high >> 4) * np.uint32(0x9E3779B1) >> np.uint32(22)).astype(np.int64)]


class Writer:
    def __init__(self, blocks: int, ids: int) -> None:
        self.low, self.range = np.zeros(blocks, np.uint64), np.full(blocks, (1 << 48) - 1, np.uint64)
        self.words = np.zeros((blocks, 2 * ids + 8), np.uint32)
        self.n = np.zeros(blocks, np.int64)

    def put(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray | int) -> None:
        part = self.range[rows] // np.asarray(total, np.uint64)
        self.low[rows] += start.astype(np.uint64) * part
        self.range[rows] = part * size.astype(np.uint64)
        short = rows[self.range[rows] < LIMIT]
        if len(short):
            self._shift(short)
            self.range[short] <<= np.uint64(16)

    def _shift(self, rows: np.ndarray) -> None:
        if self.n.max(initial=0) + 4 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        low = self.low[rows]
        self.words[rows, self.n[rows]] = low >> np.uint64(32)  # with the carry
        self.n[rows] += 1
        self.low[rows] = (low & np.uint64(0xFFFFFFFF)) << np.uint64(16)

    def close(self) -> list[bytes]:
        every = np.arange(len(self.n))
        for _ in range(3):
            self._shift(every)
        for k in range(self.words.shape[1] - 1, 0, -1):
            self.words[:, k - 1] += self.words[:, k] >> 16
        packed = (self.words & 0xFFFF).astype("<u2")
        return [packed[k, :n].tobytes() for k, n in enumerate(self.n.tolist())]


class Reader:
    def __init__(self, blocks: list[bytes]) -> None:
        sizes = np.array([len(b) // 2 for b in blocks])
        self.words = np.zeros((len(blocks), int(sizes.max(initial=0)) + 4), np.uint64)
        for k, b in enumerate(blocks):
            self.words[k, : sizes[k]] = np.frombuffer(b, "<u2")
        self.last = self.words.shape[1] - 1
        self.code = (self.words[:, 0] << np.uint64(32)) | (self.words[:, 1] << np.uint64(16)) | self.words[:, 2]
        self.at, self.range = np.full(len(blocks), 3), np.full(len(blocks), (1 << 48) - 1, np.uint64)

    def peek(self, rows: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        self.part = self.range[rows] // np.asarray(total, np.uint64)
        return np.minimum(self.code[rows] // np.maximum(self.part, np.uint64(1)), np.asarray(total, np.uint64) - np.uint64(1)).astype(np.int64)

    def take(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.code[rows] -= start.astype(np.uint64) * self.part
        self.range[rows] = self.part * size.astype(np.uint64)
        short = rows[self.range[rows] < LIMIT]
        if len(short):
            at = np.minimum(self.at[short], self.last)
            self.code[short] = (self.code[short] << np.uint64(16)) | self.words[short, at]
            self.range[short] <<= np.uint64(16)
            self.at[short] += 1


def _shares(upto: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the chosen share: 0 to 2 a prediction, 3 the escape."""
    edges = np.concatenate([np.zeros((len(upto), 1), upto.dtype), upto, np.full((len(upto), 1), TOTAL, upto.dtype)], axis=1)
    every = np.arange(len(upto))
    start = edges[every, which]
    return start, edges[every, which + 1] - start


def _steps(sizes: np.ndarray) -> Iterator[int]:
    """How many blocks have a t-th id. Only the last block may be shorter than the others."""
    for t in range(int(sizes.max(initial=0))):
        yield int((sizes > t).sum())


def code_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """ids (of under 65536) -> a payload for each block."""
    sizes = np.diff(np.append(np.arange(0, len(ids), block), len(ids)))
    grid = np.zeros((len(sizes), block), np.uint16)
    grid.reshape(-1)[: len(ids)] = ids
    model, out = Model(len(sizes)), Writer(len(sizes), block)
    for t, n in enumerate(_steps(sizes)):
        model.keep(n)
        now = grid[:n, t]
        predicted, upto = model.predict()
        which = np.where(predicted[0] == now, 0, np.where(predicted[1] == now, 1, np.where(predicted[2] == now, 2, 3)))
        out.put(model.lanes, *_shares(upto, which), TOTAL)
        rows = np.flatnonzero(which == 3)
        if len(rows):
            escaped = now[rows]
            for k, context in enumerate(nibble_contexts(escaped)):
                value = ((escaped >> (12 - 4 * k)) & 15).astype(np.int64)
                upto = model.nibble(k, rows, context)
                end = upto[np.arange(len(rows)), value]
                size = model.nibbles[k][rows, context, value]
                out.put(rows, end - size, size, upto[:, 15])
                model.count(k, rows, context, value)
        model.learn(now, predicted)
    return out.close()


def read_blocks(payloads: list[bytes], n_ids: int, block: int = BLOCK) -> np.ndarray:
    sizes = np.diff(np.append(np.arange(0, n_ids, block), n_ids))
    grid = np.zeros((len(sizes), block), np.uint16)
    model, source = Model(len(sizes)), Reader(payloads)
    for t, n in enumerate(_steps(sizes)):
        model.keep(n)
        predicted, upto = model.predict()
        which = (source.peek(model.lanes, TOTAL)[:, None] >= upto).sum(1)
        source.take(model.lanes, *_shares(upto, which))
        now = np.where(which == 0, predicted[0], np.where(which == 1, predicted[1], predicted[2]))
        rows = np.flatnonzero(which == 3)
        if len(rows):
            escaped = np.zeros(len(rows), np.uint16)
            for k in range(4):
                context = nibble_contexts(escaped)[k]
                upto = model.nibble(k, rows, context)
                value = (source.peek(rows, upto[:, 15])[:, None] >= upto).sum(1)
                size = model.nibbles[k][rows, context, value]
                source.take(rows, upto[np.arange(len(rows)), value] - size, size)
                model.count(k, rows, context, value)
                escaped |= (value << (12 - 4 * k)).astype(np.uint16)
            now[rows] = escaped
        grid[:n, t] = now
        model.learn(now, predicted)
    return grid.reshape(-1)[:n_ids]


def write_frame(keys: list[int | None], lists: list[np.ndarray], block: int = BLOCK) -> bytes:
    """Documents' ids and token ids -> a frame."""
    held = np.array([k if k is not None else -(1 << 63) for k in keys], "<i8")
    index = zlib.compress(held.tobytes() + np.array([len(x) for x in lists], "<u4").tobytes(), 1)
    ids = np.concatenate(lists) if lists else np.zeros(0, np.uint16)
    parts = [HEAD.pack(MAGIC, len(keys), len(ids), block, zlib.crc32(index)), struct.pack("<I", len(index)), index]
    for k, payload in enumerate(code_blocks(ids, block)):
        parts += [BLOCK_HEAD.pack(len(payload) // 2, zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes())), payload]
    return b"".join(parts)


def read_frame(frame: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, n_docs, n_ids, block, crc = HEAD.unpack_from(frame)
    (size,) = struct.unpack_from("<I", frame, HEAD.size)
    at = HEAD.size + 4 + size
    index = frame[HEAD.size + 4 : at]
    if magic != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("the frame's head is damaged")
    index = zlib.decompress(index)
    keys, sizes = np.frombuffer(index[: 8 * n_docs], "<i8").tolist(), np.frombuffer(index[8 * n_docs :], "<u4").astype(np.int64)
    payloads, sums = [], []
    for k in range(-(-n_ids // block)):
        if len(frame) < at + BLOCK_HEAD.size:
            raise ValueError(f"block {k} is missing")
        words, crc = BLOCK_HEAD.unpack_from(frame, at)
        at += BLOCK_HEAD.size
        payloads.append(frame[at : at + 2 * words])
        sums.append(crc)
        at += 2 * words
    ids = read_blocks(payloads, n_ids, block)
    for k, crc in enumerate(sums):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return [None if k == -(1 << 63) else k for k in keys], np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


@lru_cache(2)
def _tokenizer(name: str):  # noqa: ANN202
    """A text's encoding by the tokenizers library. The tokenizer splits a text by this pattern before
    it merges, so the library encodes each different piece once. A text that holds the string of an added
    token is split there first, so it goes to the library whole."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    whole = lambda text: tuple(tokenizer.encode(text, add_special_tokens=False).ids)
    pieces = Pieces(lambda piece: whole(piece.decode()))
    find, added = regex.compile(public_tokenizers.PATTERN).findall, [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(map(text.__contains__, added)):
            return np.array(whole(text), np.uint16)
        return np.fromiter(chain.from_iterable(map(pieces.__getitem__, find(text))), np.uint16)

    return encode


def _write(batches: Iterator[pa.RecordBatch], name: str, end_id: int, block: int, frame: int) -> Iterator[pa.RecordBatch]:
    encode, keys, lists, held = _tokenizer(name), [], [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([keys[0]], pa.int64()), pa.array([held], pa.int64()), pa.array([write_frame(keys, lists, block)], pa.binary())], ["first_id", "n_ids", "frame"])
    for ids, texts in chunks(batches):
        for key, text in zip(ids, texts, strict=True):
            tokens = np.append(encode(text), np.uint16(end_id))
            if held and held + len(tokens) > frame:
                yield pack()
                keys, lists, held = [], [], 0
            keys.append(key)
            lists.append(tokens)
            held += len(tokens)
    if keys:
        yield pack()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, frame in zip(batch.column("first").to_pylist(), batch.column("frame"), strict=True):
            keys, lists = read_frame(frame.as_py())
            packed = [x.astype("<u4").tobytes() for x in lists]
            starts = first + np.cumsum([0, *map(len, lists)])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], ["id", "start", "ids"])


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """Writes the frames in ascending order of the ids and returns their table: place (order of the frames), first_id, n_ids, frame."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    frames = rows.mapInArrow(partial(_write, name=tokenizer, end_id=end_id, block=block, frame=frame), "first_id long, n_ids long, frame binary")
    # tasks come in the order of their ranges, and frames in that of a task
    return stage(frames.withColumn("place", F.monotonically_increasing_id()), "token-frames")


def read_tokens(frames: DataFrame) -> DataFrame:
    """id, start (ids of all documents before it), ids (packed, unsigned 32 bits) of every document in the frames."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each frame of millions of ids
    starts = frames.select("place", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    starts = stage(starts, "frame-starts")
    # the join is on frames, which are compressed; ids are decoded after it and aren't shuffled
    return frames.join(starts.hint("merge"), "place").select("first", "frame").mapInArrow(_read, "id long, start long, ids binary")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = write_tokens(documents(spark, sf_dir))
    return read_tokens(frames).select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
