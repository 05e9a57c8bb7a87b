"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every
two neighbours are: no merge across their border comes before the merges that
build them. So a nondeterministic transducer guesses tokens byte by byte and checks
each border; one guess survives. Its subset construction is done lazily, state by
state, as texts need them: a state is the set of (last token, node of the token under
way in the tree of tokens), kept as packed numbers. At most one token can end at a
place, and a state's output is that token. A guess lives no longer than the longest
token, which bounds the lookahead: tokens are final up to the last place that all
guesses pass through, and are read backwards from there. Pieces of text that are
themselves tokens are one token, as in the tiktoken library. Memory is bounded:
states and known pieces are dropped when there are too many.

Decoding. Tokens are byte strings that can end inside a character. A table holds,
for each token, the state of a UTF-8 recogniser after it for each state before it;
a stream gives out bytes up to the last complete character and keeps the rest.

Defined results: a null text is empty and has no tokens; rows repeat as in the
input; a table without rows gives none; very long texts and pieces are encoded whole; other
columns play no part, whatever their names. ids are packed as little-endian unsigned
32-bit integers. Bytes that aren't UTF-8 are passed on unchanged at the stream's end.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from wharfline.llm.common import chunks, documents, give_back

RANKS = "byte_bpe_multi_50k.tiktoken"
#: States and pieces that a worker keeps, and the longest piece of these.
MAX_STATES = 1 << 18
MAX_PIECES = 1 << 18
KEPT_CHARS = 64
#: Bytes after which a long piece gives out what is settled.
LOOK = 1024
#: ids that the decoder takes at a time.
FEED = 1 << 14
NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Dropped(Exception):
    """There are too many states."""


class Arcs(dict):
    """state | byte -> state, worked out on first use. States are numbered in steps of 256."""

    def __init__(self, find: Callable[[int], int]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key: int) -> int:
        self[key] = found = self.find(key)
        return found


class Transducer:
    """Encodes one piece at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, look: int = LOOK) -> None:
        self.ranks, self.max_states, self.look = ranks, max_states, look
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        # the tree of tokens, its root is 0: (node, byte) -> node; what token ends at a node, whether any goes on, how deep it is
        self.steps: dict[int, int] = {}
        self.token_at, self.goes_on, self.depth = [-1], [True], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                after = self.steps.setdefault(node << 8 | byte, len(self.token_at))
                if after == len(self.token_at):
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = rank
        self.borders: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.arcs = Arcs(self.arc)
        self._empty()

    def _empty(self) -> None:
        """Forgets all states but the first, whose one guess stands at the root after no token."""
        first = array("q", [0]).tobytes()
        self.number: dict[bytes, int] = {first: 0}  # a state's number, in steps of 256: arcs share these integers
        self.members: list[bytes] = [first]
        self.ends: list[int] = [-1]  # the token that ends where the state is, if one does
        self.arcs.clear()

    def forget(self) -> None:
        self._empty()
        self.borders.clear()
        for spines in self.spines:
            spines.clear()

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        parts, limit = [token[k : k + 1] for k in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            if rank >= limit:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]] | None:
        """The tokens that stand at this end of the token (0: left, 1: right) while it is built, the last built first, each
        with the rank that makes it and the rank that takes it up; None if merging never makes the token."""
        known = self.spines[side]
        if token not in known:
            spine, top, taken = [], token, NEVER
            while True:
                spine.append((top, self.ranks[top] if len(top) > 1 else -1, taken))
                if len(top) == 1:
                    break
                halves = self._halves(top)
                if halves is None:
                    spine = None
                    break
                taken, top = self.ranks[top], halves[side]
            known[token] = spine
        return known[token]

    def _border(self, first: int, second: int) -> bool:
        """Whether the two tokens stay apart. Of equal ranks the merge further left comes first."""
        left = self._spine(self.bytes[first], 1) if first >= 0 else []
        right = self._spine(self.bytes[second], 0)
        if left is None or right is None:
            return False
        # both spines go back in time: only tokens that stand at the same time can merge
        i = j = 0
        while i < len(left) and j < len(right):
            (a, made_a, taken_a), (b, made_b, taken_b) = left[i], right[j]
            if made_a <= taken_b and made_b < taken_a:
                rank = self.ranks.get(a + b, NEVER)
                if rank < taken_a and rank <= taken_b and rank != NEVER:
                    return False
            if made_a > made_b or (made_a == made_b and j + 1 == len(right)):
                i += 1
            else:
                j += 1
        return True

    def _step(self, members: Iterable[int], byte: int) -> tuple[list[int], int]:
        """Guesses after a byte, and the token that ends with it (-1: none). A guess is (token before + 1) << 32 | node. Guesses stay
        in the order of where their token under way begins, so equal sets are equal sequences; only one token can end."""
        after, steps, borders, ended = [], self.steps, self.borders, -1
        for guess in members:
            node = steps.get((guess & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            last = guess >> 32
            if self.goes_on[node]:
                after.append(last << 32 | node)
            rank = self.token_at[node]
            if rank >= 0:
                key = last << 32 | rank
                apart = borders.get(key)
                if apart is None:
                    if len(borders) > 2 * self.max_states:
                        borders.clear()
                    apart = borders[key] = self._border(last - 1, rank)
                if apart:
                    ended = rank
        if ended >= 0:
            after.append((ended + 1) << 32)
        if not after:
            raise ValueError(f"no token for byte {byte}")
        return after, ended

    def arc(self, key: int) -> int:
        """The state after a state and a byte (their sum is the key)."""
        if len(self.members) > self.max_states:
            raise Dropped
        after, ended = self._step(memoryview(self.members[key >> 8]).cast("q"), key & 0xFF)
        return self._numbered(array("q", after).tobytes(), ended)

    def _again(self, path: list[int]) -> list[int]:
        """Drops all states but those of the path and the first, which get new numbers."""
        kept = [(self.members[state >> 8], self.ends[state >> 8]) for state in path]
        self._empty()
        return [self._numbered(packed, ended) for packed, ended in kept]

    def _numbered(self, packed: bytes, ended: int) -> int:
        found = self.number.get(packed)
        if found is None:
            found = self.number[packed] = len(self.members) << 8
            self.members.append(packed)
            self.ends.append(ended)
        return found

    def _tokens(self, path: list[int], at: int) -> list[int]:
        """The tokens up to a place, found backwards: the state at each place tells what token ends there."""
        out, ends, sizes = [], self.ends, self.sizes
        while at:
            token = ends[path[at - 1] >> 8]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _settled(self, state: int, path: list[int]) -> int:
        """The last place that the tokens of all guesses of the state pass through."""
        places = {len(path) - self.depth[guess & 0xFFFFFFFF] for guess in memoryview(self.members[state >> 8]).cast("q")}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.sizes[self.ends[path[last - 1] >> 8]])
        return places.pop()

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, path, out, arcs, given = 0, [], [], self.arcs, 0
        while True:
            at = given + len(path)
            try:
                for byte in piece[at : at + self.look]:
                    state = arcs[state | byte]
                    path.append(state)
            except Dropped:
                *path, state = self._again([*path, state])
                continue
            if given + len(path) == len(piece):
                return (*out, *self._tokens(path, len(path)))
            done = self._settled(state, path)  # a long piece: what all guesses agree on is given out
            out += self._tokens(path, done)
            del path[:done]
            given += done


class Pieces(dict):
    """piece -> ids, worked out on first use. When half the limit is full it becomes the older half, and pieces of
    that which are used again come over; the rest goes with the next turn. Long pieces aren't kept, so bytes are bounded too."""

    def __init__(self, encode, limit: int = MAX_PIECES) -> None:  # noqa: ANN001
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def forget(self) -> None:
        self.clear()
        self.older.clear()

    def __missing__(self, piece: str):  # noqa: ANN204
        if len(piece) > KEPT_CHARS:
            return self.encode(piece.encode())
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode())
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(lambda piece: array("I", self.transducer.encode(piece)).tobytes())  # packed ids take half of a tuple's memory

    def forget(self) -> None:
        self.transducer.forget()
        self.pieces.forget()

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(text))), "<u4")


def utf8_table() -> np.ndarray:
    """State after each byte. 0: between characters; 1, 2, 3: so many bytes to come; 4 to 7: after E0,
    ED, F0 and F4, whose next byte has a smaller range; 8: not UTF-8."""
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80], table[0, 0xC2:0xE0], table[0, 0xE0:0xF0], table[0, 0xF0:0xF5] = 0, 1, 2, 3
    for state, lead in enumerate((0xE0, 0xED, 0xF0, 0xF4), 4):
        table[0, lead] = state
    for left in (1, 2, 3):
        table[left, 0x80:0xC0] = left - 1
    table[4, 0xA0:0xC0], table[5, 0x80:0xA0], table[6, 0x90:0xC0], table[7, 0x80:0x90] = 1, 1, 2, 2
    return table


class Vocabulary:
    """Bytes of each id, and the recogniser's state after it for each state before it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        padded = np.zeros((len(self.tokens), int(sizes.max(initial=0))), np.uint8)
        padded[np.arange(padded.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(self.tokens), np.uint8)
        step, self.after = utf8_table(), np.tile(np.arange(9, dtype=np.uint8), (len(self.tokens), 1))
        for k in range(padded.shape[1]):
            self.after = np.where((k < sizes)[:, None], step[self.after, padded[:, k : k + 1]], self.after)
        self.whole = self.after[:, 0] == 0


class Stream:
    """Gives out the bytes of complete characters as ids come in."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.of, self.state, self.kept = vocabulary, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        state, at, done, n = self.state, 0, 0, len(ids)
        odd = np.flatnonzero(~self.of.whole[ids])
        while at < n:
            if state == 0:  # on to the next token that isn't whole characters
                k = int(np.searchsorted(odd, at))
                at = done = int(odd[k]) if k < len(odd) else n
                if at == n:
                    break
            state = int(self.of.after[ids[at], state])
            at += 1
        if state == 0:
            done = n
        self.state = state
        parts = list(map(self.of.tokens.__getitem__, ids.tolist()))
        if not done:
            self.kept += b"".join(parts)
            return b""
        out, self.kept = b"".join((self.kept, *parts[:done])), b"".join(parts[done:])
        return out

    def close(self) -> bytes:
        rest, self.kept, self.state = self.kept, b"", 0
        return rest


def decode(ids: np.ndarray, vocabulary: Vocabulary, feed: int = FEED) -> bytes:
    stream = Stream(vocabulary)
    return b"".join([*(stream.feed(ids[k : k + feed]) for k in range(0, len(ids), feed)), stream.close()])


@lru_cache(2)
def _encoder(name: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(public_tokenizers.path(name)), pattern)


@lru_cache(2)
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(load_ranks(public_tokenizers.path(name)))


def _encode(batches: Iterator[pa.RecordBatch], name: str, pattern: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(name, pattern)
    gc.set_threshold(200_000, 50, 50)  # the encoder's many small objects live long and hold no garbage
    for ids, texts in chunks(batches, 1 << 20):
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([encoder(x).tobytes() for x in texts], pa.binary())], ["id", "ids"])
    encoder.forget()  # workers outlive their tasks: what this one's texts needed goes, the tree of tokens stays
    give_back()


def _decode(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(name)
    for batch in batches:
        texts = [decode(np.frombuffer(x.as_buffer() or b"", "<u4"), vocabulary) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(texts, pa.binary())], ["id", "ids", "decoded"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id, ids (packed) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("ids", BinaryType())])
    return rows.mapInArrow(partial(_encode, name=ranks, pattern=pattern, id_type=to_arrow_type(kind)), schema)


def decode_ids(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """id, ids, decoded (bytes) of every row of (id, ids)."""
    schema = StructType([*encoded.select("id", "ids").schema.fields, StructField("decoded", BinaryType())])
    return encoded.select("id", "ids").mapInArrow(partial(_decode, name=ranks), schema)


def _round_trip(batches: Iterator[pa.RecordBatch], name: str, pattern: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, name, pattern, id_type), name)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id, ids, decoded of every row, encoded and decoded by one worker."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    return rows.mapInArrow(partial(_round_trip, name=ranks, pattern=pattern, id_type=to_arrow_type(kind)), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def token_digests(docs: DataFrame) -> DataFrame:
    return round_trip(docs).select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
