"""Hashes of word shingles, and the fingerprint of their majority."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import xxhash

SLICE = 1 << 16


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles, repeats included, a slice at a time; none for a wordless text."""
    words = text.encode().lower().split()
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    for at in range(0, n, SLICE):
        parts = [whole[a:b] for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), "<u8", len(parts))


def majority(slices: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def shingle_set(text: str, shingle: int) -> tuple[int, np.ndarray]:
    """The fingerprint and the distinct hashes in order; a wordless text has the set of 0 alone."""
    slices = list(shingle_hashes(text, shingle))
    return majority(slices), np.unique(np.concatenate(slices)) if slices else np.zeros(1, np.uint64)
