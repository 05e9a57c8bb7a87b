"""Alignment of two tokenizers against a walk over both, and its sparse products against dense ones."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wharfline.llm import alignment

PATHS = public_tokenizers.path(alignment.TOKENIZER_A), public_tokenizers.path(alignment.TOKENIZER_B)
SCHEMA = "doc_id long, text string, id string, row long, pairs string, n_a string"
TEXTS = [
    "The quick brown fox jumps over the lazy dog", "the quick brown fox", "", None, " ", "a", "Größe é 日本 😀 naïve", "x <|endoftext|> <s> </s> <unk> <0x0A>", "▁ is no space", "tab\tand\nlines\r\n\r\n  end ",
    "    four spaces", "aaaaaaaaaaaaaaaaaaaa", "12345 67,89", "don't we'll 's", "é ​ \x00 ﻿", "word " * 4000, "no" + "spaces" * 3000, "quick quick quick",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_chars():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def walked(text, a, b):
    """Token ids of both sides, groups and links, by walking along both; None where there are no tokens."""
    if not text:
        return None
    ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    chars = byte_chars()
    raw_a = [bytes(chars[c] for c in a.id_to_token(x)) for x in ids[0]]
    raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
    if not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
        return None
    ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
    i = j = 0
    links, groups, own = [], [], ([], [])
    while i < len(ends[0]):
        links.append((i, j))
        end_a, end_b = ends[0][i], ends[1][j]
        if end_a <= end_b:
            own[0].append(ids[0][i])
            i += 1
        if end_b <= end_a:
            own[1].append(ids[1][j])
            j += 1
        if end_a == end_b:
            groups.append(own)
            own = ([], [])
    return ids, groups, links


def brute(texts, a, b):
    each = [walked(t, a, b) for t in texts]
    counts = Counter(pair for x in each if x for pair in {(x[0][0][i], x[0][1][j]) for i, j in x[2]})
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, groups, links = x
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest()))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_equals_walk(spark, libraries, hot_pairs):
    texts = [*TEXTS, TEXTS[0], TEXTS[0]]
    ids = [*range(len(TEXTS)), 0, None]
    docs = spark.createDataFrame([(i, t, "i", 1, "p", "n") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    got = alignment.align(docs, hot_pairs=hot_pairs).collect()
    want = list(zip(ids, brute(texts, *libraries), strict=True))
    assert sorted(((r.doc_id, tuple(r[f] for f in FIELDS)) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty).count() == 0 and alignment.token_links(empty).count() == 0


def test_links_of_tokens(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:12])), "doc_id long, text string")
    each = {k: walked(t, *libraries) for k, t in enumerate(TEXTS[:12])}
    got = sorted((r.doc_id, r.a_place, r.b_place, r.a, r.b) for r in alignment.token_links(docs).collect())
    assert got == sorted((k, i, j, x[0][0][i], x[0][1][j]) for k, x in each.items() if x for i, j in x[2])
    whole = {k: sum(len(g) * len(h) for g, h in x[1]) if x else 0 for k, x in each.items()}
    shared = alignment.token_links(docs, shared_groups=True).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in shared} == {k: n for k, n in whole.items() if n}
    assert {r.doc_id: r.n_shared for r in alignment.align(docs).collect()} == whole
    spelt = alignment.token_links(docs).groupBy("doc_id").sum("n_bytes").collect()
    assert {r[0]: r[1] for r in spelt} == {k: len(f" {TEXTS[k]}".encode()) for k, x in each.items() if x}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t▁abcéß日😀<s>/x123'.ARE"), max_size=60))
def test_encoders_equal_the_libraries(text):
    own, b = alignment.tokenizers(*PATHS), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    if "▁" not in text and text:  # such texts have no tokens either way
        assert own.encode_b(f" {text}") == b.encode(text)
    assert own.encode_a(f" {text}") == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(f" {text}", add_special_tokens=False).ids


def test_long_runs_of_white_space():
    own = alignment.tokenizers(*PATHS)
    text = " a" + " \n" * 200_000 + "b"
    assert b"".join(own.bytes_a[k] for k in own.encode_a(text)) == text.encode()
    assert own.encode_a(" a" + " " * 150_000 + "b") == own.encode_a(" a" + " " * 99_999)[:1] + own.encode_a("a" + " " * 149_999)[1:] + own.encode_a(" b")


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False), st.integers(1, 30))
def test_products_equal_dense_ones(rows, inner, width, random, at_once):
    dense = [np.array([[random.random() < 0.4 for _ in range(w)] for _ in range(h)]) for h, w in ((rows, inner), (inner, width))]
    a, b = (alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in dense)
    found = np.zeros((rows, width), int)
    for row, column, value in alignment.product(a, b, at_once):
        found[row, column] += value
    assert (found == dense[0].astype(int) @ dense[1].astype(int)).all()
    back = alignment.transposed(a)
    assert [back.columns[s:e].tolist() for s, e in zip(back.starts, back.starts[1:], strict=False)] == [np.flatnonzero(c).tolist() for c in dense[0].T]
