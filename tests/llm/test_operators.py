"""Each operator against a brute-force version, and over hard inputs: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wharfline.llm import bpe, exact_dedup, language_id, lm_scoring, mixing, quality_classifier, quality_rules, sharding, simhash, text_stats, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, fp long, key string, id string"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to there again and again until night falls"
TEXTS = [
    BASE, BASE, BASE.replace(" ", "\n\t "), BASE + " now", "", None, "   ", "Größe é 日本 😀", "a", "a b", "x " * 30_000, "EUR*** $$$ ### x%", "don't '' <|endoftext|>  s 12345",
    "Der schnelle Fuchs springt über den faulen Hund und läuft weg", "el perro corre mañana por la calle", "\x1c\x85  ü", BASE.upper(),
]


def rows(texts=TEXTS):
    return [(k, t, ["en", "de", None, "es"][k % 4], ["s0", None, "s1", "s0"][k % 4], 0, "d", 1, "k", "i") for k, t in enumerate(texts)] + [(3, "twice", "en", "s0", 0, "d", 1, "k", "i"), (3, "twice", "en", "s0", 0, "d", 1, "k", "i"), (None, "no id", "en", "s0", 0, "d", 1, "k", "i")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().split()


# 1
def test_lm_scores(spark, docs, empty):
    got = lm_scoring.score_texts(docs).collect()
    train, lists = Counter(), []
    for i, t, *_ in rows():
        toks = [*(t or "").encode().lower().split(), b"\n"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        lists.append((i, toks, held))
        if not held:
            train.update(toks)
    n, v = sum(train.values()), len(train)
    want = sorted(
        (i is None, i or 0, held, len(toks), sum(train[x] > 0 for x in toks), n, round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks), 6)) for i, toks, held in lists
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score_texts(empty).count() == 0
    # repeated text is likelier than its words alone
    assert next(r for r in got if r.doc_id == 1).score > next(r for r in got if r.doc_id == 1).base_score


def test_lm_rare_words_take_the_shuffled_way(spark, docs):
    many, few = (sorted(map(tuple, lm_scoring.score_texts(docs, hot=h).select("n_tokens", "n_known", F.round("base_score", 6)).collect())) for h in (1 << 18, 3))
    assert many == few


def pair_scores(docs, **bounds):
    return sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in lm_scoring.score_texts(docs, **bounds).collect())


def test_lm_pairs_count_after_rare_words_too(docs):
    assert pair_scores(docs, hot=3) == pair_scores(docs) == pair_scores(docs, hot=0)


def test_lm_pairs_beyond_the_filter_count_too(docs):
    many = docs.union(docs).union(docs.where("doc_id < 4"))
    whole = pair_scores(many)
    assert pair_scores(many, filter_bits=0) == whole == pair_scores(many, filter_bits=12 * 60, hot=3)


def test_log_frequency_filter():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.tile([1, 2, 3, 9, 200], 1000)
    levels = lm_scoring.level_of(counts)
    blocks = 40
    of = lm_scoring.block_of(keys, blocks)
    bits = np.stack([np.frombuffer(lm_scoring.build_block(keys[of == b], levels[of == b]), np.uint8) for b in range(blocks)])
    read = lm_scoring.read_levels(bits, keys, int(levels.max()))
    assert (read >= levels).all() and (read != levels).mean() < 0.02
    values = lm_scoring.level_counts(int(levels.max()))[levels[counts > 1]]
    assert (np.abs(np.log(values / counts[counts > 1])) < math.log(1.45)).all()


@pytest.fixture(scope="module")
def exact_scores():
    """Scores of the small table's texts from a plain table of quantised pair counts."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    lists = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in table}
    n, pairs, mass = Counter(), Counter(), Counter()
    for i, toks in lists.items():
        if zlib.crc32(str(i).encode()) % 10:
            n.update(toks)
            pairs.update(zip([b"\n", *toks], toks))
    levels = lm_scoring.level_of(np.array(list(pairs.values())))
    counts = lm_scoring.level_counts(int(levels.max()))[levels] - lm_scoring.DISCOUNT
    held = dict(zip(pairs, counts.tolist(), strict=True))
    for (a, _), c in held.items():
        mass[a] += c
    scale, scores = sum(n.values()) + 0.1 * (len(n) + 1), {}
    for i, toks in lists.items():
        total = 0.0
        for a, b in zip([b"\n", *toks], toks):
            base, history = (n[b] + 0.1) / scale, max(n[a], mass[a] / 0.999)
            total += math.log10(held.get((a, b), 0.0) / history + (1 - mass[a] / history) * base if history else base)
        scores[i] = total, len(toks)
    return scores


@pytest.mark.parametrize("filter_bits", [lm_scoring.FILTER_BITS, 1 << 22, 1 << 21])
def test_lm_scores_are_those_of_a_table_of_counts(spark, exact_scores, filter_bits):
    got = lm_scoring.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), filter_bits=filter_bits, hot=20_000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: n for i, (_, n) in exact_scores.items()}
    off = sum(abs(r.score - exact_scores[r.doc_id][0]) for r in got) / sum(r.n_tokens for r in got)
    assert off < 1e-4, off


def test_lm_probabilities_of_followers_sum_to_one(spark):
    texts = [("a b a c a b d a b " * 20, k) for k in range(40)]
    frame = spark.createDataFrame([(k, t) for t, k in texts], "doc_id long, text string")
    alone = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(["a", "b", "c", "d", ""])], "doc_id long, text string")
    # P(first word | end) of all words of the vocabulary, times P(end | word), is below one in sum and positive
    got = lm_scoring.score_texts(frame.unionByName(alone)).where("doc_id >= 1000").collect()
    assert 0 < sum(10**r.score for r in got) <= 1.0001


# 2
def brute_dedup():
    groups = defaultdict(list)
    for i, t, *_ in rows():
        norm = __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append(i)
    return groups


@pytest.mark.parametrize("heavy_rows", [1, 2, 64])
def test_exact_dedup(docs, empty, heavy_rows):
    got = exact_dedup.mark_duplicates(docs, heavy_rows=heavy_rows).collect()
    groups = brute_dedup()
    assert len(got) == len(rows())
    for r in got:
        g = groups[r.text_sha256]
        assert r.doc_id in g and r.group_size == len(g) and r.keep_id == min((x for x in g if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.drop_duplicates(docs, heavy_rows=heavy_rows)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_of_many_groups_beyond_the_heavy_ones(spark):
    """More frequent digests than winners; the hottest of the rest are broadcast."""
    frame = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text  "), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 300).cast("string")).alias("text"))
    want = frame.groupBy("text").agg(F.min("doc_id").alias("k"), F.count("*").alias("n")).collect()
    got = exact_dedup.mark_duplicates(frame, heavy=1, hot_rows=100)
    assert sorted((r.keep_id, r.group_size, r.c, r.s) for r in got.groupBy("keep_id", "group_size").agg(F.count("*").alias("c"), F.sum(F.col("kept").cast("int")).alias("s")).collect()) == sorted((r.k, r.n, r.n, 1) for r in want)
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(frame, heavy=1).collect()) == sorted(r.k for r in want)


# 3
@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.RANKS))


def test_bpe_matches_the_library_and_decodes(docs, empty, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows())
    got = bpe.decode_ids(bpe.encode_texts(docs))
    assert Counter((r.id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    assert bpe.token_digests(empty).count() == 0


def test_bpe_pieces_with_a_small_state_budget(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small, random, tokens = bpe.Transducer(ranks, max_states=50, look=8), np.random.default_rng(7), list(ranks)
    for k in range(1500):
        piece = b"".join(tokens[j] for j in random.integers(0, len(tokens), random.integers(1, 5))) if k % 2 else bytes(random.choice(list(b"aabte "), random.integers(1, 40)).tolist())
        assert small.encode(piece) == tuple(library._core_bpe.encode_single_piece(piece))


def test_bpe_long_pieces_are_given_out_on_the_way(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = bpe.Pieces(bpe.Transducer(ranks).encode)
    for piece in ("ab" * 20_000, "é日本" * 3000, "=" * 9999):
        assert pieces[piece] == tuple(library._core_bpe.encode_single_piece(piece.encode()))
    assert not pieces  # long pieces aren't kept


def test_stream_decoder_gives_whole_characters(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary, text = bpe.Vocabulary(ranks), "né 日本語 😀😀 Ω ab"
    ids = np.array(library.encode_ordinary(text), "<u4")
    for size in (1, 2, 3, 100):
        stream = bpe.Stream(vocabulary)
        parts = [stream.feed(ids[k : k + size]) for k in range(0, len(ids), size)] + [stream.close()]
        for p in parts:
            p.decode()
        assert b"".join(parts) == text.encode()
    broken = np.array([ranks[bytes([b])] for b in b"a\xff\xe2"], "<u4")
    assert bpe.decode(broken, vocabulary, 1) == b"a\xff\xe2"


# 4
def test_token_files_round_trip(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    got = token_output.read_tokens(token_output.write_tokens(docs, block=64, frame=3000)).collect()
    want = Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, *_ in rows())
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    at = 0
    order = sorted(got, key=lambda r: r.start)
    assert [r.id if r.id is not None else -1 for r in order] == sorted(r.id if r.id is not None else -1 for r in order)
    for r in order:
        assert r.start == at
        at += len(r.ids) // 4
    assert token_output.read_tokens(token_output.write_tokens(empty)).count() == 0


def test_frames_are_checked():
    random = np.random.default_rng(1)
    lists = [random.integers(0, 50_257, n).astype(np.uint16) for n in (0, 1, 700, 3000)] + [np.full(5000, 7, np.uint16), np.arange(4000, dtype=np.uint16)]
    frame = token_output.write_frame([1, None, 3, 4, 5, 6], lists, block=256)
    keys, back = token_output.read_frame(frame)
    assert keys == [1, None, 3, 4, 5, 6] and all((a == b).all() and len(a) == len(b) for a, b in zip(lists, back, strict=True))
    assert len(token_output.write_frame([1], [np.full(5000, 7, np.uint16)], block=2048)) < 400
    for at in (30, len(frame) // 2, len(frame) - 5):
        bad = bytearray(frame)
        bad[at] ^= 64
        with pytest.raises((ValueError, zlib.error)):
            token_output.read_frame(bytes(bad))
    with pytest.raises((ValueError, __import__("struct").error)):
        token_output.read_frame(frame[:-200])


# 5
def brute_counts(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rule_counts_and_verdicts(docs, empty, marks):
    got = quality_rules.judge(docs, marks).collect()
    want = Counter((i, *brute_counts(t)) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) and 0 <= r.anomaly <= 1
    assert quality_rules.judge(empty, marks).count() == 0
    assert quality_rules.judge(docs, marks.where("false")).where("kept").count() == sum(not r.base_failed for r in got)


def test_forest_sets_outliers_apart():
    random = np.random.default_rng(3)
    x = np.vstack([random.normal(size=(2000, 13)), random.normal(size=(40, 13)) + 8])
    score = quality_rules.Forest(x, 64, 256, 1).score(x)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)
    limit = quality_rules.threshold([(int(s * 2000), float(k < 2000), 1) for k, s in enumerate(score)], 2000, 0.005)
    assert (score[2000:] >= limit).all() and (score[:2000] >= limit).mean() <= 0.005
    assert quality_rules.Forest(np.zeros((0, 13)), 4, 16, 1).score(np.zeros((2, 13))).tolist() == [0, 0]


# 6
def test_language_id(spark, docs, empty):
    samples = {"en": "the dog and the house were there with them", "de": "der Hund und das Haus waren dort mit ihnen", "fr": "le chien et la maison étaient là avec eux", "es": "el perro y la casa estaban allí con ellos", "nl": "de hond en het huis waren daar met hen", "it": "il cane e la casa erano lì con loro"}
    for langs in (["en"], ["en", "de"], list(samples)):
        train = spark.createDataFrame([(k, samples[x], x) for k, x in enumerate(langs * 5)], "doc_id long, text string, lang string")
        decoder = language_id.learn(train)
        got = {(r.id, r.lang_pred) for r in language_id.predict(train, decoder).collect()}
        assert got == {(k, x) for k, x in enumerate(langs * 5)}
    odd = {r.id: r for r in language_id.predict(docs, decoder).collect()}
    assert len(odd) == len({i for i, *_ in rows()}) and all(0 <= r.score <= 1 for r in odd.values())
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (4, 5, 6)) and odd[13].lang_pred == "de" and odd[14].lang_pred == "es"
    assert language_id.predict(empty, decoder).count() == 0
    assert language_id.predict(docs, language_id.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_codewords_are_apart():
    for n in range(2, 40):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert (apart[~np.eye(n, dtype=bool)] >= (1 if n < 3 else 2)).all()


# 7
def brute_print(text, shingle=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints):
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in prints}


def test_fingerprints(docs, empty):
    got = Counter((r.doc_id, r.fp) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((i, np.uint64(brute_print(t)).astype(np.int64).item()) for i, t, *_ in rows())
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 7 and all(25 <= m.bit_count() <= 45 for m in masks)
    for a in range(64):
        for b in range(a, 64):
            assert any(not m & (1 << a | 1 << b) for m in masks)


@pytest.mark.parametrize("pairwise", [1, 24])
def test_near_components(spark, pairwise):
    random = np.random.default_rng(5)
    prints, base = {}, [int(x) for x in random.integers(0, 1 << 63, 12)]
    for k in range(400):
        x = base[k % 12]
        for b in random.integers(0, 64, k % 6):
            x ^= 1 << int(b)
        prints[k] = x
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for x, k in {x: k for k, x in reversed(list(prints.items()))}.items()], "fp long, rep long")
    pairs = simhash.linked_pairs(frame, pairwise=pairwise)
    from wharfline.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(pairs).collect()}
    assert {k: found.get(k, k) for k in (r.rep for r in frame.collect())} == {k: v for k, v in brute_classes({r.rep: r.fp & (1 << 64) - 1 for r in frame.collect()}).items()}
    assert connected_components(pairs.where("false")).count() == 0
    assert {r.node: r.component for r in connected_components(pairs, hub=1).collect()} == found


def test_near_stage_keeps_one_of_each(docs, empty):
    kept = simhash.keep_one_of_each(docs.where("doc_id is not null"))
    classes = simhash.near_duplicates(docs.where("doc_id is not null")).select("component").distinct().count()
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == classes
    assert simhash.keep_one_of_each(empty).count() == 0


# 8
def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(words(t))
    target = brute_targets(dict(sizes))
    assert len(got) == len(rows())
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert math.isclose(r.target, target[s], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(taken[s] == round(target[s]) for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").na.fill(-1).collect())) == sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").na.fill(-1).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixed_rows_of_one_id_have_their_own_counts(spark):
    frame = spark.createDataFrame([(k, f"a{j} b", "s0") for k in (1, None) for j in range(20)] + [(2, "c d", "s1")] * 40, "doc_id long, text string, source string")
    want = sum((2 * r.taken + r.size) // (2 * r.size) for r in mixing.mix(frame).collect())
    assert mixing.mixed_documents(frame).count() == want


# 9
def test_sharding(spark, docs, empty):
    texts = [f"text {k % 97}" if k % 3 else f"own {k}" for k in range(1500)] + ["hot"] * 800
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sharding.assign_shards(frame, shards=8).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    where = defaultdict(Counter)
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 16 and r.crc == zlib.crc32(texts[r.doc_id].encode())
        where[texts[r.doc_id]][r.shard] += 1
    whole = [max(c.values()) / sum(c.values()) for t, c in where.items() if t.startswith("text")]
    assert np.mean(whole) > 0.95  # random shards would hold about a third of a group together
    assert sharding.assign_shards(docs).count() == len(rows()) and sharding.assign_shards(empty).count() == 0


def test_quotas_keep_every_count():
    random = np.random.default_rng(2)
    for _ in range(50):
        n = 6
        wish = {(a, b): int(random.integers(1, 50)) for a in range(n) for b in range(n) if a != b and random.random() < 0.5}
        free = random.integers(0, 60, n).tolist()
        allow, paid = sharding.quotas(wish, free)
        change = Counter()
        for (a, b), k in [*allow.items(), *(((a, b), k) for a, b, k in paid)]:
            change[a] -= k
            change[b] += k
        assert not any(change.values()) and all(k <= wish[p] for p, k in allow.items())
        out = Counter()
        for a, _, k in paid:
            out[a] += k
        assert all(out[a] <= free[a] for a in range(n))


# 10
def test_quality_scores(spark, docs, empty, marks):
    got = quality_classifier.quality_scores(docs, marks).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    assert quality_classifier.quality_scores(empty, marks).count() == 0
    assert {r.score for r in quality_classifier.quality_scores(docs, marks.where("false")).collect()} == {0.5}


def test_quality_accuracy_on_held_out_rows(spark):
    good = [f"{BASE} {k} and some more words of a sound text number {k}" for k in range(150)]
    bad = [("BUY!! NOW!! | $$$ " * 20) + str(k) for k in range(150)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1 - k % 2) for k in range(len(texts))], "doc_id long, quality int")
    held = quality_classifier.quality_scores(frame, marks).where("held_out").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held)
    assert quality_classifier.keep_good(frame, marks).where("doc_id % 2 = 0").count() == 150


def test_isotonic_pools_violators():
    x, y = quality_classifier.isotonic([(0.0, 0.2, 1), (1.0, 0.1, 1), (2.0, 0.5, 2)])
    assert x.tolist() == [0.5, 2.0] and np.allclose(y, [0.15, 0.5])


def test_statistics_of_odd_texts():
    for t in [t or "" for t in TEXTS]:
        counts, ratios = text_stats.text_stats(t)
        assert tuple(counts) == brute_counts(t) and all(math.isfinite(x) for x in ratios)


def test_pieces_are_packed_and_states_share_their_numbers():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    encoder = bpe.Encoder(ranks, r"\w+|\s")
    assert encoder("abcab x abcab").tolist() == [257, 256, 32, 120, 32, 257, 256]
    assert {piece: np.frombuffer(ids, "<u4").tolist() for piece, ids in encoder.pieces.items()} == {"abcab": [257, 256], " ": [32], "x": [120]}
    numbers = {id(n) for n in encoder.transducer.number.values()}
    assert all(id(state) in numbers for state in encoder.transducer.arcs.values() if state >> 8)
