from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wharfline.llm import bpe, exact_dedup, mixing, quality_classifier, shingle_join, shingles, simhash
from wharfline.llm.common import documents, labels, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """What each stage keeps, in turn, with the operators' own results beside it."""
    docs, kept = documents(spark, SF), []
    for _, step in corpus_pipeline.STAGES:
        after = step(spark, docs, SF).cache()
        kept.append((docs, after))
        docs = after
    return kept


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark, whole):
    (docs, good), (_, exact), (_, near), (_, mixed), (_, encoded) = whole
    assert all(x.columns == docs.columns for x in (good, exact, near, mixed))
    scores = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels(spark, SF)).collect()}
    assert ids(good) == sorted(k for k, s in scores.items() if s >= 0.5)
    assert ids(exact) == sorted(r.doc_id for r in exact_dedup.mark_duplicates(good).where("kept").collect())
    assert ids(near) == brute_kept([(r.doc_id, r.text) for r in exact.select("doc_id", "text").collect()])
    taken = mixing.mix(near).collect()
    assert ids(mixed) == sorted(r.doc_id for r in taken if r.size for _ in range((2 * r.taken + r.size) // (2 * r.size)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(np.array(library.encode_ordinary(r.text), "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()) == want
    assert encoded.count() == corpus_pipeline.run(spark, SF).count()


def test_empty_table(spark):
    docs = documents(spark, SF).where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute_kept(rows):
    """Ids of the least row of each group linked by a five-word Jaccard similarity of 0.8 or more."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        return k if root[k] == k else top(root[k])

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(doc_id)
    return sorted(map(min, groups.values()))


def test_near_stage_finds_every_similar_pair(spark):
    random = np.random.default_rng(7)
    texts = ["", " \n", "a b", "A  b", "a b c"]
    for size in (30, 60, 200, 400):
        for _ in range(3):
            base = [f"w{k}" for k in random.integers(0, 5000, size)]
            for edits in (0, 1, 1, 2, 3, 4, 6, 8, 10):
                near = list(base)
                for k in random.integers(0, size, edits * size // 200 + (edits > 0)):
                    near[k] = f"x{random.integers(0, 5000)}"
                texts.append(" ".join(near))
    common = " ".join(f"c{k}" for k in range(40))
    texts += [f"{common} {' '.join(f'v{k}' for k in random.integers(0, 5000, extra))}" for extra in (1, 3, 5, 7, 9, 11, 40, 80) for _ in range(6)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(simhash.keep_one_of_each(frame)) == brute_kept(rows)


def test_busy_shingles_are_shared_like_others(spark):
    random = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in random.integers(0, 12, 40)) for _ in range(60)] + ["", None, "a b"]
    frame = stage(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), "test-texts")
    _, counts = shingle_join.summaries(frame, 2)
    calm, busy = (sorted(map(tuple, shingle_join.shared_prefixes(frame, counts, 2, hot).collect())) for hot in (20_000, 0))
    assert calm == busy and len(calm) > 60


def test_sketches_never_rule_out_a_similar_pair():
    random = np.random.default_rng(5)
    for size in (1, 8, 60, 900, 30_000):
        base = np.unique(random.integers(0, 1 << 63, size, np.uint64))
        for part in (0.0, 0.05, 0.1, 0.2, 0.9):
            other = np.unique(np.concatenate([base[int(part * len(base)) :], random.integers(0, 1 << 63, int(part * size), np.uint64)]))
            apart = sum(int(a ^ b).bit_count() for a, b in zip(shingle_join.sketch(base).view("<u8"), shingle_join.sketch(other).view("<u8"), strict=True))
            assert apart <= len(np.setxor1d(base, other))
    assert shingle_join.sketch(shingles.shingle_set("", 5)[1]).shape == (32,)


def test_near_stage_tells_rows_apart_where_ids_are_null_or_repeat(spark):
    base = [f"w{k}" for k in range(50)]
    near = [" ".join([*base[:-1], f"x{k}"]) for k in range(4)]
    other = " ".join(f"o{k}" for k in range(50))
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (7, near[3]), (7, other), (None, other + " o"), (None, "alone without a name"), (None, "one more of these by itself")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4
    assert sorted((r.doc_id or 0, r.text[:2]) for r in kept) == [(0, "al"), (0, "on"), (7, "o0"), (7, "w0")]


def test_stages_carry_columns_whose_names_clash(spark):
    names = ["_id", "_row", "_copy", "_copies", "_kept", "_good", "_doc", "key", "id", "fp", "component", "score", "y", "fold", "size", "taken"]
    base = " ".join(f"w{k}" for k in range(60))
    texts = [base, base + " end", None, "", base, " ".join(f"z{k}" for k in range(30_000)), "short text"]
    rows = [(k if k != 4 else None, t, "en", "s0", 0, *([k] * len(names))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, SF)
        assert after.columns == docs.columns
        assert all(len({r[n] for n in names}) == 1 for r in after.collect())
        if step is not corpus_pipeline.quality:
            docs = after
    assert corpus_pipeline.encoding(spark, docs, SF).count() == docs.count() > 0


def test_rows_of_a_shingle_meet_the_least_edited_one(spark):
    shared = spark.createDataFrame([(1, k, 100, 0 if k == 7 else 5, 7, 100) for k in range(40)], "shingle long, row long, n int, place int, least long, least_n int")
    assert {tuple(r) for r in shingle_join.star_pairs(shared).collect()} == {(min(k, 7), max(k, 7)) for k in range(40) if k != 7}
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{j}" for j in range(k)] + base[2 * k :]) for k in (3, 2, 1, 0)]  # the last is the origin
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    held = {}
    for r in shingle_join.shared_prefixes(rows, shingle_join.summaries(rows, 5)[1], 5).collect():
        held.setdefault(r.shingle, []).append((r.place, r.row, r.least))
    assert len(held) > 3 and all({least for _, _, least in rows} == {min(rows)[1]} for rows in held.values())
    nothing = spark.createDataFrame([], "node long, component long")
    dealt = shingle_join.dealt_pairs(shared, nothing, spark.createDataFrame([], "u long, v long"))
    assert str(dealt._jdf.queryExecution().optimizedPlan()).count("Generate") == 1 and dealt.count() < 12 * 40  # all deals are one shuffle
