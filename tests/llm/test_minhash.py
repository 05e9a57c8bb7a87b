"""HyperMinHash near-dedup against all pairs, its estimate against true similarities, and hard inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wharfline.llm import minhash
from wharfline.llm.components import connected_components

SCHEMA = "doc_id long, text string, id string, n int, d1 long, key string, component string"
EXTRA = ("i", 1, 2, "k", "c")


def brute(rows):
    """(doc_id, n, component, kept) by all pairs of four-word sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[top(k)] = min(i, names.get(top(k), i))
    return sorted(((i, len(sets[k]), names.get(top(k)), i == names.get(top(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    texts = []
    for size in (4, 5, 6, 8, 12, 20, 40, 90, 200, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, 2, size // 25, size // 12):
                words = base[:]
                for _ in range(changes):
                    words[rng.randrange(len(words))] = word()
                texts.append(" ".join(words[rng.randrange(2) :]))
    shared = " ".join(word() for _ in range(60))  # a passage that many texts hold
    texts += [shared + " " + " ".join(word() for _ in range(k)) for k in range(0, 60, 3)]
    return texts


@pytest.mark.parametrize("hot_rows", [minhash.HOT_ROWS, 3])
def test_equals_all_pairs(spark, hot_rows):
    rows = list(enumerate([None, "", " \t", None, "", "a", "A", "a b", "one two three four", "One  two\nthree FOUR", "x " * 50_000, *corpus(1)]))
    rows += [(7, "repeated id one two three"), (7, "repeated id one two three"), (7, "another text of the same id"), (None, "no id at all here"), (None, "no id at all here"), (None, rows[40][1]), (3, rows[50][1])]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = minhash.near_duplicates(docs, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found, want = sorted(map(tuple, got.collect()), key=str), brute(rows)
    # rows of one id that stand in different groups have no order of their own in brute(); null ids compare as kept only without a name
    assert [(i, n, c) for i, n, c, _ in found] == [(i, n, c) for i, n, c, _ in want]
    assert all(kept == (i == c) for i, _, c, kept in found)


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    named = spark.createDataFrame([("b", "one two three four five"), ("a", "One two three four five"), (None, "x y")], "doc_id string, text string")
    assert sorted(map(tuple, minhash.near_duplicates(named).collect()), key=str) == [("a", 2, "a", True), ("b", 2, "a", False), (None, 1, None, True)]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    for size in (5, 10, 30, 100, 300, 3000):
        errors, banded = [], 0
        for _ in range(200):
            common, own = rng.integers(0, 1 << 64, size * 4, np.uint64), rng.integers(0, 1 << 64, size, np.uint64)  # 4 of 5 are shared
            a, b = np.unique(common), np.unique(np.concatenate([common, own]))
            ra, rb = minhash.registers(a)[None], minhash.registers(b)[None]
            errors.append(minhash.estimates(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - 0.8)
            banded += (minhash.bands(ra.astype("<u2")) == minhash.bands(rb.astype("<u2"))).any()
        assert banded == 200
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06 and min(errors) > minhash.LEAST_ESTIMATE - 0.8, size


def test_unlike_sets_agree_by_chance_only():
    rng = np.random.default_rng(4)
    tries = [(np.sort(rng.integers(0, 1 << 64, 2000, np.uint64)), np.sort(rng.integers(0, 1 << 64, 500, np.uint64))) for _ in range(300)]
    equal = np.mean([(minhash.registers(a) == minhash.registers(b)).mean() for a, b in tries])
    assert equal == pytest.approx(2.0**-10 * 2000 * 500 / 2500**2 / (2 * np.log(2)), rel=0.5)
    assert minhash.registers(np.zeros(1, np.uint64)).tolist() == [53 << 10] * 128  # the least rest there is


def test_query_reads_whole_table(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = minhash.op12_minhash(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(enumerate(corpus(5))))
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_pairs_of_one_hash_grow_with_its_sets(spark):
    met = spark.createDataFrame([(1, k, 10, 0, k, 400) for k in range(400)] + [(2, 1000, 10, 0, 1000, 2), (2, 2000, 5, 0, 2000, 2)], "hash long, node long, n int, place int, component long, held long")
    dealt = minhash.dealt_pairs(met, spark.createDataFrame([(0, 1)], "u long, v long"))
    pairs = {tuple(r) for r in dealt.collect()}
    assert 400 < len(pairs) < 12 * 400 and (0, 1) not in pairs and all(u < v < 400 for u, v in pairs)  # sets that differ in size aren't compared
    rest = minhash.crossing_pairs(met, connected_components(dealt), dealt)  # as if all dealt pairs were similar
    assert rest.count() < 400  # 79,400 where all pairs are met
    apart = minhash.crossing_pairs(met, dealt.limit(0).select(F.col("u").alias("node"), F.col("v").alias("component")), dealt)
    assert {tuple(r) for r in apart.collect()} | pairs == {(u, v) for v in range(400) for u in range(v)}  # no pair is lost where none is


def test_heavily_edited_sets_meet_the_least_edited_ones(spark):
    # an origin, 300 sets linked to it and 100 that no deal has linked: only the least edited of the hash are near all of them
    met = spark.createDataFrame([(1, k, 100, min(k, 11), k, 401) for k in range(401)], "hash long, node long, n int, place int, component long, held long")
    found = spark.createDataFrame([(k, 0) for k in range(301)], "node long, component long")
    none = spark.createDataFrame([], "u long, v long")
    central = minhash.central_pairs(met, found, none)
    pairs = {tuple(r) for r in central.collect()}
    assert {(0, k) for k in range(301, 401)} <= pairs and len(pairs) <= minhash.CENTRES * 100
    assert minhash.central_pairs(met, found, none, 3).exceptAll(central).count() == 0  # hot hashes are broadcast
    assert minhash.crossing_pairs(met, found, none).count() == 35_050
    assert minhash.crossing_pairs(met, connected_components(found.toDF("v", "u").unionByName(central)), central).count() == 0
