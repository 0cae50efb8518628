"""Candidate keys of the Jaccard join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import jaccard
from foliant.llm.common import mix64
from foliant.llm.jaccard import Threshold, candidate_keys


def both_keys(a, b, num):
    keys, at = candidate_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.zeros(1, np.uint8), Threshold(num, 100))
    return keys[: at[1]], keys[at[1] :]


@pytest.mark.parametrize("num", [85, 90, 95])
def test_linked_sets_share_a_key(num):
    rng, linked = np.random.RandomState(1), 0
    for n in [*range(1, 40), 60, 100, 300, 1000] * 12:
        a = np.unique(rng.randint(0, 2 ** int(rng.choice([60, 63])), n).astype(np.uint64))  # of narrow values many parts are empty
        left = np.delete(a, rng.choice(len(a), rng.randint(0, n // 8 + 1), replace=False))
        b = np.unique(np.concatenate([left, rng.randint(0, 2**63, rng.randint(0, n // 8 + 1)).astype(np.uint64)]))
        if Threshold(num, 100).linked(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(*both_keys(a, b, num)))
    assert linked > 30


def test_strangers_with_common_shingles_share_no_key(spark, monkeypatch):
    """Shingles recur in a growing corpus; documents must not meet for one of them (F1)."""
    rng, met = np.random.RandomState(2), []
    pool = mix64(np.arange(3000))
    sets = [np.sort(rng.choice(pool, 400, replace=False)) for _ in range(60)]
    bounds = np.arange(61) * 400
    keys, at = candidate_keys(np.concatenate(sets), bounds, np.zeros(1, np.uint8), Threshold(90, 100))
    assert len(np.unique(keys)) == len(keys)

    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, 300))) for i in range(80)]
    seen = jaccard._sets_of
    monkeypatch.setattr(jaccard, "_sets_of", lambda texts, pairs, *more: (met.append(pairs.count()), seen(texts, pairs, *more))[1])
    out = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert met == [0] and all(r.doc_id == r.component_id for r in out)


def test_keys_of_many_components_are_not_copied_for_the_driver(spark, monkeypatch):
    """Only rows of large keys are dealt by salts; with all of them so a broadcast grew 32 times over its estimate (F1)."""
    few = spark.range(1000).select(F.col("id").alias("key"), F.lit(5).cast("long").alias("size"))
    frame = spark.range(3000).select((F.col("id") % 1500).alias("key"), F.col("id").alias("cls"))
    monkeypatch.setattr(jaccard, "salted", lambda *a: pytest.fail("copied"))
    assert jaccard._members(frame, few).count() == 2000
    monkeypatch.undo()
    monkeypatch.setattr(jaccard, "HOT", 4)
    assert jaccard._members(frame, few).distinct().count() == 2000


@pytest.mark.parametrize("block", [1024, 24])
def test_near_misses_are_not_copied_by_the_size_of_their_group(spark, monkeypatch, block):
    """Rows in tiles stay within a bound for each member, and components are those of brute force."""
    rng = np.random.RandomState(11)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(420):
        words = list(base)
        for at in rng.choice(100, 3 if i % 7 else 1, replace=False):
            words[at] = f"x{rng.randint(6)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows, write = {}, jaccard.Scratch.write

    def counted(self, df, name, *more):
        out = write(self, df, name, *more)
        rows[name] = out.count() if name in ("members", "tiles") else 0
        return out

    monkeypatch.setattr(jaccard.Scratch, "write", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(docs).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(98)} for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(sets))}
    assert rows["tiles"] <= 2 * jaccard.BLOCKS * rows["members"]
    if block > len(texts):
        assert rows["tiles"] == rows["members"]
