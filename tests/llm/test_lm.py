"""The language model against a plain one: dictionaries, and EM over every token."""

import collections
import math
import zlib

import numpy as np
import pytest

from foliant.llm.lm import BUCKETS, score_documents

ROUNDS = 60


def fold(i):
    return zlib.crc32(str(i).encode()) % 10


class Plain:
    """Counts of bigrams, words and documents of some texts."""

    def __init__(self, texts):
        self.words, self.pairs, self.after = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            ts = [None, *t.split(), "</s>"]
            self.words.update(ts[1:])
            self.pairs.update(zip(ts, ts[1:], strict=False))
            self.after.update(ts[:-1])
        self.n, self.v = sum(self.words.values()), len(self.words)

    def estimates(self, before, word):
        c = self.after[before] if before is None else self.words[before]
        return [self.pairs[(before, word)] / c if c else 0.0, self.words[word] / max(self.n, 1), 1 / (self.v + 1)], min(int(math.log2(c + 1)), BUCKETS - 1)


def rounded(estimates):
    """As EM sees them: to eighths of a power of two."""
    return np.array([2.0 ** (np.rint(8 * np.log2(p)) / 8) if p > 0 else 0.0 for p in estimates])


def weights_of(fit, deleted):
    rows = []
    for t in deleted:
        ts = [None, *t.split(), "</s>"]
        rows += [(rounded(p), b) for p, b in (fit.estimates(x, y) for x, y in zip(ts, ts[1:], strict=False))]
    w = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        new = np.full((BUCKETS, 3), 1 / 3)
        total = np.ones(BUCKETS)
        for p, b in rows:
            share = w[b] * p
            new[b] += share / share.sum()
            total[b] += 1
        w = new / total[:, None]
    return w


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.RandomState(6)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(x), 59)] for x in rng.zipf(1.5, n) - 1)
    return [(i, text(rng.randint(1, 60))) for i in range(400)]


def test_score_is_the_interpolation(spark, corpus):
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    w = weights_of(Plain([t for i, t in corpus if fold(i) > 1]), [t for i, t in corpus if fold(i) == 1])
    full = Plain([t for i, t in corpus if fold(i)])
    mixed = lambda a, b: float(np.dot(w[(e := full.estimates(a, b))[1]], e[0]))
    for before in (None, "w0", "w1", "w5", "never seen"):
        known = sum(mixed(before, word) for word in full.words)
        unseen = mixed(before, "another word")
        c = full.after[None] if before is None else full.words[before]
        whole = known + unseen + (0.0 if c else w[0][0])  # an unknown context has no successors to share its weight
        assert whole == pytest.approx(1, abs=1e-9)
    for i, t in corpus:
        ts = [None, *t.split(), "</s>"]
        want = sum(math.log10(mixed(a, b)) for a, b in zip(ts, ts[1:], strict=False))
        assert got[i] == pytest.approx(want, rel=1e-6)


def test_held_out_texts_teach_nothing(spark, corpus):
    other = [(i, t if fold(i) else "zzz yyy zzz") for i, t in corpus]
    score = lambda rows: {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = score(corpus), score(other)
    assert all(a[i] == pytest.approx(b[i], rel=1e-12) for i, _ in corpus if fold(i))
