"""Toxicity: gradient-boosted trees over dense features, calibrated.

A lexicon of words and word beginnings is learned from a bounded sample of
labelled documents (``sample`` rows, those of the smallest hashes); trees and
an isotonic calibration are fitted on its features.  Lexicon counts are sums
over tasks, and the driver sees ``lexicon`` entries and ``sample`` feature
rows at most, whatever the corpus.  Scoring reads every whole text once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWERED, NON_SPACE, Scratch, hash_words, ship, slices, text_buffers, unused, words_of

#: Labelled keys learned from, entries of the lexicon, and letters of a word's beginning.
SAMPLE = 20_000
LEXICON = 4_096
BEGINNING = 5
#: An entry stands in so many sampled texts at least, and its log odds are above this.
RARE, ODDS = 4, 0.7

#: Second persons in the corpus' languages.
_SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi ton ta tes vous votre vos te ti tus usted ustedes vosotros vuestro".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT | ~NON_SPACE)
_SHOUT = np.zeros(256, bool)
_SHOUT[[33, 63]] = True
#: Characters often put for letters inside a word.
_SWAP = np.arange(256, dtype=np.uint8)
for _from, _to in zip(b"013457@$!+", b"oieastasit", strict=True):
    _SWAP[_from] = _to
_CORE = _LETTER | _DIGIT
_CORE[[*b"@$+"]] = True

FEATURES = (
    "hits", "hit_rate", "strength", "strength_rate", "strongest", "begin_strength", "begin_rate", "begin_strongest",
    "veiled_hits", "near_second", "second_rate", "capitals", "capital_words", "marks", "shouts", "digits",
    "mixed_words", "log_words", "mean_word", "window_strength",
)


def _cores(raw: np.ndarray, offsets: np.ndarray):
    """Words without marks at their edges: starts, ends, text of each word."""
    starts, ends, text = words_of(raw, offsets, _CORE)
    return starts, ends, text


def entries(raw: np.ndarray, offsets: np.ndarray):
    """For each word: text, fingerprint of the word and of its beginning."""
    starts, ends, text = _cores(raw, offsets)
    low = LOWERED[raw]
    word = hash_words(low, starts, ends)
    begin = hash_words(low, starts, np.minimum(ends, starts + BEGINNING)) ^ np.uint64(1)
    return starts, ends, text, word, begin


def _second_persons() -> np.ndarray:
    blob = " ".join(_SECOND).encode()
    raw = np.frombuffer(blob, np.uint8)
    starts, ends, _ = words_of(raw, np.array([0, len(raw)]), NON_SPACE)
    return np.sort(hash_words(raw, starts, ends))


def _value(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def features(column, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    starts, ends, text, word, begin = entries(raw, offsets)
    count = np.bincount(text, minlength=n).astype(float)
    per_word = 1 / np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1)
    total = lambda x: np.bincount(text, x, n)

    def most(x):
        out = np.zeros(n)
        np.maximum.at(out, text, x)
        return out

    v, b = _value(keys, values, word), _value(keys, values, begin)
    hit = v > 1
    swapped = _SWAP[LOWERED[raw]]
    has_odd = np.concatenate([[0], np.cumsum(_SWAP[LOWERED[raw]] != LOWERED[raw])])
    odd = (has_odd[ends] > has_odd[starts]) & ~hit
    veiled = np.zeros(len(word))
    if odd.any():
        veiled[odd] = _value(keys, values, hash_words(swapped, starts[odd], ends[odd])) > 1
    second = np.isin(word, _second_persons())
    near = np.zeros(len(word), bool)
    for shift in range(1, 6):
        same = text[shift:] == text[:-shift]
        near[shift:] |= second[:-shift] & same
        near[:-shift] |= second[shift:] & same
    char = lambda lut: np.diff(np.concatenate([[0], np.cumsum(lut[raw])])[offsets]) / size
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    length = ends - starts
    caps = ((upper[ends] - upper[starts]) == length) & (length > 1)
    d = digit[ends] - digit[starts]
    good = np.maximum(v, 0) + np.maximum(b, 0)
    run = np.concatenate([[0], np.cumsum(good)])
    last = np.minimum(np.arange(len(good)) + 20, np.cumsum(count).astype(np.int64)[text] if len(good) else 0)
    window = run[last] - run[:-1] if len(good) else good
    return np.stack(
        [
            total(hit), total(hit) * per_word, total(v), total(v) * per_word, most(v), total(b), total(b) * per_word, most(b),
            total(veiled), total(hit & near), total(second) * per_word, char(_UPPER), total(caps) * per_word, char(_MARK), char(_SHOUT), char(_DIGIT),
            total((d > 0) & (d < length)) * per_word, np.log1p(count), total(length) * per_word, most(window),
        ],
        1,
    )


@dataclass
class Trees:
    """Boosted trees of fixed depth; node i has children 2i+1 and 2i+2."""

    start: float
    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.column.shape[1]
        rows = np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Logistic loss, second order, on quantile bins."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    inner, k = 2**depth - 1, x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if len(x) else np.zeros(1) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    columns, cuts, leaves = [], [], []
    score = np.full(len(y), start)
    for _ in range(trees if len(y) else 0):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            local = node - first
            for j in range(k):
                if not len(edges[j]):
                    continue
                m = len(edges[j]) + 1
                cell = local * m + binned[:, j]
                gs = np.cumsum(np.bincount(cell, g, wide * m).reshape(wide, m), 1)
                hs = np.cumsum(np.bincount(cell, h, wide * m).reshape(wide, m), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs[:, :-1] ** 2 / (hs[:, :-1] + ridge) + (gt - gs[:, :-1]) ** 2 / (ht - hs[:, :-1] + ridge) - gt**2 / (ht + ridge)
                gain[(hs[:, :-1] < 1e-3) | (ht - hs[:, :-1] < 1e-3)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                better = top > best
                best[better] = top[better]
                column[first : first + wide][better] = j
                cut[first : first + wide][better] = edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[at]
        columns.append(column)
        cuts.append(cut)
        leaves.append(leaf)
    shape = (len(columns), inner)
    return Trees(start, np.array(columns, np.int64).reshape(shape), np.array(cuts).reshape(shape), np.array(leaves).reshape(len(columns), inner + 1))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising calibration: pooled adjacent violators at their mean scores."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, blocks[-1][2] + s]
    # A pseudo-count keeps the ends off 0 and 1.
    return np.array([s / n for _, n, s in blocks]), np.array([(v + 0.5 * (len(blocks) == 1)) / (n + (len(blocks) == 1)) for v, n, _ in blocks])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Between knots scores rise in a line; a thousandth keeps the order of ties."""
    tie = 1 / (1 + np.exp(-raw))
    flat = np.interp(raw, *knots) if len(knots[0]) else tie
    return np.clip(0.999 * flat + 0.001 * tie, 0.0, 1.0)


def fold_of(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    corpus: DataFrame | None = None,
    sample: int = SAMPLE,
    lexicon: int = LEXICON,
) -> DataFrame:
    """Add held_out, score and predicted to every document.

    Labels are taken from rows whose crc32(key as text) mod 5 is not 0; those
    rows' texts come from ``corpus`` (default: ``docs``).  Null keys and
    labels teach nothing; of several labels of a key the highest counts.  A
    quarter of the sample is kept from the trees for the calibration.  Without
    usable labels every score is that of an even prior.  Of several texts of
    one key one is learned from, so that ``sample`` bounds what is collected.  Null texts score like
    empty ones.  Repeated rows are scored each; an empty table gives an empty
    result.  Columns of ``docs`` pass through; those named like the three
    results are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").where(fold_of(F.col("k")) > 0)
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    source = (corpus if corpus is not None else docs).select(F.col(key).alias("d"), F.col(text).alias("t"))
    # At most ``sample`` rows of (key, label).
    known = F.broadcast(known)
    train = source.join(known, F.col("d") == F.col("k")).select("k", F.coalesce("t", F.lit("")).alias("t"), F.col("y").cast("int").alias("y"))
    # One text for a key, however many rows repeat it: ``sample`` texts at most.
    train = train.groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("y").alias("y"))
    train = train.select("t", "y", (F.pmod(F.xxhash64("k", F.lit("part")), F.lit(4)) == 0).alias("cal"))
    train = scratch.write(train, "train")

    def counted(batches):
        for s in slices(batches, "t", 8 << 20):
            raw, offsets = text_buffers(s.column("t"))
            _, _, owner, word, begin = entries(raw, offsets)
            y = s.column("y").to_numpy(zero_copy_only=False).astype(bool)
            pairs = np.unique(np.stack([np.tile(owner, 2).astype(np.uint64), np.concatenate([word, begin])]), axis=1)
            h, at = np.unique(pairs[1], return_inverse=True)
            bad = y[pairs[0].astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.bincount(at, bad, len(h)).astype(np.int64)), pa.array(np.bincount(at, ~bad, len(h)).astype(np.int64))], ["h", "bad", "good"]
            )

    fit = train.where("not cal")
    n_bad, n_good = fit.agg(F.sum((F.col("y") > 0).cast("long")), F.sum((F.col("y") <= 0).cast("long"))).first()
    n_bad, n_good = n_bad or 0, n_good or 0
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    words = fit.mapInArrow(counted, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.where(F.col("bad") + F.col("good") >= RARE).withColumn("odds", odds)
    top = words.where(F.col("odds") > ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "h").limit(lexicon).toPandas().sort_values("h")
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], top["odds"].to_numpy(float)[order]

    def dense(batches):
        for s in slices(batches, "t", 4 << 20):
            x = features(s.column("t"), keys, values)
            yield pa.RecordBatch.from_arrays([s.column("y"), s.column("cal"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "cal", "x"])

    rows = train.mapInArrow(dense, "y int, cal boolean, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    y = (rows["y"].to_numpy() > 0).astype(float)
    cal = rows["cal"].to_numpy(bool)
    order = np.lexsort([*x.T, y, cal]) if len(x) else np.zeros(0, np.int64)
    x, y, cal = x[order], y[order], cal[order]
    model = fit_trees(x[~cal], y[~cal])
    knots = isotonic(model.raw(x[cal]), y[cal])
    scratch.drop()
    added = ("held_out", "score", "predicted")
    kept = [c for c in docs.columns if c not in added]
    body = unused(docs.columns, "body")

    def score(batches):
        for s in slices(batches, body, 4 << 20):
            p = calibrated(model.raw(features(s.column(body), keys, values)), knots)
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in kept), s.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, *added])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    rows = docs.select(*[docs[c] for c in kept], (fold_of(docs[key]) == 0).alias("held_out"), docs[text].alias(body))
    return rows.mapInArrow(score, schema)
