"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams the one with the smallest
fingerprint counts.  A shared run of ``window`` words has the same one on both
sides, so a window of a document can stand in an item only if its fingerprint
does.  Windows that pass a filter of item fingerprints are joined with the
windows of items by fingerprint and words, and hits are extended to all words
inside shared windows.  What is joined is windows, never whole texts.

Items of fewer than ``window`` words are one window each, which winnowing
can't promise to meet; for each such length that occurs, documents offer all
word sequences of that length instead.

The filter is a Bloom filter of fixed size (``2 ** BLOOM_BITS`` bits, whatever
the tables hold); when full it passes all, and the join stays right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWERED, Scratch, combine, grams, hash_words, may_hold, salted, ship, slices, text_buffers, unused, words_of
from .tiles import by_sorted_group

BLOOM_BITS = 22
SLICE = 4 << 20
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    least, span = h, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return least


class Texts:
    """Lower-cased words of many texts, and their windows."""

    def __init__(self, column):
        raw, offsets = text_buffers(column)
        self.raw = LOWERED[raw]
        self.starts, self.ends, self.owner = words_of(self.raw, offsets, ALNUM)
        self.h = hash_words(self.raw, self.starts, self.ends)
        self.n_words = np.bincount(self.owner, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])

    def winnowed(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint of the least k-gram) of every window."""
        if len(self.h) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # k-grams over all words; those across two texts are in no window within one.
        g = combine([self.h[i : len(self.h) - k + 1 + i] for i in range(k)])
        least = sliding_least(g, window - k + 1)
        at = np.flatnonzero(self.owner[: len(least)] == self.owner[window - 1 :])
        return at, least[at]

    def sequences(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every n words of one text."""
        g, at = grams(self.h, self.owner, n)
        return at, g ^ np.uint64(n)

    def spelt(self, at: np.ndarray, n: int) -> list[bytes]:
        """The words of windows, by single spaces."""
        body, starts, ends = self.raw.tobytes(), self.starts, self.ends
        return [b" ".join(body[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)) for i in at.tolist()]


def _rows(ids, texts: Texts, found: list[tuple[np.ndarray, np.ndarray, int]], name: str) -> pa.RecordBatch:
    """(id, position, n, fp, words) of windows."""
    at = np.concatenate([a for a, _, _ in found])
    owner = texts.owner[at]
    fp = np.concatenate([v for _, v, _ in found]).view(np.int64)
    n = np.concatenate([np.full(len(a), k, np.int32) for a, _, k in found])
    words = [w for a, _, k in found for w in texts.spelt(a, k)]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(owner)), pa.array((at - texts.first[owner]).astype(np.int64)), pa.array(n), pa.array(fp), pa.array(words, pa.binary())],
        [name, "position", "n", "fp", "words"],
    )


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(name, n, fp, words) of all windows of items (name, text)."""

    def each(batches):
        for s in slices(batches, "text", SLICE):
            t = Texts(s.column("text"))
            found = [(*t.winnowed(window, k), window)]
            for n in np.unique(t.n_words[(t.n_words > 0) & (t.n_words < window)]).tolist():
                at, v = t.sequences(n)
                whole = t.n_words[t.owner[at]] == n
                found.append((at[whole], v[whole], n))
            yield _rows(s.column("name"), t, found, "name")

    return items.mapInArrow(each, "name string, position long, n int, fp long, words binary").drop("position").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    k: int = 6,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted strings) and spans to every document.

    Spans are word positions [start, end) of merged hits.  Null and empty
    texts have no words and no hits; an item without words is in nothing; a
    null item id hits words but is not named; rows of one item id count as one
    item.  Repeated documents are judged each; with an empty benchmark all are
    clean, and no documents give no rows.  Columns of ``docs`` pass through,
    whatever their names, except those named like the four results, which are
    replaced.  Texts of documents that meet nothing are not shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontaminate")
    added = ("n_words", "n_hit", "item_ids", "spans")
    kept = [c for c in docs.columns if c not in added]
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text")).where("text is not null")
    windows = scratch.write(item_windows(items, window, k), "windows")
    short = sorted(r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # fewer than window numbers
    bit = F.col("fp").bitwiseAND((1 << BLOOM_BITS) - 1)
    marks = windows.select((bit / 32768).cast("int").alias("w"), (bit % 32768).cast("long").alias("b")).groupBy("w").agg(F.bitmap_construct_agg("b").alias("m"))
    bloom = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)  # filled from rows of 4 KB, of which there are 128
    for r in marks.collect():
        bloom[r["w"] * 4096 : r["w"] * 4096 + 4096] = np.frombuffer(r["m"], np.uint8)[:4096]

    def offer(batches):
        for s in slices(batches, "text", SLICE):
            t = Texts(s.column("text"))
            found = []
            for at, v, n in [(*t.winnowed(window, k), window), *((*t.sequences(n), n) for n in short)]:
                spot = (v & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)
                hit = ((bloom[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
                found.append((at[hit], v[hit], n))
            yield _rows(s.column("doc"), t, found, "doc")

    # By key and text, so that copies of a text are spread over the tasks.
    row_key = F.xxhash64(F.col(key), F.col(text))
    offered = docs.select(row_key.alias("doc"), F.col(text).alias("text")).mapInArrow(offer, "doc long, position long, n int, fp long, words binary")
    offered = scratch.write(offered, "offered")
    # First the windows themselves, once each; then the places of those that an item has, a frequent window dealt to many tasks.
    met = scratch.write(offered.select("fp", "words").distinct().join(windows, ["fp", "words"]), "met")
    places = salted(offered, ["fp", "words"], "doc", met.select("fp", "words").distinct()).select("doc", "position", "n").distinct()
    named = salted(offered, ["fp", "words"], "doc", met.where("name is not null").select("fp", "words", "name")).select("doc", "name").distinct()

    def merge(t: pa.Table) -> list[pa.RecordBatch]:
        start = t.column("position").to_numpy()
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate((start + t.column("n").to_numpy())[order])
        new = np.concatenate([[True], start[1:] > reach[:-1]])
        lo, hi = start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.RecordBatch.from_arrays([t.column("doc").slice(0, 1).combine_chunks(), pa.array([int((hi - lo).sum())]), pa.array([spans], kind)], ["doc", "hits", "spans"])]

    covered = by_sorted_group(places, "doc", merge, "doc long, hits long, spans array<struct<start:long,end:long>>")
    names = named.groupBy("doc").agg(F.sort_array(F.collect_set("name")).alias("names"))
    doc = unused(docs.columns, "doc")
    hits = covered.join(names, "doc", "left").select(F.col("doc").alias(doc), F.struct("hits", "names", "spans").alias(unused(docs.columns, "hits")))
    hits = scratch.write(hits, "hits")
    scratch.drop("windows", "offered", "met")
    found = F.col(hits.columns[1])
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    no_names, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:long,end:long>>")
    may_hit = may_hold(hits, doc)
    clean = docs.where(~may_hit(row_key)).select(*kept, n_words, F.lit(0).cast("long").alias("n_hit"), no_names.alias("item_ids"), no_spans.alias("spans"))
    judged = docs.where(may_hit(row_key)).withColumn(doc, row_key).join(hits, doc, "left")
    judged = judged.select(*kept, n_words, F.coalesce(found["hits"], F.lit(0)).cast("long").alias("n_hit"), F.coalesce(found["names"], no_names).alias("item_ids"), F.coalesce(found["spans"], no_spans).alias("spans"))
    return clean.unionByName(judged)
