"""Packing: non-negative least squares over shallow length combinations.

A document becomes whole windows and one remainder.  The histogram of piece
lengths, at most ``window`` numbers, goes to the driver, which enumerates
combinations of two and three lengths that fill a window exactly, solves for
their repeat counts by non-negative least squares against the histogram,
rounds them down, packs what is left greedily, and lays the last leftovers end
to end, cutting them at window edges.  The outcome is a table of a few
thousand rules "the pieces of this length with these ranks go there"; ranks
come from counts per (chunk, length), so no length is ever sorted in one task.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, shuffle_partitions, slices

_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file (JSON), added tokens included.

    Ids are those of that library with ``add_special_tokens=False``; ranks are
    the ids, in whose order the file lists its merges.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The alphabet of byte-level BPE: printable bytes stand for themselves, others for characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def combinations(window: int, stride: int) -> list[tuple[int, ...]]:
    """All pairs, and the triples with one length on a lattice, that fill a window."""
    out = {(a, window - a) for a in range(1, window // 2 + 1)}
    for b in range(stride, window, stride):
        for a in range(1, (window - b) // 2 + 1):
            out.add(tuple(sorted((a, b, window - a - b))))
    return sorted(out)


def nonnegative_least_squares(columns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimise |A x - h|^2 over x >= 0 by accelerated projected gradients.

    Column j of A counts the lengths in ``columns[j]``; A is never built.
    """
    flat = np.array([v for c in columns for v in c])
    which = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    n, m = len(histogram), len(columns)
    times = lambda x: np.bincount(flat, x[which], n)
    back = lambda r: np.bincount(which, r[flat], m)
    v = np.ones(m)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x, y, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - histogram) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, window: int, stride: int = 64, slack: int = 8) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, rank from, rank to, first sequence, offset, step).

    A piece with a rank in the range goes to sequence ``first + rank - from``
    at the offset; where ``step`` > 0 pieces are laid end to end from position
    ``offset`` on, counted from the start of sequence ``first``.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rules, sequence = [], 0

    def take(lengths: tuple[int, ...], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for v in lengths:
            rules.append((v, int(used[v]), int(used[v]) + repeats, sequence, offset, 0))
            used[v] += repeats
            left[v] -= repeats
            offset += v
        sequence += repeats

    if left[window]:
        take((window,), int(left[window]))
    columns = [c for c in combinations(window, stride) if all(left[v] for v in c)]
    if columns:
        x = nonnegative_least_squares(columns, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            repeats = int(x[j])
            need = {v: columns[j].count(v) for v in columns[j]}
            repeats = min([repeats, *(int(left[v]) // k for v, k in need.items())])
            if repeats > 0:
                take(columns[j], repeats)
    # Greedy: the largest length, then the largest that still fits, as often as counts allow.
    for top in range(window - 1, 0, -1):
        while left[top]:
            room, chosen, spare = window - top, [top], left.copy()
            spare[top] -= 1
            while room > slack:
                fit = np.flatnonzero(spare[: room + 1])
                if not len(fit):
                    break
                chosen.append(int(fit[-1]))
                spare[chosen[-1]] -= 1
                room -= chosen[-1]
            if room > slack:
                break
            take(tuple(chosen), min(int(left[v]) // chosen.count(v) for v in set(chosen)))
    # The rest lies end to end and is cut at window edges.
    position = 0
    for v in np.flatnonzero(left):
        count, v = int(left[v]), int(v)
        rules.append((v, int(used[v]), int(used[v]) + count, sequence, position, v))
        position += v * count
    return rules


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 1024,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; null and empty texts have that
    one id.  Every id lies in one piece.  Only the last sequence, and greedy
    ones by at most 8 ids, fall short of the window.  Repeated rows are packed
    each on their own; ties in rank order are between equal pieces only.  An
    empty table gives no pieces.  Other columns are not read.

    Tokens are made once; the pieces (ids of remainders with them, a few KB
    each at most) are stored in the shared folder and read by both the count
    and the placement.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    chunks = shuffle_partitions(spark)

    def cut(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for s in slices([b], "t", 4 << 20):
                keys, cols = [], [[] for _ in range(6)]
                for i, t in enumerate(s.column("t").to_pylist()):
                    ids = np.array(enc.encode(t or "", allowed_special="all") + [end_id], "<u4")
                    raw = ids.tobytes()
                    for start in range(0, len(ids), window):
                        part = raw[4 * start : 4 * (start + window)]
                        n = len(part) // 4
                        keys.append(i)
                        for c, v in zip(cols, (start, n, zlib.crc32(part), len(ids), None if n == window else part, zlib.crc32(part, i)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [s.column("k").take(pa.array(keys, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                    ["k", "start", "length", "crc", "doc_tokens", "ids"],
                )

    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        cut, f"k {kind}, start long, length long, crc long, doc_tokens long, ids binary"
    )
    pieces = scratch.write(made.withColumn("chunk", F.pmod(F.xxhash64("k", "start", "crc"), F.lit(chunks)).cast("int")), "pieces")

    counts = pieces.groupBy("length", "chunk").count()
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():
        histogram[length] = n
    rules = spark.createDataFrame(
        plan(histogram, window) or [(0, 0, 0, 0, 0, 0)], "r_length long, r_from long, r_to long, r_sequence long, r_offset long, r_step long"
    )
    before = W.Window.partitionBy("length").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("chunk", "length").orderBy("k", "start", "crc")
    ranked = (
        pieces.withColumn("nth", F.row_number().over(within) - 1)
        .join(bases, ["length", "chunk"])
        .withColumn("rank", F.col("base") + F.col("nth"))
    )
    # The rules are a few thousand rows, bounded by the window alone.
    placed = ranked.join(
        F.broadcast(rules), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to"))
    )
    nth = F.col("rank") - F.col("r_from")
    position = F.col("r_offset") + nth * F.col("r_step")
    laid = F.col("r_step") > 0
    placed = placed.select(
        "k", "start", "length", "crc", "doc_tokens",
        F.when(laid, F.col("r_sequence") + F.floor(position / window)).otherwise(F.col("r_sequence") + nth).cast("long").alias("sequence"),
        F.when(laid, position % window).otherwise(F.col("r_offset")).cast("long").alias("offset"),
        "ids",
    )
    over = F.col("offset") + F.col("length") > window

    def halve(batches):
        for b in batches:
            at = {c: b.column(c).to_numpy() for c in ("start", "length", "doc_tokens", "sequence", "offset")}
            first = window - at["offset"]
            ids = [v.as_buffer().to_pybytes() for v in b.column("ids")]
            crcs = [[zlib.crc32(x[: 4 * n]) for x, n in zip(ids, first.tolist(), strict=True)], [zlib.crc32(x[4 * n :]) for x, n in zip(ids, first.tolist(), strict=True)]]
            for start, n, sequence, offset, crc in (
                (at["start"], first, at["sequence"], at["offset"], crcs[0]),
                (at["start"] + first, at["length"] - first, at["sequence"] + 1, 0 * first, crcs[1]),
            ):
                cols = (start, n, np.array(crc, np.int64), at["doc_tokens"], sequence, offset)
                yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c) for c in cols)], ["k", "start", "length", "crc", "doc_tokens", "sequence", "offset"])

    placed = scratch.write(placed.withColumn("over", over).withColumn("ids", F.when(over, F.col("ids"))), "placed")
    scratch.drop("pieces")
    whole = placed.where(~F.col("over")).drop("ids", "over")
    halves = placed.where("over").drop("over").mapInArrow(halve, f"k {kind}, start long, length long, crc long, doc_tokens long, sequence long, offset long")
    return whole.unionByName(halves).select(
        F.col("k").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset"
    )
