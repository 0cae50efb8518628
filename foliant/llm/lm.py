"""LM scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders up to ``order`` and
a uniform one; mixture weights depend on how often the context was seen
(buckets of powers of two) and are learned by expectation-maximisation on a
deleted part of the training documents whose counts the estimates leave out.

Counts never meet as one row per n-gram occurrence.  Documents are gathered
into blocks of a few MB; a block asks for the counts of its distinct n-grams,
as compressed arrays of 64-bit fingerprints cut by fingerprint range, ranges
are merged side by side, and the totals come back to the blocks.  Both
exchanges grow with the corpus, and every array is bounded by a block or by a
range, of which there are as many as the shuffle has partitions.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWERED, NON_SPACE, Scratch, combine, hash_words, shuffle_partitions, text_buffers, words_of

BLOCK = 8 << 20
BEGIN, END = np.uint64(0xB5026F5AA96619E9), np.uint64(0x5851F42D4C957F2D)
BUCKETS = 24
#: Steps per factor of two in which EM sees probabilities.
FINE = 8


def to_blob(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed unsigned 64-bit numbers, by byte planes."""
    v = values.astype("<u8")
    if ascending and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return len(v).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def from_blob(blob: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, an end after each text, and texts' bounds."""
    raw = LOWERED[raw]
    starts, ends, text = words_of(raw, offsets, NON_SPACE)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    h = np.full(bounds[-1], END, np.uint64)
    h[np.arange(len(starts)) + text] = hash_words(raw, starts, ends)
    return h, bounds


def ngrams(h: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the fingerprint of the n-gram that ends at each token.

    Those of two tokens and more keep 56 bits; with 10^12 of them, one in
    some 10^5 then shares its count with another.
    """
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [h]
    for k in range(2, order + 1):
        parts = []
        for back in range(k - 1, -1, -1):
            p = np.full(len(h), BEGIN, np.uint64)
            ok = place >= back
            p[ok] = h[np.flatnonzero(ok) - back]
            parts.append(p)
        out.append(combine(parts) & ~np.uint64(0xFF))
    return out


def _ranges(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


_BLOCK_SCHEMA = "block long, dev boolean, part int, ord int, keys binary, counts binary, ids array<{kind}>, roles array<int>, bounds binary, body binary, asks boolean"
HELD, DEV, FIT = 0, 1, 2


def _blocks(batches, order: int, parts: int, kind):
    """Text rows and count requests of blocks; deleted documents have blocks of their own."""
    open_: dict[bool, list] = {True: [], False: []}
    held_bytes = {True: 0, False: 0}

    def close(dev: bool):
        rows, open_[dev], held_bytes[dev] = open_[dev], [], 0
        table = pa.Table.from_batches(rows).combine_chunks()
        raw, offsets = text_buffers(table.column("t"))
        roles = table.column("role").to_numpy()
        block = uuid.uuid4().int >> 65
        h, bounds = tokens(raw, offsets)
        counted = np.repeat(roles != HELD, np.diff(bounds))
        out = [(block, dev, -1, 0, None, None, table.column("k").to_pylist(), roles.tolist(), to_blob(offsets, True), pa.compress(raw.tobytes(), codec="zstd", asbytes=True), False)]
        for o, g in enumerate(ngrams(h, bounds, order), 1):
            u, at = np.unique(g, return_inverse=True)
            c = np.bincount(at, counted, len(u)).astype(np.uint64)
            cut = _ranges(u, parts)
            for p in range(parts):
                lo, hi = cut[p], cut[p + 1]
                if hi > lo:
                    out.append((block, dev, p, o, to_blob(u[lo:hi], True), to_blob(c[lo:hi]), None, None, None, None, True))
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.bool_()]
        names = ["block", "dev", "part", "ord", "keys", "counts", "ids", "roles", "bounds", "body", "asks"]
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), types, strict=True)], names)

    for b in batches:
        role = b.column("role").to_numpy()
        sizes = np.asarray(pc.binary_length(b.column("t")).fill_null(0)) + 1
        for dev in (False, True):
            mine = np.flatnonzero((role == DEV) == dev)
            at = 0
            while at < len(mine):
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[mine[at:]]), BLOCK - held_bytes[dev], side="right")))
                open_[dev].append(b.take(pa.array(mine[at:upto])))
                held_bytes[dev] += int(sizes[mine[at:upto]].sum())
                at = upto
                if held_bytes[dev] >= BLOCK or at < len(mine):
                    yield from close(dev)
    for dev in (False, True):
        if open_[dev]:
            yield from close(dev)


def _merge(g: pd.DataFrame) -> pd.DataFrame:
    """Totals of one fingerprint range, sent back to each block that asked."""
    out = []
    for o, rows in g.groupby("ord"):
        keys = [from_blob(b, True) for b in rows["keys"]]
        counts = np.concatenate([from_blob(b) for b in rows["counts"]])
        sizes = [len(k) for k in keys]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        dev = np.repeat(rows["dev"].to_numpy(bool), sizes)
        fit = np.bincount(at[~dev], counts[~dev], len(u)).astype(np.uint64)
        deleted = np.bincount(at[dev], counts[dev], len(u)).astype(np.uint64)
        stats = (int((fit + deleted).sum()), int((fit + deleted > 0).sum()), int(fit.sum()), int((fit > 0).sum())) if o == 1 else (0, 0, 0, 0)
        lo = 0
        for block, is_dev, n in zip(rows["block"], rows["dev"], sizes, strict=True):
            a = at[lo : lo + n]
            lo += n
            out.append((block, is_dev, g["part"].iloc[0], o, to_blob(fit[a]), to_blob(deleted[a]), *stats))
            stats = (0, 0, 0, 0)
    return pd.DataFrame(out, columns=["block", "dev", "part", "ord", "fit", "deleted", "n", "v", "n_fit", "v_fit"])


def _counted(texts: pd.DataFrame, answers: pd.DataFrame, order: int):
    """Per text row: ids, roles, bounds and, for each order, (fit, deleted) counts by token."""
    row = texts.iloc[0]
    offsets = from_blob(row["bounds"], True).astype(np.int64)
    size = int(offsets[-1])
    body = pa.decompress(row["body"], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    h, bounds = tokens(np.frombuffer(body, np.uint8), offsets)
    counts = []
    for o, g in enumerate(ngrams(h, bounds, order), 1):
        _, at = np.unique(g, return_inverse=True)
        mine = answers[answers["ord"] == o].sort_values("part")
        counts.append(tuple(np.concatenate([from_blob(b) for b in mine[c]]).astype(np.float64)[at] for c in ("fit", "deleted")))
    return row["ids"], np.asarray(row["roles"]), bounds, counts


def _estimates(counts: list[np.ndarray], bounds: np.ndarray, begun: float, n: float, v: float):
    """Maximum-likelihood estimates, highest order first, and context buckets."""
    first = bounds[:-1]
    context = None
    out = [np.full(len(counts[0]), 1.0 / (v + 1)), counts[0] / max(n, 1.0)]
    for k in range(1, len(counts)):
        context = np.empty_like(counts[k])
        context[1:] = counts[k - 1][:-1]
        context[first] = begun
        out.append(np.divide(counts[k], context, out=np.zeros_like(context), where=context > 0))
    bucket = np.zeros(len(counts[0]), np.int64) if context is None else np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return out[::-1], bucket


def learn_weights(cells: pd.DataFrame, orders: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket (rows) from counted cells of quantised estimates."""
    weights = np.full((BUCKETS, orders), 1.0 / orders)
    if not len(cells):
        return weights
    q = cells[[f"q{i}" for i in range(orders)]].to_numpy()
    p = np.where(q == -(1 << 20), 0.0, np.exp2(q / FINE))
    b, n = cells["bucket"].to_numpy(), cells["n"].to_numpy(float)
    total = np.bincount(b, n, BUCKETS)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, share[:, i], BUCKETS) for i in range(orders)], 1)
        # One pseudo-token for each weight keeps every weight above zero.
        weights = (new + 1.0 / orders) / (total + 1.0)[:, None]
    return weights


def score_documents(docs: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(key as text) mod 10 = 0 are held out of all counts;
    those with 1 are the deleted part for the weights, and count like the
    others in the model that scores.  A null key counts as an empty one; null
    and empty texts are one end token; repeated rows count and are scored
    each.  Without training documents all maximum-likelihood estimates are 0
    and the uniform one remains.  An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    parts = 2 * shuffle_partitions(spark)
    fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10
    role = F.when(fold == 0, HELD).when(fold == 1, DEV).otherwise(FIT).cast("int")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), role.alias("role"))
    kind = rows.schema["k"].dataType.simpleString()
    arrow_kind = to_arrow_type(rows.schema["k"].dataType)
    stored = scratch.write(rows.mapInArrow(lambda b: _blocks(b, order, parts, arrow_kind), _BLOCK_SCHEMA.format(kind=kind)), "blocks", ["asks"])
    begun = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    texts = stored.where(~F.col("asks")).select("block", "dev", "ids", "roles", "bounds", "body")
    asked = stored.where("asks").select("block", "dev", "part", "ord", "keys", "counts")
    answers = scratch.write(
        asked.groupBy("part").applyInPandas(_merge, "block long, dev boolean, part int, ord int, fit binary, deleted binary, n long, v long, n_fit long, v_fit long"), "answers", ["dev"]
    )
    scratch.drop("blocks/asks=true")
    n, v, n_fit, v_fit = (int(x or 0) for x in answers.agg(*(F.sum(c) for c in ("n", "v", "n_fit", "v_fit"))).first())
    answers = answers.select("block", "dev", "part", "ord", "fit", "deleted")
    d_fit, d_all = float(begun.get(FIT, 0)), float(begun.get(FIT, 0) + begun.get(DEV, 0))

    def expect(t: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        _, _, bounds, counts = _counted(t, a, order)
        p, bucket = _estimates([fit for fit, _ in counts], bounds, d_fit, n_fit, v_fit)
        with np.errstate(divide="ignore"):
            cells = {f"q{i}": np.where(x > 0, np.rint(FINE * np.log2(x)), -(1 << 20)).astype(np.int64) for i, x in enumerate(p)}
        return pd.DataFrame({"bucket": bucket, **cells}).value_counts().rename("n").reset_index()

    names = [f"q{i}" for i in range(order + 1)]
    cells = (
        texts.where("dev").groupBy("block").cogroup(answers.where("dev").groupBy("block"))
        .applyInPandas(expect, "bucket long, " + ", ".join(f"{c} long" for c in names) + ", n long")
        .groupBy("bucket", *names).agg(F.sum("n").alias("n"))
    )
    # Quantised cells: their number is bounded by the steps, whatever the corpus.
    weights = learn_weights(cells.toPandas(), order + 1)

    def score(t: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        ids, roles, bounds, counts = _counted(t, a, order)
        full = [fit + deleted for fit, deleted in counts]
        p, bucket = _estimates(full, bounds, d_all, n, v)
        mixed = sum(weights[bucket, i] * x for i, x in enumerate(p))
        first = bounds[:-1]
        base = np.log10((full[0] + 0.1) / (n + 0.1 * (v + 1)))
        return pd.DataFrame(
            {
                "k": list(ids), "held_out": roles == HELD, "n_tokens": np.diff(bounds),
                "n_known": np.add.reduceat((full[0] > 0).astype(np.int64), first), "train_tokens": n,
                "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(mixed), first),
            }
        )

    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("k", key)
