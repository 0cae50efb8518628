"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a 64-bit ring.  A key starts at its own
hash and walks clockwise; a shard that has reached its capacity is passed by,
so an overflowing key continues to the next one.  Keys are admitted in the
order of a second hash, which makes the outcome independent of row order and
of the cluster: it is the serial admission of all keys in that order.

Distributed form: keys fall into bins by admission order.  The driver holds
counts per (bin, arc of the ring), whose number is fixed by parameters, and
walks over them.  Only a bin in which some shard fills up has to be replayed
key by key, in an executor; there are at most as many of those as shards.
Knowing the loads at the start of each bin, all bins then place their keys
side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

BINS_AT_MOST = 4096


def ring_of(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points (unsigned) and the shard that owns each."""
    points = [
        (int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big"), s)
        for s in range(shards)
        for v in range(virtual)
    ]
    points.sort()
    return np.array([p for p, _ in points], np.uint64), np.array([s for _, s in points], np.int64)


def routes(owners: np.ndarray, full: np.ndarray) -> np.ndarray:
    """For each arc, the first shard clockwise that is not full (-1: none)."""
    out = np.full(len(owners), -1, np.int64)
    if full.all():
        return out
    following = -1
    for i in range(2 * len(owners) - 1, -1, -1):
        a = i % len(owners)
        if not full[owners[a]]:
            following = owners[a]
        out[a] = following
    return out


def admit(arc, copies, weight, load, rows, capacity, owners):
    """Admit runs of equal keys in the given order.

    ``load`` and ``rows`` (per shard) are updated in place.  Returns index of
    the run, shard, first slot and number of copies for each placed piece of a
    run; a run is split where its shard fills up.
    """
    pieces = []
    i, copies = 0, copies.astype(np.int64).copy()
    while i < len(arc):
        to = routes(owners, load >= capacity)[arc[i:]]
        if to[0] < 0:
            raise ValueError("the capacities are smaller than the keys together")
        event, event_shard = len(to), -1
        for s in np.unique(to):
            at = np.flatnonzero(to == s)
            total = np.cumsum(copies[i:][at] * weight[i:][at])
            k = int(np.searchsorted(total, capacity[s] - load[s]))
            if k < len(at) and at[k] < event:
                event, event_shard = int(at[k]), int(s)
        for s in np.unique(to[:event]):
            at = i + np.flatnonzero(to[:event] == s)
            c = copies[at]
            pieces.append((at, np.full(len(at), s), rows[s] + np.cumsum(c) - c, c))
            rows[s] += c.sum()
            load[s] += (c * weight[at]).sum()
        i += event
        if event_shard >= 0:
            s, w = event_shard, int(weight[i])
            c = min(int(copies[i]), -(-int(capacity[s] - load[s]) // max(w, 1)))
            pieces.append((np.array([i]), np.array([s]), np.array([rows[s]]), np.array([c])))
            rows[s] += c
            load[s] += c * w
            copies[i] -= c
            i += copies[i] == 0
    if not pieces:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*pieces, strict=True))


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    law: str = "rows",
    slack: float = 0.0,
    virtual: int = 32,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Return ``key``, size, text_crc32, law, shard, slot, grown_shard per row.

    Size is the UTF-8 length of the text plus 1; a null text counts as empty.
    ``law`` names what is bounded: ``rows`` (with ``slack`` 0 the counts of
    two shards differ by one at most) or ``bytes`` (a shard takes keys while
    it is below (1 + slack) times the mean size).  Slots count from 0 in each
    shard without gaps.  Repeated rows are rows of their own with slots of
    their own; null keys are one key.  ``grown_shard`` is null: under bounded
    loads an added shard may also move keys between old ones.  An empty table
    gives an empty result.  Other columns, whatever their names, are not read.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    bins = min(BINS_AT_MOST, max(8, 4 * shuffle_partitions(spark)))
    points, owners = ring_of(shards, virtual)
    by_rows = law == "rows"
    body = F.coalesce(F.col(text), F.lit(""))
    runs = (
        docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
        .groupBy("k", "size", "crc")
        .count()
        .select("k", "size", "crc", F.col("count").alias("copies"), F.xxhash64("k").alias("spot"), F.xxhash64("k", F.lit("admission")).alias("turn"))
    )

    def on_ring(batches):
        for b in batches:
            spot = b.column("spot").to_numpy().view(np.uint64)
            turn = b.column("turn").to_numpy().view(np.uint64)
            arc = np.searchsorted(points, spot) % len(points)
            bin_ = ((turn >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("k", "size", "crc", "copies", "turn")] + [pa.array(arc.astype(np.int32)), pa.array(bin_.astype(np.int32))],
                ["k", "size", "crc", "copies", "turn", "arc", "bin"],
            )

    kind = runs.schema["k"].dataType.simpleString()
    keyed = scratch.write(
        runs.mapInArrow(on_ring, f"k {kind}, size long, crc long, copies long, turn long, arc int, bin int"), "keyed"
    )
    weight = F.col("copies") if by_rows else F.col("copies") * F.col("size")
    counts = keyed.groupBy("bin", "arc").agg(F.sum(weight).alias("w"), F.sum("copies").alias("n")).toPandas()
    total = int(counts["w"].sum())
    if slack > 0 or not by_rows:
        capacity = np.full(shards, int(np.ceil((1 + slack) * total / shards)), np.int64)
    else:
        capacity = total // shards + (np.arange(shards) < total % shards).astype(np.int64)

    def in_turn(g: pd.DataFrame) -> pd.DataFrame:
        return g.sort_values(["turn", "size", "crc"], kind="stable")

    def unit(g: pd.DataFrame) -> np.ndarray:
        return np.ones(len(g), np.int64) if by_rows else g["size"].to_numpy(np.int64)

    def replayed(load: np.ndarray, rows: np.ndarray):
        def replay(g: pd.DataFrame) -> pd.DataFrame:
            g, after, counted = in_turn(g), load.copy(), rows.copy()
            admit(g["arc"].to_numpy(), g["copies"].to_numpy(), unit(g), after, counted, capacity, owners)
            return pd.DataFrame({"shard": range(shards), "load": after, "n": counted})

        return replay

    load, rows = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    start: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b, g in counts.groupby("bin", sort=True):
        start[int(b)] = load.copy(), rows.copy()
        to = routes(owners, load >= capacity)[g["arc"].to_numpy()]
        more = np.bincount(to, g["w"], shards).astype(np.int64)
        if (load + more < capacity)[np.unique(to)].all():
            load += more
            rows += np.bincount(to, g["n"], shards).astype(np.int64)
            continue

        after = keyed.where(F.col("bin") == int(b)).groupBy("bin").applyInPandas(replayed(load, rows), "shard int, load long, n long")
        after = after.toPandas().sort_values("shard")
        load, rows = after["load"].to_numpy(np.int64), after["n"].to_numpy(np.int64)

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = in_turn(g)
        load, rows = (x.copy() for x in start[int(g["bin"].iloc[0])])
        at, shard, slot, n = admit(g["arc"].to_numpy(), g["copies"].to_numpy(), unit(g), load, rows, capacity, owners)
        out = g.iloc[at][["k", "size", "crc"]].reset_index(drop=True)
        return out.assign(shard=shard.astype(np.int32), slot=slot, n=n)

    placed = keyed.groupBy("bin").applyInPandas(place, f"k {kind}, size long, crc long, shard int, slot long, n long")
    return placed.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        "shard",
        F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
