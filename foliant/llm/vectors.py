"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one, where cosine c means distance
sqrt(2 - 2c).  A table hashes by ``projections`` random Gaussian directions,
each cut into steps of ``width`` from a random origin; vectors of one label
that agree in all of them share a bucket.  The number of projections follows
the number of vectors (so buckets of unrelated vectors stay small) and the
number of tables follows from the recall wanted for a pair just at the
threshold.  Every pair that shares a bucket is checked by exact cosine in
double precision, inside tiles of bounded size: large buckets are cut into
blocks, and pairs of blocks are compared in memory.  A pair counts in the
first table that joins it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .tiles import by_sorted_group

TILE = 256


def collision(width: float, distance: float) -> float:
    """Chance that one projection puts two points at this distance in one step."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(vectors: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """Projections a table and tables."""
    apart = collision(width, math.sqrt(2))
    projections = max(6, math.ceil(math.log(max(vectors, 2)) / -math.log(apart)))
    joined = collision(width, math.sqrt(2 - 2 * threshold)) ** projections
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-joined))


class Hasher:
    """Bucket keys of all tables; directions are drawn once for each number of dimensions."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.tables, self.projections, self.width, self.seed = tables, projections, width, seed
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def directions(self, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
        if dimensions not in self.drawn:
            rng, n = np.random.RandomState(self.seed), self.tables * self.projections
            self.drawn[dimensions] = rng.uniform(0, self.width, n), rng.normal(size=(dimensions, n))
        return self.drawn[dimensions]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        origin, towards = self.directions(x.shape[1])
        steps = np.floor((x @ towards + origin) / self.width).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.projections)
        out = np.tile(np.arange(self.tables, dtype=np.uint64) + np.uint64(x.shape[1] << 20), (len(x), 1))
        for p in range(self.projections):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + steps[:, :, p]
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def scaled(column: pa.Array) -> list[bytes | None]:
    """Vectors divided by their greatest component; None for those that link with nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
    flat = column.flatten()
    empty = np.asarray(flat.is_null())
    x = np.asarray(flat.cast(pa.float64()).fill_null(0.0)) + 0.0
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    ok = (size > 0) & (np.bincount(owner, empty | ~np.isfinite(x), len(size)) == 0)
    most = np.zeros(len(size))
    np.maximum.at(most, owner, np.where(np.isfinite(x), np.abs(x), 0.0))
    ok &= most > 0
    body = (x / np.where(ok, most, 1.0)[owner]).astype("<f8").tobytes()
    return [body[8 * (b - n) : 8 * b] if good else None for b, n, good in zip(end.tolist(), size.tolist(), ok.tolist(), strict=True)]


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    width: float = 2.0,
    recall: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """Return key, n_links, component_id and kept for every row.

    Only rows of one non-null label are compared.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and
    form components of their own.  Equal vectors are one class with a count:
    each links to all others of it.  Vectors of different lengths never link.
    Repeated rows count as vectors; among rows with the least key of a
    component all are kept, and a null key ranks last.  An empty table gives
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = rows.schema["k"].dataType.simpleString()
    label_kind = rows.schema["label"].dataType.simpleString()

    def as_bytes(batches):
        for b in batches:
            named = b.column("label").is_valid().to_pylist()
            out = [v if has else None for v, has in zip(scaled(b.column("v")), named, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("label"), pa.array(out, pa.binary())], ["k", "label", "v"])

    rows = rows.mapInArrow(as_bytes, f"k {kind}, label {label_kind}, v binary")
    rows = scratch.write(rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("k").alias("least"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    projections, tables = shape(n, threshold, width, recall)
    hasher = Hasher(tables, projections, width, seed)

    def hashed(batches):
        for b in batches:
            blobs, salt = b.column("v").to_pylist(), b.column("salt").to_numpy()
            sizes = np.array([len(v) for v in blobs])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                keys = hasher(matrix([blobs[i] for i in at])) ^ salt[at, None]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("cls", "v", "copies")), pa.array(list(keys), pa.list_(pa.int64()))], ["cls", "v", "copies", "keys"])

    labelled = classes.join(rows.where("cls is not null").select("cls", "label").distinct(), "cls")
    labelled = labelled.select("cls", "v", "copies", F.xxhash64("label").alias("salt"))
    signed = scratch.write(labelled.mapInArrow(hashed, "cls long, v binary, copies long, keys array<long>"), "signed")
    buckets = signed.select("cls", F.posexplode("keys").alias("tab", "bucket"))
    sizes = buckets.groupBy("bucket").count().where("count > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    members = buckets.join(sizes, "bucket").withColumn("block", F.pmod(F.hash("cls"), F.col("blocks")))
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("cls", "tab", "bucket", "block", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), (F.col("block") == F.col("other")).alias("own"))
    tiles = tiles.join(signed, "cls")

    def compare(t: pa.Table) -> list[pa.RecordBatch]:
        cls, copies = t.column("cls").to_numpy(), t.column("copies").to_numpy()
        block, table = t.column("block").to_numpy(), int(t.column("tab")[0].as_py())
        x = matrix(t.column("v").to_pylist())
        near = x @ x.T >= threshold - 1e-9
        if not t.column("own")[0].as_py():
            near &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        if not len(i):
            return []
        # Exact cosines, a few thousand at once; a pair counts in the first table that joins it.
        fresh = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 4096]], x[j[k : k + 4096]]) >= threshold for k in range(0, len(i), 4096)])
        if table:
            keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(x), -1)[:, :table]
            fresh &= np.concatenate([(keys[i[k : k + 4096]] != keys[j[k : k + 4096]]).all(1) for k in range(0, len(i), 4096)])
        i, j = i[fresh], j[fresh]
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        # For components a star for each group of the tile is enough.
        root = np.arange(len(x))
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at, b = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        return [
            pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([cls[at], cls[root[b]]])),
                    pa.array(np.concatenate([np.zeros(len(at), np.int64), cls[b]])),
                    pa.array(np.concatenate([links[at].astype(np.int64), np.zeros(len(b), np.int64)])),
                ],
                ["a", "b", "links"],
            )
        ]

    found = scratch.write(by_sorted_group(tiles, "tile", compare, "a long, b long, links long"), "found")
    counted = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    scratch.drop("signed")
    roots = connected_components(found.where("links = 0").select("a", "b"), scratch)
    info = classes.select("cls", "copies", "least")
    info = info.join(counted, info["cls"] == counted["a"], "left").drop("a").join(roots, info["cls"] == roots["node"], "left").drop("node")
    info = info.withColumn("root", F.coalesce("root", "cls"))
    least = info.groupBy("root").agg(F.min("least").alias("component"))
    info = info.join(least, "root").select(F.col("cls").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = rows.select("k", "cls").join(info, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("c").isNull(), F.col("k")).otherwise(F.col("component"))
    return out.select(
        F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept")
    )
