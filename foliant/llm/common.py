"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-only lower-casing, which leaves every other character as it is.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def unused(columns: list[str], name: str) -> str:
    """``name``, or one like it that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Give the package's code to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="foliant-code-"), "foliant_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._foliant_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the master is local (tests) a temporary folder stands in.
    """
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tasks over which the rows of one value are dealt, and the size of filters.
SALTS, FILTER_BITS = 32, 22

#: Spark drops the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator call, in the shared folder; ``level`` is how hard they are compressed."""

    def __init__(self, spark: SparkSession, label: str, level: int = 3):
        self.spark, self.level = spark, level
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(self.level))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; all of them without names."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def salted(frame: DataFrame, by: list[str], spread: str, few: DataFrame) -> DataFrame:
    """``frame`` joined with ``few`` on ``by``; rows of one value are dealt to ``SALTS`` tasks by ``spread``, ``few`` is copied.

    Spark does not reckon with the copies when it decides on a broadcast, which
    the driver holds; so the join is by a shuffle.
    """
    salts = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return frame.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salts, [*by, "salt"]).drop("salt")


def may_hold(frame: DataFrame, column: str):
    """A test that passes every value of a column and few others.

    It is a bitmap of fixed size (2 ** FILTER_BITS bits), whatever the frame
    holds, and reaches plans as a scalar subquery; when full it passes all, and
    joins stay right.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    places = (1 << FILTER_BITS) // 64
    at = frame.select(spot(F.col(column)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    maps = at.select(F.shiftright("p", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("m"))
    every = frame.sparkSession.range(0, places, 1, 1).withColumnRenamed("id", "w").join(maps, "w", "left")
    rows = F.sort_array(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m"))))
    bits = every.agg(F.transform(rows, lambda x: x["m"]).alias("bits")).scalar()

    def test(c: Column) -> Column:
        p = spot(c)
        word = F.get(bits, F.shiftright(p, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow result through the shared checkpoint folder.

    Spark removes such files once the frame is garbage (where it is set to).
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], offsets - first


def _powers() -> tuple[np.ndarray, np.uint64]:
    rng = np.random.RandomState(20240607)
    table = rng.randint(0, 2**32, 256, np.uint64) << np.uint64(32) | rng.randint(0, 2**32, 256, np.uint64)
    return table, np.uint64(0x9E3779B97F4A7C15 | 1)


_BYTE_CODE, _BASE = _powers()
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lut(allowed: Iterator[int] | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~_lut([0x20, *range(0x09, 0x0E)])
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z.
ALNUM = _lut([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_SLAB = 1 << 20


def words_of(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions in ``raw``) and text index of every word.

    A word never reaches across two texts.
    """
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[:n] = word_bytes[raw]
    is_start = inside.copy()
    is_start[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    is_start[bounds] = inside[bounds]
    is_end = np.zeros(n + 1, bool)
    is_end[1:] = inside[:-1]
    is_end[:n] &= ~inside[:n] | is_start[:n]
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, text


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte span, from prefix sums over slabs."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SLAB, side="right")))
        hi = int(ends[j - 1])
        powers = np.full(hi - lo + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.add.accumulate(_BYTE_CODE[raw[lo:hi]] * powers[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        back = np.full(hi - lo + 1, _BASE_INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        out[i:j] = (sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for aligned sequences of fingerprints, order counted."""
    out = np.full(len(hashes[0]), 0x243F6A8885A308D3 + len(hashes), np.uint64)
    for h in hashes:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def grams(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k consecutive words within a text, and their starts."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(h) - k + 1] == text[k - 1 :])
    return combine([h[at + i] for i in range(k)]), at


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of text (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)) if len(column) else []
        i = 0
        while i < batch.num_rows:
            before = int(sizes[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(i, j - i)
            i = j
