"""A store of documents, section rows, bodies and responses: Parquet tables in one folder.

Every write adds a batch in a folder of its own and lists it last, so readers
see whole batches only, and a write that is cut off leaves nothing that is read.
Later batches win: a document's rows are those of the last batch that has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.replay import REPLAY

TABLES = {
    "documents": "id",
    "sections": "document_id",
    "bodies": "document_id",
    "gone": "document_id",
    "replies": "token",
}


class Store:
    """Tables under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of whole batches, oldest first."""
        path, fs = self._path("batches")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def save(self, **tables: DataFrame) -> str:
        """Add one batch of the given tables."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        name = f"{len(self.batches()):012d}-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{self.root}/data/{name}/{table}")
        path, fs = self._path("batches", name)
        fs.create(path).close()
        return name

    def delete(self, document_ids: DataFrame) -> str:
        """Forget documents (document_id), their sections and bodies."""
        return self.save(gone=document_ids.select("document_id").distinct())

    def read(self, table: str) -> DataFrame | None:
        """The rows that hold now; None if the table was never written."""
        key = TABLES[table]
        parts = []
        for n, name in enumerate(self.batches()):
            for kind in (table, "gone"):
                path, fs = self._path("data", name, kind)
                if fs.exists(path) and not (kind == "gone" and table == "replies"):
                    parts.append((kind, self.spark.read.parquet(str(path.toString())).withColumn("__batch", F.lit(n))))
        rows = [df for kind, df in parts if kind == table]
        if not rows:
            return None
        every = rows[0]
        for df in rows[1:]:
            every = every.unionByName(df, allowMissingColumns=True)
        if table == "replies":
            return every.drop("__batch")
        # The last batch that has a document, or forgets it, holds for it.
        last = every.select(F.col(key).alias("__key"), "__batch")
        for kind, df in parts:
            if kind == "gone":
                last = last.unionByName(df.select(F.col("document_id").alias("__key"), "__batch"))
        last = last.groupBy("__key").agg(F.max("__batch").alias("__last"))
        return every.join(last, (F.col(key) == F.col("__key")) & (F.col("__batch") == F.col("__last")), "left_semi").drop("__batch")

    def replies(self) -> DataFrame:
        """Stored responses, for ``Engine.replay``."""
        found = self.read("replies")
        return found if found is not None else self.spark.createDataFrame([], REPLAY)
