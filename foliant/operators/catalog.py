"""Relational operators over the document and section tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def page_limit(limit: int) -> int:
    return 50 if limit <= 0 else min(limit, 200)


def in_scope(org: str, store: str | None = None, org_col: str = "org_id", store_col: str = "store_id") -> Column:
    """The tenant must match; an empty store matches all stores."""
    test = F.col(org_col) == org
    return test & (F.col(store_col) == store) if store else test


def list_documents(docs: DataFrame, scope: Column, limit: int = 0, before=None, status: str | None = None, created: str = "created_at", tiebreak: str | None = None) -> DataFrame:
    """One page, newest first, with one row more than asked if there is a next page.

    ``before`` is the creation time of the previous page's last row; rows
    sharing it are passed over, unless ``tiebreak`` names an id column and
    ``before`` is a (time, id) pair.
    """
    rows = docs.where(scope)
    if status:
        rows = rows.where(F.col("status") == status)
    if before is not None:
        if tiebreak:
            at, last = before
            rows = rows.where((F.col(created) < F.lit(at)) | ((F.col(created) == F.lit(at)) & (F.col(tiebreak) < F.lit(last))))
        else:
            rows = rows.where(F.col(created) < F.lit(before))
    order = [F.desc(created), *([F.desc(tiebreak)] if tiebreak else [])]
    return rows.orderBy(*order).limit(page_limit(limit) + 1)


def sections_of(sections: DataFrame, docs: DataFrame, scope: Column) -> DataFrame:
    """Sections whose document is in scope; only section columns come back."""
    return sections.join(docs.where(scope).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def tree_order(sections: DataFrame) -> DataFrame:
    return sections.orderBy("depth", "ordinal", "parent_id", "id")


def dedupe_ingest(incoming: DataFrame, existing: DataFrame | None = None, org: str = "org_id", key: str = "idempotency_key", order: list[str] | None = None) -> DataFrame:
    """First row of each (tenant, key) that the table doesn't hold yet.

    Rows without a key are never duplicates.  Minima combine before the
    shuffle, so a key that comes in very often is no hot partition.
    """
    order = order or ["created_at", "id"]
    keyed = incoming.where(F.col(key).isNotNull())
    first = keyed.groupBy(org, key).agg(F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("__first")).select("__first.*")
    if existing is not None:
        first = first.join(existing.where(F.col(key).isNotNull()).select(org, key).distinct(), [org, key], "left_anti")
    return first.select(*incoming.columns).unionByName(incoming.where(F.col(key).isNull()))


def upsert_latest(stored: DataFrame, changes: DataFrame, key: str = "id", version: list[str] | None = None, created: str = "created_at") -> DataFrame:
    """Last write wins for each key; the first creation time stays.

    One aggregation: maxima combine before the shuffle, so a key that is
    written very often is no hot partition.
    """
    version = version or ["updated_at"]
    rest = [c for c in stored.columns if c not in (key, created)]
    both = stored.withColumn("__gen", F.lit(0)).unionByName(changes.withColumn("__gen", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct("__gen", *version))
    out = both.groupBy(key).agg(last.alias("__last"), F.min(created).alias(created))
    return out.select(*[F.col(c) if c in (key, created) else F.col(f"__last.{c}").alias(c) for c in stored.columns])


def patch(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replace the columns that ``changes`` has a non-null value for."""
    named = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *(F.col(c).alias(f"__new_{c}") for c in named)), key, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in named else F.col(c) for c in rows.columns])


def delete_documents(docs: DataFrame, sections: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in ``gone(id)`` and their sections."""
    kept = docs.join(gone, "id", "left_anti")
    return kept, sections.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def without_summary(sections: DataFrame) -> DataFrame:
    """Only what an incremental run has to compute."""
    return sections.where(F.coalesce("summary", F.lit("")) == "")


def response_json(**columns: Column) -> Column:
    """A response object; zero and empty values are left out."""
    def value(c: Column) -> Column:
        return F.when(~c.cast("string").isin("", "0"), c)

    return F.to_json(F.struct(*(value(c).alias(n) for n, c in columns.items())), {"ignoreNullFields": "true"})


def first_k(rows: DataFrame, by: list[str], rank: str, k: int) -> DataFrame:
    """The first ``k`` of each ranked list; 0 keeps all."""
    if k <= 0:
        return rows
    return rows.withColumn("__n", F.row_number().over(W.Window.partitionBy(*by).orderBy(rank))).where(F.col("__n") <= k).drop("__n")
