"""Operators on ranked lists of section ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def known_ids(picked: DataFrame, sections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Drop ids the tree lacks and repeats; first places stay.  ``picked`` has (by..., pos, id)."""
    by = by or ["query_id", "document_id"]
    first = picked.groupBy(*by, "id").agg(F.min("pos").alias("pos"))
    return first.join(sections.select("document_id", "id").distinct(), ["document_id", "id"], "left_semi").select(*by, "pos", "id")


def union_merge(picked: DataFrame, by: list[str]) -> DataFrame:
    return picked.groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def max_confidence(picked: DataFrame, by: list[str]) -> DataFrame:
    return picked.where("confidence is not null").groupBy(*by, "id").agg(F.max("confidence").alias("confidence"))


def ordered_union(picked: DataFrame, by: list[str]) -> DataFrame:
    """Union over sub-questions in the order in which ids are first seen."""
    first = picked.groupBy(*by, "id").agg(F.min(F.struct("sub_no", "pos")).alias("first"))
    return first.withColumn("rank", F.row_number().over(W.Window.partitionBy(*by).orderBy("first"))).drop("first")


def composite_ids(document: Column, ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(ids, lambda i: F.concat_ws(":", document, i))))


def merge_scores(candidates: DataFrame, scores: DataFrame, by: list[str], top_k: int = 0) -> DataFrame:
    """Left join of scores: scored ones first by score, then the others in input order.

    ``candidates``: (by..., pos, id); ``scores``: (by..., seq, id, score).
    Scores of unknown ids are ignored and the first score of an id counts.
    """
    first = scores.groupBy(*by, "id").agg(F.min_by("score", "seq").alias("score"))
    joined = candidates.join(first, [*by, "id"], "left").withColumn("scored", F.col("score").isNotNull())
    order = W.Window.partitionBy(*by).orderBy(F.desc("scored"), F.desc("score"), "pos")
    out = joined.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_k) if top_k > 0 else out


def abstains(picked: DataFrame, by: list[str], threshold: float = 0.4) -> DataFrame:
    """Whether every given confidence is below the threshold; none at all answers."""
    return picked.groupBy(*by).agg(F.coalesce(F.max("confidence") < threshold, F.lit(False)).alias("abstain"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def restrict_confidences(confidences: Column, ids: Column) -> Column:
    """The map's entries for ``ids``; null when none is left."""
    kept = F.map_filter(confidences, lambda k, _: F.array_contains(ids, k))
    return F.when(F.size(kept) > 0, kept)


def add_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "cost_usd", "llm_calls")))


def distinct_questions(questions: Column, cap: int) -> Column:
    """Stripped, not blank, first casing of each, at most ``cap`` (0: all)."""
    from foliant.functions.text import strip

    said = F.filter(F.transform(questions, strip), lambda q: q != "")
    first = F.filter(said, lambda q, i: F.array_position(F.transform(said, F.lower), F.lower(q)) == i + 1)
    return F.slice(first, 1, cap) if cap > 0 else first


def trimmed(values: Column, cap: int = 0) -> Column:
    from foliant.functions.text import strip

    kept = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.slice(kept, 1, cap) if cap > 0 else kept


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses) * 100).otherwise(F.lit(0.0))


def fan_out(results: DataFrame, by: list[str]) -> DataFrame:
    """Outcome of many documents: some may fail, all failing is an error."""
    ok = F.count(F.when(F.col("error").isNull(), 1))
    return results.groupBy(*by).agg(F.count("*").alias("documents"), ok.alias("succeeded"), (ok == 0).alias("failed"))
