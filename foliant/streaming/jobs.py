"""Ingest jobs as a stream, and event rows of selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQuery

JOBS = "kind string, document_id string, payload string, run_at timestamp, dedupe_key string, attempt int, max_attempts int"


def distinct_jobs(jobs: DataFrame, within: str = "24 hours") -> DataFrame:
    """Jobs of one dedupe key run once within the time; those without key always run."""
    keyed = jobs.withColumn("__key", F.coalesce("dedupe_key", F.concat(F.lit("\0"), F.xxhash64(*jobs.columns).cast("string"))))
    return keyed.withWatermark("run_at", within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run each micro-batch of due jobs.

    ``work`` gets the jobs whose ``run_at`` has come (a null one is due) and
    returns them with ``error`` and ``error_kind``; ``sink`` gets them with the
    state that follows.  Jobs that came too early go to the sink untouched, in
    state "waiting", to be enqueued again.  Delivery is at least once: sinks key
    on the batch id.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp()
        early = F.coalesce(F.col("run_at") > now, F.lit(False))
        done = work(rows.where(~early)).withColumn("state", next_state(F.col("error"), F.col("error_kind"), F.col("attempt"), F.col("max_attempts")))
        waiting = rows.where(early).withColumns({"error": F.lit(None).cast("string"), "error_kind": F.lit(None).cast("string"), "state": F.lit("waiting")})
        sink(done.unionByName(waiting.select(*(c for c in done.columns if c in waiting.columns)), allowMissingColumns=True), batch_id)

    writer = distinct_jobs(jobs).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def next_state(error: Column, kind: Column, attempt: Column, most: Column) -> Column:
    """ready; back to parsing after a transient error that may be tried again; else failed."""
    again = (F.coalesce(kind, F.lit("transient")) == "transient") & (attempt < most)
    return F.when(error.isNull(), "ready").when(again, "parsing").otherwise("failed")


def retries(results: DataFrame) -> DataFrame:
    """Jobs to enqueue again, later with each attempt."""
    again = results.where("state = 'parsing'").withColumn("attempt", F.col("attempt") + 1)
    return again.withColumn("run_at", F.timestamp_seconds(F.unix_timestamp("run_at") + F.pow(F.lit(2), F.col("attempt")).cast("long"))).drop("error", "error_kind", "state")


def selection_events(picked: DataFrame, slices: DataFrame) -> DataFrame:
    """Ordered event rows of a chunked selection: started, then each slice's, then completed.

    ``slices``: (query_id, document_id, slice_no); ``picked`` adds (pos, id).
    A section that two slices pick is reported by both.
    """
    key = ["query_id", "document_id"]
    row = lambda df, event, rank, slice_no, pos, id_: df.select(*key, F.lit(event).alias("event"), rank.alias("rank"), slice_no.alias("slice_no"), pos.alias("pos"), id_.alias("id"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    each = slices.select(*key, "slice_no").distinct()
    whole = each.select(*key).distinct()
    events = row(whole, "started", F.lit(0), F.lit(-1), zero, none)
    events = events.unionByName(row(each, "slice_started", F.lit(1), F.col("slice_no"), F.lit(-1), none))
    events = events.unionByName(row(picked, "section_selected", F.lit(1), F.col("slice_no"), F.col("pos"), F.col("id")))
    events = events.unionByName(row(each, "slice_completed", F.lit(1), F.col("slice_no"), F.lit(1 << 30), none))
    events = events.unionByName(row(whole, "completed", F.lit(2), F.lit(-1), zero, none))
    order = W.Window.partitionBy(*key).orderBy("rank", "slice_no", "pos")
    return events.withColumn("seq", F.row_number().over(order) - 1).select(*key, "seq", "event", F.nullif("slice_no", F.lit(-1)).alias("slice_no"), "id")


def server_sent(events: DataFrame) -> DataFrame:
    """Events as text of a server-sent stream."""
    data = F.to_json(F.struct("document_id", "slice_no", "id"), {"ignoreNullFields": "true"})
    return events.withColumn("text", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), data, F.lit("\n\n")))


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int, most: int, key: str = "key") -> DataFrame:
    """Cache contents after expiry and least-recently-used eviction: (key, used_at, ...)."""
    fresh = entries.where(F.col("used_at") > now - F.expr(f"interval {int(ttl_seconds)} seconds"))
    return fresh.orderBy(F.desc("used_at"), key).limit(most)


def idempotent_requests(requests: DataFrame, within: str = "24 hours") -> DataFrame:
    """One row for each method, path, tenant and key within the time."""
    return requests.withWatermark("at", within).dropDuplicatesWithinWatermark(["method", "path", "org_id", "idempotency_key"])
