"""Driver queries against their DuckDB twins, and job streams."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliant.plans.oracle import ORACLE
from foliant.plans.part_oracle import ORACLE as PART_ORACLE
from foliant.plans.part_queries import QUERIES as PART_QUERIES
from foliant.plans.queries import QUERIES
from foliant.streaming import jobs

SF = "/root/testdata/sf0.001"
ORACLE, QUERIES = ORACLE | PART_ORACLE, QUERIES | PART_QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    twin = duck.sql(ORACLE[name])
    assert columns == sorted(twin.columns)
    order = lambda rows, cols: sorted(str([plain(r[cols.index(c)]) for c in columns]) for r in rows)
    assert order([tuple(r) for r in df.collect()], df.columns) == order(twin.fetchall(), list(twin.columns))


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 200 and set(out.columns) == {"query_id", "document_id", "section_ids", "confidence", "abstained", "trace_token"}
    assert os.path.exists(SF)


def test_job_stream(spark, tmp_path):
    """Duplicates run once, transient failures come back, permanent ones fail."""
    rows = [("ingest", "a", "", "2024-01-01 00:00:00", "k1", 0, 3), ("ingest", "a", "", "2024-01-01 00:01:00", "k1", 0, 3), ("ingest", "b", "", "2024-01-01 00:02:00", None, 2, 3), ("ingest", "c", "", "2024-01-01 00:03:00", None, 3, 3), ("ingest", "d", "", "2024-01-01 00:04:00", "k4", 0, 3)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "kind string, document_id string, payload string, run_at string, dedupe_key string, attempt int, max_attempts int").withColumn("run_at", F.to_timestamp("run_at"))
    df.coalesce(1).write.json(src)
    stream = spark.readStream.schema(jobs.JOBS).json(src)
    seen = []

    def work(batch):
        kind = F.when(F.col("document_id") == "d", "permanent").otherwise("transient")
        bad = F.col("document_id") != "a"
        return batch.withColumn("error", F.when(bad, F.lit("boom"))).withColumn("error_kind", F.when(bad, kind))

    def sink(batch, _):
        seen.extend((r.document_id, r.state) for r in batch.collect())
        seen.extend((r.document_id, r.attempt) for r in jobs.retries(batch).collect())

    jobs.run_jobs(stream, work, sink, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen, key=str) == sorted([("a", "ready"), ("b", "parsing"), ("b", 3), ("c", "failed"), ("d", "failed")], key=str)


def test_selection_events(spark):
    slices = spark.createDataFrame([("q", "d", 0), ("q", "d", 1)], "query_id string, document_id string, slice_no int")
    picked = spark.createDataFrame([("q", "d", 1, 0, "s"), ("q", "d", 0, 0, "s")], "query_id string, document_id string, slice_no int, pos int, id string")
    events = jobs.selection_events(picked, slices)
    assert [(r.event, r.slice_no, r.id) for r in events.orderBy("seq").collect()] == [
        ("started", None, None), ("slice_started", 0, None), ("section_selected", 0, "s"), ("slice_completed", 0, None),
        ("slice_started", 1, None), ("section_selected", 1, "s"), ("slice_completed", 1, None), ("completed", None, None),
    ]
    assert jobs.server_sent(events).where("text like 'event: section_selected%'").count() == 2
    old = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-02 00:00:01")], "key string, used_at string").withColumn("used_at", F.to_timestamp("used_at"))
    assert [r.key for r in jobs.live_entries(old, F.lit("2024-01-02 00:00:02").cast("timestamp"), 3600, 1).collect()] == ["c"]
