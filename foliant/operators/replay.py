"""Stored responses by trace token."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLAY = "token string, document_id string, query string, model string, selected_ids array<string>, response string, created_at timestamp"


def response_text(response: dict) -> str:
    """The stored form: compact JSON and a newline."""
    return json.dumps(response, ensure_ascii=False, separators=(",", ":")) + "\n"


def replay(requests: DataFrame, stored: DataFrame, now, ttl_seconds: int = 86_400) -> DataFrame:
    """(token, document_id, query, status, response): 200, 404 unknown or expired, 409 other document or query."""
    live = stored.where(F.col("created_at") > F.lit(now) - F.expr(f"interval {int(ttl_seconds)} seconds"))
    live = live.groupBy("token").agg(F.max_by(F.struct("document_id", "query", "response"), "created_at").alias("s"))
    rows = requests.join(live, "token", "left")
    same = F.col("s.document_id").eqNullSafe(F.col("document_id")) & F.col("s.query").eqNullSafe(F.col("query"))
    status = F.when(F.col("s").isNull(), 404).when(~same, 409).otherwise(200)
    return rows.select("token", "document_id", "query", status.alias("status"), F.when(status == 200, F.col("s.response")).alias("response"))
