"""Deterministic tokens and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the token format.
PROMPT_VERSION = "v1"
PAGE_VERSION = "1-pages"


def _joined(*parts: Column) -> Column:
    # A null is an empty part; left out, as by concat_ws, it would move the others up.
    return F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts))


def trace_token(document: Column, version: Column, model: Column, ids: Column) -> Column:
    """SHA-256 over document, version, model, prompt version and sorted ids."""
    head = F.concat(_joined(document, version, model, F.lit(PROMPT_VERSION)), F.lit("\0"))
    return F.sha2(F.concat(head, F.array_join(F.array_sort(ids), "\0")), 256)


def cache_key(document: Column, query: Column, strategy: Column, model: Column) -> Column:
    return F.sha2(_joined(document, query, strategy, model), 256)


def page_range_text(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p:"), start.cast("string"))).otherwise(F.concat(F.lit("p:"), start.cast("string"), F.lit("-"), end.cast("string")))


def page_trace_token(document: Column, model: Column, ranges: Column) -> Column:
    """Trace token of page ranges (array of struct start, end)."""
    ids = F.transform(ranges, lambda r: page_range_text(r["start"], r["end"]))
    return trace_token(document, F.lit(PAGE_VERSION), F.concat(F.lit("treewalk:"), model), ids)


def section_id(document: Column, path: Column) -> Column:
    """Deterministic section id from the document and the ordinals down to it."""
    return F.concat(F.lit("sec_"), F.substring(F.sha2(F.concat_ws("/", document, F.array_join(path.cast("array<string>"), ".")), 256), 1, 32))


def source_key(document: Column, file_extension: Column) -> Column:
    return F.concat(F.lit("documents/"), document, F.lit("/source"), file_extension)


def section_key(document: Column, section: Column) -> Column:
    return F.concat(F.lit("documents/"), document, F.lit("/sections/"), section, F.lit(".txt"))
