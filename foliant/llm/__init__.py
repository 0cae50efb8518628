"""Training-data operators: filters, scans, scoring, sharding, dedup, packing.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
driver queries, ``sql.py`` their DuckDB twins.
"""
