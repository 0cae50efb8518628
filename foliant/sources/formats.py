"""Routing by content type or extension, and the scan of each format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions.text import content_type, extension, first_line, clip_bytes, is_text_heading, strip
from foliant.sources import parsers

#: Fixed values, in the order in which formats are tried: content types and extensions.
FORMATS = (
    ("markdown", ("text/markdown", "text/x-markdown"), (".md", ".markdown")),
    ("html", ("text/html", "application/xhtml+xml"), (".html", ".htm", ".xhtml")),
    ("docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (".docx",)),
    ("xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), (".xlsx",)),
    ("csv", ("text/csv", "application/csv"), (".csv",)),
    ("pdf", ("application/pdf",), (".pdf",)),
    ("text", ("text/plain",), (".txt",)),
)

_PARSE = {"markdown": parsers.parse_markdown, "html": parsers.parse_html, "docx": parsers.parse_docx, "xlsx": parsers.parse_xlsx, "csv": parsers.parse_csv}

PARTS = "document_id string, parser string, doc_title string, seq long, level int, title string, content string, page_start int, page_end int, metadata map<string,string>, error string"


def parser_name(ct: Column, filename: Column) -> Column:
    """The first format that accepts; null means unsupported."""
    out = F.lit(None).cast("string")
    for name, types, extensions in reversed(FORMATS):
        out = F.when(content_type(ct).isin(*types) | extension(filename).isin(*extensions), name).otherwise(out)
    return out


def parse_parts(docs: DataFrame) -> DataFrame:
    """Flat parts of all documents (document_id, content_type, filename, content binary).

    Plain text is split by window expressions, the other formats by a Python
    reader over Arrow batches.  A document that can't be read gives one row
    with ``error``; PDF arrives as rows, see ``pdf_rows``.
    """
    routed = docs.withColumn("parser", parser_name(F.col("content_type"), F.col("filename")))
    texts = text_parts(routed.where("parser = 'text'").select("document_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    texts = texts.select("document_id", F.lit("text").alias("parser"), "doc_title", "seq", "level", "title", "content", F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("error"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PARTS.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                parse = _PARSE.get(r.parser)
                try:
                    if parse is None:
                        raise ValueError("unsupported format")
                    title, found = parse(bytes(r.content or b""))
                    rows += [(r.document_id, r.parser, title, i, p["level"], p["title"], p["content"], p["page_start"], p["page_end"], p["metadata"], None) for i, p in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((r.document_id, r.parser, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns)

    others = routed.where("parser is null or parser not in ('text', 'pdf')").select("document_id", "parser", "content")
    return texts.unionByName(others.mapInPandas(read, PARTS))


def text_parts(docs: DataFrame) -> DataFrame:
    """Plain text (document_id, text): a running count of heading lines numbers the parts."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", "\r+$", "")).withColumn("head", is_text_heading(F.col("line")))
    upto = W.Window.partitionBy("document_id").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    lines = lines.withColumn("seq", F.sum(F.col("head").cast("long")).over(upto))
    said = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda s: s["line"])
    parts = lines.groupBy("document_id", "seq").agg(
        F.max(F.when(F.col("head"), strip(F.col("line")))).alias("heading"), strip(F.array_join(said, "\n")).alias("content")
    )
    parts = parts.withColumn("level", F.when(F.col("heading").isNull(), 0).otherwise(1)).withColumn("title", F.coalesce("heading", F.lit("")))
    first = docs.select("document_id", clip_bytes(first_line(F.col("text")), 120).alias("line1"))
    titles = parts.where("level = 1").groupBy("document_id").agg(F.min_by("title", "seq").alias("t1"))
    out = parts.join(first, "document_id").join(titles, "document_id", "left")
    return out.select("document_id", F.coalesce("t1", "line1").alias("doc_title"), "seq", "level", "title", "content")
