"""PDF post-processing over text rows or glyphs that another tool extracted.

No PDF reader is bundled: the source is a table of glyphs
(document_id, page, seq, x, y, w, size, font, ch) or of finished rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions.text import fields, is_boilerplate, match_key, join_letter_spacing, strip

SAME_ROW = 2.0
WORD_GAP = 0.20
HEADING_FACTOR = 1.2

ROWS = "document_id string, page int, row int, y double, size double, bold boolean, text string"


def is_bold(font: Column) -> Column:
    f = F.lower(font)
    return f.contains("bold") | f.contains("-bd") | f.contains(",bd")


def round_size(size: Column) -> Column:
    """To half points."""
    return F.floor(size * 2 + 0.5) / 2


def rows_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """Rows of each page: a glyph joins the first row within 2 points of its first glyph."""
    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        tops: list[float] = []
        owner = np.empty(len(g), int)
        for i, y in enumerate(g["y"].to_numpy()):
            near = next((k for k, t in enumerate(tops) if abs(t - y) < SAME_ROW), None)
            if near is None:
                tops.append(y)
                near = len(tops) - 1
            owner[i] = near
        out = []
        for n, k in enumerate(sorted(range(len(tops)), key=lambda k: -tops[k])):
            r = g[owner == k].sort_values("x", kind="stable")
            gap = r["x"].to_numpy()[1:] - (r["x"] + r["w"]).to_numpy()[:-1]
            space = np.concatenate([[False], gap > WORD_GAP * r["size"].to_numpy()[1:]])
            text = "".join((" " if s else "") + c for s, c in zip(space, r["ch"], strict=True))
            inked = r[r["ch"].str.strip() != ""]
            bold = inked["font"].str.lower().str.contains("bold|-bd|,bd").mean() > 0.5 if len(inked) else False
            out.append((g["document_id"].iloc[0], int(g["page"].iloc[0]), n, tops[k], float(r["size"].max()), bool(bold), text.strip()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    found = glyphs.groupBy("document_id", "page").applyInPandas(cluster, ROWS)
    found = found.withColumn("text", join_letter_spacing(F.col("text")))
    return found.where((strip(F.col("text")) != "") & ~is_boilerplate(F.col("text")))


def usable_documents(rows: DataFrame) -> DataFrame:
    """Documents with five rows of real text; overlaid glyphs double their letters."""
    from foliant.functions.text import doubled_share

    n, doubled = doubled_share(F.col("text"))
    good = (F.octet_length(strip(F.col("text"))) >= 4) & ~(F.coalesce(doubled * 100 / F.nullif(n, F.lit(0)), F.lit(0)) > 30)
    return rows.where(good).groupBy("document_id").count().where("count >= 5").select("document_id")


def upper_median(c: str) -> Column:
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, (F.size(values) / 2).cast("int") + 1)


def heading_levels(rows: DataFrame) -> DataFrame:
    """Add level: distinct sizes over the floor, large to small, are 1 to 6.

    Bold rows at body size come one level below; numbered ones go deeper by
    their dots.  0 is body text.
    """
    # The histogram of sizes is small, so the median needs no list of rows.
    sizes = rows.groupBy("document_id", round_size(F.col("size")).alias("s")).count()
    order = W.Window.partitionBy("document_id").orderBy("s")
    upto = order.rowsBetween(W.Window.unboundedPreceding, 0)
    total = F.sum("count").over(W.Window.partitionBy("document_id"))
    median = sizes.withColumn("upto", F.sum("count").over(upto)).withColumn("half", F.floor(total / 2) + 1).where("upto >= half").groupBy("document_id").agg(F.min("s").alias("median"))
    large = sizes.join(median, "document_id").where(F.col("s") > F.col("median") * HEADING_FACTOR)
    levels = large.withColumn("size_level", F.least(F.row_number().over(W.Window.partitionBy("document_id").orderBy(F.desc("s"))), F.lit(6))).select("document_id", "s", "size_level")
    deepest = levels.groupBy("document_id").agg(F.max("size_level").alias("deepest"))
    out = rows.withColumn("s", round_size(F.col("size"))).join(levels, ["document_id", "s"], "left").join(median, "document_id", "left").join(deepest, "document_id", "left")
    words = F.size(fields(F.col("text")))
    short = words.between(1, 25) & ~F.col("text").endswith(",")
    bold_level = F.least(F.coalesce("deepest", F.lit(0)) + 1, F.lit(6))
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?\s+\S", 1)
    deeper = F.when(number != "", F.size(F.split(number, r"\.")) - 1).otherwise(0)
    level = F.when(F.col("size_level").isNotNull(), F.col("size_level")).when(F.col("bold") & (F.col("s") >= F.col("median")), bold_level + deeper)
    return out.withColumn("level", F.when(short, F.coalesce(level, F.lit(0))).otherwise(F.lit(0)).cast("int")).select(*rows.columns, "level")


def match_outline(outline: DataFrame, rows: DataFrame) -> DataFrame:
    """Bookmarks (document_id, pos, level, title) to rows, each after the one before.

    A document gives no rows when under half of its bookmarks are found.
    """
    keyed = rows.select("document_id", "page", "row", match_key(F.col("text")).alias("key"))
    marks = outline.select("document_id", "pos", "level", "title", match_key(F.col("title")).alias("key"))

    def walk(m: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        m, r = m.sort_values("pos"), r.sort_values(["page", "row"])
        keys, at, out = r["key"].tolist(), 0, []
        for b in m.itertuples():
            hit = next((i for i in range(at, len(keys)) if b.key and keys[i].startswith(b.key)), None)
            if hit is not None:
                out.append((b.document_id, b.pos, b.level, b.title, int(r["page"].iloc[hit]), int(r["row"].iloc[hit])))
                at = hit + 1
        columns = ["document_id", "pos", "level", "title", "page", "row"]
        return pd.DataFrame(out if 2 * len(out) >= len(m) else [], columns=columns)

    return marks.groupBy("document_id").cogroup(keyed.groupBy("document_id")).applyInPandas(walk, "document_id string, pos int, level int, title string, page int, row int")


def parts_from_rows(rows: DataFrame) -> DataFrame:
    """Rows with levels to flat parts (document_id, seq, level, title, content, page_start, page_end)."""
    place = W.Window.partitionBy("document_id").orderBy("page", "row").rowsBetween(W.Window.unboundedPreceding, 0)
    numbered = rows.withColumn("seq", F.sum((F.col("level") > 0).cast("long")).over(place))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("page", "row", "text")))), lambda s: s["text"])
    return numbered.groupBy("document_id", "seq").agg(
        F.max("level").alias("level"), F.coalesce(F.max(F.when(F.col("level") > 0, strip(F.col("text")))), F.lit("")).alias("title"),
        F.array_join(body, "\n").alias("content"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )


def attach_tables(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """Append found tables (document_id, page, n, rows array<array<string>>) of at least 2 x 2.

    They stand under one last section "Tables" that spans their pages.
    """
    from foliant.functions.text import normalised_rows, page_table_markdown

    clean = tables.withColumn("rows", normalised_rows(F.col("rows")))
    clean = clean.where((F.size("rows") >= 2) & (F.size(F.element_at("rows", 1)) >= 2))
    last = parts.groupBy("document_id").agg(F.max("seq").alias("last"))
    base = clean.join(last, "document_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    nth = F.row_number().over(W.Window.partitionBy("document_id").orderBy("page", "n"))
    each = base.select("document_id", (F.col("last") + 1 + nth).alias("seq"), F.lit(2).alias("level"), F.concat(F.lit("Table (page "), F.col("page").cast("string"), F.lit(")")).alias("title"), page_table_markdown(F.col("rows")).alias("content"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    top = base.groupBy("document_id").agg((F.max("last") + 1).alias("seq"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    top = top.select("document_id", "seq", F.lit(1).alias("level"), F.lit("Tables").alias("title"), F.lit("").alias("content"), "page_start", "page_end")
    return parts.unionByName(top).unionByName(each)
