"""Page ranges: interval joins within a document, and budgets over ordered text.

Every interval join carries ``document_id`` as an equality, so it is planned as
a hash or merge join with the overlap as a residual test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions.text import clip_bytes, nonblank, squeeze, strip


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    known = (a_start > 0) & (a_end > 0) & (b_start > 0) & (b_end > 0)
    return known & (a_start <= b_end) & (b_start <= a_end)


def overlap_size(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    return F.when(overlaps(a_start, a_end, b_start, b_end), shared).otherwise(F.lit(0))


def sections_overlapping(sections: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sections that meet any range (document_id, start, end), each once."""
    test = overlaps(sections["page_start"], sections["page_end"], ranges["start"], ranges["end"])
    return sections.join(ranges, (sections["document_id"] == ranges["document_id"]) & test, "left_semi")


def clamp_range(start: Column, end: Column, last: Column) -> Column:
    """struct(start, end) inside 1..last, or null where nothing is left (last 0: open)."""
    s = F.when(start <= 0, F.lit(1)).otherwise(start)
    e = F.when(end <= 0, s).otherwise(end)
    lo, hi = F.least(s, e), F.greatest(s, e)
    bad = ((start <= 0) & (end <= 0)) | ((last > 0) & (lo > last))
    return F.when(~bad, F.struct(lo.alias("start"), F.when(last > 0, F.least(hi, last)).otherwise(hi).alias("end")))


def select_cited(ranges: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Clamp, keep each range once with its best confidence, take the top ``k``.

    ``ranges``: (by..., pos, start, end, confidence, last_page).
    """
    rows = ranges.withColumn("r", clamp_range(F.col("start"), F.col("end"), F.col("last_page"))).where("r is not null")
    rows = rows.groupBy(*by, "r").agg(F.max("confidence").alias("confidence"), F.min("pos").alias("pos"))
    best = F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc("confidence"), "pos"))
    rows = rows.withColumn("n", best).where(F.col("n") <= k)
    return rows.select(*by, "r.start", "r.end", "confidence")


def citation_sources(cited: DataFrame, read: DataFrame, by: list[str]) -> DataFrame:
    """Cited ranges where a query has any, else the pages it read; ranges once."""
    fallback = read.join(cited.select(*by).distinct(), by, "left_anti")
    return cited.select(*by, "start", "end").unionByName(fallback.select(*by, "start", "end")).distinct()


def resolve_toc_ends(nodes: DataFrame) -> DataFrame:
    """Add ``end``: the page before the next sibling that has a page, else the
    parent's end, else the node's own start.

    ``nodes``: (document_id, toc_seq, parent_seq, depth, title, start_page, end_page),
    siblings in ``toc_seq`` order.  One pass for each depth, parents first.
    """
    after = W.Window.partitionBy("document_id", "parent_seq").orderBy("toc_seq").rowsBetween(1, W.Window.unboundedFollowing)
    page = F.when(F.col("start_page") > 0, F.col("start_page"))
    rows = nodes.withColumn("__next", F.first(page, ignorenulls=True).over(after))
    rows = rows.withColumn("__end", F.when(F.col("end_page") > 0, F.col("end_page")).when(F.col("__next").isNotNull(), F.greatest(F.col("__next") - 1, F.col("start_page"))))
    deepest = rows.agg(F.max("depth")).first()[0]
    done = None
    for d in range((deepest if deepest is not None else -1) + 1):
        level = rows.where(F.col("depth") == d)
        if done is None:
            level = level.withColumn("__up", F.lit(None).cast("int"))
        else:
            up = done.select("document_id", F.col("toc_seq").alias("parent_seq"), F.col("end").alias("__up"))
            level = level.join(up, ["document_id", "parent_seq"], "left")
        end = F.coalesce("__end", F.when(F.col("__up") > 0, F.col("__up")), "start_page").cast("int")
        level = level.select(*nodes.columns, end.alias("end"))
        done = level if done is None else done.unionByName(level)
    return nodes.withColumn("end", F.col("end_page")).limit(0) if done is None else done


def heading_paths(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """The best fitting TOC node of each section: (document_id, id, title_path).

    ``toc``: (document_id, toc_seq, depth, start, end, title_path).  A node that
    contains the section beats one that doesn't; then deeper, more overlap,
    tighter, earlier start, earlier in the list.  If the winner has no titles
    the section has no path.
    """
    s, t = sections.select("document_id", "id", "page_start", "page_end").alias("s"), toc.alias("t")
    over = overlap_size(F.col("s.page_start"), F.col("s.page_end"), F.col("t.start"), F.col("t.end"))
    holds = (F.col("t.start") <= F.col("s.page_start")) & (F.col("s.page_end") <= F.col("t.end"))
    met = s.join(t, (F.col("s.document_id") == F.col("t.document_id")) & (over > 0))
    score = F.struct(holds.alias("a"), F.col("t.depth").alias("b"), over.alias("c"), (F.col("t.start") - F.col("t.end")).alias("d"), (-F.col("t.start")).alias("e"), (-F.col("t.toc_seq")).alias("f"))
    best = met.groupBy("s.document_id", "s.id").agg(F.max_by(F.col("t.title_path"), score).alias("title_path"))
    return best.where(F.size("title_path") > 0)


def toc_title_paths(nodes: DataFrame) -> DataFrame:
    """Titles from the top to each node, blank ones left out; preorder kept."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = None
    own = F.when(nonblank(F.col("title")), F.array(strip(F.col("title")))).otherwise(F.array().cast("array<string>"))
    for d in range((deepest if deepest is not None else -1) + 1):
        level = nodes.where(F.col("depth") == d)
        if done is None:
            level = level.withColumn("title_path", own)
        else:
            up = done.select("document_id", F.col("toc_seq").alias("parent_seq"), F.col("title_path").alias("__up"))
            level = level.join(up, ["document_id", "parent_seq"]).withColumn("title_path", F.concat("__up", own)).drop("__up")
        level = level.select(*nodes.columns, "title_path")
        done = level if done is None else done.unionByName(level)
    return nodes.withColumn("title_path", own).limit(0) if done is None else done


def clip_to_budget(pieces: DataFrame, by: list[str], order: str, limit: int = 16000, text: str = "piece") -> DataFrame:
    """Concatenate ordered pieces up to ``limit`` bytes.

    Pieces that begin at or before the limit are reported, the last one cut:
    (by..., text, used: array of order values).
    """
    before = W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    rows = pieces.withColumn("__at", F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0))).where(F.col("__at") <= limit)
    rows = rows.withColumn("__cut", clip_bytes(F.col(text), (F.lit(limit) - F.col("__at")).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct(order, "__cut")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["__cut"]), "").alias("text"), F.transform(parts, lambda p: p[order]).alias("used"))


def page_texts(sections: DataFrame) -> DataFrame:
    """Text of each page: titles and bodies of the sections that start on it, in preorder."""
    title = F.when(nonblank(F.col("title")), F.concat(strip(F.col("title")), F.lit("\n"))).otherwise(F.lit(""))
    part = F.concat(title, F.coalesce("content", F.lit("")))
    rows = sections.where(F.col("page_start") > 0).select("document_id", F.col("page_start").alias("page_number"), "preorder", part.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("preorder", "part"))), lambda p: p["part"])
    return rows.groupBy("document_id", "page_number").agg(F.array_join(parts, "\n").alias("text"))


def indexed_text(pages: DataFrame, budget: int) -> DataFrame:
    """Pages in their index tags, as many from the first on as fit the budget."""
    tag = lambda end: F.concat(F.lit(f"<{end}physical_index_"), F.col("page_number").cast("string"), F.lit(">\n"))
    rows = pages.withColumn("piece", F.concat(tag(""), "text", F.lit("\n"), tag("/")))
    upto = W.Window.partitionBy("document_id").orderBy("page_number").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum(F.octet_length("piece")).over(upto)).where(F.col("__sum") <= budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "piece"))), lambda p: p["piece"])
    return rows.groupBy("document_id").agg(F.array_join(parts, "").alias("text"))


def physical_index(c: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(c, r"<physical_index_(\d+)>", 1), F.lit("999999999")).cast("int"), F.lit(0))


def citations(cited: DataFrame, sections: DataFrame, paths: DataFrame, by: list[str]) -> DataFrame:
    """Cited ranges with the ids of their sections and the first one's path."""
    c, s = cited.alias("c"), sections.alias("s")
    test = overlaps(F.col("s.page_start"), F.col("s.page_end"), F.col("c.start"), F.col("c.end"))
    met = c.join(s, (F.col("c.document_id") == F.col("s.document_id")) & test)
    spot = F.struct(F.col("s.page_start").alias("ps"), F.col("s.page_end").alias("pe"), F.col("s.preorder").alias("o"), F.col("s.id").alias("id"))
    rows = met.groupBy(*(F.col(f"c.{x}").alias(x) for x in (*by, "start", "end"))).agg(F.array_sort(F.collect_list(spot)).alias("found"))
    rows = rows.select(*by, "start", "end", F.transform("found", lambda f: f["id"]).alias("section_ids"), F.element_at("found", 1)["id"].alias("id"))
    return rows.join(paths, ["document_id", "id"], "left").drop("id")


def match_titles(pages: DataFrame, nodes: DataFrame, head: int = 4000) -> DataFrame:
    """Nodes whose title stands at the start of their page keep it, others get page 0."""
    rows = nodes.join(pages.select("document_id", F.col("page_number").alias("start_page"), "text"), ["document_id", "start_page"], "left")
    found = F.lower(squeeze(clip_bytes(F.col("text"), head))).contains(F.lower(squeeze(F.col("title"))))
    return rows.withColumn("start_page", F.when(F.coalesce(found, F.lit(False)), F.col("start_page")).otherwise(F.lit(0))).drop("text")
