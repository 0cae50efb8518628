"""Tree operators over section rows (document_id, id, parent_id, ordinal, ...).

A tree is an adjacency list; ``view`` adds the path of ordinals from the top,
and nearly everything else is a filter or an aggregate over path prefixes.
The only loops run over depth, one join for each level of the whole corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions import hashing
from foliant.functions.text import clean_for_model, approx_tokens, nonblank, squeeze, strip
from foliant.plans.storage import cut

LEVELS = 11


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def view(sections: DataFrame) -> DataFrame:
    """Add path, stored depth, view depth and preorder; orphans go with their subtrees.

    With several top sections a synthetic root stands above them, so they are
    at view depth 1; a single top section is the root itself.
    """
    base = sections.drop("path", "depth", "view_depth", "preorder")
    level = base.where(_blank("parent_id")).withColumn("path", F.array("ordinal")).withColumn("depth", F.lit(0))
    levels, depth = [level], 0
    below = base.where(~_blank("parent_id"))
    while True:
        depth += 1
        up = level.select("document_id", F.col("id").alias("parent_id"), F.col("path").alias("__up"))
        level = cut(below.join(up, ["document_id", "parent_id"]).withColumn("path", F.concat("__up", F.array("ordinal"))).withColumn("depth", F.lit(depth)).drop("__up"))
        if not level.take(1):
            break
        levels.append(level)
    rows = reduce(lambda a, b: a.unionByName(b), levels)
    per_doc = W.Window.partitionBy("document_id")
    tops = F.sum((F.col("depth") == 0).cast("int")).over(per_doc)
    return rows.withColumn("view_depth", F.col("depth") + (tops > 1).cast("int")).withColumn(
        "preorder", F.row_number().over(per_doc.orderBy("path", "id"))
    )


def children(sections: DataFrame) -> DataFrame:
    kids = sections.where(~_blank("parent_id")).groupBy("document_id", F.col("parent_id").alias("id"))
    return kids.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("id").alias("child")))), lambda s: s["child"]).alias("children"))


def leaves(sections: DataFrame) -> DataFrame:
    parents = sections.where(~_blank("parent_id")).select("document_id", F.col("parent_id").alias("id")).distinct()
    return sections.join(parents, ["document_id", "id"], "left_anti")


def leaf_tokens(sections: DataFrame) -> DataFrame:
    return leaves(sections).groupBy("document_id").agg(F.sum("token_count").alias("leaf_tokens"), F.count("*").alias("leaves"))


def totals(sections: DataFrame) -> DataFrame:
    paged = (F.coalesce("page_start", F.lit(0)) > 0) | (F.coalesce("page_end", F.lit(0)) > 0)
    return sections.groupBy("document_id").agg(F.count("*").alias("sections"), F.sum("token_count").alias("tokens"), F.max(paged).alias("has_pages"))


def ancestors(viewed: DataFrame) -> DataFrame:
    """(document_id, id, above, distance): every section with itself and all above it."""
    paths = viewed.select("document_id", "id", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"), "path")
    paths = paths.select("document_id", "id", F.slice("path", 1, F.col("n")).alias("p"), (F.size("path") - F.col("n")).alias("distance"))
    above = viewed.select("document_id", F.col("id").alias("above"), F.col("path").alias("p"))
    return paths.join(above, ["document_id", "p"]).select("document_id", "id", "above", "distance")


def propagate_pages(viewed: DataFrame) -> DataFrame:
    """A section's range spans its own and all its descendants'; 0 is unknown."""
    page = lambda c: F.nullif(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    own = viewed.select("document_id", "id", page("page_start").alias("s"), page("page_end").alias("e"))
    spans = ancestors(viewed).join(own, ["document_id", "id"]).groupBy("document_id", F.col("above").alias("id"))
    spans = spans.agg(F.coalesce(F.min("s"), F.lit(0)).alias("page_start"), F.coalesce(F.max("e"), F.lit(0)).alias("page_end"))
    return viewed.drop("page_start", "page_end").join(spans, ["document_id", "id"])


def compact(viewed: DataFrame, min_tokens: int = 50, max_depth: int = 0) -> DataFrame:
    """Absorb what lies at ``max_depth`` and below, then prune small leaves.

    Leaves are judged as they were before pruning: a parent whose children all
    go stays, childless.
    """
    min_tokens = min_tokens or 50
    rows = viewed
    if max_depth > 0:
        above = ancestors(viewed).where("distance >= 0").join(viewed.select("document_id", "id", "token_count"), ["document_id", "id"])
        sums = above.groupBy("document_id", F.col("above").alias("id")).agg(F.sum("token_count").alias("__sum"))
        rows = rows.where(F.col("view_depth") < max_depth).join(sums, ["document_id", "id"])
        at_edge = F.col("view_depth") + 1 >= max_depth
        rows = rows.withColumn("token_count", F.when(at_edge, F.col("__sum")).otherwise(F.col("token_count"))).drop("__sum")
    small = leaves(rows).where((F.col("token_count") < min_tokens) & (F.col("id") != "") & (F.col("view_depth") > 0))
    return rows.join(small.select("document_id", "id"), ["document_id", "id"], "left_anti").drop("page_start", "page_end", "summary_axes", "candidate_questions")


def merge_single_children(viewed: DataFrame) -> DataFrame:
    """Collapse chains of only children.

    The lowest section of a chain gives id, summary and content, the highest
    parent and ordinal; titles join with " > " and tokens add up.
    """
    kids = viewed.groupBy("document_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("__kids"))
    rows = viewed.join(kids, ["document_id", "id"], "left").withColumn("__kids", F.coalesce("__kids", F.lit(0)))
    up = rows.select("document_id", F.col("id").alias("above"), (F.col("__kids") == 1).alias("lone"), F.col("title").alias("t"), F.col("token_count").alias("n"), F.col("parent_id").alias("p"), F.col("ordinal").alias("o"), F.col("depth").alias("d"))
    chain = ancestors(viewed).join(up, ["document_id", "above"])
    chain = chain.groupBy("document_id", "id").agg(F.array_sort(F.collect_list(F.struct("distance", "lone", "t", "n", "p", "o", "d"))).alias("c"))
    # From the section upward, while each one above has a single child.
    run = F.aggregate(
        F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), F.lit(0),
        lambda acc, x: F.when((acc + 1 == x["distance"]) & x["lone"], acc + 1).otherwise(acc),
    )
    merged = rows.where("__kids <> 1").join(chain.withColumn("k", run), ["document_id", "id"])
    top = F.element_at("c", F.col("k") + 1)
    part = F.slice("c", 1, F.col("k") + 1)
    cols = {
        "title": F.array_join(F.reverse(F.transform(part, lambda x: x["t"])), " > "),
        "token_count": F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["n"]),
        "parent_id": top["p"],
        "ordinal": top["o"],
        "depth": top["d"],
    }
    return merged.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in viewed.columns if c not in ("path", "view_depth", "preorder")])


def llms_txt(viewed: DataFrame, docs: DataFrame) -> DataFrame:
    """The outline of each document as Markdown: (document_id, llms_txt)."""
    heading = F.when(nonblank(F.col("title")), strip(F.col("title"))).otherwise(F.col("id"))
    hashes = F.repeat(F.lit("#"), F.least(F.col("view_depth") + 1, F.lit(6)))
    said = F.when(nonblank(F.col("summary")), F.concat(squeeze(F.col("summary")), F.lit("\n"))).otherwise(F.lit(""))
    line = F.concat(F.lit("\n"), hashes, F.lit(" "), heading, F.lit("\n"), said)
    top = F.when(F.col("view_depth") == 0, F.when(nonblank(F.col("summary")), F.concat(F.lit("\n> "), squeeze(F.col("summary")), F.lit("\n"))).otherwise(F.lit(""))).otherwise(line)
    body = viewed.select("document_id", "preorder", top.alias("line")).groupBy("document_id")
    body = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "line"))), lambda s: s["line"]), "").alias("body"))
    title = F.when(nonblank(F.col("title")), strip(F.col("title"))).otherwise(F.col("document_id").cast("string"))
    out = docs.select(F.col("id").alias("document_id"), "title").join(body, "document_id", "left")
    return out.select("document_id", F.concat(F.lit("# "), title, F.lit("\n"), F.coalesce("body", F.lit(""))).alias("llms_txt"))


def parents_by_level(flat: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add parent_seq: the nearest earlier heading of a smaller level.

    It is the greatest, over smaller levels, of the last row of that level,
    which needs no stack.  ``flat``: (document_id, seq, level, ...).
    """
    before = W.Window.partitionBy("document_id").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("seq")), ignorenulls=True).over(before).alias(f"__last{n}") for n in range(1, levels)]
    rows = flat.select("*", *last)
    best = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(F.col("level") > n, F.col(f"__last{n}")) for n in range(1, levels)))
    return rows.withColumn("parent_seq", best).drop(*(f"__last{n}" for n in range(1, levels)))


def with_preamble(flat: DataFrame) -> DataFrame:
    """A first part without heading becomes "Introduction", or goes if blank."""
    n = F.count("*").over(W.Window.partitionBy("document_id"))
    rows = flat.withColumn("__n", n)
    rows = rows.where(~((F.col("level") == 0) & ~nonblank(F.col("content")) & (F.col("__n") > 1))).drop("__n")
    return rows.withColumn("title", F.when(F.col("level") == 0, F.lit("Introduction")).otherwise(F.col("title"))).withColumn("level", F.greatest("level", F.lit(1)))


def persist_tree(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Section rows with deterministic ids, and their bodies as a second table.

    ``flat``: (document_id, seq, parent_seq, title, content, page_start, page_end).
    """
    ordinal = F.row_number().over(W.Window.partitionBy("document_id", "parent_seq").orderBy("seq")) - 1
    rows = flat.withColumn("ordinal", ordinal).withColumn("id", F.col("seq").cast("string")).withColumn("parent_id", F.coalesce(F.col("parent_seq").cast("string"), F.lit("")))
    rows = view(rows).withColumn("sid", hashing.section_id(F.col("document_id"), F.col("path")))
    up = hashing.section_id(F.col("document_id"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(1))))
    body = clean_for_model(F.col("content"))
    blank = ~nonblank(body)
    page = lambda c: F.nullif(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(0))
    sections = rows.select(
        F.col("sid").alias("id"), "document_id", F.when(F.size("path") > 1, up).alias("parent_id"), "ordinal", "depth",
        clean_for_model(F.col("title")).alias("title"),
        F.when(blank, F.lit("")).otherwise(hashing.section_key(F.col("document_id"), F.col("sid"))).alias("content_ref"),
        approx_tokens(body).alias("token_count"), page("page_start").alias("page_start"), page("page_end").alias("page_end"),
    )
    bodies = rows.where(~blank).select(F.col("sid").alias("section_id"), "document_id", body.alias("content"))
    return sections, bodies


def summarise(viewed: DataFrame, call, limit: int = 4000) -> DataFrame:
    """Fill empty summaries bottom up: (document_id, id, summary).

    ``viewed`` has the column ``content``.  ``call`` maps a column of prompts
    to a column of summaries.  A parent is told only its children's titles and
    summaries; a section with neither text nor children gets its title.
    """
    from foliant.functions.text import clip_bytes

    deepest = viewed.agg(F.max("depth")).first()[0]
    done = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        rows = viewed.where(F.col("depth") == depth)
        if done is not None:
            lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title", "summary"))), lambda s: F.concat(F.lit("- "), s["title"], F.lit(": "), s["summary"]))
            kids = done.where(F.col("depth") == depth + 1).groupBy("document_id", F.col("parent_id").alias("id")).agg(F.array_join(lines, "\n").alias("kids"))
            rows = rows.join(kids, ["document_id", "id"], "left")
        else:
            rows = rows.withColumn("kids", F.lit(None).cast("string"))
        told = F.when(F.col("kids").isNotNull(), F.concat(F.lit("This section's subsections, each with a short summary:\n"), "kids")).otherwise(clip_bytes(F.coalesce("content", F.lit("")), limit))
        fresh = F.when(nonblank(told), call(F.concat_ws("\n", "title", told))).otherwise(F.col("title"))
        kept = F.when(nonblank(F.col("summary")), F.col("summary")).otherwise(fresh)
        level = cut(rows.select("document_id", "id", "parent_id", "ordinal", "depth", "title", kept.alias("summary")))
        done = level if done is None else done.unionByName(level)
    return viewed.select("document_id", "id", "summary").limit(0) if done is None else done.select("document_id", "id", "summary")
