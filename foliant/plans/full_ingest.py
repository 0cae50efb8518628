"""Full ingest: what a model adds to parsed documents.

Summaries (plain or in axes), candidate questions, and a table of contents made
from pages.  Every stage is one plan over all documents; a call that fails
leaves a section with a head of its text, without questions, and a document
without a table of contents, and never ends the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import replies
from foliant.functions.replies import read_column
from foliant.functions.text import clip_bytes, fallback_summary, nonblank
from foliant.operators import pages, toc, tree
from foliant.plans import prompts
from foliant.plans.clients import Client, caller

#: Pages searched for a printed table of contents, and bytes shown to the model.
CHECKED_PAGES = 20
PAGE_BYTES, PAGES_BYTES, BODY_BYTES = 6_000, 24_000, 48_000

AXES = "struct<topics:array<string>,entities:array<string>,numbers:array<string>,one_line:string>"
NODES = "array<struct<structure:string,title:string,physical_index:string>>"


def summary_axes(viewed: DataFrame, client: Client, profile: str = "") -> DataFrame:
    """(document_id, id, summary, topics, entities, numbers) of sections that have text.

    A reply that can't be read becomes the line itself; no reply, the head of the text.
    """
    rows = viewed.where(nonblank(F.col("content")))
    ask = F.lit('Describe the section as JSON {"topics": [], "entities": [], "numbers": [], "one_line": ""}.\n')
    prompt = F.concat(prompts.profile_note(F.lit(profile)), F.lit("\n"), ask, F.lit("Title: "), "title", F.lit("\n"), clip_bytes(F.col("content"), 4000))
    said = rows.withColumn("said", caller(client, replies.summary_axes)(prompt))
    said = said.withColumn("axes", read_column(replies.summary_axes, AXES)(F.col("said.reply")))
    head = fallback_summary(F.col("title"), F.col("content"))
    line = F.when(nonblank(F.col("axes.one_line")), F.col("axes.one_line")).when(F.col("axes").isNull() & nonblank(F.col("said.reply")), F.trim("said.reply")).otherwise(head)
    none = F.array().cast("array<string>")
    return said.select("document_id", "id", line.alias("summary"), *(F.coalesce(f"axes.{c}", none).alias(c) for c in ("topics", "entities", "numbers")))


def toc_pages(page_rows: DataFrame, client: Client, checked: int = CHECKED_PAGES) -> DataFrame:
    """(document_id, page_number) of leading pages that hold a table of contents, by the model's word."""
    first = page_rows.where(F.col("page_number") <= checked)
    prompt = F.concat(F.lit('Does this page hold a table of contents? Reply as JSON {"toc_detected": "yes or no"}.\n'), clip_bytes(F.col("text"), PAGE_BYTES))
    yes = read_column(lambda r: replies.says_yes(r, "toc_detected"), "boolean")
    return first.where(yes(caller(client, replies.outer_json)(prompt)["reply"])).select("document_id", "page_number")


def toc_nodes(page_rows: DataFrame, client: Client, checked: int = CHECKED_PAGES) -> DataFrame:
    """(document_id, pos, structure, title, start_page): read off the contents pages, else made from the text."""
    found = toc_pages(page_rows, client, checked).join(page_rows, ["document_id", "page_number"])
    printed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n")
    printed = found.groupBy("document_id").agg(clip_bytes(printed, PAGES_BYTES).alias("printed"))
    body = pages.indexed_text(page_rows, BODY_BYTES).withColumnRenamed("text", "body")
    asked = page_rows.select("document_id").distinct().join(body, "document_id", "left").join(printed, "document_id", "left")
    ask = F.lit('Give the table of contents as JSON {"nodes": [{"structure": "1.1", "title": "", "physical_index": "<physical_index_1>"}]}.\n')
    contents = F.when(F.col("printed").isNotNull(), F.concat(F.lit("Printed contents:\n"), "printed", F.lit("\n"))).otherwise(F.lit(""))
    prompt = F.concat(ask, contents, F.lit("Text:\n"), F.coalesce("body", F.lit("")))
    rows = asked.select("document_id", F.posexplode(read_column(replies.toc_nodes, NODES)(caller(client, replies.toc_nodes)(prompt)["reply"])).alias("pos", "n"))
    return rows.select("document_id", "pos", "n.structure", "n.title", pages.physical_index(F.col("n.physical_index")).alias("start_page"))


def verified(nodes: DataFrame, page_rows: DataFrame, client: Client) -> DataFrame:
    """Start pages that the model denies, or that the document lacks, become 0; a failed call clears nothing."""
    here = nodes.where("start_page > 0").join(page_rows.select("document_id", F.col("page_number").alias("start_page"), "text"), ["document_id", "start_page"], "left")
    prompt = F.concat(F.lit("Does a section of this title begin on the page? Reply as JSON {\"start_begin\": \"yes or no\"}.\nTitle: "), "title", F.lit("\nPage:\n"), clip_bytes(F.col("text"), PAGE_BYTES))
    asked = here.withColumn("said", F.when(F.col("text").isNotNull(), caller(client, replies.outer_json)(prompt)))
    yes = read_column(lambda r: replies.says_yes(r, "start_begin"), "boolean")
    heard = F.col("said.reply").isNotNull()
    keep = F.col("text").isNotNull() & (~heard | F.coalesce(yes(F.col("said.reply")), F.lit(False)))
    kept = asked.select("document_id", "toc_seq", keep.alias("__keep"))
    out = nodes.join(kept, ["document_id", "toc_seq"], "left")
    return out.withColumn("start_page", F.when(F.coalesce("__keep", F.lit(False)), F.col("start_page")).otherwise(0).cast("int")).drop("__keep")


def build_toc(viewed: DataFrame, client: Client, checked: int = CHECKED_PAGES) -> DataFrame:
    """A table of contents for documents with pages: nodes with start and end pages and ids.

    ``viewed`` has the column ``content``.
    """
    page_rows = pages.page_texts(viewed)
    nodes = verified(toc.assemble(toc_nodes(page_rows, client, checked)), page_rows, client)
    last = page_rows.groupBy("document_id").agg(F.max("page_number").cast("int").alias("last_page"))
    return toc.end_pages(nodes, last)


def tree_json(nodes: DataFrame, columns: tuple[str, ...] = ("title", "start_page", "end_page", "node_id"), seq: str = "toc_seq", parent: str = "parent_seq", depth: str = "depth", keep=None) -> DataFrame:
    """(document_id, tree): nested JSON of flat nodes, children under "nodes".

    ``keep`` is a condition; a node that fails it goes with all below it, its
    siblings stay.  One pass for each depth, deepest first.
    """
    rows = nodes if keep is None else nodes.withColumn("__keep", keep)
    deepest = rows.agg(F.max(depth)).first()[0]
    below = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col(depth) == d)
        if below is not None:
            listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__seq"), F.col("__json")))), lambda s: s["__json"]), ","), F.lit("]"))
            level = level.join(below.groupBy("document_id", F.col("__up").alias(seq)).agg(listed.alias("__kids")), ["document_id", seq], "left")
        else:
            level = level.withColumn("__kids", F.lit(None).cast("string"))
        if keep is not None:
            level = level.where("__keep")
        own = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        whole = F.when(F.col("__kids").isNull(), own).otherwise(F.concat(F.expr("substring(" + "__own, 1, length(__own) - 1)"), F.lit(',"nodes":'), "__kids", F.lit("}")))
        below = level.withColumn("__own", own).select("document_id", F.col(parent).alias("__up"), F.col(seq).alias("__seq"), whole.alias("__json"))
    if below is None:
        return rows.select("document_id", F.lit("[]").alias("tree")).limit(0)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__seq", "__json"))), lambda s: s["__json"]), ",")
    return below.groupBy("document_id").agg(F.concat(F.lit("["), top, F.lit("]")).alias("tree"))


def enrich(engine, sections: DataFrame, bodies: DataFrame, axes: bool = False, questions: bool = False, contents: bool = False, profile: str = "") -> tuple[DataFrame, DataFrame | None]:
    """(sections with summaries and what else was asked for, table of contents or None)."""
    viewed = engine.view(sections, bodies)
    if axes:
        found = summary_axes(viewed, engine.client, profile)
        rest = engine.summarise(viewed.drop("summary").join(found.select("document_id", "id", "summary"), ["document_id", "id"], "left"))
        out = sections.join(rest, ["document_id", "id"], "left").join(found.drop("summary"), ["document_id", "id"], "left")
    else:
        out = sections.join(engine.summarise(viewed), ["document_id", "id"], "left")
    if questions:
        out = out.join(engine.questions(viewed), ["document_id", "id"], "left")
    return out, build_toc(viewed, engine.client) if contents else None
