"""Driver queries: the engine's operators over the supplied tables.

Stand-ins: orders are documents (customer = tenant, status = status), line items
their sections, region > nation > customer > orders a four-level tree, events
jobs and scores, documents plain-text files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import hashing, text
from foliant.operators import catalog, chunking, pages, ranking, tree
from foliant.plans import prompts, strategies
from foliant.plans.budget import Budget, split
from foliant.plans.clients import Lexical
from foliant.sources.formats import parse_parts, text_parts


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------------

def order_docs(spark, sf):
    return _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price")
    )


def tenant_docs(spark, sf):
    """Orders whose tenant is their priority."""
    return order_docs(spark, sf).drop("org_id").join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("org_id")), "id")


def line_sections(spark, sf):
    return _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("preorder"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("title"),
        F.col("l_linenumber").alias("page_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("page_end"), F.col("l_quantity").cast("int").alias("qty"),
    )


def geo_tree(spark, sf, orders: bool = False):
    """One tree for each region: nation > customer (> order)."""
    r, n, c = (_t(spark, sf, x) for x in ("region", "nation", "customer"))
    top = r.select(F.col("r_regionkey").alias("document_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("").alias("parent_id"), F.lit(0).alias("ordinal"), F.col("r_name").alias("title"), F.lit(0).alias("token_count"))
    nation = n.select(F.col("n_regionkey").alias("document_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("title"), F.lit(0).alias("token_count"))
    home = n.select("n_nationkey", F.col("n_regionkey").alias("document_id"))
    where = c.join(home, c["c_nationkey"] == home["n_nationkey"])
    cust = where.select("document_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.col("c_custkey").cast("int").alias("ordinal"), F.col("c_name").alias("title"), (F.col("c_custkey") % 97).cast("int").alias("token_count"))
    rows = top.unionByName(nation).unionByName(cust)
    if orders:
        o = _t(spark, sf, "orders").join(where.select("document_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.unionByName(o.select("document_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent_id"), F.col("o_orderkey").cast("int").alias("ordinal"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 211).cast("int").alias("token_count")))
    return rows


def _dotted(path):
    return F.array_join(path.cast("array<string>"), ".")


# ---- text ------------------------------------------------------------------------

def approx_tokens(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.approx_tokens(F.col("text")).cast("long").alias("tokens"), F.octet_length("text").cast("long").alias("n_bytes"))


def fallback_summary(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.fallback_summary(F.col("source"), F.col("text")).alias("summary"))


def text_headings(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(text.is_text_heading(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), text.strip(F.col("line")).alias("heading"))


def text_sections(spark, sf):
    parts = text_parts(_t(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return parts.select(F.col("document_id").alias("doc_id"), "seq", F.col("level").cast("long").alias("level"), F.length("content").cast("long").alias("n_content"))


def boilerplate_lines(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(text.is_boilerplate(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def mojibake_titles(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", text.is_mojibake_title(F.col("p_name")).alias("bad"))


def letter_spacing(spark, sf):
    spaced = F.array_join(F.split("n_name", ""), " ")
    return _t(spark, sf, "nation").select("n_nationkey", text.join_letter_spacing(F.upper(spaced)).alias("joined"))


def match_keys(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", text.match_key(F.concat_ws("  - ", "c_name", "c_mktsegment")).alias("k"))


def table_grids(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"]))
    g = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("na|me"))), rows).alias("rows"))
    return g.select("n_regionkey", text.table_markdown(F.col("rows")).alias("grid"))


# ---- catalog ---------------------------------------------------------------------

def list_documents_page(spark, sf):
    docs = tenant_docs(spark, sf)
    page = catalog.list_documents(docs, catalog.in_scope("1-URGENT"), limit=50, status="O", tiebreak="id", before=("1998-01-01 00:00:00", 0))
    return page.select("id", "org_id", "status")


def count_sections_scoped(spark, sf):
    docs = order_docs(spark, sf)
    return catalog.sections_of(line_sections(spark, sf), docs, F.col("status") == "F").groupBy("document_id").agg(F.count("*").alias("n"))


def list_sections_scoped(spark, sf):
    docs = tenant_docs(spark, sf)
    return catalog.sections_of(line_sections(spark, sf), docs, catalog.in_scope("1-URGENT", "O", store_col="status")).select("document_id", "id", "page_start", "page_end")


def ingest_dedupe(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("org_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("idempotency_key"), F.col("ts").alias("created_at"))
    return catalog.dedupe_ingest(e).select("id", "org_id", "idempotency_key")


def upsert_latest(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "event_id", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))
    out = catalog.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), version=["updated_at", "event_id"])
    return out.select("id", "status", "event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


def delete_cascade(spark, sf):
    docs = order_docs(spark, sf)
    kept, sections = catalog.delete_documents(docs, line_sections(spark, sf), docs.where("status = 'F'").select("id"))
    return sections.groupBy("document_id").agg(F.count("*").alias("n")).join(kept.select(F.col("id").alias("document_id"), "status"), "document_id")


def patch_status(spark, sf):
    docs = order_docs(spark, sf).select("id", "status")
    late = _t(spark, sf, "lineitem").where("l_shipdate >= '1998-06-01'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("status", F.lit("L"))
    return catalog.patch(docs, late)


# ---- trees -----------------------------------------------------------------------

def tree_view(spark, sf):
    v = tree.view(geo_tree(spark, sf, True))
    return v.select("document_id", "id", "view_depth", _dotted(F.col("path")).alias("path"), F.col("preorder").cast("long").alias("preorder"))


def tree_rollup(spark, sf):
    v = tree.view(geo_tree(spark, sf, True))
    above = tree.ancestors(v).join(v.select("document_id", "id", "token_count"), ["document_id", "id"])
    return above.groupBy("document_id", F.col("above").alias("id")).agg(F.sum("token_count").alias("tokens"), F.count("*").alias("sections"))


def leaf_token_sum(spark, sf):
    return tree.leaf_tokens(geo_tree(spark, sf, True))


def tree_children(spark, sf):
    return tree.children(geo_tree(spark, sf)).select("document_id", "id", F.array_join("children", ",").alias("children"))


def compact_tree(spark, sf):
    v = tree.view(geo_tree(spark, sf)).withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0)).withColumn("summary_axes", F.lit("")).withColumn("candidate_questions", F.lit(""))
    return tree.compact(v, 50).select("document_id", "id", "token_count")


def llms_txt(spark, sf):
    r, n = _t(spark, sf, "region"), _t(spark, sf, "nation")
    sections = n.select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").cast("string").alias("id"), F.lit("").alias("parent_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("title"), F.concat(F.lit("nation  "), F.col("n_nationkey").cast("string")).alias("summary"))
    return tree.llms_txt(tree.view(sections), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")))


# ---- pages -----------------------------------------------------------------------

def _ranges(spark, sf):
    return order_docs(spark, sf).select(F.col("id").alias("document_id"), (F.col("id") % 5).cast("int").alias("start"), (F.col("id") % 5 + F.col("org_id") % 3).cast("int").alias("end"))


def page_overlap(spark, sf):
    return pages.sections_overlapping(line_sections(spark, sf), _ranges(spark, sf)).select("document_id", "id")


def heading_paths(spark, sf):
    toc = line_sections(spark, sf).select("document_id", F.col("id").alias("toc_seq"), (F.col("qty") % 3).alias("depth"), F.col("page_start").alias("start"), (F.col("page_start") + F.col("qty") % 5).alias("end"), F.array("title").alias("title_path"))
    found = pages.heading_paths(line_sections(spark, sf), toc)
    return found.select("document_id", "id", F.array_join("title_path", "/").alias("path"))


def cited_top_k(spark, sf):
    e = _t(spark, sf, "events")
    r = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 9).cast("int").alias("start"), (F.col("event_id") % 7).cast("int").alias("end"), text.rounded(F.col("value") % 1, 2).alias("confidence"), F.lit(6).alias("last_page"))
    return pages.select_cited(r, ["query_id"], 3)


def page_budget_clip(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "piece"))
    out = pages.clip_to_budget(rows, ["document_id"], "pos", 500)
    return out.select("document_id", F.length("text").cast("long").alias("n"), F.size("used").cast("long").alias("used"))


def propagate_pages(spark, sf):
    v = tree.view(geo_tree(spark, sf)).withColumn("page_start", F.col("token_count") % 13).withColumn("page_end", F.col("token_count") % 13 + F.col("token_count") % 3)
    return tree.propagate_pages(v).select("document_id", "id", "page_start", "page_end")


def page_texts(spark, sf):
    return pages.page_texts(line_sections(spark, sf).withColumn("content", F.col("qty").cast("string"))).select("document_id", "page_number", "text")


# ---- rankings --------------------------------------------------------------------

def _scores(spark, sf):
    e = _t(spark, sf, "events")
    return e.select((F.col("user_id") % 50).alias("query_id"), F.col("event_id").alias("pos"), F.concat_ws("-", F.col("event_type"), (F.col("user_id") % 7).cast("string")).alias("id"), F.when(F.col("event_id") % 4 > 0, text.rounded(F.col("value") / 1000, 3)).alias("confidence"))


def union_merge(spark, sf):
    return ranking.union_merge(_scores(spark, sf), ["query_id"]).select("query_id", F.array_join("ids", ",").alias("ids"))


def max_confidence(spark, sf):
    return ranking.max_confidence(_scores(spark, sf), ["query_id"])


def ordered_union(spark, sf):
    rows = _scores(spark, sf).withColumn("sub_no", (F.col("pos") % 3).cast("int"))
    return ranking.ordered_union(rows, ["query_id"]).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def rerank_top_k(spark, sf):
    s = _scores(spark, sf)
    candidates = s.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    given = s.where("confidence is not null and pos % 3 = 0").select("query_id", F.col("pos").alias("seq"), "id", F.col("confidence").alias("score"))
    out = ranking.merge_scores(candidates, given, ["query_id"], 5)
    return out.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def abstain(spark, sf):
    return ranking.abstains(_scores(spark, sf).withColumn("query_id", F.col("pos") % 500), ["query_id"], 0.4)


def dedupe_questions(spark, sf):
    c = _t(spark, sf, "conversations").where("role = 'user'")
    q = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("q"))
    return q.select("conv_id", F.size(ranking.distinct_questions(F.concat("q", "q"), 5)).cast("long").alias("n"))


# ---- tokens and prompts ----------------------------------------------------------

def trace_token(spark, sf):
    s = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("ids"))
    return s.select("l_orderkey", hashing.trace_token(F.col("l_orderkey").cast("string"), F.lit("1"), F.lit("m"), F.col("ids")).alias("token"))


def cache_key(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", hashing.cache_key(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit("auto"), F.col("o_orderstatus")).alias("key"))


def outline_lines(spark, sf):
    v = strategies._optional(tree.view(geo_tree(spark, sf)).withColumn("summary", F.col("token_count").cast("string")))
    return v.select("document_id", "id", prompts.outline_line().alias("line"))


def selection_prompt(spark, sf):
    v = strategies._optional(tree.view(geo_tree(spark, sf)))
    o = prompts.outlines(v.withColumn("line", prompts.outline_line()), ["document_id"])
    return o.select("document_id", prompts.selection_prompt(F.lit("Document: x"), F.col("outline"), F.lit(""), F.lit("which?")).alias("prompt"))


# ---- what SQL cannot say ---------------------------------------------------------

def html_sections(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.lit("text/html").alias("content_type"), F.lit("p.html").alias("filename"), F.encode("html", "UTF-8").alias("content"))
    return parse_parts(p.withColumn("document_id", F.col("document_id").cast("string"))).select("document_id", "doc_title", "seq", "level", "title", F.length("content").alias("n"), "error")


def _nodes(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    return d.select("document_id", F.col("pos").cast("long").alias("seq"), F.lit(None).cast("long").alias("parent_seq"), F.lit(1).alias("level"), F.lit("line").alias("title"), "content", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(False).alias("is_table"))


def chunk_leaves(spark, sf):
    return chunking.chunk_leaves(_nodes(spark, sf), 1200, 600).select("document_id", "seq", "parent_seq", "level", "title", F.octet_length("content").alias("n"))


def cap_leaves(spark, sf):
    return chunking.cap_leaves(_nodes(spark, sf), 5).groupBy("document_id").agg(F.count("*").alias("leaves"), F.sum(F.octet_length("content")).alias("n"))


def split_budget(spark, sf):
    v = tree.view(geo_tree(spark, sf)).withColumn("summary", F.lit("")).withColumn("document_id", F.col("document_id").cast("string"))
    docs = _t(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"))
    return split(v, docs, Budget(400, 0)).groupBy("document_id", "slice_no", "breadcrumb").agg(F.count("*").alias("sections"))


def text_tree(spark, sf):
    """Plain text to section rows: headings, hierarchy, ids, token counts."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    flat = text_parts(d).withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0))
    sections, _ = tree.persist_tree(tree.parents_by_level(tree.with_preamble(flat)))
    return sections


def lexical_select(spark, sf):
    """Flagship: whole text documents to trees, one question over all, gated and traced."""
    from foliant.plans.engine import Engine, Options

    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "source")
    flat = text_parts(d.select("document_id", "text")).withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0))
    sections, bodies = tree.persist_tree(tree.parents_by_level(tree.with_preamble(flat)))
    engine = Engine(spark, Lexical(), Options(strategy="single-pass", max_sections=3, abstain_below=0.1))
    viewed = engine.view(sections.join(bodies.select(F.col("section_id").alias("id"), text.fallback_summary(F.lit(""), F.col("content")).alias("summary")), "id", "left"))
    queries = d.select(F.lit("q1").alias("query_id"), "document_id", F.lit("the introduction of this and that").alias("query"))
    out = engine.query(queries, viewed, d.select(F.col("document_id").alias("id"), F.col("source").alias("title")))
    return out.select("query_id", "document_id", F.array_join("section_ids", ",").alias("section_ids"), "confidence", "abstained", "trace_token")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        approx_tokens, fallback_summary, text_headings, text_sections, boilerplate_lines, mojibake_titles, letter_spacing, match_keys, table_grids,
        list_documents_page, count_sections_scoped, list_sections_scoped, ingest_dedupe, upsert_latest, delete_cascade, patch_status,
        tree_view, tree_rollup, leaf_token_sum, tree_children, compact_tree, llms_txt,
        page_overlap, heading_paths, cited_top_k, page_budget_clip, propagate_pages, page_texts,
        union_merge, max_confidence, ordered_union, rerank_top_k, abstain, dedupe_questions,
        trace_token, cache_key, outline_lines, selection_prompt,
        html_sections, chunk_leaves, cap_leaves, split_budget, text_tree, lexical_select,
    )
}
