"""Driver queries, second part: file names, replies, tables of contents, pages,
rankings, jobs and events, over the same stand-ins as in ``queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions import hashing, replies, text
from foliant.operators import catalog, pages, ranking, toc, tree
from foliant.operators.replay import replay
from foliant.sources import pdf_rows
from foliant.streaming import jobs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


MODES = ["AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "RAIL X"]


def _lines(spark, sf):
    """Line items numbered from 1 within their order: doc, n, q(uantity), mode, flag, part."""
    order = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("n"), F.col("l_quantity").cast("int").alias("q"),
        _pick(MODES, F.col("l_partkey")).alias("mode"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"),
    )


# ---- text ------------------------------------------------------------------------

TYPES = ["Text/Markdown; charset=utf-8", " text/html", "application/PDF ;q=1", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/csv", "image/png"]
NAMES = ["a.MD", "b.tar.markdown", "c/d.txt", "e.htm", "x.y/f", "g.PDF", "h.docx"]


def content_types(spark, sf):
    e = _t(spark, sf, "events").select("event_id", _pick(TYPES, F.col("event_id")).alias("ct"), _pick(NAMES, F.col("event_id")).alias("name"))
    return e.select("event_id", text.content_type(F.col("ct")).alias("type"), text.extension(F.col("name")).alias("extension"), text.guess_content_type(F.col("name")).alias("guess"), text.source_kind(F.col("ct")).alias("kind"))


def page_table_grids(spark, sf):
    """Ragged rows with blank ones between, padded to the widest."""
    n = F.col("n_nationkey")
    row = F.when(n % 3 == 0, F.array(n.cast("string"), F.col("n_name"), F.lit(" a|b "))).when(n % 3 == 1, F.array(n.cast("string"), F.col("n_name"))).otherwise(F.array(F.lit(" "), F.lit(None).cast("string")))
    g = _t(spark, sf, "nation").select("n_regionkey", "n_nationkey", row.alias("row")).groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda s: s["row"]).alias("rows"))
    return g.select("n_regionkey", text.page_table_markdown(F.col("rows")).alias("grid"), F.size(text.normalised_rows(F.col("rows"))).cast("long").alias("n_rows"))


def clean_texts(spark, sf):
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    d = _t(spark, sf, "documents").withColumn("t", t)
    return d.select("doc_id", F.length(text.clean_paragraphs(F.col("t"))).cast("long").alias("n_clean"), text.first_line(F.col("t")).alias("line"), F.md5(text.normalised_title(F.col("text"))).alias("title_md5"))


def page_tokens(spark, sf):
    """Range texts and trace tokens of pages."""
    s = _lines(spark, sf).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct(F.col("n").alias("start"), (F.col("n") + F.col("q") % 2).alias("end")))).alias("r"))
    return s.select("doc", hashing.page_trace_token(F.col("doc").cast("string"), F.lit("m"), F.col("r")).alias("token"))


def keys_and_ids(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("d"), F.array(F.col("o_custkey").cast("int"), F.lit(2)).alias("path"))
    sid = hashing.section_id(F.col("d"), F.col("path"))
    return o.select("o_orderkey", sid.alias("section"), hashing.section_key(F.col("d"), sid).alias("key"), hashing.source_key(F.col("d"), F.lit(".pdf")).alias("source"))


# ---- replies of a model -----------------------------------------------------------

def _reply(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _events(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", text.rounded(F.col("value"), 2).alias("value"))


def selection_replies(spark, sf):
    """Fenced, with a repeat and a confidence beyond 1; plain id lists; prose; nothing."""
    u, e = F.col("user_id"), F.col("event_id")
    picks = _reply('```json\n{"picks": [{"id": " s', u, '", "confidence": ', text.rounded(F.col("value") / 50, 3), '}, {"id": "t"}, {"id": "s', u, '", "confidence": 0.1}]}\n```')
    plain = _reply('Sure: {"selected_section_ids": ["a', e, '", " ", "b"]} there.')
    said = F.when(e % 4 == 0, picks).when(e % 4 == 1, plain).when(e % 4 == 2, F.lit("no idea")).otherwise(F.lit(" "))
    read = replies.read_column(replies.selection, "struct<ids: array<string>, confidences: map<string, double>>")
    out = _events(spark, sf).select("event_id", read(said).alias("r"))
    return out.select("event_id", F.array_join("r.ids", ",").alias("ids"), F.element_at("r.confidences", F.array_join(F.slice("r.ids", 1, 1), "")).alias("first"), F.col("r").isNull().alias("unread"))


def section_actions(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    said = (
        F.when(e % 4 == 0, _reply('{"action": " Outline ", "level": "', u, '"}')).when(e % 4 == 1, _reply('{"tool": "expand", "section_id": " s', u, '"}'))
        .when(e % 4 == 2, _reply('{"action": "done", "selected_section_ids": ["a', u, '", "b"]}')).otherwise(F.lit('{"action": "jump"}'))
    )
    read = replies.read_column(replies.section_action, "struct<action: string, level: long, id: string, ids: array<string>>")
    out = _events(spark, sf).select("event_id", read(said).alias("r"))
    return out.select("event_id", "r.action", "r.level", "r.id", F.array_join("r.ids", ",").alias("ids"))


def page_actions(spark, sf):
    """Pages as a range text, as a list, as fields; cited ranges in every form."""
    e = F.col("event_id")
    said = (
        F.when(e % 3 == 0, _reply('{"tool": "GET_PAGES", "pages": "', e % 9 + 1, "-", e % 9 + 3, '"}'))
        .when(e % 3 == 1, _reply('{"action": "read", "start_page": "', e % 5 + 2, '", "confidence": "high"}'))
        .otherwise(_reply('{"tool": "done", "answer": "x', e, '", "confidence": ', text.rounded(F.col("value") / 100, 3), ', "cited_pages": [[1, ', e % 7 + 1, '], "4", {"start": 2}, "none"]}'))
    )
    read = replies.read_column(replies.page_action, "struct<action: string, start: long, end: long, answer: string, confidence: double, cited: array<array<long>>>")
    out = _events(spark, sf).select("event_id", read(said).alias("r"))
    return out.select("event_id", "r.action", F.col("r.start").alias("first"), F.col("r.end").alias("last"), "r.answer", "r.confidence", F.array_join(F.transform("r.cited", lambda c: F.concat_ws("-", c.cast("array<string>"))), ",").alias("cited"))


def rerank_replies(spark, sf):
    """Blank ids go, negative scores are 0, large ones stay."""
    e = F.col("event_id")
    said = F.when(e % 5 == 0, F.lit("[]")).otherwise(_reply('{"ranked": [{"id": "a', e, '", "score": ', text.rounded(F.col("value") - 50, 2), '}, {"id": " "}, {"id": " b ", "score": "7"}]}'))
    read = replies.read_column(lambda r: None if (v := replies.scores(r)) is None else [{"id": i, "score": s} for i, s, _ in v], "array<struct<id: string, score: double>>")
    return _events(spark, sf).select("event_id", F.explode(read(said)).alias("r")).select("event_id", "r.id", "r.score")


def plan_replies(spark, sf):
    e = F.col("event_id")
    subs = F.when(e % 2 == 0, _reply('["who ', e, '", " "]')).otherwise(F.lit("[]"))
    said = _reply('Plan:\n{"intent": " ', F.col("event_type"), ' ", "entities": ["x', F.col("user_id"), '", 3], "is_multi_hop": true, "sub_questions": ', subs, "}")
    read = replies.read_column(replies.plan, "struct<intent: string, entities: array<string>, is_multi_hop: boolean, sub_questions: array<string>>")
    out = _events(spark, sf).select("event_id", read(said).alias("r"))
    return out.select("event_id", "r.intent", F.array_join("r.entities", ",").alias("entities"), "r.is_multi_hop", F.array_join("r.sub_questions", ",").alias("subs"))


def axes_replies(spark, sf):
    """Topics are capped at four; the line loses its white space; questions keep the first casing."""
    e = F.col("event_id")
    said = _reply('{"topics": ["a', e, '", "b", "c", "d", "e"], "numbers": [" 1 "], "one_line": " two  words\\n', F.col("event_type"), '", "questions": ["Who', e, '?", "who', e, '?", "What?"]}')
    axes = replies.read_column(replies.summary_axes, "struct<topics: array<string>, numbers: array<string>, one_line: string>")
    asked = replies.read_column(replies.questions, "array<string>")
    out = _events(spark, sf).select("event_id", axes(said).alias("r"), asked(said).alias("q"))
    return out.select("event_id", F.array_join("r.topics", ",").alias("topics"), F.array_join("r.numbers", ",").alias("numbers"), "r.one_line", F.array_join("q", ",").alias("questions"))


def toc_replies(spark, sf):
    """Nodes of a table of contents and yes-or-no answers, as a model writes them."""
    e = F.col("event_id")
    said = _reply('```\n{"table_of_contents": [{"structure": "1.', e % 4, '", "title": "T', e, '", "physical_index": "<physical_index_', e % 30, '>"}, 7], "toc_detected": "', F.when(e % 3 == 0, F.lit(" Yes ")).otherwise(F.lit("no")), '"}\n```')
    nodes = replies.read_column(replies.toc_nodes, "array<struct<structure: string, title: string, physical_index: string>>")
    yes = replies.read_column(lambda r: replies.says_yes(r, "toc_detected"), "boolean")
    out = _events(spark, sf).select("event_id", F.explode(nodes(said)).alias("r"), yes(said).alias("yes"))
    return out.select("event_id", "r.structure", "r.title", pages.physical_index(F.col("r.physical_index")).cast("long").alias("page"), toc.dotted_depth(F.col("r.structure")).cast("long").alias("depth"), "yes")


# ---- tables of contents -------------------------------------------------------------

def _flat_toc(spark, sf):
    """Line 1 of an order is chapter "1", the others sections "1.<n>"; some have a blank title."""
    n, q = F.col("n"), F.col("q")
    return _lines(spark, sf).select(
        F.col("doc").cast("string").alias("document_id"), n.alias("pos"), F.when(n == 1, F.lit("1")).otherwise(F.concat(F.lit("1."), n.cast("string"))).alias("structure"),
        F.when((q % 11 == 0) & (n > 1), F.lit(" ")).otherwise(F.concat(F.lit(" Line "), n.cast("string"))).alias("title"), F.when(n == 1, F.lit(1)).otherwise(n + q % 4).cast("int").alias("start_page"),
    )


def toc_assemble(spark, sf):
    out = toc.assemble(_flat_toc(spark, sf))
    return out.select("document_id", *_long("toc_seq", "parent_seq", "depth"), "structure", "title", *_long("start_page"), "node_id")


def toc_end_pages(spark, sf):
    last = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(12).alias("last_page")).distinct()
    return toc.end_pages(toc.assemble(_flat_toc(spark, sf)), last).select("document_id", *_long("toc_seq", "start_page", "end_page"))


def _numbered_toc(spark, sf):
    n, q = F.col("n"), F.col("q")
    return _lines(spark, sf).select(
        F.col("doc").alias("document_id"), n.alias("toc_seq"), F.when(n > 1, F.lit(1)).alias("parent_seq"), F.when(n > 1, 1).otherwise(0).alias("depth"),
        F.when(q % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" L"), n.cast("string"))).alias("title"),
        F.when(q % 5 == 0, 0).otherwise(n + q % 3).cast("int").alias("start_page"), F.when((n == 1) & (q % 2 == 0), 9).otherwise(0).alias("end_page"),
    )


def toc_ends(spark, sf):
    return pages.resolve_toc_ends(_numbered_toc(spark, sf)).select("document_id", *_long("toc_seq"), F.col("end").cast("long").alias("end_page"))


def toc_paths(spark, sf):
    return pages.toc_title_paths(_numbered_toc(spark, sf)).select("document_id", *_long("toc_seq"), F.array_join("title_path", "/").alias("path"))


# ---- pages --------------------------------------------------------------------------

def _cited(spark, sf):
    l = _lines(spark, sf).where("n <= 2")
    return l.select(F.col("doc").alias("document_id"), F.col("n").alias("query_id"), (F.col("part") % 4 + 1).cast("int").alias("start"), (F.col("part") % 4 + 2).cast("int").alias("end"))


def _sections(spark, sf):
    return _lines(spark, sf).select(F.col("doc").alias("document_id"), F.col("n").alias("id"), F.col("n").alias("preorder"), F.concat(F.lit("Line "), F.col("n").cast("string")).alias("title"), F.col("n").alias("page_start"), (F.col("n") + F.col("q") % 3).alias("page_end"), F.col("q").alias("qty"))


def citation_sources(spark, sf):
    """Queries with odd pages cite nothing and fall back to what they read."""
    read = _cited(spark, sf)
    return pages.citation_sources(read.where("start % 2 = 0"), read.withColumn("end", F.col("end") + 1), ["document_id", "query_id"]).select("document_id", *_long("query_id", "start", "end"))


def citations(spark, sf):
    s = _sections(spark, sf)
    paths = s.where("qty % 2 = 0").select("document_id", "id", F.array("title").alias("title_path"))
    out = pages.citations(_cited(spark, sf), s, paths, ["document_id", "query_id"])
    return out.select("document_id", *_long("query_id", "start", "end"), F.array_join(F.col("section_ids").cast("array<string>"), ",").alias("ids"), F.array_join("title_path", "/").alias("path"))


def indexed_pages(spark, sf):
    """Pages in their index tags, as many as fit."""
    p = _lines(spark, sf).select(F.col("doc").alias("document_id"), F.col("n").alias("page_number"), F.col("mode").alias("text"))
    return pages.indexed_text(p, 200)


def title_matches(spark, sf):
    p = _lines(spark, sf).select(F.col("doc").alias("document_id"), F.col("n").alias("page_number"), F.concat(F.lit("Page  about "), F.col("mode"), F.lit("\nmore")).alias("text"))
    nodes = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("toc_seq"), F.lit("about  rail").alias("title"), (F.col("o_custkey") % 3 + 1).cast("int").alias("start_page"))
    return pages.match_titles(p, nodes).select("document_id", *_long("start_page"))


# ---- rankings and responses -----------------------------------------------------------

def known_ids(spark, sf):
    e = _t(spark, sf, "events")
    picked = e.select((F.col("user_id") % 40).alias("query_id"), (F.col("event_id") % 6).alias("document_id"), F.col("event_id").alias("pos"), F.concat(F.lit("s"), (F.col("event_id") % 29).cast("string")).alias("id"))
    have = e.select((F.col("event_id") % 6).alias("document_id"), F.concat(F.lit("s"), (F.col("event_id") % 17).cast("string")).alias("id"))
    return ranking.known_ids(picked, have)


def kept_confidences(spark, sf):
    from foliant.plans.queries import _scores

    best = ranking.max_confidence(_scores(spark, sf), ["query_id"]).withColumn("confidence", ranking.clamp(F.col("confidence") * 3))
    m = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "confidence"))).alias("m"))
    wanted = F.array(*(F.concat(F.lit("click-"), F.lit(str(i))) for i in range(4)))
    kept = ranking.restrict_confidences(F.col("m"), wanted)
    return m.select("query_id", F.explode_outer(kept).alias("id", "confidence"))


def composite_ids(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderstatus")).alias("ids"))
    return o.select("o_custkey", F.array_join(ranking.composite_ids(F.col("o_custkey").cast("string"), F.col("ids")), ",").alias("ids"))


def usage_sum(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"), (F.col("event_id") + F.col("user_id")).alias("total_tokens"), (F.col("event_id") % 8 / 8).alias("cost_usd"), F.lit(1).alias("llm_calls"))
    out = ranking.add_usage(e, ["event_type"])
    return out.withColumn("hit_rate", F.round(ranking.hit_rate(F.col("llm_calls"), F.col("llm_calls") * 3), 3))


def fan_out(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.when((F.col("event_id") % 3 > 0) | (F.col("user_id") % 5 == 0), F.lit("boom")).alias("error"))
    return ranking.fan_out(e, ["query_id"])


def trimmed_lists(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.array(F.concat(F.lit("  "), F.col("c_name")), F.lit(" \t"), F.col("c_mktsegment"), F.lit("z ")).alias("v"))
    return c.select("c_custkey", F.array_join(ranking.trimmed(F.col("v"), 2), ",").alias("kept"))


def response_rows(spark, sf):
    """A response object without its zero and empty values."""
    n = _t(spark, sf, "customer")
    return n.select("c_custkey", catalog.response_json(id=F.col("c_custkey"), size=F.col("c_custkey") % 3, title=F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit(""))).alias("json"))


def first_of_each(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return catalog.first_k(o, ["o_custkey"], "o_orderkey", 3)


def missing_summaries(spark, sf):
    s = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("summary"))
    return catalog.without_summary(s).select("c_custkey")


def patch_summaries(spark, sf):
    """Summary columns are replaced where a change has a value."""
    s = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("summary"), F.col("c_mktsegment").alias("candidate_questions"))
    changes = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.count("*") > 10, F.max("o_orderpriority")).alias("summary"), F.min("o_orderstatus").alias("candidate_questions"))
    return catalog.patch(s, changes)


def ingest_into_existing(spark, sf):
    """Rows whose tenant and key the table holds already are left out."""
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("org_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("idempotency_key"), F.col("ts").alias("created_at"))
    return catalog.dedupe_ingest(e.where("id % 2 = 0"), e.where("id % 2 = 1")).select("id", "org_id", "idempotency_key")


# ---- trees ----------------------------------------------------------------------------

def tree_totals(spark, sf):
    from foliant.plans.queries import geo_tree

    rows = geo_tree(spark, sf).withColumn("page_start", F.col("token_count") % 2).withColumn("page_end", F.lit(0))
    return tree.totals(rows)


def merged_chains(spark, sf):
    """Customers with one order are merged with it."""
    from foliant.plans.queries import geo_tree

    v = tree.view(geo_tree(spark, sf, True))
    return tree.merge_single_children(v).select("document_id", "id", "parent_id", "title", *_long("token_count", "ordinal", "depth"))


def compact_depth(spark, sf):
    """Nothing below nations; they take the tokens of what lay there."""
    from foliant.plans.queries import geo_tree

    v = tree.view(geo_tree(spark, sf)).withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0)).withColumn("summary_axes", F.lit("")).withColumn("candidate_questions", F.lit(""))
    return tree.compact(v, 50, 2).select("document_id", "id", *_long("token_count"))


# ---- rows of extracted pages -------------------------------------------------------------

def _page_rows(spark, sf):
    """Lines as page rows: line 1 in large type, some bold, all with sizes of half points."""
    n, q = F.col("n"), F.col("q")
    size = F.when(n == 1, 20.2).when(q % 9 == 0, 15.0).otherwise(10.1).cast("double")
    said = F.when(q % 4 == 0, F.concat(F.lit("2.1 "), F.col("mode"))).otherwise(F.concat(F.col("mode"), F.lit(" "), F.col("flag")))
    return _lines(spark, sf).select((F.col("doc") % 200).cast("string").alias("document_id"), F.col("doc").cast("int").alias("page"), n.alias("row"), F.lit(0.0).alias("y"), size.alias("size"), (q % 6 == 0).alias("bold"), said.alias("text"))


def heading_levels(spark, sf):
    out = pdf_rows.heading_levels(_page_rows(spark, sf))
    return out.select("document_id", *_long("page", "row", "level"))


def page_parts(spark, sf):
    """Rows with levels to flat parts."""
    rows = _page_rows(spark, sf).withColumn("level", F.when(F.col("size") > 18, 1).otherwise(0))
    out = pdf_rows.parts_from_rows(rows)
    return out.select("document_id", *_long("seq", "level"), "title", F.md5("content").alias("content_md5"), *_long("page_start", "page_end"))


def usable_pages(spark, sf):
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 15).cast("string").alias("document_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", "(.)", "$1$1")).alias("text"))
    return pdf_rows.usable_documents(p)


def font_marks(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", _pick(["Arial-BoldMT", "Times", "Foo-Bd", "X,Bd", "bolt"], F.col("p_partkey")).alias("font"))
    return p.select("p_partkey", pdf_rows.is_bold(F.col("font")).alias("bold"), pdf_rows.round_size(F.col("p_partkey") % 97 / 7).alias("size"))


# ---- jobs, events, replay ------------------------------------------------------------------

def job_states(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.lit("boom")).alias("error"), _pick(["transient", "permanent"], F.col("user_id")).alias("error_kind"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), F.col("ts").alias("run_at"))
    done = e.withColumn("state", jobs.next_state(F.col("error"), F.col("error_kind"), F.col("attempt"), F.col("max_attempts")))
    later = jobs.retries(done).select("event_id", F.unix_timestamp("run_at").alias("retry_at"), F.col("attempt").cast("long").alias("next_attempt"))
    return done.select("event_id", "state").join(later, "event_id", "left")


def selection_events(spark, sf):
    """Event rows of a chunked selection and their text on the wire."""
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("query_id"), F.lit("d").alias("document_id"), (F.col("event_id") % 2).cast("int").alias("slice_no"), F.col("event_id").cast("int").alias("pos"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"))
    out = jobs.server_sent(jobs.selection_events(e, e.select("query_id", "document_id", "slice_no")))
    return out.select("query_id", *_long("seq"), "event", "text")


def live_cache(spark, sf):
    """What lives after expiry, the most recently used of it."""
    e = _t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("used_at"))
    now = e.agg(F.max("used_at")).first()[0]
    return jobs.live_entries(e, F.lit(now), 3 * 86_400, 25).select("key")


def replayed(spark, sf):
    """Stored responses by token: known, unknown, and of another query."""
    o = _t(spark, sf, "orders")
    stored = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("token"), F.lit("d").alias("document_id"), F.col("o_orderpriority").alias("query"), F.col("o_orderkey").cast("string").alias("response"), F.timestamp_seconds("o_orderkey").alias("created_at"))
    asked = o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("token"), F.lit("d").alias("document_id"), F.col("o_orderpriority").alias("query"), "o_orderkey")
    top = o.agg(F.max("o_orderkey")).first()[0]
    out = replay(asked.drop("o_orderkey").distinct(), stored, F.timestamp_seconds(F.lit(top)), max(top // 2, 1))
    return out.select("token", "query", F.col("status").cast("long").alias("status"), "response")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        content_types, page_table_grids, clean_texts, page_tokens, keys_and_ids,
        selection_replies, section_actions, page_actions, rerank_replies, plan_replies, axes_replies, toc_replies,
        toc_assemble, toc_end_pages, toc_ends, toc_paths, citation_sources, citations, indexed_pages, title_matches,
        known_ids, kept_confidences, composite_ids, usage_sum, fan_out, trimmed_lists, response_rows, first_of_each, missing_summaries, patch_summaries, ingest_into_existing,
        tree_totals, merged_chains, compact_depth, heading_levels, page_parts, usable_pages, font_marks,
        job_states, selection_events, live_cache, replayed,
    )
}
