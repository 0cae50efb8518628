"""The engine: documents in, trees kept as tables, questions answered over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import hashing, replies
from foliant.functions.replies import read_column
from foliant.functions.text import clip_bytes, fallback_summary, is_mojibake_title, nonblank
from foliant.operators import catalog, chunking, pages, ranking, tree
from foliant.operators.replay import replay as replay_rows
from foliant.plans import strategies
from foliant.plans.budget import Budget
from foliant.plans.clients import Client, Lexical, NoModel, caller
from foliant.plans.full_ingest import enrich
from foliant.plans.store import Store
from foliant.sources.formats import parse_parts


@dataclass
class Options:
    strategy: str = "auto"
    model: str = "none"
    version: str = "1"
    budget: Budget = field(default_factory=Budget)
    threshold: int = 60_000
    max_sections: int = 0
    answer_sections: int = 5
    most_leaves: int = chunking.MOST_LEAVES
    planning: bool = False
    decompose: bool = True
    rerank: bool = False
    rerank_top: int = 0
    rerank_bytes: int = 2_000
    abstain: bool = True
    abstain_below: float = 0.4
    hops: int = 8
    page_bytes: int = 16_000
    cited_ranges: int = 3
    span_bytes: int = 400


#: Names a caller may ask for.
STRATEGIES = ("auto", "single-pass", "chunked-tree", "treewalk", "agentic")


class Engine:
    """Corpus-at-once: every method takes and returns DataFrames."""

    def __init__(self, spark: SparkSession, client: Client | None = None, options: Options | None = None):
        self.spark, self.client, self.options = spark, client or Lexical(), options or Options()
        if self.options.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.options.strategy}")

    # ---- ingest ------------------------------------------------------------------

    def ingest(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, sections, bodies) of files (document_id, org_id, store_id, filename, content_type, content).

        Minimal mode: no model is called.  Unreadable files become documents
        with status ``failed``.  Long leaves of documents with pages are cut
        into chunks before leaves are capped.
        """
        parts = parse_parts(files.select("document_id", "content_type", "filename", "content"))
        good = parts.where("error is null")
        flat = tree.parents_by_level(tree.with_preamble(good.select("document_id", "seq", "level", "title", "content", "page_start", "page_end", F.coalesce(F.element_at("metadata", "table") == "true", F.lit(False)).alias("is_table"))))
        flat = flat.select("document_id", "seq", "parent_seq", "level", "title", "content", "page_start", "page_end", "is_table")
        paged = F.coalesce(F.col("page_start"), F.lit(0)) > 0
        nodes = chunking.chunk_leaves(flat.where(paged)).unionByName(flat.where(~paged).select(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in chunking.NODES.split(", ")))))
        nodes = chunking.cap_leaves(nodes, self.options.most_leaves)
        sections, bodies = tree.persist_tree(nodes)
        outcome = parts.groupBy("document_id").agg(F.max("doc_title").alias("t"), F.max("error").alias("error_message"))
        title = F.when(nonblank(F.col("t")) & ~is_mojibake_title(F.col("t")), F.col("t")).otherwise(F.col("filename"))
        docs = files.join(outcome, "document_id", "left").select(
            F.col("document_id").alias("id"), "org_id", "store_id", title.alias("title"), "content_type",
            F.when(F.col("error_message").isNull(), "ready").otherwise("failed").alias("status"), F.coalesce("error_message", F.lit("")).alias("error_message"),
            F.octet_length("content").cast("long").alias("byte_size"),
        )
        return docs, sections, bodies

    def ingest_full(self, files: DataFrame, axes: bool = False, questions: bool = False, contents: bool = False, profile: str = "", store: Store | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        """(documents, sections, bodies, contents): ``ingest`` and what the model adds.

        Sections get summaries, and on request axes and candidate questions;
        ``contents`` makes a table of contents for documents with pages.  With
        a store, the outcome is written there as one batch.
        """
        docs, sections, bodies = self.ingest(files)
        sections, nodes = enrich(self, sections, bodies, axes, questions, contents, profile)
        if store is not None:
            store.save(documents=docs, sections=sections, bodies=bodies)
        return docs, sections, bodies, nodes

    def view(self, sections: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
        viewed = tree.view(sections)
        if "summary" not in viewed.columns:
            viewed = viewed.withColumn("summary", F.lit(""))
        if bodies is not None:
            viewed = viewed.join(bodies.select("document_id", F.col("section_id").alias("id"), "content"), ["document_id", "id"], "left")
        return viewed

    def summarise(self, viewed: DataFrame) -> DataFrame:
        """Summaries bottom up by the model; a failed call falls back to the text's head."""
        call = caller(self.client)

        def said(prompt):
            reply = call(prompt)
            return F.coalesce(F.when(nonblank(reply["reply"]), F.trim(reply["reply"])), fallback_summary(F.lit(""), prompt))

        return tree.summarise(viewed, said)

    def questions(self, viewed: DataFrame, n: int = 5) -> DataFrame:
        """Candidate questions of leaves that have none yet: (document_id, id, candidate_questions)."""
        leaves = tree.leaves(viewed)
        if "candidate_questions" in leaves.columns:
            leaves = leaves.where("candidate_questions is null")
        read = read_column(lambda r: replies.questions(r, n), "array<string>")
        prompt = F.concat(F.lit(f"Write {n} questions this text answers as JSON {{\"questions\": [...]}}.\n"), "title", F.lit("\n"), clip_bytes(F.coalesce("content", F.lit("")), 4000))
        return leaves.select("document_id", "id", F.coalesce(read(caller(self.client, replies.questions)(prompt)["reply"]), F.array().cast("array<string>")).alias("candidate_questions"))

    # ---- queries -----------------------------------------------------------------

    def plan(self, queries: DataFrame) -> DataFrame:
        read = read_column(replies.plan, "struct<intent:string,entities:array<string>,expected_doc_areas:array<string>,is_multi_hop:boolean,sub_questions:array<string>>")
        prompt = F.concat(F.lit("Plan how to answer as JSON with intent, entities, expected_doc_areas, is_multi_hop, sub_questions.\nQuestion: "), "query")
        return queries.withColumn("plan", read(caller(self.client, replies.plan)(prompt)["reply"]))

    def select(self, queries: DataFrame, viewed: DataFrame, docs: DataFrame) -> DataFrame:
        """(query_id, document_id, pos, id, confidence) by the configured strategy."""
        o = self.options
        small = lambda q, v=viewed: strategies.single_pass(q, v, docs, self.client)
        chunked = lambda q, v=viewed: strategies.chunked_tree(q, v, docs, self.client, o.budget)

        def agent(q: DataFrame, v: DataFrame = viewed, by_pages: bool = True) -> DataFrame:
            walks = strategies.navigate(q, v, self.client, by_pages, o.hops if by_pages else None, o.page_bytes)
            if not by_pages:
                return walks.select("query_id", "document_id", F.posexplode("ids").alias("pos", "id"), F.nullif("confidence", F.lit(0.0)).alias("confidence"))
            cited = self.cited(walks, v).join(walks.select(*strategies.KEY, F.nullif("confidence", F.lit(0.0)).alias("confidence")), strategies.KEY)
            met = cited.join(v.select("document_id", "id", "page_start", "page_end", "preorder"), "document_id").where(pages.overlaps(F.col("page_start"), F.col("page_end"), F.col("start"), F.col("end")))
            from pyspark.sql import window as W

            met = met.groupBy(*strategies.KEY, "id", "confidence").agg(F.min(F.struct("page_start", "page_end", "preorder")).alias("o"))
            return met.withColumn("pos", F.row_number().over(W.Window.partitionBy(*strategies.KEY).orderBy("o")) - 1).select(*strategies.KEY, "pos", "id", "confidence")

        by_name = {
            "single-pass": small, "chunked-tree": chunked, "treewalk": agent, "agentic": lambda q: agent(q, by_pages=False),
            "auto": lambda q: strategies.auto(q, viewed, lambda a, v: chunked(a, v), (lambda a, v: agent(a, v)) if "content" in viewed.columns else None, o.threshold),
        }
        run = by_name[o.strategy]
        if not (o.planning and o.decompose):
            return run(queries)
        planned = self.plan(queries)
        multi = planned.where("plan.is_multi_hop").select(*queries.columns, F.col("plan.sub_questions").alias("sub_questions"))
        single = planned.where("plan is null or not plan.is_multi_hop").select(*queries.columns)
        return run(single).unionByName(strategies.decomposed(multi, run))

    def query_many(self, queries: DataFrame, viewed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results, outcomes) of queries over several documents each.

        A document that has no tree gets an error row instead of a result and
        does not stop the others.  ``outcomes`` has, for each query, documents,
        succeeded, failed (all of them) and the composite section ids.
        """
        have = viewed.select("document_id").distinct()
        results = self.query(queries.join(have, "document_id", "left_semi"), viewed, docs)
        lost = queries.join(have, "document_id", "left_anti").select(*strategies.KEY, F.lit("document not found").alias("error"))
        every = results.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)
        ids = ranking.composite_ids(F.col("document_id"), F.coalesce("section_ids", F.array().cast("array<string>")))
        named = every.select("query_id", F.explode(ids).alias("id")).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("section_ids"))
        return every, ranking.fan_out(every, ["query_id"]).join(named, "query_id", "left")

    def with_options(self, **overrides) -> Engine:
        """The same engine with other options for one request; None leaves an option as it is."""
        return Engine(self.spark, self.client, replace(self.options, **{k: v for k, v in overrides.items() if v is not None}))

    def query_cached(self, queries: DataFrame, stored: DataFrame, viewed: DataFrame, docs: DataFrame, ttl_seconds: int, now) -> tuple[DataFrame, DataFrame]:
        """(selection, entries to store): unexpired entries of ``stored(key, ids, at)`` are not asked for again."""
        o = self.options
        return strategies.cached(queries, stored, lambda q: self.select(q, viewed, docs), o.strategy, o.model, ttl_seconds, now)

    def query(self, queries: DataFrame, viewed: DataFrame, docs: DataFrame) -> DataFrame:
        """Select, abstain, limit, re-rank; one row for each (query, document) with its token."""
        o = self.options
        found = self.select(queries, viewed, docs)
        if o.abstain:
            weak = ranking.abstains(found, strategies.KEY, o.abstain_below).where("abstain").select(*strategies.KEY)
        else:
            weak = queries.select(*strategies.KEY).limit(0)
        kept = catalog.first_k(found.join(weak, strategies.KEY, "left_anti"), strategies.KEY, "pos", o.max_sections)
        if o.rerank and "content" in viewed.columns:
            kept = self.rerank(queries, kept, viewed)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"])
        rows = kept.groupBy(*strategies.KEY).agg(ids.alias("section_ids"), F.max("confidence").alias("confidence"))
        out = queries.join(rows, strategies.KEY, "left").join(weak.withColumn("abstained", F.lit(True)), strategies.KEY, "left")
        out = out.withColumn("abstained", F.coalesce("abstained", F.lit(False))).withColumn("section_ids", F.coalesce("section_ids", F.array().cast("array<string>")))
        token = hashing.trace_token(F.col("document_id"), F.lit(o.version), F.lit(o.model), F.col("section_ids"))
        return out.withColumn("trace_token", F.when(~F.col("abstained"), token))

    def rerank(self, queries: DataFrame, picked: DataFrame, viewed: DataFrame) -> DataFrame:
        """New order by scores over excerpts; a failed call keeps the old one."""
        o = self.options
        body = picked.join(viewed.select("document_id", "id", "title", "content"), ["document_id", "id"])
        line = F.concat(F.lit("["), "id", F.lit("] "), "title", F.lit("\n"), clip_bytes(F.coalesce("content", F.lit("")), o.rerank_bytes))
        shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n\n")
        asked = body.groupBy(*strategies.KEY).agg(shown.alias("shown")).join(queries.select(*strategies.KEY, "query"), strategies.KEY)
        prompt = F.concat(F.lit('Score each section from 0 to 1 as JSON {"scores": [{"id": "...", "score": 0.0}]}.\n'), "shown", F.lit("\nQuestion: "), "query")
        read = read_column(lambda r: None if (s := replies.scores(r)) is None else [{"id": i, "score": v} for i, v, _ in s], "array<struct<id:string,score:double>>")
        scored = asked.select(*strategies.KEY, F.posexplode(read(caller(self.client, replies.scores)(prompt)["reply"])).alias("seq", "s")).select(*strategies.KEY, "seq", "s.id", "s.score")
        merged = ranking.merge_scores(picked, scored, strategies.KEY, o.rerank_top)
        return merged.select(*strategies.KEY, (F.col("rank") - 1).alias("pos"), "id", "confidence")

    def spans(self, queries: DataFrame, picked: DataFrame, bodies: DataFrame) -> DataFrame:
        """A quote of each picked section that answers the query, with its byte range."""
        limit = self.options.span_bytes
        rows = picked.join(queries.select(*strategies.KEY, "query"), strategies.KEY).join(bodies.select("document_id", F.col("section_id").alias("id"), "content"), ["document_id", "id"])
        prompt = F.concat(F.lit('Quote the passage that answers as JSON {"quote": "..."}.\n'), "content", F.lit("\nQuestion: "), "query")
        said = rows.withColumn("reply", caller(self.client)(prompt)["reply"])

        @F.pandas_udf("start int, end int, text string")
        def place(bodies: pd.Series, answers: pd.Series) -> pd.DataFrame:
            found = [(None, None, None) if not (q := replies.quote(a, limit)) else (*replies.locate(b, q), q) for b, a in zip(bodies, answers, strict=True)]
            return pd.DataFrame(found, columns=["start", "end", "text"]).astype({"start": "Int32", "end": "Int32"})

        return said.select(*strategies.KEY, "id", place("content", "reply").alias("span"))

    def answer(self, queries: DataFrame, viewed: DataFrame, docs: DataFrame, bodies: DataFrame) -> DataFrame:
        """Answers written from the best sections' text."""
        o = self.options
        found = self.query(queries, viewed, docs)
        rows = found.select(*strategies.KEY, F.posexplode(F.slice("section_ids", 1, o.answer_sections)).alias("pos", "id"))
        rows = rows.join(bodies.select("document_id", F.col("section_id").alias("id"), "content"), ["document_id", "id"])
        block = F.concat(F.lit("["), "id", F.lit("]\n"), clip_bytes(F.col("content"), 4000))
        shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda s: s["b"]), "\n\n")
        asked = rows.groupBy(*strategies.KEY).agg(shown.alias("shown")).join(queries.select(*strategies.KEY, "query"), strategies.KEY)
        prompt = F.concat(F.lit("Answer from the evidence alone.\n"), "shown", F.lit("\nQuestion: "), "query")
        said = asked.select(*strategies.KEY, caller(self.client)(prompt)["reply"].alias("answer"))
        return found.join(said, strategies.KEY, "left")

    def cited(self, walks: DataFrame, viewed: DataFrame) -> DataFrame:
        """(query_id, document_id, start, end) a page agent cites, or the pages it read."""
        last = viewed.groupBy("document_id").agg(F.coalesce(F.max("page_end"), F.lit(0)).alias("last_page"))
        rows = walks.select(*strategies.KEY, "confidence", F.posexplode("cited").alias("pos", "r")).join(last, "document_id")
        best = pages.select_cited(rows.select(*strategies.KEY, "pos", "r.start", "r.end", "confidence", "last_page"), strategies.KEY, self.options.cited_ranges)
        read = walks.select(*strategies.KEY, F.explode("read").alias("r")).select(*strategies.KEY, "r.start", "r.end")
        return pages.citation_sources(best, read, strategies.KEY)

    def answer_by_pages(self, queries: DataFrame, viewed: DataFrame, toc: DataFrame | None = None) -> DataFrame:
        """Page agent's answers with citations (ranges, section ids, title paths) and trace tokens."""
        walks = strategies.navigate(queries, viewed, self.client, True, self.options.hops, self.options.page_bytes)
        paths = pages.heading_paths(viewed, toc) if toc is not None else viewed.select("document_id", "id", F.array().cast("array<string>").alias("title_path")).limit(0)
        cites = pages.citations(self.cited(walks, viewed), viewed, paths, strategies.KEY)
        listed = cites.groupBy(*strategies.KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "section_ids", "title_path"))).alias("citations"))
        out = walks.select(*strategies.KEY, "answer", "confidence", "hops", "events").join(listed, strategies.KEY, "left")
        token = hashing.page_trace_token(F.col("document_id"), F.lit(self.options.model), F.col("citations"))
        return out.withColumn("trace_token", F.when(F.col("citations").isNotNull(), token))

    def llms_txt(self, viewed: DataFrame, docs: DataFrame) -> DataFrame:
        return tree.llms_txt(viewed, docs)

    def replay(self, requests: DataFrame, stored: DataFrame, now, ttl_seconds: int = 86_400) -> DataFrame:
        return replay_rows(requests, stored, now, ttl_seconds)


def without_model(spark: SparkSession, options: Options | None = None) -> Engine:
    """An engine whose model calls fail and fall back."""
    return Engine(spark, NoModel(), options)
