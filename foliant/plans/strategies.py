"""Retrieval strategies over a whole corpus of trees at once.

A query table (query_id, document_id, query) meets viewed sections; each
strategy returns (query_id, document_id, pos, id, confidence).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliant.functions import replies
from foliant.functions.replies import read_column
from foliant.operators import ranking, tree
from foliant.plans import prompts
from foliant.plans.budget import Budget, split
from foliant.plans.clients import Client, caller

KEY = ["query_id", "document_id"]
_SELECTION = "struct<ids:array<string>,confidences:map<string,double>>"


def _optional(viewed: DataFrame) -> DataFrame:
    for name, kind in (("summary", "string"), ("candidate_questions", "array<string>"), ("entities", "array<string>"), ("numbers", "array<string>")):
        if name not in viewed.columns:
            viewed = viewed.withColumn(name, F.lit(None).cast(kind))
    return viewed


def _picks(asked: DataFrame, client: Client, by: list[str]) -> DataFrame:
    call, read = caller(client, replies.selection), read_column(replies.selection, _SELECTION)
    said = asked.withColumn("said", call("prompt")).withColumn("sel", read(F.col("said.reply")))
    rows = said.select(*by, F.posexplode("sel.ids").alias("pos", "id"), F.col("sel.confidences").alias("c"))
    return rows.select(*by, "pos", "id", F.try_element_at("c", F.col("id")).alias("confidence"))


def single_pass(queries: DataFrame, viewed: DataFrame, docs: DataFrame, client: Client) -> DataFrame:
    """One prompt with the whole outline of each document."""
    lines = _optional(viewed).withColumn("line", prompts.outline_line())
    whole = prompts.outlines(lines, ["document_id"])
    titled = whole.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id")
    asked = queries.join(titled, "document_id")
    asked = asked.withColumn("prompt", prompts.selection_prompt(F.concat(F.lit("Document: "), "title"), F.col("outline"), F.lit(""), F.col("query")))
    found = _picks(asked, client, KEY)
    kept = ranking.known_ids(found, viewed, KEY)
    return kept.join(found.groupBy(*KEY, "id").agg(F.max("confidence").alias("confidence")), [*KEY, "id"]).select(*KEY, "pos", "id", "confidence")


def chunked_tree(queries: DataFrame, viewed: DataFrame, docs: DataFrame, client: Client, budget: Budget) -> DataFrame:
    """A prompt for each slice; ids unknown to a slice go, the rest unite sorted."""
    slices = split(viewed, docs, budget)
    rows = slices.select("document_id", "slice_no", "breadcrumb", "pos", "id", F.col("view_depth").alias("d")).join(_optional(viewed).drop("view_depth"), ["document_id", "id"])
    lines = rows.withColumn("line", prompts.outline_line({"view_depth": F.col("d")}))
    outline = prompts.outlines(lines, ["document_id", "slice_no", "breadcrumb"], "pos")
    asked = queries.join(outline, "document_id")
    asked = asked.withColumn("prompt", prompts.selection_prompt(F.col("breadcrumb"), F.col("outline"), F.lit(""), F.col("query")))
    found = _picks(asked, client, [*KEY, "slice_no"])
    known = found.join(slices.select("document_id", "slice_no", "id"), ["document_id", "slice_no", "id"], "left_semi")
    merged = known.groupBy(*KEY, "id").agg(F.max("confidence").alias("confidence"))
    return merged.withColumn("pos", F.row_number().over(W.Window.partitionBy(*KEY).orderBy("id")) - 1).select(*KEY, "pos", "id", "confidence")


def auto_choice(viewed: DataFrame, threshold: int) -> DataFrame:
    """(document_id, large): documents with pages and many leaf tokens go to the page agent."""
    rows = tree.totals(viewed).join(tree.leaf_tokens(viewed), "document_id")
    return rows.select("document_id", (F.col("has_pages") & (F.col("leaf_tokens") > threshold)).alias("large"))


def auto(queries: DataFrame, viewed: DataFrame, small: Callable[[DataFrame, DataFrame], DataFrame], large: Callable[[DataFrame, DataFrame], DataFrame] | None, threshold: int = 60_000) -> DataFrame:
    """Small documents by one strategy and large ones by the other."""
    if large is None:
        return small(queries, viewed)
    choice = auto_choice(viewed, threshold)
    parts = []
    for is_large, run in ((False, small), (True, large)):
        docs = choice.where(F.col("large") == is_large).select("document_id")
        parts.append(run(queries.join(docs, "document_id", "left_semi"), viewed.join(docs, "document_id", "left_semi")))
    return parts[0].unionByName(parts[1])


def decomposed(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Queries with sub_questions run once for each; results unite in order of first sight."""
    subs = queries.select(*KEY, F.posexplode("sub_questions").alias("sub_no", "query"))
    named = subs.withColumn("whole", F.col("query_id")).withColumn("query_id", F.concat_ws("#", "query_id", "sub_no"))
    found = run(named.select(*KEY, "query")).join(named.select("query_id", "document_id", "whole", "sub_no"), KEY)
    found = found.drop("query_id").withColumnRenamed("whole", "query_id")
    ranked = ranking.ordered_union(found, KEY)
    best = found.groupBy(*KEY, "id").agg(F.max("confidence").alias("confidence"))
    return ranked.join(best, [*KEY, "id"]).select(*KEY, (F.col("rank") - 1).alias("pos"), "id", "confidence")


@dataclass
class Walk:
    """What a navigation of one document led to."""

    answer: str = ""
    confidence: float = 0.0
    cited: list[tuple[int, int]] = field(default_factory=list)
    read: list[tuple[int, int]] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    hops: int = 0
    events: list[str] = field(default_factory=list)


def _page_walk(g: pd.DataFrame, query: str, client: Client, hops: int, limit: int) -> Walk:
    rows = g.sort_values("preorder")
    paged = rows[(rows["page_start"] > 0) & (rows["page_end"] > 0)].sort_values(["page_start", "page_end"], kind="stable")
    last = int(paged["page_end"].max()) if len(paged) else 0
    structure = json.dumps([{"id": r.id, "title": r.title, "depth": int(r.view_depth), "start_page": int(r.page_start or 0), "end_page": int(r.page_end or 0)} for r in rows.itertuples() if r.id])

    def pages(start: int, end: int) -> str:
        out, room = [], limit
        for r in paged.itertuples():
            if r.page_start <= end and start <= r.page_end and room >= 0:
                piece = f"## {r.title} (pages {r.page_start}-{r.page_end})\n{r.content or ''}\n".encode()[: max(room, 0)]
                room -= len(piece)
                out.append(piece.decode("utf-8", "ignore"))
                if room <= 0:
                    break
        return "".join(out)

    walk, note = Walk(), f"The document has {last} pages.\n" if last else ""
    talk = f"{note}Tools: get_document_structure, get_pages(start_page, end_page), done(answer, cited_pages, confidence).\nQuestion: {query}\n"

    def finish(a: dict) -> Walk:
        walk.answer, walk.confidence, walk.cited = a["answer"], a["confidence"], a["cited"]
        return walk

    while walk.hops < hops:
        walk.hops += 1
        a = replies.page_action(client(talk))
        if a is None:
            talk += "\nReply with one JSON tool call.\n"
            continue
        walk.events.append(a["action"])
        if a["action"] == "done":
            return finish(a)
        if a["action"] == "get_document_structure":
            talk += f"\nStructure: {structure}\n"
        elif a["action"] == "get_pages":
            start, end = max(min(a["start"], a["end"]), 1), max(a["start"], a["end"])
            end = min(end, last) if last else end
            if max(a["start"], a["end"]) <= 0 or (last and start > last):
                talk += "\nNo such pages.\n"
            else:
                walk.read.append((start, end))
                talk += f"\nPages {start}-{end}:\n{pages(start, end)}\n"
        else:
            talk += f"\nUnknown tool {a['action']}.\n"
    walk.hops += 1
    a = replies.page_action(client(talk + "\nAnswer now with the tool done.\n"))
    return finish(a) if a and a["action"] == "done" else walk


def _section_walk(g: pd.DataFrame, query: str, client: Client, hops: int, limit: int) -> Walk:
    rows = {r.id: r for r in g.sort_values("preorder").itertuples()}
    line = lambda r: "  " * int(r.view_depth) + f"- [{r.id}] {r.title}"
    outline = lambda level: "\n".join(line(r) for r in rows.values() if r.view_depth <= level)
    walk, talk = Walk(), f"Outline:\n{outline(1)}\nActions: outline(level), expand(section_id), read(section_id), done(picks).\nQuestion: {query}\n"
    while walk.hops < hops:
        walk.hops += 1
        a = replies.section_action(client(talk))
        if a is None:
            talk += "\nReply with one JSON action.\n"
            continue
        walk.events.append(a["action"])
        if a["action"] == "done":
            walk.ids = list(dict.fromkeys(i for i in a["ids"] if i in rows))
            walk.confidence = max(a["confidences"].values(), default=0.0)
            return walk
        if a["action"] == "outline":
            talk += f"\nOutline:\n{outline(a['level'])}\n"
        elif a["id"] not in rows:
            talk += f"\nNo section {a['id']}.\n"
        elif a["action"] == "expand":
            talk += "\n".join(["", *(line(r) for r in rows.values() if r.parent_id == a["id"]), ""])
        else:
            talk += "\n" + (rows[a["id"]].content or "").encode()[:limit].decode("utf-8", "ignore") + "\n"
    return walk


_WALK = "query_id string, document_id string, answer string, confidence double, cited array<struct<start:int,end:int>>, read array<struct<start:int,end:int>>, ids array<string>, hops int, events array<string>"


def navigate(queries: DataFrame, viewed: DataFrame, client: Client, pages: bool = True, hops: int | None = None, limit: int = 16_000) -> DataFrame:
    """Agents: one grouped task for each (query, document).

    ``viewed`` has the column ``content``.  The page agent (8 steps, then one
    forced answer) cites page ranges; the section agent (6 steps) picks ids and
    selects nothing when its steps run out.
    """
    walk_one, hops = (_page_walk, hops or 8) if pages else (_section_walk, hops or 6)
    rows = queries.join(viewed.select("document_id", "id", "parent_id", "title", "view_depth", "preorder", F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"), "content"), "document_id")

    def each(g: pd.DataFrame) -> pd.DataFrame:
        w = walk_one(g, g["query"].iloc[0], client, hops, limit)
        spans = lambda rs: [{"start": a, "end": b} for a, b in rs]
        return pd.DataFrame([(g["query_id"].iloc[0], g["document_id"].iloc[0], w.answer, w.confidence, spans(w.cited), spans(w.read), w.ids, w.hops, w.events)], columns=["query_id", "document_id", "answer", "confidence", "cited", "read", "ids", "hops", "events"])

    return rows.groupBy(*KEY).applyInPandas(each, _WALK)


def cached(queries: DataFrame, stored: DataFrame, run: Callable[[DataFrame], DataFrame], strategy: str, model: str, ttl_seconds: int, now) -> tuple[DataFrame, DataFrame]:
    """(results, fresh): ids of unexpired entries come from ``stored(key, ids, at)``.

    A hit has ids only, without confidences.  ``fresh`` are rows to store.
    """
    from foliant.functions.hashing import cache_key

    keyed = queries.withColumn("key", cache_key(F.col("document_id"), F.col("query"), F.lit(strategy), F.lit(model)))
    live = stored.where(F.col("at") > F.lit(now) - F.expr(f"interval {int(ttl_seconds)} seconds")).groupBy("key").agg(F.max_by("ids", "at").alias("ids"))
    hits = keyed.join(live, "key").select(*KEY, F.posexplode("ids").alias("pos", "id"), F.lit(None).cast("double").alias("confidence"))
    missed = keyed.join(live, "key", "left_anti")
    found = run(missed.drop("key"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"])
    fresh = found.groupBy(*KEY).agg(ids.alias("ids")).join(missed.select(*KEY, "key"), KEY).select("key", "ids", F.lit(now).alias("at"))
    return hits.unionByName(found), fresh
