"""Prompt text as columns: one row for each section becomes one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import clip_bytes, nonblank, strip

ASK = 'Reply with one JSON object: {"picks": [{"id": "...", "confidence": 0.0}]}. Use only ids shown in brackets.'
AGAIN = "That was not the JSON object asked for. Reply with the object alone."


def question_hint(questions: Column) -> Column:
    """The first question that isn't blank, at most 120 bytes, cut at a word after 100."""
    first = F.get(F.filter(F.transform(questions, strip), lambda q: q != ""), F.lit(0))
    head = clip_bytes(first, 120)
    at_word = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    cut = F.when(F.octet_length(at_word) > 100, at_word).otherwise(head)
    return F.when(F.octet_length(first) > 120, F.concat(cut, F.lit("…"))).otherwise(first)


def outline_line(row: dict[str, Column] | None = None) -> Column:
    """``- [id] title — summary — entities: … — numbers: …`` and an ``answers:`` line."""
    c = {n: F.col(n) for n in ("id", "title", "summary", "view_depth", "candidate_questions", "entities", "numbers")} | (row or {})
    pad = F.repeat(F.lit("  "), c["view_depth"])
    some = lambda values: F.array_join(F.slice(F.filter(F.transform(values, strip), lambda x: x != ""), 1, 3), ", ")
    extra = lambda name, values: F.when(F.coalesce(some(values), F.lit("")) != "", F.concat(F.lit(f" — {name}: "), some(values))).otherwise(F.lit(""))
    said = F.when(F.coalesce(c["summary"], F.lit("")) != "", F.concat(F.lit(" — "), c["summary"])).otherwise(F.lit(""))
    line = F.concat(pad, F.lit("- ["), c["id"], F.lit("] "), c["title"], said, extra("entities", c["entities"]), extra("numbers", c["numbers"]), F.lit("\n"))
    hint = question_hint(c["candidate_questions"])
    return F.concat(line, F.when(F.coalesce(hint, F.lit("")) != "", F.concat(pad, F.lit("    answers: "), hint, F.lit("\n"))).otherwise(F.lit("")))


def outlines(lines: DataFrame, by: list[str], order: str = "preorder") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"])
    return lines.groupBy(*by).agg(F.array_join(parts, "").alias("outline"))


def selection_prompt(breadcrumb: Column, outline: Column, siblings: Column, query: Column) -> Column:
    beside = F.when(nonblank(siblings), F.concat(F.lit("\nNearby sections, for context only:\n"), siblings)).otherwise(F.lit(""))
    return F.concat(breadcrumb, F.lit("\n\nSections:\n"), outline, beside, F.lit("\nQuestion: "), query, F.lit("\n\n"), F.lit(ASK))


def profile_note(profile: Column) -> Column:
    p = F.lower(strip(F.coalesce(profile, F.lit(""))))
    return F.when(p == "research", "The document is a research paper.").when(p == "medical", "The document is a medical text.").otherwise("The document is of a general kind.")
