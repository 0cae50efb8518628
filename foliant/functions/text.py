"""String expressions.  Lengths that matter are UTF-8 bytes, and white space is
Unicode white space; both differ from Spark's plain ``length`` and ``trim``."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^\s+|\s+$"
_SPACE = r"(?U)\s+"

#: Phrases that mark a row as a licence or publisher stamp.
BOILERPLATE_SIGNATURES = (
    "hereby grants permission",
    "provided proper attribution is provided",
    "solely for use in journalistic",
    "all rights reserved",
    "is licensed under a creative commons",
    "licensed under cc by",
    "this work is licensed under",
    "permission to make digital or hard copies",
    "copyright held by the owner",
    "preprint. under review",
    "preprint submitted to",
)
#: Tails of such phrases, which count in rows of at most four words.
BOILERPLATE_FRAGMENTS = ("scholarly works", "journalistic or", "or scholarly")
#: Fixed value: numbered and labelled headings of plain text.
LABELLED_HEADING = r"(?i)^(\d+(\.\d+)*\.?\s+\S|(chapter|section|part|appendix|article)\s+([0-9]+|[ivxlcdm]+|[a-z])\b)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def fields(c: Column) -> Column:
    """Words between runs of white space, without empty ones."""
    return F.filter(F.split(c, _SPACE), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.array_join(fields(c), " ")


def nonblank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def clip_bytes(c: Column, limit: int | Column) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends with a whole character."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = c.cast("binary")
    # A character spans four bytes at most, so one of four cuts ends on an edge.
    cut = lambda back: F.substring(raw, F.lit(1), F.greatest(limit - back, F.lit(0)))
    clean = lambda b: F.is_valid_utf8(b.cast("string"))
    out = cut(3)
    for back in (2, 1, 0):
        out = F.when(clean(cut(back)), cut(back)).otherwise(out)
    return F.when(F.octet_length(c) <= limit, c).otherwise(out.cast("string"))


def approx_tokens(c: Column) -> Column:
    """The larger of 13/10 of the words and a quarter of the bytes, at least 1; 0 for ''."""
    words = F.size(fields(c))
    guess = F.greatest(F.floor(words * 13 / 10), F.floor(F.octet_length(c) / 4), F.lit(1))
    return F.when(c == "", F.lit(0)).otherwise(guess).cast("int")


def clean_for_model(c: Column) -> Column:
    """Control characters but tab, LF and CR go."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


codecs.register_error("foliant-byte", lambda e: ("\ufffd", e.start + 1))


def decode_lossy(raw: bytes | None) -> str | None:
    """Decode bytes; each byte that is no UTF-8 becomes one replacement character."""
    return None if raw is None else bytes(raw).decode("utf-8", "foliant-byte")


def doubled_share(c: Column) -> tuple[Column, Column]:
    """Counts of ASCII letters and digits, and of those that repeat their neighbour."""
    letters = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]", " ")
    n = F.length(F.replace(letters, F.lit(" "), F.lit("")))
    at = F.sequence(F.lit(1), F.greatest(F.length(letters) - 1, F.lit(1)))
    char = lambda i: F.substring(letters, i, F.lit(1))
    pairs = F.size(F.filter(at, lambda i: (char(i) == char(i + 1)) & (char(i) != " ")))
    return n, F.when(F.length(letters) > 1, pairs).otherwise(F.lit(0))


def is_mojibake_title(c: Column) -> Column:
    """Too few letters, or more than 30 % of them doubled as by overlaid glyphs."""
    n, doubled = doubled_share(c)
    return (n < 4) | (F.floor(doubled * 100 / n) > 30)


def fallback_summary(title: Column, body: Column) -> Column:
    head = F.when(F.octet_length(body) > 240, F.concat(clip_bytes(body, 240), F.lit("…"))).otherwise(body)
    return F.when(nonblank(body), squeeze(head)).otherwise(title)


def clean_paragraphs(c: Column) -> Column:
    """Squeeze each paragraph; drop empty ones."""
    paragraphs = F.transform(F.split(c, "\n\n"), squeeze)
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def first_line(c: Column) -> Column:
    """First line that is not blank, stripped."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def normalised_title(c: Column) -> Column:
    return F.lower(squeeze(c))


def is_text_heading(line: Column) -> Column:
    """A short numbered, labelled or all-capitals line."""
    t = strip(line)
    letters = F.regexp_replace(t, r"\P{L}", "")
    capitals = (F.length(letters) >= 2) & (F.regexp_replace(letters, r"\p{Lu}", "") == "") & ~t.endswith(".")
    short = (t != "") & (F.octet_length(t) <= 80) & ~t.endswith(",") & ~t.endswith(";")
    return short & (t.rlike(LABELLED_HEADING) | capitals)


def is_boilerplate(line: Column) -> Column:
    low = F.lower(strip(line))
    hit = F.lit(False)
    for s in BOILERPLATE_SIGNATURES:
        hit = hit | low.contains(s)
    short = F.lit(False)
    for s in BOILERPLATE_FRAGMENTS:
        short = short | low.contains(s)
    return hit | low.rlike("^arxiv:[0-9]") | ((F.size(fields(low)) <= 4) & short)


def is_letter_spaced(c: Column) -> Column:
    parts = fields(strip(c))
    singles = F.size(F.filter(parts, lambda w: F.octet_length(w) <= 1))
    return (F.octet_length(strip(c)) >= 5) & (F.size(parts) >= 4) & (singles * 2 >= F.size(parts))


def join_letter_spacing(c: Column) -> Column:
    """Glue groups of single characters; wider gaps part words."""
    def glue(group: Column) -> Column:
        singles = F.forall(fields(group), lambda w: F.octet_length(w) <= 1)
        return F.when(singles, F.array_join(fields(group), "")).otherwise(group)

    return F.when(is_letter_spaced(c), F.array_join(F.transform(F.split(c, r"\s{2,}"), glue), " ")).otherwise(c)


def match_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces, for comparing headings."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9 \t\n]", "")
    return F.trim(F.regexp_replace(kept, r"[ \t\n]+", " "))


def json_object(reply: Column) -> Column:
    """The outermost braces of a reply that may be fenced or wrapped in prose."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


# ---- file names and content types ------------------------------------------------

def content_type(c: Column) -> Column:
    return F.trim(F.lower(F.split_part(c, F.lit(";"), F.lit(1))))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def guess_content_type(name: Column) -> Column:
    e = extension(name)
    return (
        F.when(e.isin(".md", ".markdown"), "text/markdown").when(e == ".txt", "text/plain")
        .when(e.isin(".html", ".htm"), "text/html").when(e == ".pdf", "application/pdf").otherwise("application/octet-stream")
    )


def source_kind(ct: Column) -> Column:
    t = content_type(ct)
    return (
        F.when(t.contains("pdf"), "pdf").when(t.contains("markdown"), "markdown").when(t.contains("html"), "html")
        .when(t.contains("wordprocessingml"), "docx").when(t.startswith("text/"), "text").otherwise("file")
    )


# ---- tables ---------------------------------------------------------------------

def normalised_rows(rows: Column) -> Column:
    """Pad to the widest row, strip cells, drop blank rows."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cell = lambda x: strip(F.coalesce(x, F.lit("")))
    padded = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell))
    return F.filter(padded, lambda r: F.exists(r, lambda x: x != ""))


def _grid(rows: Column, escape) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, escape), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    body = F.concat(F.array(line(F.element_at(rows, 1)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line))
    return F.when(F.size(rows) > 0, F.array_join(body, "\n")).otherwise(F.lit(""))


def table_markdown(rows: Column) -> Column:
    """Grid of an office, CSV or HTML table; the first row is its header."""
    return _grid(normalised_rows(rows), lambda x: squeeze(F.replace(x, F.lit("|"), F.lit("\\|"))))


def page_table_markdown(rows: Column) -> Column:
    """Grid of a table found on a page; bars become entities."""
    return _grid(normalised_rows(rows), lambda x: squeeze(F.replace(x, F.lit("|"), F.lit("&#124;"))))


def rounded(c: Column, digits: int) -> Column:
    """A double to ``digits`` decimals as SQL engines that work in doubles do it: the scaled value is rounded,
    halves away from zero.  Spark's ``round`` takes the shortest decimal text for the value, so 0.285 (a little
    under it) goes up there even where 0.285 * 100 is under 28.5."""
    scaled = F.abs(c) * F.lit(10.0**digits)
    part = scaled % F.lit(1.0)
    whole = scaled - part + F.when(part >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    out = F.signum(c) * whole / F.lit(10.0**digits)
    return F.when(F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), c).otherwise(out)
