"""Reading model replies leniently.

Plain functions; ``read_column`` lifts them over a column by Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_json(reply: str | None) -> dict | None:
    """The object between the first and last brace, fenced or not; None if there is none."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].removesuffix("```")
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last < first:
        return None
    try:
        found = json.loads(text[first : last + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _number(v) -> float | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, int | float):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str):
        try:
            return _number(float(v.strip()))
        except ValueError:
            return None
    return None


def _page(v) -> int:
    n = _number(v)
    return int(n) if n is not None else 0


def _strings(v) -> list[str]:
    return [s for x in v if isinstance(x, str) and (s := x.strip())] if isinstance(v, list) else []


def unit(v: float) -> float:
    return min(1.0, max(0.0, v))


def selection(reply: str | None) -> dict | None:
    """ids in order and their confidences, from picks or else from a plain id list."""
    if not (reply or "").strip():
        return {"ids": [], "confidences": {}}
    found = outer_json(reply)
    if found is None:
        return None
    picks = found.get("picks")
    if isinstance(picks, list) and picks:
        confidences: dict[str, float | None] = {}
        for p in picks:
            if isinstance(p, dict) and isinstance(p.get("id"), str) and (i := p["id"].strip()) and i not in confidences:
                c = p.get("confidence")
                confidences[i] = unit(float(c)) if isinstance(c, int | float) and not isinstance(c, bool) else None
        return {"ids": list(confidences), "confidences": {k: v for k, v in confidences.items() if v is not None}}
    return {"ids": _strings(found.get("selected_section_ids")), "confidences": {}}


def section_action(reply: str | None) -> dict | None:
    """outline(level), expand(id), read(id) or done(ids) of the section agent."""
    found = outer_json(reply)
    name = str((found or {}).get("action") or (found or {}).get("tool") or "").strip().lower()
    if name not in ("outline", "expand", "read", "done"):
        return None
    picked = selection(json.dumps(found)) or {"ids": [], "confidences": {}}
    return {"action": name, "level": _page(found.get("level")), "id": str(found.get("section_id") or found.get("id") or "").strip(), **picked}


_RANGE = re.compile(r"\s*(\d+)(?:\s*[-–]\s*(\d+))?\s*$")


def page_range(v) -> tuple[int, int] | None:
    """[5, 7], {"start": 5, "end": 7}, "5-7" or 5."""
    if isinstance(v, str) and (m := _RANGE.match(v)):
        return int(m[1]), int(m[2] or m[1])
    if isinstance(v, list) and v and all(_number(x) is not None for x in v[:2]):
        return _page(v[0]), _page(v[min(1, len(v) - 1)])
    if isinstance(v, dict):
        start = _page(v.get("start", v.get("start_page")))
        end = _page(v.get("end", v.get("end_page")))
        return (start, end or start) if start or end else None
    n = _number(v)
    return (int(n), int(n)) if n is not None else None


def page_action(reply: str | None) -> dict | None:
    """One step of the page agent; a field of the wrong kind is left at its default."""
    found = outer_json(reply)
    if found is None:
        return None
    name = next((v.strip().lower() for v in (found.get("tool"), found.get("action")) if isinstance(v, str) and v.strip()), "")
    if not name:
        return None
    asked = page_range(found.get("pages")) or (_page(found.get("start_page")), _page(found.get("end_page")))
    cited = found.get("cited_pages")
    ranges = [r for v in (cited if isinstance(cited, list) else []) if (r := page_range(v))]
    return {
        "action": name, "start": asked[0], "end": asked[1] or asked[0],
        "answer": found["answer"] if isinstance(found.get("answer"), str) else "",
        "confidence": unit(_number(found.get("confidence")) or 0.0), "cited": ranges,
    }


def scores(reply: str | None) -> list[tuple[str, float, str]] | None:
    """(id, score, reason); negative scores are 0, large ones stay."""
    found = outer_json(reply)
    rows = next((found[k] for k in ("scores", "ranked", "results") if isinstance(found.get(k), list)), None) if found else None
    if rows is None:
        return None
    good = [r for r in rows if isinstance(r, dict) and isinstance(r.get("id"), str) and r["id"].strip()]
    return [(r["id"].strip(), max(0.0, _number(r.get("score")) or 0.0), str(r.get("reason") or "")) for r in good]


def plan(reply: str | None) -> dict | None:
    found = outer_json(reply)
    if found is None:
        return None
    subs = _strings(found.get("sub_questions"))
    return {
        "intent": str(found.get("intent") or "").strip(), "entities": _strings(found.get("entities")),
        "expected_doc_areas": _strings(found.get("expected_doc_areas")), "is_multi_hop": bool(found.get("is_multi_hop")) and bool(subs), "sub_questions": subs,
    }


def summary_axes(reply: str | None) -> dict | None:
    """Topics, entities and numbers, at most 4, 8 and 6, and one line."""
    found = outer_json(reply)
    if found is None:
        return None
    return {"topics": _strings(found.get("topics"))[:4], "entities": _strings(found.get("entities"))[:8], "numbers": _strings(found.get("numbers"))[:6], "one_line": " ".join(str(found.get("one_line") or "").split())}


def questions(reply: str | None, cap: int = 5) -> list[str] | None:
    found = outer_json(reply)
    if found is None:
        return None
    out: dict[str, str] = {}
    for q in _strings(found.get("questions")):
        out.setdefault(q.lower(), q)
    return list(out.values())[:cap]


def toc_nodes(reply: str | None) -> list[dict] | None:
    found = outer_json(reply)
    rows = next((found[k] for k in ("nodes", "table_of_contents", "toc") if isinstance(found.get(k), list)), None) if found else None
    if rows is None:
        return None
    return [{"structure": str(r.get("structure") or ""), "title": str(r.get("title") or ""), "physical_index": str(r.get("physical_index") or "")} for r in rows if isinstance(r, dict)]


def says_yes(reply: str | None, *names: str) -> bool:
    found = outer_json(reply) or {}
    return any(str(found.get(n, "")).strip().lower() in ("yes", "true") for n in names)


def quote(reply: str | None, limit: int = 400) -> str:
    found = outer_json(reply) or {}
    said = found.get("quote") if isinstance(found.get("quote"), str) else ""
    return said.encode()[:limit].decode("utf-8", "ignore").strip()


def locate(body: str, said: str) -> tuple[int, int]:
    """Byte range of a quote, white space of any kind being equal; (-1, -1) if absent."""
    if not said.strip():
        return -1, -1
    at = body.find(said)
    end = at + len(said)
    if at < 0:
        m = re.search(r"\s+".join(map(re.escape, said.split())), body)
        if not m:
            return -1, -1
        at, end = m.span()
    return len(body[:at].encode()), len(body[:end].encode())


def read_column(reader: Callable, schema: str) -> Callable[[Column], Column]:
    """The reader over a column of replies; its result is a value of ``schema``."""

    @F.pandas_udf("string")
    def as_json(replies: pd.Series) -> pd.Series:
        return replies.map(lambda r: None if (v := reader(r)) is None else json.dumps({"v": v}))

    return lambda c: F.from_json(as_json(c), f"v {schema}")["v"]
