"""Context budgets and the division of a tree into slices that fit one."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = "document_id string, slice_no int, breadcrumb string, pos int, id string, view_depth int"


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 100_000
    reserved: int = 4_000
    parallel: int = 8

    @property
    def available(self) -> int:
        left = max(0, self.max_tokens - self.reserved)
        return left or self.max_tokens


def line_bytes(title, summary, id_) -> int:
    return sum(len((x or "").encode()) for x in (title, summary, id_)) + 8


def cost(size: int) -> int:
    """Tokens of lines that hold so many bytes together."""
    return size // 4


class _Tree:
    def __init__(self, g: pd.DataFrame):
        g = g.sort_values("preorder")
        self.ids = g["id"].tolist()
        self.titles = dict(zip(g["id"], g["title"].fillna(""), strict=True))
        self.depth = dict(zip(g["id"], g["view_depth"], strict=True))
        own = {r.id: line_bytes(r.title, r.summary, r.id) for r in g.itertuples()}
        self.own, self.below = own, dict(own)
        self.kids: dict[str, list[str]] = {}
        up = dict(zip(g["id"], g["parent_id"].fillna(""), strict=True))
        for i in self.ids:
            self.kids.setdefault(up[i] if up[i] in own else "", []).append(i)
        for i in reversed(self.ids):
            if up[i] in own:
                self.below[up[i]] += self.below[i]

    def subtree(self, top: str) -> list[str]:
        out, stack = [], [top]
        while stack:
            i = stack.pop()
            out.append(i)
            stack += reversed(self.kids.get(i, []))
        return out


def _divide(tree: _Tree, node: str | None, title: str, crumb: str, room: int) -> list[tuple[str, list[str]]]:
    """Next-fit over children; a child larger than the room is divided itself."""
    slices: list[tuple[str, list[str]]] = []
    open_, used = ([node], cost(tree.own[node])) if node is not None else ([""], cost(line_bytes(title, "", "")))
    for child in tree.kids.get(node if node is not None else "", []):
        size = cost(tree.below[child])
        if size > room:
            if open_:
                slices.append((crumb, open_))
            slices += _divide(tree, child, tree.titles[child], f"{crumb} → {title}" if title else crumb, room)
            open_, used = [], 0
            continue
        if open_ and used + size > room:
            slices.append((crumb, open_))
            open_, used = [], 0
        open_ = open_ + tree.subtree(child)
        used += size
    if open_:
        slices.append((crumb, open_))
    n = len(slices)
    return slices if n < 2 else [(f"{c} (slice {i} of {n})", s) for i, (c, s) in enumerate(slices, 1)]


def split(viewed: DataFrame, docs: DataFrame, budget: Budget) -> DataFrame:
    """Slices of each document's outline: one row for each section in a slice.

    A document that fits is one slice.  The line of a divided section leads
    its first slice.  Several top sections hang from a root with an empty id.
    """
    room = budget.available
    titled = viewed.join(docs.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title")), "document_id")
    titled = titled.select("document_id", "doc_title", "id", "parent_id", "title", "summary", "view_depth", "preorder")

    def each(g: pd.DataFrame) -> pd.DataFrame:
        doc, title = g["document_id"].iloc[0], g["doc_title"].iloc[0] or ""
        tree, crumb = _Tree(g), f"Document: {title}"
        tops = tree.kids.get("", [])
        total = sum(tree.below[t] for t in tops) + (line_bytes(title, "", "") if len(tops) > 1 else 0)
        everything = ([""] if len(tops) > 1 else []) + [i for t in tops for i in tree.subtree(t)]
        if room <= 0 or cost(total) <= room:
            slices = [(crumb, everything)]
        elif len(tops) == 1:
            slices = _divide(tree, tops[0], tree.titles[tops[0]], crumb, room)
        else:
            slices = _divide(tree, None, title, crumb, room)
        rows = [(doc, n, c, pos, i, int(tree.depth.get(i, 0))) for n, (c, ids) in enumerate(slices) for pos, i in enumerate(ids)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SLICES.split(", ")])

    return titled.groupBy("document_id").applyInPandas(each, SLICES)
