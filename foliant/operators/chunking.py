"""Bounding leaves: cutting long ones and merging many small ones.

Both are greedy within a document, so they run in Python; documents are spread
over the cluster, and a task walks through its documents one after the other.
Work is linear in the text, and n log n in a document's sections.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_LEAF = 2400
CHUNK = 900
MOST_LEAVES = 400

NODES = "document_id string, seq long, parent_seq long, level int, title string, content string, page_start int, page_end int, is_table boolean"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _size(s: str) -> int:
    return len(s.encode("utf-8"))


def _byte_cut(s: str, limit: int) -> str:
    return s.encode("utf-8")[:limit].decode("utf-8", "ignore")


def _by_document(nodes: DataFrame, each: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``each`` over the rows of every document, in ``seq`` order, without a call's overhead for each group.

    One document is in memory at a time; empty lists of rows are never passed.
    """
    kind = pa.schema([(name, _KINDS[k]) for name, k in map(str.split, NODES.split(", "))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and held[-1]["document_id"] != row["document_id"]:
                    out += each(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if held:
            yield pa.RecordBatch.from_pylist(each(held), kind)

    rows = nodes.select(*(F.col(name).cast(k).alias(name) for name, k in map(str.split, NODES.split(", "))))
    return rows.repartition("document_id").sortWithinPartitions("document_id", "seq").mapInArrow(walk, NODES)


def split_words(text: str, target: int = CHUNK) -> list[str]:
    """Pieces of about ``target`` bytes (200 at least), a quarter more at most, cut at spaces."""
    target = max(target, 200)
    most, out, raw, at = target + target // 4, [], text.strip().encode("utf-8"), 0
    while len(raw) - at > most:
        head = raw[at : at + most].decode("utf-8", "ignore")
        space = head.rfind(" ")
        if space < 0 or _size(head[:space]) < target // 2:
            space = len(head)
        out.append(head[:space].strip())
        at += _size(head[:space])
        while at < len(raw):  # white space before the next piece
            some = raw[at : at + 64].decode("utf-8", "ignore")
            lead = len(some) - len(some.lstrip())
            at += _size(some[:lead])
            if lead < len(some):
                break
    rest = raw[at:].decode("utf-8")
    return out + [rest] if rest or not out else out


def chunk_title(chunk: str, fallback: str) -> str:
    """What stands before an early colon, else the first words up to 60 bytes."""
    s = chunk.strip()
    if not s:
        return fallback
    label, colon, _ = s.partition(":")
    if colon and 0 < _size(label) < 80 and len(label.split()) >= 2:
        return label.strip()
    if _size(s) > 60:
        head = _byte_cut(s, 60)
        space = head.rfind(" ")
        s = head[:space] if space >= 0 and _size(head[:space]) >= 30 else head
    return s.strip().rstrip(" ,;.:") or fallback


def chunk_leaves(nodes: DataFrame, threshold: int = LONG_LEAF, target: int = CHUNK) -> DataFrame:
    """Long leaves become parents of their pieces; pieces keep pages and go one level down."""

    def each(rows: list[dict]) -> list[dict]:
        parents = {r["parent_seq"] for r in rows}
        out, renumber = [], {}
        for r in rows:
            at = renumber[r["seq"]] = len(out)
            body = r["content"] or ""
            pieces = split_words(body, target) if r["seq"] not in parents and _size(body) > threshold else []
            whole = len(pieces) < 2
            out.append(r | {"seq": at, "parent_seq": renumber.get(r["parent_seq"]), "content": r["content"] if whole else ""})
            for n, piece in enumerate([] if whole else pieces, 1):
                title = chunk_title(piece, f"{r['title']} — part {n}")
                out.append(r | {"seq": at + n, "parent_seq": at, "level": r["level"] + 1, "title": title, "content": piece})
        return out

    return _by_document(nodes, each)


class _Forest:
    """Sections as linked siblings, with heaps of adjacent leaf pairs by size and of parents of one leaf.

    Contents are lists that are joined at the end; sizes are kept beside them.
    Merging keeps the left of two siblings, so the first child of a parent stays.
    """

    def __init__(self, rows: list[dict]):
        self.rows = {r["seq"]: dict(r) for r in rows}
        self.kids: dict[int | None, list[int]] = {None: []}
        for seq, r in self.rows.items():
            body = r["content"] or ""
            r["content"], r["inked"], r["merged"] = body, bool(body.strip()), False
            r["parts"], r["size"] = ([body] if r["inked"] else []), _size(body)
            self.kids.setdefault(r["parent_seq"], []).append(seq)
        self.count = {up: len(k) for up, k in self.kids.items()}
        self.next: dict[int, int | None] = {}
        self.last: dict[int, int | None] = {}
        for siblings in self.kids.values():
            for a, b in zip([None, *siblings], [*siblings, None], strict=True):
                if a is not None:
                    self.next[a] = b
                if b is not None:
                    self.last[b] = a
        self.order = self._walk_order()
        self.preorder, stack = {}, list(reversed(self.kids[None]))
        while stack:
            s = stack.pop()
            self.preorder[s] = len(self.preorder)
            stack += reversed(self.kids.get(s, []))
        self.leaves = sum(self.is_leaf(s) for s in self.rows)
        self.pairs: list[tuple] = []
        self.lone: list[tuple] = []

    def _walk_order(self) -> dict[int, int]:
        """A list's own pairs come before those below it, lists in preorder."""
        order, stack = {}, [None]
        while stack:
            up = stack.pop()
            for s in self.kids.get(up, []):
                order[s] = len(order)
            stack += [s for s in reversed(self.kids.get(up, [])) if self.kids.get(s)]
        return order

    def is_leaf(self, s: int) -> bool:
        return not self.count.get(s)

    def mergeable(self, s: int | None) -> bool:
        return s is not None and self.is_leaf(s) and not self.rows[s]["is_table"]

    def offer(self, a: int | None) -> None:
        if a in self.rows and self.mergeable(a) and self.mergeable(b := self.next[a]):
            heapq.heappush(self.pairs, (self.rows[a]["size"] + self.rows[b]["size"], self.order[a], a, b))

    def offer_lone(self, s: int | None) -> None:
        if s in self.preorder and self.lone_leaf(s):
            heapq.heappush(self.lone, (self.preorder[s], s))

    def absorb(self, into: int, gone: int) -> None:
        a, b = self.rows[into], self.rows.pop(gone)
        if len(a["parts"]) < len(b["parts"]):
            b["parts"][:0] = a["parts"]
            a["parts"] = b["parts"]
        else:
            a["parts"] += b["parts"]
        a["size"] = sum(r["size"] for r in (a, b) if r["inked"]) + 2 * (a["inked"] and b["inked"])
        a["inked"], a["merged"] = a["inked"] or b["inked"], True
        starts = [p for p in (a["page_start"], b["page_start"]) if p]
        a["page_start"], a["page_end"] = min(starts, default=0), max(a["page_end"], b["page_end"])
        self.count[b["parent_seq"]] -= 1
        before, after = self.last.pop(gone, None), self.next.pop(gone, None)
        if before is not None:
            self.next[before] = after
        if after is not None:
            self.last[after] = before

    def lone_leaf(self, s: int) -> bool:
        return s in self.rows and self.count.get(s) == 1 and self.mergeable(self.kids[s][0])

    def collapse(self, s: int) -> None:
        self.absorb(s, self.kids[s][0])
        self.offer(self.last[s])
        self.offer(s)
        self.offer_lone(self.rows[s]["parent_seq"])

    def cap(self, most: int) -> None:
        for s in reversed(self.preorder):  # children before parents
            if self.lone_leaf(s):
                self.collapse(s)
        self.pairs, self.lone = [], []
        for s in self.rows:
            self.offer(s)
            self.offer_lone(s)
        while self.leaves > most:
            if self.pairs:
                size, _, a, b = heapq.heappop(self.pairs)
                fresh = a in self.rows and b in self.rows and self.next.get(a) == b and self.mergeable(a) and self.mergeable(b)
                if fresh and size == self.rows[a]["size"] + self.rows[b]["size"]:
                    self.absorb(a, b)
                    self.leaves -= 1
                    self.offer(self.last[a])
                    self.offer(a)
                    self.offer_lone(self.rows[a]["parent_seq"])
            elif self.lone:
                _, s = heapq.heappop(self.lone)
                if self.lone_leaf(s):
                    self.collapse(s)
            else:
                return

    def table(self) -> list[dict]:
        out = []
        for s in sorted(self.rows):
            r = self.rows[s]
            out.append({c: r[c] for c in _COLUMNS} | ({"content": "\n\n".join(r["parts"])} if r["merged"] else {}))
        return out


def cap_leaves(nodes: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """At most ``most`` leaves a document (0 or less: no cap).

    Parents of a single leaf absorb it, then the smallest pair of neighbouring
    leaves merges, again and again; tables never do.
    """
    if most <= 0:
        return nodes

    def each(rows: list[dict]) -> list[dict]:
        parents = {r["parent_seq"] for r in rows}
        if sum(r["seq"] not in parents for r in rows) <= most:
            return rows
        forest = _Forest(rows)
        forest.cap(most)
        return forest.table()

    return _by_document(nodes, each)
