"""Tables of contents from flat nodes with dotted numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOC = "document_id string, toc_seq long, parent_seq long, depth int, structure string, title string, start_page int, node_id string"


def dotted_depth(structure: Column) -> Column:
    return F.when(F.coalesce(structure, F.lit("")) == "", F.lit(1)).otherwise(F.regexp_count(structure, F.lit(r"\.")) + 1)


def assemble(nodes: DataFrame) -> DataFrame:
    """Hierarchy of (document_id, pos, structure, title, start_page).

    The parent is what stands on a stack cut to depth - 1 entries, so a node
    that skips a level hangs under the one before.  Blank titles go.  Node ids
    chain ``toc_<structure>`` (or the place, where that is blank) by ``_``.
    """

    names = [c.split()[0] for c in TOC.split(", ")]
    kind = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; what is held is the stack: (seq, node id, children so far)."""
        now, seq, top, stack = object(), 0, 0, []
        for batch in batches:
            out = []
            for document, structure, title, start in zip(*(batch.column(c).to_pylist() for c in ("document_id", "structure", "title", "start_page")), strict=True):
                if document != now:
                    now, seq, top, stack = document, 0, 0, []
                title = (title or "").strip()
                if not title:
                    continue
                structure = (structure or "").strip()
                del stack[structure.count(".") :]
                if stack:
                    up = stack[-1]
                    place, up[2] = up[2], up[2] + 1
                else:
                    up, place, top = None, top, top + 1
                node = "_".join(x for x in (up[1] if up else "toc", structure or f"n{place}") if x)
                out.append((document, seq, up[0] if up else None, len(stack), structure, title, start or 0, node))
                stack.append([seq, node, 0])
                seq += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    rows = nodes.select(F.col("document_id").cast("string").alias("document_id"), "pos", "structure", "title", F.col("start_page").cast("int").alias("start_page"))
    rows = rows.repartition("document_id").sortWithinPartitions("document_id", F.asc_nulls_last("pos"))
    return rows.mapInArrow(walk, TOC)


def end_pages(nodes: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Add end_page: before the first later sibling that starts after the node,
    else the parent's end, else the document's last page; 0 where that is before the start.

    ``last_pages`` holds a document once.  One pass over sorted documents, one
    in memory at a time, linear in its nodes; a parent's depth is less than its
    children's.
    """
    each = nodes.select("document_id", F.lit(None).cast("int").alias("last"), F.struct(*nodes.columns).alias("node"))
    lasts = last_pages.select("document_id", F.col("last_page").cast("int").alias("last"), F.lit(None).cast(each.schema["node"].dataType).alias("node"))
    rows = each.unionByName(lasts).repartition("document_id").sortWithinPartitions("document_id", F.col("node.toc_seq"))
    schema = "node " + each.schema["node"].dataType.simpleString() + ", end_page int"

    def ends(seqs: list, parents: list, depths: list, starts: list, last: int | None) -> list[int]:
        after, waiting = [None] * len(seqs), defaultdict(list)
        for i, (parent, start) in enumerate(zip(parents, starts, strict=True)):
            if start is None:
                continue
            open_ = waiting[parent]  # siblings that no later one has started after, the least start on top
            while open_ and starts[open_[-1]] < start:
                after[open_.pop()] = start
            open_.append(i)
        end, at = [0] * len(seqs), {}
        for i in sorted(range(len(seqs)), key=lambda i: (depths[i] is None, depths[i])):
            up = at.get(parents[i]) if parents[i] is not None else None
            ceiling = end[up] if up is not None and depths[i] is not None and depths[up] < depths[i] and end[up] > 0 else last
            fin = ceiling if after[i] is None else after[i] - 1
            if starts[i] is not None and fin is not None and starts[i] > 0 and fin >= starts[i]:
                end[i] = fin
            at[seqs[i]] = i
        return end

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.RecordBatch) -> pa.RecordBatch:
            node = t.column("node")
            seqs, parents, depths, starts = (node.field(c).to_pylist() for c in ("toc_seq", "parent_seq", "depth", "start_page"))
            out, i = [0] * len(seqs), 0
            documents, lasts, known = t.column("document_id").to_pylist(), t.column("last").to_pylist(), node.is_valid().to_pylist()
            while i < len(seqs):
                j, last, lo = i, None, i
                while j < len(seqs) and documents[j] == documents[i]:
                    if not known[j]:  # rows of last pages sort first
                        last, lo = lasts[j], j + 1
                    j += 1
                out[lo:j] = ends(seqs[lo:j], parents[lo:j], depths[lo:j], starts[lo:j], last)
                i = j
            return pa.RecordBatch.from_arrays([node, pa.array(out, pa.int32())], ["node", "end_page"]).filter(node.is_valid())

        for b in batches:
            if not b.num_rows:
                continue
            documents = b.column("document_id").to_pylist()
            cut = len(documents)
            while cut and documents[cut - 1] == documents[-1]:
                cut -= 1
            if cut or (held and held[-1].column("document_id")[-1].as_py() != documents[0]):
                whole = pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()
                held = []
                yield from (done(t) for t in whole)
            held.append(b.slice(cut))
        if held:
            yield from (done(t) for t in pa.Table.from_batches(held).combine_chunks().to_batches())

    return rows.mapInArrow(walk, schema).select("node.*", "end_page")
