"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node reached.

    Each round points every node at its least neighbour, follows pointers of
    pointers once, and replaces nodes by where they point, so long chains
    shrink by a factor and stars vanish at once.  Minima are combined before
    the shuffle, so a node with very many links is no hot key.  Every round is
    a stored table: nothing is recomputed after a loss.  Self-links and
    repeated links are allowed; no links give no rows.  A round's tables go as
    soon as the next round has read them.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0")
    roots, i = None, 0
    while edges.take(1):
        i += 1
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
        least = scratch.write(least, f"least-{i}")
        over = least.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = scratch.write(least.join(over, "to").select("node", F.col("far").alias("to")), f"jump-{i}")
        scratch.drop(f"least-{i}")
        a, b = (jump.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("a_to <> b_to")
        edges = scratch.write(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct(), f"links-{i}")
        scratch.drop(f"links-{i - 1}")
        if roots is None:
            roots = jump.select("node", F.col("to").alias("root"))
        else:
            step = jump.select(F.col("node").alias("root"), F.col("to").alias("next"))
            roots = scratch.write(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"roots-{i}")
            scratch.drop(f"jump-{i}", f"roots-{i - 1}" if i > 2 else "jump-1")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def joined_components(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots(node, root)`` after some more ``links(a, b)``, which may name other nodes too."""
    found = scratch.write(links.where("a <> b").distinct(), "joined-links")
    if not found.take(1):
        return roots
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    moved = found.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    moved = scratch.write(moved, "joined-moved")
    over = connected_components(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), Scratch(scratch.spark, "joined"))
    over = over.select(F.col("node").alias("root"), F.col("root").alias("next"))
    ends = moved.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_root").alias("root")), F.struct(F.col("b").alias("node"), F.col("b_root").alias("root")))).alias("x")).select("x.*")
    every = roots.select("node", "root").unionByName(ends).distinct()
    return scratch.write(every.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "joined-roots")
