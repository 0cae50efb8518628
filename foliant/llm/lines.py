"""Line dedup: exact and fuzzy copies of lines, with built-in functions only.

Lines are normalised to lower-case words without punctuation and grouped by
the fingerprint of those.  Every distinct line is signed by ``POOL`` minima of
hashes of its words, longer words being likelier to be the least, so that
articles and the like hardly count; a table takes some of the minima as its
key.  The share of near lines that meet in a table depends on how many words
they share and not on line length.  Members of a bucket are held against its
least and its greatest line first, so that a group of copies is not expanded
into pairs; members that are in different components after that are compared
with each other.  Two bits of each of 32 minima tell most strangers at once.
Candidates are verified by edit similarity, and every connected group keeps
its first occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import SALTS, Scratch, may_hold, salted, unused
from .components import connected_components, joined_components

#: Lines of fewer words and fewer letters are never dropped: short phrases recur by chance.
LEAST_WORDS, LEAST_LETTERS = 3, 10
#: Scripts that put no spaces between words: every character is a word.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"
#: Characters from the first of these scripts on.
FAR = r"[\u0E00-\x{10FFFF}]"
SIMILARITY = 0.8
#: ASCII characters that are in no word of a lower-case line, one by one, which Java looks up in a table; of ranges it tries each.
_NONE = "[" + "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))) + "]"
#: Runs of them but single spaces, which stay as they are.
BETWEEN = f"{_NONE}(?:(?<! )|{_NONE}){_NONE}*"
#: Lines with more letters are compared word by word.
LONG_LINE = 120
#: Minima of each signature; with the other columns it stays within what Spark compiles.
POOL = 32
#: (weighted share of common words met with RECALL, minima in a key).  A fifth of
#: all words replaced leaves two thirds on average, and less where long ones went.
KINDS = {"words": (0.6, 3)}
RECALL = 0.95
#: Lines for which keys of that width suffice; for so many times as many they get one minimum more.
#: The number is a parameter and never counted, so what is found does not depend on the size of the input.
LINES, TIMES = 8_000_000, 24
#: The weight of a word of n letters is 2 ** (n - 1), as far as this power.
WEIGHTS = 6
#: Words of a line that are reckoned with at once: so many fewer rows are grouped.
ABREAST = 4
#: Tables keyed at once.
ROUND = 7
#: How hard intermediate tables are compressed: the lines take a tenth more than at 3, for a third of the time.
LEVEL = 1
#: Of 32 pairs of bits, those that near lines agree in; unrelated lines of one bucket agree in 12.
AGREEING = 17
#: Buckets of more lines, told from one line of ``SAMPLED``, are dealt to many tasks.
HOT, SAMPLED = 4096, 64
#: Buckets of more members are compared in tiles, two blocks of at most about so many at once.
BLOCK, TILE = 128, 512


def normalised(line: Column, far: Column) -> Column:
    """Lower-case runs of letters, digits and characters beyond ASCII, by single spaces.

    Runs in scripts without spaces are cut into characters, CJK punctuation
    ends words.  ``far`` tells whether the line may hold such characters.
    """
    ended = F.regexp_replace(line, r"[\u3000-\u3004\u3008-\u303F\uFF01-\uFF0F\uFF1A-\uFF20]", " ")
    cut = F.regexp_replace(ended, UNSPACED, " $0 ")
    line = F.when(far & F.rlike(line, F.lit(UNSPACED)), cut).otherwise(line)
    return F.trim(F.regexp_replace(F.lower(line), BETWEEN, " "))


def spelt(norm: Column) -> Column:
    """Words side by side, without spaces between characters of unspaced scripts."""
    return F.when(F.octet_length(norm) == F.length(norm), norm).otherwise(F.regexp_replace(norm, f"(?<={UNSPACED}) (?={UNSPACED})", ""))


def tables(kind: str, lines: int) -> list[tuple[int, ...]]:
    """The minima that each table takes for its key.

    Keys get longer as lines grow, so that buckets do not fill with strangers;
    the chance of meeting stays, because tables are added until a pair at the kind's similarity meets in one of
    them with ``RECALL``, by a simulation of which minima agree.  All minima are
    dealt before one is taken again: tables with minima in common meet in the
    same pairs, so fewer tables do when they have few.
    """
    at, width = KINDS[kind]
    while lines > LINES:
        width, lines = width + 1, lines // TIMES
    rng = np.random.RandomState(20240611)
    agree = rng.rand(8000, POOL) < at
    met, picked, left = np.zeros(len(agree), bool), [], []
    while met.mean() < RECALL:
        if len(left) < width:
            left += [i for i in rng.permutation(POOL).tolist() if i not in left]
        picked.append(tuple(sorted(left[:width])))
        left = left[width:]
        met |= agree[:, picked[-1]].all(1)
    return picked


def minima() -> list[Column]:
    """The least of ``POOL`` hashes of the words ``g0``, ``g1`` and so on, made of their one fingerprint.

    A hash is the fingerprint turned by some bits, with some bits flipped, and
    divided by a power of two that grows with the word (columns ``weight0`` and so on).
    """
    rng = np.random.RandomState(20240612)
    out = []
    for i in range(POOL):
        by, flip = 1 + i * 62 // POOL, int(rng.randint(-(2**63), 2**63, dtype=np.int64))
        turned = [F.shiftleft(f"g{j}", by).bitwiseOR(F.shiftrightunsigned(f"g{j}", 64 - by)) for j in range(ABREAST)]
        least = F.least(*(F.call_function("shiftrightunsigned", t.bitwiseXOR(F.lit(flip)), F.col(f"weight{j}")) for j, t in enumerate(turned)))
        out.append(F.min(least).alias(f"m{i}"))
    return out


def abreast(lines: DataFrame) -> DataFrame:
    """Fingerprints and weights of all words of ``lines(h, size, norm)``, ``ABREAST`` to a row; a last row repeats its first word."""
    split = lines.select("h", "size", F.split("norm", " ").alias("words"))
    at = split.select("h", "size", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(ABREAST))).alias("i"))
    words = at.select("h", "size", *(F.coalesce(F.get("words", F.col("i") + j), F.get("words", F.col("i"))).alias(f"word{j}") for j in range(ABREAST)))
    prints = (F.xxhash64(f"word{j}").alias(f"g{j}") for j in range(ABREAST))
    weights = (F.coalesce(F.least(F.lit(WEIGHTS + 1), F.length(f"word{j}")), F.lit(0)).alias(f"weight{j}") for j in range(ABREAST))
    return words.select("h", "size", *prints, *weights)


def sketch() -> Column:
    """Two bits of each of 32 minima."""
    out = F.lit(0).cast("long")
    for i in range(32):
        out = out.bitwiseOR(F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(3)), 2 * i))
    return out


def agreeing(a: Column, b: Column) -> Column:
    """In how many of the 32 pairs of bits two sketches agree."""
    x = a.bitwiseXOR(b)
    return 32 - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def table_keys(kind: str, picked: list[tuple[int, ...]]) -> Column:
    """One number for each table, of the minima it takes; strangers that share it are told apart later."""
    return F.array(*(F.hash(F.lit(f"{kind}{n}"), *(F.col(f"m{i}") for i in p)) for n, p in enumerate(picked)))


def spaces(norm: Column) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" ")))


def extent(norm: Column, far: Column) -> Column:
    """A line's number of words and, in the last byte, its letters and spaces, as far as one more than ``LONG_LINE``."""
    words = spaces(norm) + 1
    letters = F.when(far, F.length(spelt(norm))).otherwise(F.length(norm))
    return F.shiftleft(words.cast("long"), 8).bitwiseOR(F.least(letters, F.lit(LONG_LINE + 1)).cast("long"))


def fitting(a: Column, b: Column, similarity: float) -> Column:
    """Whether lines of two extents may be ``similar``: an edit distance is no less than the difference of lengths."""
    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) <= F.floor(F.greatest(x, y) * (1 - similarity) + 1e-9)

    x, y = a.bitwiseAND(F.lit(255)), b.bitwiseAND(F.lit(255))
    return F.when(F.greatest(x, y) <= LONG_LINE, near(x, y)).otherwise(near(F.shiftright(a, 8), F.shiftright(b, 8)))


def _as_letters(words: Column) -> Column:
    """One letter for each word, for an edit distance in words."""
    code = lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(20000)) + 0x4E00)
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


def similar(similarity: float, aligned: bool = False) -> Column:
    """Edit similarity 1 - distance / longer length of at least ``similarity``.

    Columns x and y hold short lines, x_words and y_words one letter for each
    word of any line; a pair with a longer line is compared by words.  The time
    grows with the distance that is asked for, and most near lines are nearer
    than they need be, so lesser ones are asked for first.  ``aligned`` first
    counts the places in which lines of one length differ, which are no fewer
    than the distance; Spark compiles no join with that, so it is for few pairs.
    """
    def near(a: str, b: str) -> Column:
        most = F.floor(F.greatest(F.length(a), F.length(b)) * (1 - similarity) + 1e-9).cast("int")
        within = lambda k: F.call_function("levenshtein", F.col(a), F.col(b), k) >= 0
        any_ = within(F.ceil(most / 5).cast("int")) | within(F.ceil(most / 2).cast("int")) | within(most)
        differing = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: p != q), lambda x: x)
        return ((F.length(a) == F.length(b)) & (F.size(differing) <= most)) | any_ if aligned else any_

    return F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), near("x", "y")).otherwise(near("x_words", "y_words"))


def _candidates(signed: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(bucket, h, sketch, size, n, lo, hi) of lines in buckets of ``n`` > 1.

    ``lo`` and ``hi`` are the bucket's hubs, its least and its greatest line,
    where they may be near.  Rows of small buckets without such a hub are left
    out.  Rounds bound what is shuffled at once; every table has its turn in
    one.  Of very large buckets two lines of a sample are the hubs, so that
    their rows need not meet in one task.
    """
    any_, out = signed.select(F.size("keys")).head(), None
    n = any_[0] if any_ else 0
    sampled = scratch.write(signed.where(F.pmod(F.xxhash64("h"), F.lit(SAMPLED)) == 0), "sampled")

    def by_key(frame: DataFrame, first: int) -> DataFrame:
        keyed = frame.select("h", "sketch", "size", F.posexplode(F.slice("keys", first + 1, ROUND)).alias("table", "key"))
        number = (F.col("table") + first).cast("long")
        return keyed.select("h", "sketch", "size", F.shiftleft(number, 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bucket"))

    for r, first in enumerate(range(0, max(n, 1), ROUND)):
        keyed, some = by_key(signed, first), by_key(sampled, first)
        hubs = {"lo": F.min("h"), "hi": F.max("h")} | {f"{hub}_{c}": by(c, "h") for hub, by in (("lo", F.min_by), ("hi", F.max_by)) for c in ("sketch", "size")}
        counts = some.groupBy("bucket").count().where(F.col("count") * SAMPLED > HOT)
        counts = scratch.write(counts.select("bucket", (F.col("count") * SAMPLED).alias("n")), f"hot-{r}")
        rest, spread = keyed, None
        if counts.take(1):
            may_be_hot = may_hold(counts, "bucket")(F.col("bucket"))
            hot = scratch.write(some.where(may_be_hot).groupBy("bucket").agg(*(c.alias(name) for name, c in hubs.items())).join(counts, "bucket"), f"hubs-{r}")
            spread = salted(keyed.where(may_be_hot), ["bucket"], "h", hot)
            rest = keyed.where(~may_be_hot).unionByName(_without(keyed.where(may_be_hot), hot))
        alike = W.Window.partitionBy("bucket")
        # Most lines are alone in their bucket, so hubs are looked for after those are gone.
        rest = rest.select("*", F.count("*").over(alike).alias("n")).where("n > 1")
        every = rest.select("*", *(c.over(alike).alias(name) for name, c in hubs.items()))
        every = every if spread is None else every.unionByName(spread)
        for hub in ("lo", "hi"):
            may_be_near = (agreeing(F.col("sketch"), F.col(f"{hub}_sketch")) >= AGREEING) & fitting(F.col("size"), F.col(f"{hub}_size"), similarity)
            every = every.withColumn(hub, F.when((F.col("h") != F.col(hub)) & may_be_near, F.col(hub)))
        every = every.where("lo is not null or hi is not null or n > 3").select("bucket", "h", "sketch", "size", "n", "lo", "hi")
        found = scratch.write(every, f"met-{r}")
        scratch.drop(f"hot-{r}", f"hubs-{r}")
        out = found if out is None else out.unionByName(found)
    scratch.drop("sampled")
    return out


def _without(frame: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of buckets that only share a place of the filter with a very large one."""
    marked = hot.select("bucket", F.lit(True).alias("is_hot"))
    salts = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_salt = frame.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    return by_salt.join(salts, ["bucket", "salt"], "left_anti").select(*frame.columns)


def _said(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, x, x_words): a short line's letters, and one letter for each word, of the lines in ``wanted(h)``."""
    met = lines.where(may_hold(wanted, "h")(F.col("h"))).join(wanted, "h", "left_semi").groupBy("h").agg(F.min("norm").alias("norm"))
    said = met.select("h", spelt(F.col("norm")).alias("x"), _as_letters(F.split("norm", " ")).alias("x_words"))
    return said.withColumn("x", F.when(F.length("x") <= LONG_LINE, F.col("x")))


def _judged(pairs: DataFrame, said: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar."""
    other = said.select(F.col("h").alias("b"), F.col("x").alias("y"), F.col("x_words").alias("y_words"))
    return pairs.join(said.withColumnRenamed("h", "a"), "a").join(other, "b").where(similar(similarity, aligned=True)).select("a", "b")


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float, scratch: Scratch, label: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar, stored."""
    wanted = scratch.write(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), f"wanted-{label}")
    said = scratch.write(_said(wanted, lines), f"said-{label}")
    links = scratch.write(_judged(pairs, said, similarity), f"links-{label}")
    scratch.drop(f"wanted-{label}", f"said-{label}")
    return links


def _across_components(met: DataFrame, roots: DataFrame, lines: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links between members of one bucket that are in different components.

    Pairs of small buckets are verified like those with hubs.  In a large
    bucket the largest component is not compared with itself: its members stand
    in blocks of their own, and a tile is two blocks of which one at least
    holds others.  Tiles carry what is compared, so that of their pairs only
    links come out.
    """
    node = roots.select(F.col("node").alias("h"), "root")
    member = scratch.write(met.where("n > 3").select("bucket", "h", "sketch", "size", "n").join(node, "h", "left").withColumn("comp", F.coalesce("root", "h")).drop("root"), "placed")

    def pairs_of(frame: DataFrame, by: str, *more: str) -> DataFrame:
        one, two = (frame.select(by, F.col("h").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("size").alias(f"size_{side}"), F.col("comp").alias(f"comp_{side}"), *(F.col(c).alias(c if side == "a" else c.replace("x", "y")) for c in more)) for side in "ab")
        apart = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & (agreeing(F.col("sketch_a"), F.col("sketch_b")) >= AGREEING)
        apart = apart & fitting(F.col("size_a"), F.col("size_b"), similarity)
        return one.join(two, by).where(apart & similar(similarity) if more else apart).select("a", "b").distinct()

    near = scratch.write(pairs_of(member.where(F.col("n") <= BLOCK), "bucket"), "across")
    large = member.where(F.col("n") > BLOCK)
    sizes = large.groupBy("bucket", "comp").count()
    groups = sizes.groupBy("bucket").agg(F.max(F.struct("count", "comp")).alias("main"), F.sum("count").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    groups = scratch.write(groups.select("bucket", F.col("main.comp").alias("main"), blocks(F.col("main.count")).alias("mains"), blocks(F.col("all") - F.col("main.count")).alias("others")), "groups")
    if not groups.take(1):
        scratch.drop("placed", "groups")
        return _verified(near, lines, similarity, scratch, "across")
    large = scratch.write(salted(large, ["bucket"], "h", groups), "large")
    is_main = F.col("comp") == F.col("main")
    dealt = large.withColumn("is_main", is_main).withColumn("block", F.pmod(F.xxhash64("h"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(span(F.col("mains")), lambda i: F.xxhash64("bucket", F.lit("main"), "block", i))
    with_other = F.transform(span(F.col("others")), lambda i: F.xxhash64("bucket", F.lit("other"), F.least("block", i), F.greatest("block", i)))
    from_main = F.transform(span(F.col("others")), lambda i: F.xxhash64("bucket", F.lit("main"), i, "block"))
    tiles = F.when(F.col("is_main"), from_main).otherwise(F.concat(with_main, with_other))
    # The lines of both are read at once.
    wanted = near.select(F.explode(F.array("a", "b")).alias("h")).unionByName(large.select("h")).distinct()
    said = scratch.write(_said(scratch.write(wanted, "wanted-across"), lines), "said-across")
    links = scratch.write(_judged(near, said, similarity), "links-across")
    placed = dealt.select("h", "sketch", "size", "comp", F.explode(tiles).alias("tile")).join(said, "h")
    more = scratch.write(pairs_of(placed, "tile", "x", "x_words"), "links-large")
    scratch.drop("placed", "groups", "large", "across", "wanted-across", "said-across")
    return links.unionByName(more)


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    similarity: float = SIMILARITY,
    expected: int = LINES,
) -> DataFrame:
    """Add n_lines, dropped (positions from 0, ascending) and kept_text.

    The first occurrence of a group, by key, text fingerprint and position,
    stays.  Lines under ``least_words`` words stay always if they have under
    ``LEAST_LETTERS`` letters too, and so do blank lines.  ``expected`` distinct
    lines are what keys are made for: with many more, results stay the same and
    buckets hold more strangers, which costs time.
    Null texts have no lines and a null kept_text; a text whose lines all go
    has an empty one.  Rows that repeat key and text are one document, so they
    are treated alike; null keys come last.  Columns of ``docs`` pass through,
    whatever their names; those named like results are replaced.  An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines", LEVEL)
    added = ("n_lines", "dropped", "kept_text")
    kept = [c for c in docs.columns if c not in added]
    body = F.col(text)
    row, print_, gone_ = (unused(docs.columns, c) for c in ("row", "print", "gone"))
    rows = docs.select(*kept, *([body] if text in added else []), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(body).alias("print")).alias(row))
    source = rows.select(F.col(row).alias("row"), body.alias("t"), ((F.octet_length(body) > F.length(body)) & F.rlike(body, F.lit(FAR))).alias("far")).where("t is not null")
    lines = source.select("row", "far", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    told = lines.select("row", "pos", "far", normalised(F.col("line"), F.col("far")).alias("norm"))
    # One projection for both, so that words are worked out once; lines that stay anyway have no fingerprint.
    letters = F.length("norm") - spaces(F.col("norm"))
    # No two spaces stand side by side, so of this many bytes (four to a letter at most) half are letters.
    many = F.octet_length("norm") >= 8 * LEAST_LETTERS
    counts = many | (letters >= LEAST_LETTERS) | ((letters > 0) & (spaces(F.col("norm")) + 1 >= least_words))
    lines = scratch.write(told.select(F.when(counts, F.xxhash64("norm")).alias("h"), "row", "pos", "norm", extent(F.col("norm"), F.col("far")).alias("size")), "lines").where("h is not null")

    # Copies of a line have the same minima, so they need not be told apart first.
    signed = abreast(lines).groupBy("h", "size").agg(*minima()).select("h", "size", sketch().alias("sketch"), table_keys("words", tables("words", expected)).alias("keys"))
    signed = scratch.write(signed, "signed")
    met = _candidates(signed, similarity, scratch)
    scratch.drop("signed")
    # The hub of a group of copies is mostly the same in all its buckets, so there are few pairs.
    pairs = met.select("h", F.explode(F.array("lo", "hi")).alias("other")).where("other is not null")
    pairs = scratch.write(pairs.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct(), "pairs")
    links = _verified(pairs, lines, similarity, scratch, "first")
    roots = connected_components(links, scratch)
    if met.where("n > 3").take(1):
        roots = joined_components(roots, _across_components(met, roots, lines, similarity, scratch), scratch)

    # Most lines are neither linked nor repeated; those go no further.
    linked = may_hold(roots, "node")
    copied = may_hold(scratch.write(lines.groupBy("h").count().where("count > 1").select("h"), "copied"), "h")
    places = scratch.write(lines.where(linked(F.col("h")) | copied(F.col("h"))).select("h", "row", "pos"), "places")
    classes = scratch.write(places.groupBy("h").agg(F.count("*").alias("copies"), F.min(F.struct("row", "pos")).alias("first")), "classes")
    grouped = classes.where(linked(F.col("h"))).join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "copies", "first")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("stays"), F.sum("copies").alias("total")).where("total > 1")
    alone = classes.where(~linked(F.col("h")) & (F.col("copies") > 1)).select("h", F.col("first").alias("stays"))
    marked = scratch.write(grouped.join(firsts, "root").select("h", "stays").unionByName(alone), "marked")
    repeated = places.where(may_hold(marked, "h")(F.col("h")))
    drops = repeated.join(marked, "h").where(F.struct("row", "pos") != F.col("stays")).select("row", "pos")
    drops = drops.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias(gone_)).withColumnRenamed("row", print_)
    drops = scratch.write(drops, "drops")
    scratch.drop("lines", "copied", "places", "classes", "marked", "pairs")
    has_drop = may_hold(drops, print_)
    touched = rows.where(has_drop(F.col(row))).join(drops, F.col(row) == F.col(print_), "left").drop(print_)
    same = rows.where(~has_drop(F.col(row))).withColumn(gone_, F.lit(None).cast("array<int>"))
    out = touched.unionByName(same)
    gone = F.coalesce(gone_, F.array().cast("array<int>"))
    parts = F.split(body, "\n", -1)
    left = F.when(F.size(gone) == 0, body).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n_lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"))) + 1
    return out.select(*kept, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), gone.alias("dropped"), left.alias("kept_text"))
