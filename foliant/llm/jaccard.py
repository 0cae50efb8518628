"""N-gram Jaccard join over size-banded tiles.

A document is the set of its distinct word shingles.  Two sets link when
their intersection is at least ``num/den`` of their union; their sizes then
lie in one band or in neighbouring ones.  Candidate keys depend on the threshold:

* From ``PARTS_FROM`` on, elements are dealt by their hash to more parts than
  linked sets of those bands can differ in, so that some part is the same in
  both; its elements together are the key.  A part holds several elements, so
  sets that share a passage or single shingles hardly ever share a key, however
  many there are.  Empty parts are no keys: a few more parts make up for them,
  and sets of more empty ones have prefixes (below) for keys too.
* Below, the rarest ``n - ceil(n num/den) + 1`` shingles of either set, in an
  order common to all, have one in common.  These prefixes are the keys.  The
  order comes from a table of fixed size that counts documents by hashed
  shingle: a passage that many documents share stands at the end of it, and
  hardly ever in a prefix.

Either way every link has a key.

A key's group is not expanded into pairs: its members are held against one of
them, the least, and hence mostly the same one for all keys of a group of
copies.  Members are combined on the mapping side first, so a key never has
more members there than there are mapping tasks' flushes; keys go through the
shuffle packed, by ranges of their values.  Members stand with their
hub in tiles of bounded size.  There hashed bitmaps bound the overlap from
above (each bit in which they differ is an element not shared); pairs that
pass are intersected exactly, as sorted arrays.

Where a key's members are in different components after that, they are
compared with each other in tiles of two blocks: bitmaps first, then, of
members that may link, the elements, until a link joins the components; a pair
needs neighbouring bands.  This makes components exact.  Blocks grow with the
group, so that its rows are not copied the more often the larger it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, NON_SPACE, Scratch, combine, grams, hash_words, mix64, salted, shuffle_partitions, slices, text_buffers, words_of
from .components import connected_components, joined_components
from .tiles import by_sorted_group

#: Keys a mapping task holds before it combines them, and classes it remembers.
FLUSH = 1 << 20
SEEN_AT_MOST = 1 << 20
#: Members of a hub in one tile, and of a key in one block.
TILE, BLOCK = 128, 1024
#: Larger groups have larger blocks, not more than so many, until one has so many members or elements.
BLOCKS, LARGEST, ELEMENTS = 4, 8192, 1 << 22
#: Counters of the common order, in rows of ``1 << ROW_BITS``; bits of the filter of wanted classes.
ORDER_BITS, ROW_BITS = 22, 14
#: Keys of more members are dealt to many tasks.
HOT = 4096
#: Ranges of keys (their upper bits), one of which is in memory at a time.
RANGE_BITS = 12
#: The least similarity (percent) at which equal parts are the keys; parts of a large set hold some six elements, at 90 some nine.
PARTS_FROM = 85
BLOOM_BITS = 22


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of all texts, ascending in each, and bounds."""
    raw, offsets = text_buffers(column)
    raw = LOWERED[raw]
    starts, ends, text = words_of(raw, offsets, NON_SPACE)
    h = hash_words(raw, starts, ends)
    g, at = grams(h, text, n)
    owner = text[at]
    rows = len(offsets) - 1
    few = np.bincount(text, minlength=rows)
    if ((few > 0) & (few < n)).any():
        for k in range(1, n):
            w, at = grams(h, text, k)
            whole = few[text[at]] == k
            g, owner = np.concatenate([g, w[whole]]), np.concatenate([owner, text[at][whole]])
        order = np.argsort(owner, kind="stable")
        g, owner = g[order], owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    for i in range(rows):
        g[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=rows))])


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2^64 (halves are exact in doubles)."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
    high = np.bincount(group, (values >> np.uint64(32)).astype(float), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def class_ids(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set; equal sets have equal ones."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return mix64(_sums(mix64(g), owner, len(bounds) - 1) + np.diff(bounds).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class Threshold:
    """Jaccard similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.by_parts = 100 * num >= PARTS_FROM * den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * den // num + 1)
        self.edges = np.array(edges, np.int64)
        # Parts are for sets of two spans at once, each two bands wide.
        self.spans = self.edges[::2]
        self.differ, self.spare = self._parts()

    def linked(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)

    def near_sizes(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def prefix(self, n):
        return n + self.num * n // -self.den + 1

    def band(self, n):
        """Sets that link are in one band or in neighbouring ones."""
        return np.searchsorted(self.edges, n, side="right")

    def _parts(self) -> tuple[np.ndarray, np.ndarray]:
        """By span: in how many elements linked sets differ at most, of which the smaller is of the span
        and the larger of it or the next one; and parts added to those, more than are mostly empty."""
        least, after, last = (self.spans[i : len(self.spans) - 2 + i].astype(float) for i in range(3))
        small, large = after - 1, np.minimum(np.floor((after - 1) * self.den / self.num), last - 1)
        differ = np.floor((small + large) * (self.den - self.num) / (self.den + self.num) + 1e-6)
        spare = np.ones(len(differ))
        for _ in range(20):
            parts = differ + 1 + spare
            empty = parts * np.exp(-least / parts)
            spare = np.ceil(np.minimum(np.maximum(1, empty + 4 * np.sqrt(empty)), 1 + least))
        return differ.astype(np.int64), spare.astype(np.int64)


def common_order(texts: DataFrame, shingle: int) -> np.ndarray:
    """A rank for each hashed shingle, greater for those of more documents.

    Counts of ``1 << ORDER_BITS`` counters are added up by rows; a rank is a
    quarter of a power of two.  Size of the result and of what a task holds
    do not depend on the input.
    """
    width = 1 << ROW_BITS

    def count(batches):
        seen = np.zeros(1 << ORDER_BITS, np.uint32)
        for s in slices(batches, "t", 2 << 20):
            at = (shingle_sets(s.column("t"), shingle)[0] & np.uint64(len(seen) - 1)).astype(np.int32)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            seen[at[first]] += np.diff(np.concatenate([first, [len(at)]])).astype(np.uint32)
        rows = [i for i in range(len(seen) // width) if seen[i * width : (i + 1) * width].any()]
        blobs = [zlib.compress(seen[i * width : (i + 1) * width].tobytes(), 1) for i in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["row", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row, blob in zip(b.column("row").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
        ranks = [np.floor(4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["row", "ranks"])

    summed = texts.mapInArrow(count, "row int, counts binary").repartition("row").mapInArrow(add, "row int, ranks binary")
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in summed.collect():  # 256 rows of 16 KB at most
        out[r["row"] * width : (r["row"] + 1) * width] = np.frombuffer(r["ranks"], np.uint8)
    return out


def prefixes(g: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): rank and 56 bits of the rarest shingles of every set."""
    order = (ranks[(g & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))
    sizes = np.diff(bounds)
    take = np.where(sizes > 0, limit.prefix(sizes), 0)
    out = [np.partition(order[lo : lo + n], t - 1)[:t] for lo, n, t in zip(bounds.tolist(), sizes.tolist(), take.tolist(), strict=False) if t]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64), np.concatenate([[0], np.cumsum(take)])


def candidate_keys(g: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds) of every set; linked sets that differ have one in common."""
    if not limit.by_parts:
        keys, at = prefixes(g, bounds, ranks, limit)
        return mix64(keys.view(np.uint64)).view(np.int64), at
    sizes = np.diff(bounds)
    span = np.searchsorted(limit.spans, sizes, side="right") - 1
    keys, owners = [], []
    sparse = np.zeros(len(sizes), bool)
    for down in (0, 1):  # as the smaller of two sets, and as one that may link with a set of the span before
        at = np.maximum(span - down, 0)
        may = (sizes > 0) & (span >= down) & (limit.differ[at] > 0)
        if down:
            may &= limit.near_sizes(limit.spans[span] - 1, sizes)
        parts = np.where(may, limit.differ[at] + 1 + limit.spare[at], 0)
        first = np.concatenate([[0], np.cumsum(parts)])
        owner = np.repeat(np.arange(len(sizes)), np.where(may, sizes, 0))
        own = g[np.repeat(may, sizes)]
        place = first[owner] + (((own >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(place, minlength=first[-1])
        of = np.repeat(np.arange(len(sizes)), parts)
        no = (np.arange(first[-1]) - first[of]).astype(np.uint64)
        seed = mix64((at[of].astype(np.uint64) << np.uint64(44)) + no)
        key = mix64(_sums(mix64(own), place, int(first[-1])) + seed)
        keys.append(key[count > 0])
        owners.append(of[count > 0])
        sparse |= may & (np.bincount(of, count == 0, len(sizes)) > limit.spare[at])
    some = np.where(sparse, sizes, 0)
    more, more_at = prefixes(g[np.repeat(sparse, sizes)], np.concatenate([[0], np.cumsum(some)]), np.zeros(1, np.uint8), limit)
    keys, owners = np.concatenate([*keys, mix64(more.view(np.uint64))]), np.concatenate([*owners, np.repeat(np.arange(len(sizes)), np.diff(more_at))])
    order = np.argsort(owners, kind="stable")
    return keys[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(sizes)))])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def hub_links(keys: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per key its least class, and the other classes of the key paired with it."""
    order = np.argsort(keys, kind="stable")
    keys, cls = keys[order], cls[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(cls, first) if len(first) else cls
    hub = np.repeat(least, np.diff(np.concatenate([first, [len(keys)]])))
    other = cls != hub
    return keys[first], least, *distinct_pairs(cls[other], hub[other])


def bitmap(g: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(g % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out)


def bits_for(size: int) -> int:
    """Four bits an element, at least 64, a power of two."""
    return 1 << max(6, int(4 * max(size, 1) - 1).bit_length())


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) at a narrower width: widths are powers of two and places are taken modulo the width."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, width), axis=1)


def at_most_shared(maps: list[np.ndarray], n: np.ndarray, one: np.ndarray, n_one: int) -> np.ndarray:
    """For every set the most elements that it can share with ``one``."""
    out = np.zeros(len(maps), np.int64)
    widths = np.array([len(m) for m in maps])
    for w in np.unique(widths):
        at, narrow = np.flatnonzero(widths == w), min(int(w), len(one))
        differ = np.bitwise_count(folded(np.stack([maps[i] for i in at]), narrow) ^ folded(one[None], narrow)).sum(1, dtype=np.int64)
        out[at] = (n[at] + n_one - differ) // 2
    return out


def shared(sets: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted arrays with ``one``."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.bincount(np.repeat(np.arange(len(sets)), sizes), hit, len(sets)).astype(np.int64)


def packed(keys: np.ndarray, cls: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """Ranges of ascending unsigned keys, and for each its keys and classes."""
    of = (keys >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=False))
    return of[cuts].tolist(), [keys[a:b].tobytes() for a, b in spans], [cls[a:b].tobytes() for a, b in spans]


_ROLE = {"key": 0, "pair": 1, "document": 2}


def link_documents(docs: DataFrame, num: int = 90, den: int = 100, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, n_shingles and component_id for every row.

    Words are runs of non-space characters, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; null, empty and blank texts are the
    empty set, which links with nothing, and are components of their own.
    Equal sets are one class.  ``component_id`` is the least key reachable by
    links.  Repeated rows are rows of one class; a null key is never least
    unless alone.  An empty table gives an empty result; other columns are
    not read.  Sets are compared as sets of 64-bit fingerprints.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    limit = Threshold(num, den)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    ranks = np.zeros(1, np.uint8) if limit.by_parts else common_order(rows.select("t"), shingle)

    def emit(role, at, a, b, ids, keys=None, classes=None):
        n, none = len(at), lambda t: pa.nulls(len(at), t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(at, pa.int64()), pa.array(np.full(n, _ROLE[role], np.int8)), none(pa.int64()) if a is None else pa.array(a), none(pa.int64()) if b is None else pa.array(b),
                ids, pa.array(keys, pa.binary()) if keys else none(pa.binary()), pa.array(classes, pa.binary()) if classes else none(pa.binary()),
            ],
            ["range", "role", "a", "b", "k", "keys", "classes"],
        )

    def offer(batches):
        seen: set[int] = set()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held, id_type = 0, None

        def flush():
            keys, cls, a, b = hub_links(np.concatenate([w[0] for w in waiting]).view(np.uint64), np.concatenate([w[1] for w in waiting]))
            at, blobs, members = packed(keys, cls)
            yield emit("key", at, None, None, pa.nulls(len(at), id_type), blobs, members)
            yield emit("pair", a ^ b, a, b, pa.nulls(len(a), id_type))

        for s in slices(batches, "t", 2 << 20):
            g, bounds = shingle_sets(s.column("t"), shingle)
            cls, sizes = class_ids(g, bounds), np.diff(bounds)
            id_type = s.schema.field("k").type
            yield emit("document", mix64(np.arange(len(cls), dtype=np.uint64) + np.uint64(cls[:1].view(np.uint64)[0] if len(cls) else 0)).view(np.int64), cls, sizes.astype(np.int64), s.column("k"))
            fresh = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if sizes[i] and c not in seen:
                    fresh[i] = True
                    seen.add(c)
            if len(seen) > SEEN_AT_MOST:
                seen.clear()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keys, at = candidate_keys(g[fresh[owner]], np.concatenate([[0], np.cumsum(sizes[fresh])]), ranks, limit)
            waiting.append((keys, np.repeat(cls[fresh], np.diff(at))))
            held += len(keys)
            if held >= FLUSH:
                yield from flush()
                waiting, held = [], 0
        if waiting:
            yield from flush()

    def meet(batches):
        """Rows come sorted by range; one range's keys are held at a time."""
        now, held, id_type = None, [], None

        def pairs():
            keys, cls = (np.frombuffer(b"".join(h[i] for h in held), t) for i, t in enumerate((np.uint64, np.int64)))
            _, _, a, c = hub_links(keys, cls)
            return emit("pair", a ^ c, a, c, pa.nulls(len(a), id_type))

        for b in batches:
            role, id_type = b.column("role").to_numpy(), b.schema.field("k").type
            yield b.filter(pa.array(role != _ROLE["key"]))
            has = b.filter(pa.array(role == _ROLE["key"]))
            for at, keys, classes in zip(*(has.column(c).to_pylist() for c in ("range", "keys", "classes")), strict=True):
                if held and at != now:
                    yield pairs()
                    held = []
                now = at
                held.append((keys, classes))
        if held:
            yield pairs()

    schema = f"range long, role tinyint, a long, b long, k {kind}, keys binary, classes binary"
    dealt = rows.mapInArrow(offer, schema).repartition(2 * shuffle_partitions(spark), "range").sortWithinPartitions("role", "range").mapInArrow(meet, schema)
    dealt = scratch.write(dealt.drop("keys", "classes"), "dealt", ["role"])
    members = dealt.where(F.col("role") == _ROLE["document"]).select("k", F.col("a").alias("cls"), F.col("b").alias("n"))
    pairs = scratch.write(dealt.where(F.col("role") == _ROLE["pair"]).select("a", "b").distinct(), "pairs")
    scratch.drop(f"dealt/role={_ROLE['pair']}")
    sets = _sets_of(rows.select("t"), pairs, shingle, scratch)

    maybe = scratch.write(_with_hubs(pairs, sets, "m", limit), "maybe")
    scratch.drop("pairs")
    links = scratch.write(_with_hubs(maybe, sets, "g", limit), "links")
    scratch.drop("maybe")
    roots = connected_components(links, scratch)
    more = _across_components(sets, roots, ranks, limit, scratch)
    if more is not None:
        roots = joined_components(roots, more, scratch)
    scratch.drop("sets", "links", "across")
    known = members.where("n > 0").join(roots, members["cls"] == roots["node"], "left").select("k", F.coalesce("root", "cls").alias("comp"))
    least = known.groupBy("comp").agg(F.min("k").alias("component"))
    by_class = roots.select("node", "root").join(least.withColumnRenamed("comp", "root"), "root").select(F.col("node").alias("cls"), "component")
    single = least.join(roots.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("cls"), "component")
    info = by_class.unionByName(single).select(F.col("cls").alias("c"), "component")
    out = members.join(info, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k")).alias("component_id"))


def _sets_of(texts: DataFrame, pairs: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(cls, g, m, n): sorted fingerprints, bitmap and size of every class in ``pairs``.

    A bitmap of fixed size lets through all texts of such classes and few others.
    """
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    bit = F.col("cls").bitwiseAND((1 << BLOOM_BITS) - 1)
    marks = wanted.select((bit / 32768).cast("int").alias("w"), (bit % 32768).cast("long").alias("b")).groupBy("w").agg(F.bitmap_construct_agg("b").alias("m"))
    marked = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    for r in marks.collect():  # 128 rows of 4 KB at most
        marked[r["w"] * 4096 : r["w"] * 4096 + 4096] = np.frombuffer(r["m"], np.uint8)[:4096]

    def pick(batches):
        seen: set[int] = set()
        for s in slices(batches, "t", 2 << 20):
            g, bounds = shingle_sets(s.column("t"), shingle)
            cls = class_ids(g, bounds)
            out, sets, maps = [], [], []
            spot = cls & ((1 << BLOOM_BITS) - 1)
            for i in np.flatnonzero((marked[spot >> 3] >> (spot & 7).astype(np.uint8)) & (np.diff(bounds) > 0)):
                if (c := int(cls[i])) not in seen:
                    seen.add(c)
                    out.append(c)
                    own = g[bounds[i] : bounds[i + 1]]
                    sets.append(own.tobytes())
                    maps.append(bitmap(own, bits_for(len(own))).tobytes())
            if len(seen) > SEEN_AT_MOST:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.binary()), pa.array(maps, pa.binary())], ["cls", "g", "m"])

    found = texts.mapInArrow(pick, "cls long, g binary, m binary").join(wanted, "cls", "left_semi")
    return scratch.write(found.groupBy("cls").agg(F.first("g").alias("g"), F.first("m").alias("m")).withColumn("n", (F.length("g") / 8).cast("long")), "sets")


def _dealt(sets: DataFrame) -> DataFrame:
    """Sets that a join deals by class: near copies take far less room in a file than in the driver, which a broadcast goes through."""
    return sets.hint("merge")


def _with_hubs(pairs: DataFrame, sets: DataFrame, column: str, limit: Threshold) -> DataFrame:
    """Those of ``pairs(a, b)``, b a hub, that may link by bitmaps ("m") or do link by their elements ("g").

    A tile is a hub and at most about ``TILE`` of its members; the hub stands in it once.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("size"))
    large = counts.where(F.col("size") > TILE).select("b", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    small = pairs.join(large, "b", "left_anti").select("a", "b", F.xxhash64("b", F.lit(0)).alias("tile"))
    split = salted(pairs, ["b"], "a", large).select("a", "b", F.xxhash64("b", F.pmod(F.hash("a"), F.col("blocks"))).alias("tile"))
    placed = small.unionByName(split)
    hubs = placed.select("tile", F.col("b").alias("cls"), F.lit(True).alias("hub")).distinct()
    rows = placed.select("tile", F.col("a").alias("cls"), F.lit(False).alias("hub")).unionByName(hubs)
    rows = rows.join(_dealt(sets.select("cls", "n", F.col(column).alias("v"))), "cls")

    def compare(t: pa.Table) -> list[pa.RecordBatch]:
        hub = t.column("hub").to_numpy(zero_copy_only=False)
        cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
        values = [np.frombuffer(v.as_buffer(), np.uint8 if column == "m" else np.uint64) for v in t.column("v")]
        out = []
        for h in np.flatnonzero(hub):
            at = np.flatnonzero(~hub & limit.near_sizes(n, n[h]))
            if not len(at):
                continue
            near = [values[i] for i in at]
            both = at_most_shared(near, n[at], values[h], int(n[h])) if column == "m" else shared(near, values[h])
            at = at[limit.linked(both, n[at], n[h])]
            out.append(pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(np.full(len(at), cls[h]))], ["a", "b"]))
        return out

    return by_sorted_group(rows, "tile", compare, "a long, b long")


def _members(frame: DataFrame, few: DataFrame) -> DataFrame:
    """``frame`` joined with ``few(key, size, ...)`` on the key; rows of keys of great size are dealt to many tasks.

    Others are not copied for that: copies of all would be far more than Spark
    reckons with when it decides on a broadcast, which the driver holds.
    """
    large = few.where(F.col("size") > HOT)
    out = frame.join(few.where(F.col("size") <= HOT), "key").drop("size")
    return out.unionByName(salted(frame, ["key"], "cls", large).drop("size")) if large.take(1) else out


def _blocks(n: Column, elements: Column) -> Column:
    return F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / LARGEST), F.ceil(elements / ELEMENTS)).cast("int")


def _across_components(sets: DataFrame, roots: DataFrame, ranks: np.ndarray, limit: Threshold, scratch: Scratch) -> DataFrame | None:
    """Links between members of one key that are in different components so far.

    Of keys with the same members one is enough.  A key's largest component is
    not compared with itself: its members stand in blocks of their own, and a
    tile is two blocks of which one at least holds others.
    """

    def keys_of(batches):
        for b in batches:
            blobs = [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column("g")]
            bounds = np.concatenate([[0], np.cumsum([len(v) for v in blobs])]).astype(np.int64)
            keys, at = candidate_keys(np.concatenate(blobs) if blobs else np.zeros(0, np.uint64), bounds, ranks, limit)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))], ["cls", "n", "keys"])

    keyed = sets.select("cls", "g").mapInArrow(keys_of, "cls long, n long, keys array<long>")
    keyed = keyed.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("comp"), F.explode("keys").alias("key"))
    print_ = F.bit_xor(F.xxhash64("cls")).alias("print")
    keys = keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), print_, F.count("*").alias("size")).where("lo <> hi")
    keys = scratch.write(keys.groupBy("print", "size").agg(F.min("key").alias("key")).select("key", "size"), "keys")
    if not keys.take(1):
        return None
    member = scratch.write(_members(keyed, keys), "members")
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("elements"))
    groups = sizes.groupBy("key").agg(F.max(F.struct("count", "comp", "elements")).alias("main"), F.sum("count").alias("all"), F.sum("elements").alias("elements"))
    others = _blocks(F.col("all") - F.col("main.count"), F.col("elements") - F.col("main.elements"))
    groups = groups.select("key", F.col("all").alias("size"), F.col("main.comp").alias("main"), _blocks(F.col("main.count"), F.col("main.elements")).alias("mains"), others.alias("others"))
    member = _members(member, scratch.write(groups, "groups"))
    is_main = F.col("comp") == F.col("main")
    member = member.withColumn("is_main", is_main).withColumn("block", F.pmod(F.xxhash64("cls"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)

    def tile(what: str, lo: Column, hi: Column) -> Column:
        return F.xxhash64("key", F.lit(what), lo, hi)

    block = F.col("block")
    with_main = F.transform(span(F.col("mains")), lambda i: tile("main", block, i))
    with_other = F.transform(span(F.col("others")), lambda i: tile("other", F.least(block, i), F.greatest(block, i)))
    from_main = F.transform(span(F.col("others")), lambda i: tile("main", i, block))
    # Others of one block meet in each of its tiles already.
    tiles = F.when(F.col("is_main"), from_main).when(F.col("others") == 1, with_main).otherwise(F.concat(with_main, with_other))
    placed = scratch.write(member.select("cls", "comp", F.explode(tiles).alias("tile")), "tiles")

    def candidates(t: pa.Table) -> list[pa.RecordBatch]:
        """Members of which the bitmaps allow a link to another component."""
        comp, n = t.column("comp").to_numpy(), t.column("n").to_numpy()
        maps, band = [np.frombuffer(v.as_buffer(), np.uint8) for v in t.column("m")], limit.band(n)
        widths = np.array([len(m) for m in maps])
        same = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        whole = {w: np.stack([maps[i] for i in at]) for w, at in same.items()}
        at_width = {(w, v): folded(whole[w], v) for w in same for v in same if v <= w}
        hit = np.zeros(len(n), bool)
        for i in range(len(n)):
            for w, at in same.items():
                narrow = min(w, int(widths[i]))
                differ = np.bitwise_count(at_width[w, narrow] ^ folded(maps[i][None], narrow)).sum(1, dtype=np.int64)
                near = (at > i) & (comp[at] != comp[i]) & (abs(band[at] - band[i]) <= 1) & limit.near_sizes(n[at], n[i])
                near &= limit.linked((n[at] + n[i] - differ) // 2, n[at], n[i])
                hit[at[near]] = True
                hit[i] |= near.any()
        return [t.select(["tile", "cls", "comp"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]] if hit.any() else []

    near = by_sorted_group(placed.join(_dealt(sets.select("cls", "n", "m")), "cls"), "tile", candidates, "tile long, cls long, comp long")
    # Elements are sent for such members alone.
    placed = scratch.write(near, "near").join(_dealt(sets.select("cls", "g")), "cls")

    def compare(t: pa.Table) -> list[pa.RecordBatch]:
        cls = t.column("cls").to_numpy()
        names, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        g = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("g")]
        n = np.array([len(x) for x in g])
        band, maps = limit.band(n), np.stack([bitmap(x, bits_for(int(n.max()))) for x in g])
        label, links = np.arange(len(names)), []
        for i in range(len(cls) - 1):
            later = np.arange(i + 1, len(cls))
            later = later[(label[comp[later]] != label[comp[i]]) & (abs(band[later] - band[i]) <= 1) & limit.near_sizes(n[later], n[i])]
            if not len(later):
                continue
            differ = np.bitwise_count(maps[later] ^ maps[i]).sum(1, dtype=np.int64)
            later = later[limit.linked((n[later] + n[i] - differ) // 2, n[later], n[i])]
            if not len(later):
                continue
            for j in later[limit.linked(shared([g[j] for j in later], g[i]), n[later], n[i])]:
                x, y = label[comp[i]], label[comp[j]]
                if x != y:  # one link joins two components; more of them say nothing new
                    label[label == x] = y
                    links.append((cls[i], cls[j]))
        a, b = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
        return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])]

    links = scratch.write(by_sorted_group(placed, "tile", compare, "a long, b long"), "across")
    scratch.drop("keys", "members", "groups", "tiles", "near")
    return links
