"""Each operator against a plain brute force, on rows with every awkward case."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliant.llm.decontaminate import contamination
from foliant.llm.jaccard import link_documents
from foliant.llm.licenses import RULES, detect, scan_licenses
from foliant.llm.lines import dedup_lines
from foliant.llm.lm import from_blob, learn_weights, score_documents, to_blob
from foliant.llm.packing import nonnegative_least_squares, pack, plan
from foliant.llm.sharding import ring_of, shard_documents
from foliant.llm.toxicity import calibrated, fit_trees, isotonic, score_toxicity
from foliant.llm.urlfilter import judge_urls
from foliant.llm.vectors import near_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, labels string, shard int, n_words string, k string, t string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.RandomState(5)
    long_ = prose(rng, 30_000, 5000)
    base = prose(rng, 300, 3000)
    words = base.split()
    near = []
    for n in (3, 10, 14, 20, 60):
        w = list(words)
        for i in rng.choice(len(w), n, replace=False):
            w[i] = f"x{n}_{i}"
        near.append(" ".join(w))
    lines = "A line that many documents share, word for word.\n"
    return [
        None, "", "   ", "\n\n", "one", "two words", "Éa ß 中文 \x00 tab\tx", long_, base, base, base, *near, base + " tail",
        lines + prose(rng, 40), prose(rng, 40) + "\n" + lines, "A line that many documents share; word for WORD!\n" + prose(rng, 30),
        "Released under the MIT License. mit license, MIT  license", "GNU General Public License, version 3", "<|endoftext|> x  y", *(prose(rng, 20 + 7 * i) for i in range(20)),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", 7, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[8], None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://A.Org/x", "http://org/", "http://org", "http://forg/", "https://blog.EXAMPLE.org/es/1?x#y", "http://example.org/en/12#z",
        "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "ftp://com/de/a?b", "http://a.b.com./fr/", "x://y://z/w", "http://example.org/" + "a" * 50_000, "http://" + "a." * 5000 + "org/q", "http://example.org/es/\nline",
    ]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[5], "again")] * 2, "page_id long, url string, host string")
    got = collections.Counter(tuple(r) for r in judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
    want = collections.Counter()
    for r in df.collect():
        rest = r.url[r.url.index("://") + 3 :] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        want[(r.page_id, host, path, rule, verdict)] += 1
    assert got == want
    assert judge_urls(df.limit(0)).count() == 0


def test_license_base_and_labels(docs, none):
    found = scan_licenses(docs)
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in found.collect())
    want = collections.Counter()
    for i, t in rows_of(docs):
        w = alnum(t)
        spots = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in spots]
        want[(i, len(w), len(spots), min(at, default=None), max(at, default=None), tuple(sorted({x for _, x in spots})))] += 1
    assert got == want
    assert {r.doc_id: tuple(r.labels) for r in found.where("size(labels) > 0").collect()} == {20: ("mit",), 21: ("gpl", "gpl-3.0")}
    assert found.where("score < 0 or score > 1").count() == 0
    assert scan_licenses(none).count() == 0


def test_license_suppression():
    assert len(RULES) > 300
    assert [r.label for _, _, r in detect("licensed under the apache license version 2 0", RULES)] == ["apache-2.0"]
    assert [r.label for _, _, r in detect("gnu lesser general public license version 2 1 and mit license", RULES)] == ["lgpl-2.1", "mit"]
    assert detect("a plain sentence about nothing", RULES) == []


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_base_and_model(docs, none, order):
    got = {}
    for r in score_documents(docs, order=order).collect():
        got.setdefault(r.doc_id, r)
    rows = rows_of(docs)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    counts = collections.Counter(w for i, t in rows if fold(i) for w in [*spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        ts = [*spaced(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 0, len(ts), sum(counts[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts))
        assert r.score < 0 and math.isfinite(r.score)
    assert score_documents(none, order=order).count() == 0


def test_lm_bigram_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after one context, with its weights."""
    train = [(i, "a b a c a b") for i in range(40)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    probe = [i for i in range(1000, 4000) if fold(i) == 0][:5]
    rows = train + list(zip(probe, ["a a", "a b", "a c", "a", "a zzz"], strict=True))
    s = {r.doc_id: 10**r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = s[probe[3]]
    assert s[probe[1]] > s[probe[4]] and 0 < first < 1


def test_lm_parts():
    x = np.sort(np.random.RandomState(0).randint(0, 2**62, 500).astype(np.uint64))
    assert (from_blob(to_blob(x, True), True) == x).all() and (from_blob(to_blob(x)) == x).all() and len(from_blob(to_blob(x[:0]))) == 0
    import pandas as pd

    w = learn_weights(pd.DataFrame({"bucket": [3], "q0": [-8], "q1": [-80], "q2": [-160], "n": [1000]}), 3)
    assert w[3].argmax() == 0 and w.sum(1) == pytest.approx(1)


@pytest.mark.parametrize("shards", [1, 8, 100])
def test_sharding_rows(docs, none, shards):
    out = shard_documents(docs, shards=shards).toPandas()
    rows = rows_of(docs)
    assert collections.Counter(zip(out["size"], out["text_crc32"], strict=True)) == collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    counts = [int((out["shard"] == s).sum()) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert out["grown_shard"].isna().all() and set(out["law"]) == {"rows"}
    assert shard_documents(none, shards=shards).count() == 0


def test_sharding_is_the_serial_admission(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r.doc_id: r.shard for r in shard_documents(df, shards=8, slack=0.1).collect()}
    keys = df.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64("doc_id", F.lit("admission")).alias("t")).collect()
    bins = 16
    keys.sort(key=lambda r: (((r.t % 2**64) >> 32) * bins >> 32, r.t))
    points, owners = ring_of(8, 32)
    capacity, load = math.ceil(1.1 * 500 / 8), [0] * 8
    for r in keys:
        i = int(np.searchsorted(points, np.uint64(r.a % 2**64))) % len(points)
        while load[owners[i]] >= capacity:
            i = (i + 1) % len(points)
        load[owners[i]] += 1
        assert got[r.doc_id] == owners[i]


def test_sharding_bytes(docs):
    out = shard_documents(docs.where("length(text) < 10000"), shards=3, law="bytes").toPandas()
    assert len(out) == docs.where("length(text) < 10000").count()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() <= out["size"].sum() / 3 + out["size"].max()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(docs, none):
    got = dedup_lines(docs).select("doc_id", "text", "n_lines", "dropped", "kept_text").collect()
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    kept = collections.Counter()
    all_lines = set()
    seen = set()
    for r in got:
        lines = [] if r.text is None else r.text.split("\n")
        assert r.n_lines == len(lines)
        assert r.kept_text == (None if r.text is None else "\n".join(x for i, x in enumerate(lines) if i not in r.dropped))
        assert list(r.dropped) == sorted(set(r.dropped))
        for i, x in enumerate(lines):
            n = norm(x)
            if len(n.split()) < 3:
                assert i not in r.dropped
            else:
                all_lines.add(n)
                if i not in r.dropped and (r.doc_id, i) not in seen:
                    seen.add((r.doc_id, i))
                    kept[n] += 1
    assert max(kept.values()) == 1, "an exact copy stayed"
    for gone in all_lines - set(kept):
        close = [k for k in kept if abs(len(k) - len(gone)) < 0.4 * len(gone)]
        words = gone.split()
        assert any(edit(words, k.split()) <= 0.45 * max(len(words), len(k.split())) for k in close), "dropped without a near line"
    assert sum("that many documents share" in k for k in kept) == 1
    assert dedup_lines(none).count() == 0


def jaccard_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    out = collections.Counter()
    for i, (k, _) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        out[(k, len(sets[i]), (min(known) if known else None) if sets[i] else k)] += 1
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard_components(docs, none, n, num):
    got = collections.Counter(tuple(r) for r in link_documents(docs, num=num, den=100, shingle=n).collect())
    assert got == jaccard_components(rows_of(docs), n, num, 100)
    assert link_documents(none, num=num, shingle=n).count() == 0


def test_jaccard_chains_and_crowds(spark):
    """Chains whose ends don't link, and groups linked only through middle members."""
    rng = np.random.RandomState(3)
    rows = []
    for _ in range(6):
        w = prose(rng, 200, 100_000).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(w)))
            for i in rng.choice(len(w), rng.randint(1, 6), replace=False):
                w[i] = f"y{rng.randint(10**9)}"
    got = collections.Counter(tuple(r) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == jaccard_components(rows, 3, 90, 100)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=256).toPandas()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows_of(df)}
    assert set(out["doc_id"]) == set(ids)
    for i, g in out.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    assert 50256 in ids[22], "an added token in a text is one id"
    short = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 256
        short += 256 - g["length"].sum()
    assert short <= 256 + 8 * out["sequence_id"].nunique()
    assert pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() > len(ids)


def test_packing_plan_covers_all_lengths():
    rng = np.random.RandomState(1)
    for h in (np.zeros(1025, int), np.eye(1, 1025, 700, dtype=int)[0] * 1000, np.r_[0, rng.poisson(200, 1024)], np.r_[0, rng.poisson(0.05, 1024)]):
        rules = plan(h, 1024)
        seen = np.zeros_like(h)
        for length, lo, hi, *_ in sorted(rules):
            assert lo == seen[length]
            seen[length] = hi
        assert (seen == h).all()
    x = nonnegative_least_squares([(1, 3), (2, 2)], np.array([0, 5.0, 8.0, 5.0]), 2000)
    assert x == pytest.approx([5, 4], abs=0.05)


def test_contamination(spark, docs, none):
    base = alnum(rows_of(docs.where("doc_id = 8"))[0][1])
    items = [(1, " ".join(base[20:50])), (2, "two words"), (3, None), (4, ""), (5, " ".join(base[:12])), (6, "never seen " * 10), (None, " ".join(base[100:113])), (2, "mit license"), (7, "ONE"), (7, "one")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, n_words string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in contamination(docs, bench).collect())
    want = collections.Counter()
    for k, t in rows_of(docs):
        w, hit, names = alnum(t), set(), set()
        for i, x in items:
            b = alnum(x)
            n = min(13, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    names |= {str(i)} if i is not None else set()
        want[(k, len(w), len(hit), tuple(sorted(names)))] += 1
    assert got == want
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_toxicity_learns_and_leaves_labels_out(spark):
    rng = np.random.RandomState(2)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        w = prose(rng, 60, 800).split()
        if bad:
            for _ in range(3):
                w[rng.randint(60)] = ["zorg", "blikk", "snarp"][rng.randint(3)]
        rows.append((i, " ".join(w), bool(bad)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([r[:2] + ("clash",) for r in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(docs, lab).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    right = np.mean([out[i].predicted == rows[i][2] for i in held])
    assert right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in score_toxicity(docs, flipped).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_toxicity_edges(docs, none, spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    out = score_toxicity(docs, lab).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert score_toxicity(none, lab).count() == 0
    k, v = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]))
    assert (np.diff(v) > 0).all() and (np.diff(calibrated(np.linspace(-1, 1, 50), (k, v))) > 0).all()
    trees = fit_trees(np.arange(200.0)[:, None], (np.arange(200) > 99).astype(float), bins=256)
    assert ((trees.raw(np.arange(200.0)[:, None]) > 0) == (np.arange(200) > 99)).all()


def test_vectors_against_brute_force(spark):
    rng = np.random.RandomState(4)
    centres = rng.normal(size=(30, 24))
    rows = []
    for i in range(900):
        c = centres[i % 30] + rng.normal(size=24) * rng.choice([0.02, 0.25, 2.0])
        rows.append((i, [float(x) for x in c], int(i % 3) if i % 11 else None))
    hot = [float(x) for x in centres[0]]
    rows += [(1000 + i, hot, 0) for i in range(300)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [None] * 24, 1), (2005, [1.0, 2.0], 1), (5, rows[5][1], rows[5][2]), (2006, [1e-300] * 24, 1), (2007, [1.0] * 24, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    got = [tuple(r) for r in near_vectors(df).collect()]
    ok = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    total = sum(map(len, links.values()))
    assert 0.9 * total <= sum(r[1] for r in got) <= total
    component = {}
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            new = links[stack.pop()] - seen
            seen |= new
            stack += new
        component[rows[i][0]] = min(rows[j][0] for j in seen)
    assert np.mean([r[2] == component[r[0]] for r in got]) > 0.95
    assert all(r[3] == (r[0] == r[2]) for r in got) and len(got) == len(rows)
    assert near_vectors(df.limit(0)).count() == 0
