"""Operators against plain Python on seeded random input and stated cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import hashing, replies, text
from foliant.operators import catalog, chunking, pages, ranking, toc, tree
from foliant.operators.replay import REPLAY, replay, response_text
from foliant.plans.budget import Budget, split

import pandas as pd


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("s", "n"), [("", 0), ("a", 1), ("one two three", 3), ("é" * 10, 5), ("a b c d e f g h i j", 13), ("  ", 1)])
def test_approx_tokens(spark, s, n):
    assert one(spark, text.approx_tokens(F.lit(s))) == n


@pytest.mark.parametrize(("s", "bad"), [("PDF", True), ("book", False), ("GGlloobbaall WWaarrmmiinngg", True), ("", True), ("Annual Report", False)])
def test_mojibake(spark, s, bad):
    assert one(spark, text.is_mojibake_title(F.lit(s))) is bad


@pytest.mark.parametrize(
    ("line", "head"),
    [("OVERVIEW", True), ("1. Background", True), ("2.3 Methods", True), ("Chapter IV", True), ("appendix b", True), ("Plain prose line", False), ("A.", False), ("ÉTÉ ÇA", True), ("TITLE,", False), ("TITLE.", False), ("X" * 81, False), ("", False), ("Article 5 of law;", False)],
)
def test_text_heading(spark, line, head):
    assert one(spark, text.is_text_heading(F.lit(line))) is head


@pytest.mark.parametrize(
    ("line", "hit"),
    [("All Rights Reserved.", True), ("arXiv:2401.01234v2 [cs.CL]", True), ("scholarly works.", True), ("many scholarly works were read in this long line", False), ("arxiv: none", False)],
)
def test_boilerplate(spark, line, hit):
    assert one(spark, text.is_boilerplate(F.lit(line))) is hit


def test_letter_spacing(spark):
    assert one(spark, text.join_letter_spacing(F.lit("U N I T E D   S T A T E S"))) == "UNITED STATES"
    assert one(spark, text.join_letter_spacing(F.lit("a plain line"))) == "a plain line"


def test_text_helpers(spark):
    assert one(spark, text.clip_bytes(F.lit("aéé"), 2)) == "a" and one(spark, text.clip_bytes(F.lit("aéé"), 3)) == "aé"
    assert one(spark, text.fallback_summary(F.lit("T"), F.lit("  \n"))) == "T"
    assert one(spark, text.fallback_summary(F.lit("T"), F.lit("x " * 200))) == " ".join(["x"] * 120) + " …"
    assert one(spark, text.clean_for_model(F.lit("a\x00b\x07\tc\n"))) == "ab\tc\n"
    assert text.decode_lossy(b"\xff\xfe\xe2\x82") == "�" * 4 and text.decode_lossy("é".encode()) == "é"
    assert one(spark, text.table_markdown(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1"))))) == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, text.page_table_markdown(F.array(F.array(F.lit("a|b")), F.array(F.lit(" "))))) == "| a&#124;b |\n| --- |"
    assert one(spark, text.json_object(F.lit("Sure: ```json\n{\"a\": {}}\n``` ok"))) == '{"a": {}}'
    assert one(spark, text.clean_paragraphs(F.lit("a  b\n\n \n\nc"))) == "a b\n\nc"
    assert one(spark, text.first_line(F.lit("\n  \n x y \nz"))) == "x y"


def test_trace_token(spark):
    token = lambda ids: one(spark, hashing.trace_token(F.lit("d"), F.lit("1"), F.lit("m"), F.array(*map(F.lit, ids)).cast("array<string>")))
    want = hashlib.sha256(b"d\x001\x00m\x00v1\x00a\x00b").hexdigest()
    assert token(["a", "b"]) == token(["b", "a"]) == want
    assert token([]) == hashlib.sha256(b"d\x001\x00m\x00v1\x00").hexdigest()
    assert token(["a", "b"]) != token(["a\0b", "c"])


def random_levels(rng, n, most):
    return [rng.randint(1, most) for _ in range(n)]


def test_hierarchy_is_the_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(60):
        stack = []
        for i, level in enumerate(random_levels(rng, rng.randint(1, 25), 8)):
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[(f"d{d}", i)] = stack[-1][0] if stack else None
            stack.append((i, level))
            rows.append((f"d{d}", i, level))
    got = tree.parents_by_level(spark.createDataFrame(rows, "document_id string, seq long, level int"))
    assert {(r.document_id, r.seq): r.parent_seq for r in got.collect()} == want


SECTION = "document_id string, id string, parent_id string, ordinal int, title string, summary string, token_count long, page_start int, page_end int"


def forest(rng, docs=12):
    rows = []
    for d in range(docs):
        kids = {}
        for i in range(rng.randint(1, 20)):
            up = f"s{rng.randrange(i)}" if i and rng.random() < 0.85 else ""
            n = kids[up] = kids.get(up, -1) + 1
            rows.append((f"d{d}", f"s{i}", up, n, f"T{i}", "", rng.randint(0, 120), rng.choice([0, 0, rng.randint(1, 9)]), rng.choice([0, rng.randint(1, 9)])))
        rows.append((f"d{d}", "orphan", "missing", 0, "O", "", 5, 1, 1))
    return rows


def walk(rows, doc, up="", depth=0):
    for r in sorted((r for r in rows if r[0] == doc and r[2] == up), key=lambda r: r[3]):
        yield r, depth
        yield from walk(rows, doc, r[1], depth + 1)


def test_view_rollups_and_pages(spark):
    rows = forest(random.Random(2))
    viewed = tree.view(spark.createDataFrame(rows, SECTION)).cache()
    got = {(r.document_id, r.id): (r.view_depth, r.preorder) for r in viewed.collect()}
    want = {}
    for d in {r[0] for r in rows}:
        tops = sum(r[0] == d and r[2] == "" for r in rows)
        for n, (r, depth) in enumerate(walk(rows, d), 1):
            want[(d, r[1])] = (depth + (tops > 1), n)
    assert got == want
    span = {(r.document_id, r.id): (r.page_start, r.page_end) for r in tree.propagate_pages(viewed).collect()}
    for d, i in want:
        below = [r for r, _ in walk(rows, d, i)] + [r for r in rows if (r[0], r[1]) == (d, i)]
        assert span[(d, i)] == (min((r[7] for r in below if r[7]), default=0), max(r[8] for r in below))


def test_compact_and_chains(spark):
    rows = [
        ("d", "root", "", 0, "Root", "", 0, 0, 0), ("d", "c1", "root", 0, "One", "", 0, 0, 0), ("d", "a", "c1", 0, "A", "", 200, 0, 0), ("d", "b", "c1", 1, "B", "", 30, 0, 0),
        ("d", "c", "c1", 2, "C", "", 10, 0, 0), ("d", "c2", "root", 1, "Two", "", 0, 0, 0), ("d", "e", "c2", 0, "E", "", 500, 0, 0), ("d", "c3", "root", 2, "Three", "", 5, 0, 0),
    ]
    viewed = tree.view(spark.createDataFrame(rows, SECTION))
    small = tree.compact(viewed.withColumn("summary_axes", F.lit("")).withColumn("candidate_questions", F.lit("")), 50)
    assert {r.id for r in small.collect()} == {"root", "c1", "a", "c2", "e"}
    merged = {r.id: (r.title, r.token_count, r.parent_id) for r in tree.merge_single_children(viewed).collect()}
    assert merged["e"] == ("Two > E", 500, "root") and "c2" not in merged and merged["a"] == ("A", 200, "c1")
    shallow = tree.compact(viewed.withColumn("summary_axes", F.lit("")).withColumn("candidate_questions", F.lit("")), 1, 2)
    assert {r.id: r.token_count for r in shallow.collect()} == {"root": 0, "c1": 240, "c2": 500, "c3": 5}


def test_summaries_go_bottom_up(spark):
    rows = [("d", "r", "", 0, "R", "", 0, 0, 0), ("d", "a", "r", 0, "A", "", 1, 0, 0), ("d", "b", "r", 1, "B", "kept", 1, 0, 0), ("d", "e", "r", 2, "Empty", "", 0, 0, 0)]
    viewed = tree.view(spark.createDataFrame(rows, SECTION)).withColumn("content", F.when(F.col("id") == "a", "text of a"))
    got = {r.id: r.summary for r in tree.summarise(viewed, lambda p: F.concat(F.lit("<"), F.replace(p, F.lit("\n"), F.lit("|")), F.lit(">"))).collect()}
    assert got["a"] == "<A|text of a>" and got["b"] == "kept" and got["e"] == "Empty"
    assert got["r"] == "<R|This section's subsections, each with a short summary:|- A: <A|text of a>|- B: kept|- Empty: Empty>"


def test_clamp_and_budget(spark):
    cases = [((0, 0, 9), None), ((-1, 3, 9), (1, 3)), ((4, 0, 9), (4, 4)), ((7, 2, 9), (2, 7)), ((10, 12, 9), None), ((5, 20, 9), (5, 9)), ((5, 20, 0), (5, 20))]
    for (s, e, last), want in cases:
        got = one(spark, pages.clamp_range(F.lit(s), F.lit(e), F.lit(last)))
        assert (tuple(got) if got else None) == want
    df = spark.createDataFrame([("d", i, p) for i, p in enumerate(["abcd", "efgh", "ij", "kl"])], "document_id string, pos int, piece string")
    r = pages.clip_to_budget(df, ["document_id"], "pos", 8).first()
    assert (r.text, r.used) == ("abcdefgh", [0, 1, 2])
    assert pages.indexed_text(spark.createDataFrame([("d", 1, "x"), ("d", 2, "y" * 50)], "document_id string, page_number int, text string"), 60).first().text == "<physical_index_1>\nx\n</physical_index_1>\n"
    assert one(spark, pages.physical_index(F.lit("<physical_index_12>"))) == 12 and one(spark, pages.physical_index(F.lit("none"))) == 0


def test_toc_paths(spark):
    nodes = [("1", "Part I", 1), ("2", "Part II", 10), ("2.1", "Item 7", 10), ("2.2", "Item 8", 40), ("2.2.1", "Balance", 41), ("2.2.2", "Cash", 43), ("2.2.3", "Notes", 46), ("3", " ", 60)]
    flat = spark.createDataFrame([("d", i, s, t, p) for i, (s, t, p) in enumerate(nodes)], "document_id string, pos int, structure string, title string, start_page int")
    built = toc.assemble(flat).cache()
    assert [r.depth for r in built.orderBy("toc_seq").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert built.where("title = 'Balance'").first().node_id == "toc_2_2.2_2.2.1"
    ended = toc.end_pages(built, spark.createDataFrame([("d", 60)], "document_id string, last_page int"))
    assert {r.title: r.end_page for r in ended.collect()} == {"Part I": 9, "Part II": 60, "Item 7": 39, "Item 8": 60, "Balance": 42, "Cash": 45, "Notes": 60}
    titled = pages.toc_title_paths(pages.resolve_toc_ends(ended)).withColumnRenamed("start_page", "start")
    asked = spark.createDataFrame([("d", "x", 41, 41), ("d", "y", 50, 50), ("d", "z", 5, 12), ("d", "none", 0, 0)], "document_id string, id string, page_start int, page_end int")
    got = {r.id: list(r.title_path) for r in pages.heading_paths(asked, titled).collect()}
    assert got == {"x": ["Part II", "Item 8", "Balance"], "y": ["Part II", "Item 8", "Notes"], "z": ["Part II", "Item 7"]}
    skip = spark.createDataFrame([("d", 0, "1", "a", 1), ("d", 1, "1.1.1", "b", 1), ("d", 2, "1.1.2", "c", 1)], flat.schema)
    assert {r.title: r.parent_seq for r in toc.assemble(skip).collect()} == {"a": None, "b": 0, "c": 1}


def test_rerank_and_abstain(spark):
    cand = spark.createDataFrame([("q", i, s) for i, s in enumerate("abcde")], "q string, pos int, id string")
    given = spark.createDataFrame([("q", 0, "c", 0.0), ("q", 1, "zz", 9.0), ("q", 2, "b", 0.7), ("q", 3, "b", 0.9)], "q string, seq int, id string, score double")
    got = [(r.id, r.score) for r in ranking.merge_scores(cand, given, ["q"]).orderBy("rank").collect()]
    assert got == [("b", 0.7), ("c", 0.0), ("a", 0.0), ("d", 0.0), ("e", 0.0)]
    conf = spark.createDataFrame([(1, 0.1), (1, 0.39), (2, 0.1), (2, 0.45), (3, 0.4), (4, None)], "q int, confidence double")
    assert {r.q: r.abstain for r in ranking.abstains(conf, ["q"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert one(spark, ranking.distinct_questions(F.array(*map(F.lit, [" A? ", "a?", "", "B?", "C?"])), 2)) == ["A?", "B?"]
    assert one(spark, ranking.restrict_confidences(F.create_map(F.lit("a"), F.lit(1.0)), F.array(F.lit("b")))) is None


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "o", "k", 1), (2, "o", "k", 2), (3, "o", None, 3), (4, "o", None, 4), (5, "p", "k", 5)], "id int, org_id string, idempotency_key string, created_at int")
    old = spark.createDataFrame([("p", "k"), ("p", None)], "org_id string, idempotency_key string")
    assert {r.id for r in catalog.dedupe_ingest(rows, old).collect()} == {1, 3, 4}
    assert catalog.page_limit(0) == 50 and catalog.page_limit(999) == 200
    docs = spark.createDataFrame([(f"d{i}", "o", "", "ready", i) for i in range(60)], "id string, org_id string, store_id string, status string, created_at int")
    page = catalog.list_documents(docs, catalog.in_scope("o"), 3, before=50).collect()
    assert [r.created_at for r in page] == [49, 48, 47, 46]
    assert one(spark, catalog.response_json(a=F.lit(0), b=F.lit(""), c=F.lit("x"))) == '{"c":"x"}'


def test_replay(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    text_ = response_text({"a": 1})
    stored = spark.createDataFrame([("t", "d", "q", "m", [], text_, now - dt.timedelta(hours=1)), ("old", "d", "q", "m", [], text_, now - dt.timedelta(hours=25))], REPLAY)
    asked = spark.createDataFrame([("t", "d", "q"), ("t", "d", "other"), ("old", "d", "q"), ("x", "d", "q")], "token string, document_id string, query string")
    got = {(r.token, r.query): (r.status, r.response) for r in replay(asked, stored, now).collect()}
    assert got == {("t", "q"): (200, text_), ("t", "other"): (409, None), ("old", "q"): (404, None), ("x", "q"): (404, None)}


@pytest.mark.parametrize(
    ("reply", "ids", "conf"),
    [
        ('{"picks": [{"id": " a ", "confidence": 1.7}, {"id": "a"}, {"id": "b"}, {"id": ""}]}', ["a", "b"], {"a": 1.0}),
        ('```json\n{"selected_section_ids": ["x", "x", " "]}\n```', ["x", "x"], {}),
        ('Here: {"picks": [], "selected_section_ids": ["y"]} done', ["y"], {}),
        ("", [], {}),
    ],
)
def test_selection(reply, ids, conf):
    assert replies.selection(reply) == {"ids": ids, "confidences": conf}


def test_replies():
    assert replies.selection("no json") is None
    a = replies.page_action('{"tool": "done", "answer": "x", "confidence": "0.8", "cited_pages": [[1, 2], {"start": 3}, "5-7", 9, "x"]}')
    assert a["cited"] == [(1, 2), (3, 3), (5, 7), (9, 9)] and a["confidence"] == 0.8
    assert replies.page_action('{"action": "get_pages", "pages": "4-6"}')["end"] == 6 and replies.page_action("{}") is None
    assert replies.scores('{"scores": [{"id": "a", "score": -1}, {"id": " "}, {"id": "b", "score": 7}]}') == [("a", 0.0, ""), ("b", 7.0, "")]
    assert replies.plan('{"is_multi_hop": true, "sub_questions": [" "]}')["is_multi_hop"] is False
    assert replies.summary_axes('{"topics": ["a","b","c","d","e"], "one_line": " x  y "}') == {"topics": ["a", "b", "c", "d"], "entities": [], "numbers": [], "one_line": "x y"}
    assert replies.questions('{"questions": ["A?", "a?", "B?"]}') == ["A?", "B?"]
    assert replies.locate("é one\n two three", "one two") == (3, 11) and replies.locate("abc", "x") == (-1, -1)
    assert replies.section_action('{"action": "read", "section_id": "s"}')["id"] == "s"


def brute_cap(nodes, most):
    """Rebuild the greedy on plain lists."""
    kids = {}
    for n in nodes:
        kids.setdefault(n["up"], []).append(n)
    below = lambda n: kids.get(n["seq"], [])

    def absorb(a, b):
        a["text"] = "\n\n".join(t for t in (a["text"], b["text"]) if t.strip())

    def leaves(up=None):
        return sum(leaves(n["seq"]) if below(n) else 1 for n in kids.get(up, []))

    def collapse(up=None):
        for n in kids.get(up, []):
            collapse(n["seq"])
            if len(below(n)) == 1 and not below(below(n)[0]):
                absorb(n, kids.pop(n["seq"])[0])

    def first_lone(up=None):
        for n in kids.get(up, []):
            if len(below(n)) == 1 and not below(below(n)[0]):
                return n
            if found := first_lone(n["seq"]):
                return found
        return None

    if leaves() <= most:
        return sorted(n["text"] for up in kids for n in kids[up] if not below(n))
    collapse()
    while leaves() > most:
        best = None

        def look(up=None):
            nonlocal best
            row = kids.get(up, [])
            for i in range(len(row) - 1):
                if not below(row[i]) and not below(row[i + 1]):
                    size = len(row[i]["text"]) + len(row[i + 1]["text"])
                    if best is None or size < best[0]:
                        best = size, up, i
            for n in row:
                look(n["seq"])

        look()
        if best:
            row = kids[best[1]]
            absorb(row[best[2]], row.pop(best[2] + 1))
        elif lone := first_lone():
            absorb(lone, kids.pop(lone["seq"])[0])
        else:
            break
    return sorted(n["text"] for up in kids for n in kids[up] if not below(n))


def test_cap_leaves_is_the_greedy(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(30):
        nodes = []
        for i in range(rng.randint(2, 30)):
            up = rng.randrange(i) if i and rng.random() < 0.6 else None
            nodes.append({"seq": i, "up": up, "text": "x" * rng.randint(1, 50)})
        rows += [(f"d{d}", n["seq"], n["up"], 1, "t", n["text"], 1, 1, False) for n in nodes]
        want[f"d{d}"] = brute_cap([dict(n) for n in nodes], 4)
    got = chunking.cap_leaves(spark.createDataFrame(rows, chunking.NODES), 4).toPandas()
    for d, g in got.groupby("document_id"):
        parents = set(g["parent_seq"].dropna())
        assert sorted(g[~g["seq"].isin(parents)]["content"]) == want[d], d


def test_chunks():
    s = " ".join(f"word{i}" for i in range(400))
    pieces = chunking.split_words(s, 300)
    assert " ".join(pieces) == s and all(len(p) <= 375 for p in pieces) and all(len(p) >= 150 for p in pieces[:-1])
    assert chunking.split_words("é" * 400, 200) and "".join(chunking.split_words("é" * 400, 200)) == "é" * 400
    assert chunking.chunk_title("Net revenue: it grew", "f") == "Net revenue" and chunking.chunk_title(" ", "f") == "f"
    assert chunking.chunk_title("Short, one.", "f") == "Short, one"


def test_budget_slices(spark):
    rows = forest(random.Random(9), 8)
    viewed = tree.view(spark.createDataFrame(rows, SECTION))
    docs = spark.createDataFrame([(f"d{i}", f"Doc {i}") for i in range(8)], "id string, title string")
    whole = split(viewed, docs, Budget(100_000, 0)).toPandas()
    assert (whole["slice_no"] == 0).all() and not whole["breadcrumb"].str.contains("slice").any()
    parts = split(viewed, docs, Budget(12, 0)).toPandas()
    for d, g in parts.groupby("document_id"):
        ids = g[g["id"] != ""]["id"].tolist()
        assert sorted(ids) == sorted(r[1] for r, _ in walk(rows, d)), d
    assert Budget(10, 20).available == 10
    assert isinstance(parts, pd.DataFrame)


def _words_by_slices(text, target):
    """The splitter as it reads: cut the rest again and again."""
    target = max(target, 200)
    most, out, rest = target + target // 4, [], text.strip()
    size = lambda s: len(s.encode())
    while size(rest) > most:
        head = rest.encode()[:most].decode("utf-8", "ignore")
        space = head.rfind(" ")
        if space < 0 or size(head[:space]) < target // 2:
            space = len(head)
        out.append(rest[:space].strip())
        rest = rest[space:].strip()
    return out + [rest] if rest or not out else out


def test_splitter_is_linear_and_cuts_alike():

    from foliant.operators.chunking import split_words

    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["a", "é", "中", " ", "\n", " ", "word ", "x" * 300]) for _ in range(rng.randint(0, 400)))
        assert split_words(t, 200) == _words_by_slices(t, 200)
    begun = time.perf_counter()
    assert len(split_words("some words " * 2_000_000, 900)) > 15_000
    assert time.perf_counter() - begun < 20


def test_leaf_cap_of_a_large_document(spark):
    from foliant.operators.chunking import NODES, cap_leaves

    rows = [("d", i, None if i % 50 == 0 else i - i % 50, 1, f"t{i}", f"text {i}" * (i % 7), i, i, False) for i in range(20_000)]
    out = cap_leaves(spark.createDataFrame(rows, NODES), 400).toPandas()
    parents = set(out["parent_seq"].dropna().astype(int))
    assert sum(s not in parents for s in out["seq"]) <= 400
    want = sum(r[5].count("text") for r in rows)
    assert sum(c.count("text") for c in out["content"]) == want


def test_lossy_decoding_is_by_bytes():
    from foliant.functions.text import decode_lossy

    assert decode_lossy(b"a\xff\xe2\x82b\xc3") == "a���b�"
    assert decode_lossy(None) is None and len(decode_lossy(b"\xff" * 1_000_000)) == 1_000_000


def test_keys_tell_nulls_apart(spark):
    from foliant.functions.hashing import cache_key

    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    from pyspark.sql import functions as F

    assert df.select(cache_key(F.col("x"), F.col("y"), F.lit("s"), F.lit("m")).alias("k")).distinct().count() == 2


def test_toc_of_many_documents_is_one_sorted_pass(spark):
    """No Python call for each document, no self-join; the same as by brute force (F2, F3)."""
    rng = random.Random(4)
    rows = []
    for d in range(60):
        for i in range(rng.randint(1, 30)):
            rows.append((f"d{d}", i, ".".join(["1"] * rng.randint(1, 4)), rng.choice(["t", " t ", " "]), rng.choice([None, 0, *range(1, 20)])))
    rng.shuffle(rows)
    flat = spark.createDataFrame(rows, "document_id string, pos int, structure string, title string, start_page int")
    built = toc.assemble(flat)
    last = spark.createDataFrame([(f"d{d}", 15) for d in range(40)], "document_id string, last_page int")
    ended = toc.end_pages(built, last)
    plan = ended._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan
    got = {(r.document_id, r.toc_seq): r for r in ended.collect()}
    kept = sorted((r for r in rows if r[3].strip()), key=lambda r: (r[0], r[1]))
    assert len(got) == len(kept)
    for d in {r[0] for r in kept}:
        depths, starts = [], [r[4] or 0 for r in kept if r[0] == d]
        for r in (r for r in kept if r[0] == d):
            depths.append(min(r[2].count("."), depths[-1] + 1 if depths else 0))
        parents = [next((j for j in range(i - 1, -1, -1) if depths[j] < depths[i]), None) for i in range(len(depths))]
        ends = []
        for i, (depth, start) in enumerate(zip(depths, starts)):
            after = next((starts[j] for j in range(i + 1, len(depths)) if parents[j] == parents[i] and starts[j] > start), None)
            end = after - 1 if after is not None else (ends[parents[i]] if parents[i] is not None else 0) or (15 if int(d[1:]) < 40 else 0)
            ends.append(end if start > 0 and end >= start else 0)
            r = got[d, i]
            assert (r.depth, r.parent_seq, r.start_page, r.end_page) == (depth, parents[i], start, ends[i])


def test_rounding_in_doubles(spark):
    """Halves that a double misses are rounded as DuckDB does (F5)."""
    import duckdb

    values = [i / 100 / d for i in range(0, 6000, 5) for d in (50, 100, 1000)] + [-0.0125, -1.005, 2.5, 1e300, -1e17, 0.0, float("inf"), None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.r for r in frame.select("i", text.rounded(F.col("v"), 3).alias("r")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("create table v (i int, v double)")
    con.executemany("insert into v values (?, ?)", list(enumerate(values)))
    assert got == [r[0] for r in con.sql("select round(v, 3) from v order by i").fetchall()]
    assert got != [r.r for r in frame.select("i", F.round("v", 3).alias("r")).orderBy("i").collect()]
