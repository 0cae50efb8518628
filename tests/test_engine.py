"""The engine beyond selection: full ingest, tables of contents, store, many documents, due jobs."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators.chunking import split_words
from foliant.plans.clients import NoModel, Scripted
from foliant.plans.engine import Engine, Options
from foliant.plans.full_ingest import build_toc, summary_axes, tree_json
from foliant.plans.store import Store
from foliant.streaming import jobs

FILES = "document_id string, org_id string, store_id string, filename string, content_type string, content binary"
GUIDE = b"# Bees\n\nAbout bees.\n\n## Hives\n\nA hive holds thirty thousand bees.\n\n## Honey\n\nHoney keeps for years.\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("d1", "o", "s", "bees.md", "text/markdown", GUIDE), ("d2", "o", "s", "x.bin", "application/zip", b"\x00\x01"), ("d3", "o", "s", "n.txt", "text/plain", b"1 Tides\nThe moon pulls.\n2 Winds\nThe sun pushes.")]
    return spark.createDataFrame([(a, b, c, d, e, bytearray(f)) for a, b, c, d, e, f in rows], FILES)


def test_full_ingest(spark, files, tmp_path):
    said = Scripted({
        r"JSON \{\"topics\"": '{"topics": ["a","b","c","d","e"], "entities": [" X "], "numbers": ["30,000"], "one_line": " all  about it "}',
        r"questions this text answers": '{"questions": ["How many?", "how many?", "Why?"]}',
    }, "a summary")
    engine = Engine(spark, said, Options(strategy="single-pass"))
    store = Store(spark, f"file://{tmp_path}/store")
    docs, sections, bodies, nodes = engine.ingest_full(files, axes=True, questions=True, contents=True, store=store)
    status = {r.id: r.status for r in docs.collect()}
    assert status == {"d1": "ready", "d2": "failed", "d3": "ready"}
    rows = {(r.document_id, r.title): r for r in sections.collect()}
    hives = rows[("d1", "Hives")]
    assert hives.summary == "all about it" and list(hives.topics) == ["a", "b", "c", "d"] and list(hives.entities) == ["X"] and list(hives.candidate_questions) == ["How many?", "Why?"]
    assert nodes.count() == 0  # no document has pages
    assert store.read("sections").count() == sections.count() and store.read("bodies").count() == bodies.count()


def test_no_model_falls_back_to_the_text(spark, files):
    engine = Engine(spark, NoModel(), Options(strategy="single-pass"))
    _, sections, bodies, _ = engine.ingest_full(files, axes=True)
    got = {r.title: r.summary for r in sections.where("document_id = 'd3'").collect()}
    assert got == {"1 Tides": "The moon pulls.", "2 Winds": "The sun pushes."}


def test_unreadable_axes_become_the_line(spark):
    viewed = spark.createDataFrame([("d", "a", "T", "Some text."), ("d", "b", "U", " ")], "document_id string, id string, title string, content string")
    got = summary_axes(viewed, Scripted({}, " just words ")).collect()
    assert [(r.id, r.summary, list(r.topics)) for r in got] == [("a", "just words", [])]


def _paged(spark, n=4):
    rows = [("p", f"s{i}", "", i, 0, f"Part {i}", f"Text of part {i}.", i, i, i) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "document_id string, id string, parent_id string, ordinal int, depth int, title string, content string, page_start int, page_end int, preorder int")


def test_toc_from_pages(spark):
    nodes = [("1", "Part 1", 1), ("1.1", "Inner", 2), ("2", "Part 3", 3), ("3", "Lost", 9), ("4", "", 4)]
    reply = json.dumps({"nodes": [{"structure": s, "title": t, "physical_index": f"<physical_index_{p}>"} for s, t, p in nodes]})
    said = Scripted({r"hold a table of contents\?(.|\n)*Part 1": '{"toc_detected": "yes"}', r"hold a table": '{"toc_detected": "no"}', r"Printed contents:\nPart 1\nText of part 1\.\nText:": reply, r"Title: Inner": '{"start_begin": "no"}', r"begin on the page": '{"start_begin": "yes"}'})
    got = {r.title: (r.start_page, r.end_page, r.node_id, r.parent_seq) for r in build_toc(_paged(spark), said).collect()}
    assert got == {"Part 1": (1, 2, "toc_1", None), "Inner": (0, 0, "toc_1_1.1", 0), "Part 3": (3, 4, "toc_2", None), "Lost": (0, 0, "toc_3", None)}


def test_toc_of_a_silent_model(spark):
    assert build_toc(_paged(spark), NoModel()).count() == 0


def test_failed_verification_clears_nothing(spark):
    reply = '{"nodes": [{"structure": "1", "title": "Part 2", "physical_index": "<physical_index_2>"}]}'

    class Half:
        def __call__(self, prompt):
            if "begin on the page" in prompt:
                raise RuntimeError("down")
            return '{"toc_detected": "no"}' if "hold a table" in prompt else reply

    assert [(r.start_page, r.end_page) for r in build_toc(_paged(spark), Half()).collect()] == [(2, 4)]


def test_nested_json_prunes_subtrees(spark):
    rows = [("d", 0, None, 0, "A"), ("d", 1, 0, 1, "A1"), ("d", 2, 1, 2, "A1x"), ("d", 3, 0, 1, "A2"), ("d", 4, None, 0, 'B "q"'), ("e", 0, None, 0, "E")]
    nodes = spark.createDataFrame(rows, "document_id string, toc_seq long, parent_seq long, depth int, title string")
    got = {r.document_id: json.loads(r.tree) for r in tree_json(nodes, ("title",)).collect()}
    assert got == {"d": [{"title": "A", "nodes": [{"title": "A1", "nodes": [{"title": "A1x"}]}, {"title": "A2"}]}, {"title": 'B "q"'}], "e": [{"title": "E"}]}
    got = {r.document_id: json.loads(r.tree) for r in tree_json(nodes, ("title",), keep=F.col("title") != "A1").collect()}
    assert got["d"] == [{"title": "A", "nodes": [{"title": "A2"}]}, {"title": 'B "q"'}]


def test_store_keeps_the_last_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("documents") is None and store.replies().count() == 0
    docs = lambda *rows: spark.createDataFrame(rows, "id string, title string")
    store.save(documents=docs(("a", "one"), ("b", "two")))
    store.save(documents=docs(("a", "again")))
    assert sorted(tuple(r) for r in store.read("documents").collect()) == [("a", "again"), ("b", "two")]
    store.delete(spark.createDataFrame([("b",)], "document_id string"))
    assert [tuple(r) for r in store.read("documents").collect()] == [("a", "again")]
    store.save(documents=docs(("b", "back")))
    assert sorted(r.id for r in store.read("documents").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        store.save(nothing=docs(("x", "y")))


def test_many_documents_and_overrides(spark, files):
    engine = Engine(spark, options=Options(strategy="single-pass", abstain=False))
    docs, sections, bodies = engine.ingest(files)
    queries = spark.createDataFrame([("q", "d1", "honey"), ("q", "d3", "tides"), ("q", "zz", "x"), ("r", "zz", "x")], "query_id string, document_id string, query string")
    viewed = engine.view(sections, bodies)
    every, outcomes = engine.query_many(queries, viewed, docs)
    assert {(r.query_id, r.document_id): r.error for r in every.collect()} == {("q", "d1"): None, ("q", "d3"): None, ("q", "zz"): "document not found", ("r", "zz"): "document not found"}
    got = {r.query_id: (r.documents, r.succeeded, r.failed) for r in outcomes.collect()}
    assert got == {"q": (3, 2, False), "r": (1, 0, True)}
    ids = next(r.section_ids for r in outcomes.collect() if r.query_id == "q")
    assert len(ids) == 2 and ids[0].startswith("d1:sec_") and ids[1].startswith("d3:sec_")
    other = engine.with_options(strategy="chunked-tree", max_sections=1, rerank=None)
    assert (other.options.strategy, other.options.max_sections, other.options.rerank) == ("chunked-tree", 1, False) and engine.options.strategy == "single-pass"
    with pytest.raises(ValueError):
        engine.with_options(strategy="nothing")


def test_cached_queries_are_not_asked_again(spark, files):
    engine = Engine(spark, options=Options(strategy="single-pass"))
    docs, sections, bodies = engine.ingest(files)
    queries = spark.createDataFrame([("q", "d1", "honey")], "query_id string, document_id string, query string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "key string, ids array<string>, at timestamp")
    found, fresh = engine.query_cached(queries, empty, engine.view(sections, bodies), docs, 60, now)
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)
    silent = Engine(spark, NoModel(), engine.options)
    again, more = silent.query_cached(queries, kept, engine.view(sections, bodies), docs, 60, now)
    assert [r.id for r in again.collect()] == [r.id for r in found.collect()] != [] and more.count() == 0


def test_early_jobs_wait(spark, tmp_path):
    rows = [("ingest", "a", "2024-01-01 00:00:00"), ("ingest", "b", "2999-01-01 00:00:00"), ("ingest", "c", None)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "kind string, document_id string, run_at string").withColumn("run_at", F.to_timestamp("run_at")).withColumn("attempt", F.lit(0)).withColumn("max_attempts", F.lit(3)).coalesce(1).write.json(src)
    ran, states = [], {}

    def work(batch):
        ran.extend(r.document_id for r in batch.collect())
        return batch.withColumn("error", F.lit(None).cast("string")).withColumn("error_kind", F.lit(None).cast("string"))

    jobs.run_jobs(spark.readStream.schema(jobs.JOBS).json(src), work, lambda b, _: states.update({r.document_id: r.state for r in b.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(ran) == ["a", "c"] and states == {"a": "ready", "b": "waiting", "c": "ready"}


def test_long_leaves_with_pages_are_cut(spark):
    from foliant.operators.chunking import NODES, chunk_leaves

    body = "some words here " * 300
    nodes = spark.createDataFrame([("d", 0, None, 1, "T", body, 3, 4, False), ("d", 1, None, 1, "U", "short", 5, 5, False)], NODES)
    got = chunk_leaves(nodes).orderBy("seq").collect()
    assert [r.content for r in got[1:-1]] == split_words(body) and got[0].content == "" and all(r.parent_seq == 0 and r.page_start == 3 and r.level == 2 for r in got[1:-1])
    assert got[-1].content == "short" and got[-1].parent_seq is None
