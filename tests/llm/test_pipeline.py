"""The pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(p.STAGES):
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def awkward(spark):
    line = "this very line of nine words stands in many places"
    rows = [(i, t, None, None, None, "x", 1.0, [1], "k") for i, t in enumerate([None, "", " ", "\n\n", line, line, line + "\n" + "w " * 50_000, "é ß\x00", "one two"])]
    rows += [(4, line, "en", "s", 3, "x", 1.0, [1], "k")] * 2 + [(None, "no id at all here", "en", "s", 5, "x", 1.0, [1], "k"), (None, line, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, predicted string, score double, dropped array<int>, component_id string")


def test_stages_on_awkward_rows(spark):
    """Nulls, empty texts, repeated rows and clashing names neither break a stage nor lose clean documents."""
    docs = awkward(spark).cache()
    n = docs.count()
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.where("length < 1").count() == 0 and out.where("doc_id = 8").count() == 1
            assert stage(spark, docs.limit(0), SF).count() == 0
            continue
        assert out.columns == list(p.COLUMNS)
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert (8, "one two") in got and (None, "no id at all here") in got and (0, None) in got and len(got) <= n
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name in ("toxicity", "decontamination"):
            assert len(got) == n
        if name == "line_dedup":
            assert sum("stands in many places" in (t or "") for _, t in got) == 3  # (4, line) thrice is one document
        if name == "ngram_jaccard":
            assert {i for i, t in got if t and t.startswith("this very line") and len(t) < 60} == {4}


def test_near_copies_drops_rows_not_ids(spark):
    """A document is a row: one of the same id and another text stays; of equal rows and copies without an id one does."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (None, one), (4, ""), (4, ""), (None, None), (5, one + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, one), (2, two), (4, ""), (4, ""), (None, None)], key=str)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
