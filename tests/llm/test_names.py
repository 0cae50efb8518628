"""Columns whose names an operator uses itself, and rows that repeat a key."""

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.decontaminate import contamination
from foliant.llm.licenses import RULES, detect, scan_licenses
from foliant.llm.lines import dedup_lines
from foliant.llm.toxicity import score_toxicity

LINE = "this very line of nine words stands in many places"
NAMES = ("row", "gone", "print", "h", "norm", "pos", "bucket", "doc", "hits", "body", "__items", "__text", "Row")


def clashing(spark, rows, names):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_line_dedup(spark):
    df = clashing(spark, [(1, LINE), (2, LINE + "\nand another line of its own here")], NAMES[:-1])
    got = dedup_lines(df).orderBy("doc_id").collect()
    assert [list(r.dropped) for r in got] == [[], [0]] and all(r["row"] == r["gone"] == r["print"] == "clash" for r in got)
    assert dedup_lines(clashing(spark, [(1, LINE)], ["Row"])).first()["Row"] == "clash"


def test_contamination(spark):
    df = clashing(spark, [(1, "x " + LINE + " y z w v u"), (2, "nothing here")], NAMES[:-1])
    bench = spark.createDataFrame([(7, LINE)], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(df, bench).collect()}
    assert (got[1].n_hit, list(got[1].item_ids), got[2].n_hit, got[2].n_words) == (10, ["7"], 0, 2)
    assert got[1]["doc"] == got[1]["hits"] == "clash" and (got[1].spans[0].start, got[1].spans[0].end) == (1, 11)


def test_contamination_by_a_passage_that_most_documents_share(spark):
    """One window in most documents and in many items, and one document full of it."""
    rows = [(i, f"a{i} b{i} {LINE} with four words more c{i}") for i in range(300)] + [(1000, (LINE + " with four words more ") * 200)]
    bench = spark.createDataFrame([(i, f"q{i} {LINE} with four words more r{i}") for i in range(40)], "item_id long, text string")
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert all(r.n_hit == (14 if r.doc_id < 1000 else 2800) and len(r.item_ids) == 40 for r in got)


def test_licenses(spark):
    got = scan_licenses(clashing(spark, [(1, "MIT License")], NAMES[:-1])).first()
    assert list(got.labels) == ["mit"] and got["body"] == got["__text"] == "clash"


def test_findings_that_none_contains():
    """The sweep over kept ranges is the comparison with each of them."""
    rng = np.random.RandomState(5)
    words = [r.label.replace("-", " ") for r in RULES[:60]] + ["mit license", "apache license version 2 0", "gnu general public license", "public domain", "all rights reserved", "creative commons attribution share alike 4 0"]
    for _ in range(50):
        text = " ".join(words[i] for i in rng.randint(0, len(words), 40))
        found = [(m.start(), m.end(), r) for r in RULES for m in r.pattern.finditer(text)]
        kept = []
        for start, end, rule in sorted(found, key=lambda f: (f[2].priority, f[0] - f[1], f[0])):
            if not any(a <= start and end <= b for a, b, _ in kept):
                kept.append((start, end, rule))
        assert detect(text, RULES) == sorted(kept, key=lambda f: (f[0], f[1], f[2].priority))


def test_very_long_text_with_very_many_licenses(spark):
    got = scan_licenses(spark.createDataFrame([(1, "see the MIT License here. " * 30_000)], "doc_id long, text string")).select("n_words", "n_base", "first_word", "last_word", F.size("findings").alias("n")).first()
    assert tuple(got) == (150_000, 30_000, 2, 149_997, 30_000)


def test_toxicity_learns_from_one_text_of_a_key(spark):
    """Rows that repeat a key do not make the sample larger."""
    rows = [(i, f"plain text number {i} " + ("zorg " * 3 if i % 3 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda df: {r.doc_id: r.score for r in score_toxicity(df, labels).collect()}
    assert score(once) == score(once.unionByName(once).unionByName(once))
