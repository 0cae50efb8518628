"""Format readers on documents built in memory."""

import io
import zipfile

from pyspark.sql import functions as F

from foliant.operators import tree
from foliant.plans.clients import Scripted
from foliant.plans.engine import Engine, Options
from foliant.sources import parsers, pdf_rows
from foliant.sources.formats import parse_parts, parser_name

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("--", "."), body)
    return out.getvalue()


def p(text, style=None, outline=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def heads(parts):
    return [(x["level"], x["title"]) for x in parts if x["level"]]


def test_markdown():
    title, parts = parsers.parse_markdown(b"# Project Atlas\n\nIntro *text*.\n\n## Setup\n\n```\n# not a heading\n```\n\n### Dependencies\n\nNeeds Go 1.25.\n\n> # quoted\n\nUsage\n-----\nrun\n<div>\n# raw\n</div>\n\nend\n")
    assert title == "Project Atlas" and heads(parts) == [(1, "Project Atlas"), (2, "Setup"), (3, "Dependencies"), (2, "Usage")]
    by = {x["title"]: x["content"] for x in parts}
    assert "# not a heading" in by["Setup"] and "Go 1.25" in by["Dependencies"] and "Intro text." == by["Project Atlas"] and "raw" not in by["Usage"] and "end" in by["Usage"]


def test_html():
    raw = b"""<html><head><title>Atlas</title></head><body><nav>menu</nav><main><h1>Atlas</h1><p>one<p>two <b>bold<h2>Setup</h2><table><thead><tr><th>a<th>b|c</thead>
    <tbody><tr><td>1<td>2</table><h2>Usage</h2>run</main><footer>foot</footer></body></html>"""
    title, parts = parsers.parse_html(raw)
    assert title == "Atlas" and heads(parts) == [(1, "Atlas"), (2, "Setup"), (2, "Usage")]
    text = " ".join(x["content"] for x in parts)
    assert "menu" not in text and "foot" not in text and "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |" in text and "one\n\ntwo" in text
    assert parsers.parse_html(b"")[1] == [parsers.part(0, "")]


def test_docx():
    body = p("Project Atlas", "Heading1") + p("Hello") + p("Setup", "Heading 2") + p("Financials", outline=0)
    body += "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc><w:tc>" + p("2") + "</w:tc></w:tr></w:tbl>"
    notes = f'<w:footnotes {W}><w:footnote w:type="separator">{p("sep")}</w:footnote><w:footnote>{p("a real note")}</w:footnote></w:footnotes>'
    title, parts = parsers.parse_docx(zipped(**{"word__document--xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word__footnotes--xml": notes}))
    assert title == "Project Atlas" and heads(parts) == [(1, "Project Atlas"), (2, "Setup"), (1, "Financials"), (1, "Footnotes")]
    assert "| a | b |" in parts[3]["content"] and parts[4]["content"] == "a real note"


def test_xlsx_and_csv():
    shared = f"<sst {S}><si><t>Region</t></si><si><t>North</t></si></sst>"
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Sum</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>'
    book = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Q1" r:id="rId1"/></sheets></workbook>'
    rels = '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
    _, parts = parsers.parse_xlsx(zipped(**{"xl__sharedStrings--xml": shared, "xl__worksheets__sheet1--xml": sheet, "xl__workbook--xml": book, "xl___rels__workbook--xml--rels": rels}))
    assert heads(parts) == [(1, "Q1")] and parts[0]["content"] == "| Region |  | Sum |\n| --- | --- | --- |\n| North | TRUE | 5 |"
    title, parts = parsers.parse_csv(b"Region,Revenue\nNorth,100\nSouth\n")
    assert title == "Region" and parts[0]["content"].endswith("| South |  |") and parsers.column_index("AA7") == 26
    assert parsers.style_level("Title") == 1 and parsers.style_level("Heading 9") == 6 and parsers.style_level("Body") == 0


def test_routing_and_ingest(spark):
    files = [
        ("a", "text/plain; charset=utf-8", "x", b"Intro line here.\n\nOVERVIEW\nbody\n\n1. Background\nmore\r\n"), ("b", "", "README.MD", b"# T\n\n## U\nx"), ("c", "application/x", "x.bin", b""),
        ("d", "", "bad.docx", b"nope"), ("e", "text/plain", "y", b""), ("f", "text/plain", "z", b"Hello world.\nSecond line."),
    ]
    df = spark.createDataFrame([(i, "o", "s", n, t, bytearray(c)) for i, t, n, c in files], "document_id string, org_id string, store_id string, filename string, content_type string, content binary")
    names = {r.document_id: r.p for r in df.select("document_id", parser_name(F.col("content_type"), F.col("filename")).alias("p")).collect()}
    assert names == {"a": "text", "b": "markdown", "c": None, "d": "docx", "e": "text", "f": "text"}
    assert parse_parts(df).where("error is not null").select("document_id").distinct().count() == 2
    docs, sections, bodies = Engine(spark).ingest(df)
    got = {r.id: (r.status, r.title) for r in docs.collect()}
    assert got["a"] == ("ready", "OVERVIEW") and got["c"][0] == got["d"][0] == "failed" and got["f"] == ("ready", "Hello world.")
    titles = {}
    for r in sections.orderBy("document_id", "depth", "ordinal").collect():
        titles.setdefault(r.document_id, []).append((r.depth, r.title))
    assert titles["a"] == [(0, "Introduction"), (0, "OVERVIEW"), (0, "1. Background")] and titles["b"] == [(0, "T"), (1, "U")]
    assert bodies.where("document_id = 'a'").count() == 3


def test_pdf_rows(spark):
    rows = [("d", 1, 0, 700.0, 20.0, False, "Annual Report"), ("d", 1, 1, 680.0, 10.0, True, "1.2 Scope"), *(("d", 1, i, 600.0 - i, 10.0, False, f"body {i}") for i in range(2, 9)), ("d", 2, 0, 700.0, 14.0, False, "Results")]
    df = pdf_rows.heading_levels(spark.createDataFrame(rows, pdf_rows.ROWS))
    assert {r.text: r.level for r in df.where("level > 0").collect()} == {"Annual Report": 1, "Results": 2, "1.2 Scope": 4}
    parts = pdf_rows.parts_from_rows(df).orderBy("seq").collect()
    assert [(x.title, x.page_start, x.page_end) for x in parts] == [("Annual Report", 1, 1), ("1.2 Scope", 1, 1), ("Results", 2, 2)]
    marks = spark.createDataFrame([("d", 0, 1, "Annual report"), ("d", 1, 1, "Missing"), ("d", 2, 1, "RESULTS")], "document_id string, pos int, level int, title string")
    assert [r.title for r in pdf_rows.match_outline(marks, df).orderBy("pos").collect()] == ["Annual report", "RESULTS"]
    glyphs = [("d", 1, i, x, y, 5.0, 10.0, "F-Bold", c) for i, (x, y, c) in enumerate([(0.0, 100.0, "H"), (5.0, 101.0, "i"), (14.0, 100.5, "x"), (0.0, 50.0, "z")])]
    found = pdf_rows.rows_from_glyphs(spark.createDataFrame(glyphs, "document_id string, page int, seq int, x double, y double, w double, size double, font string, ch string"))
    assert [(r.text, r.bold) for r in found.orderBy("row").collect()] == [("Hi x", True), ("z", True)]
    tables = spark.createDataFrame([("d", 3, 0, [["a", "b"], ["1", "2"]]), ("d", 4, 0, [["only"]])], "document_id string, page int, n int, rows array<array<string>>")
    base = spark.createDataFrame([("d", 0, 1, "T", "c", 1, 1)], "document_id string, seq long, level int, title string, content string, page_start int, page_end int")
    assert [(r.title, r.page_start) for r in pdf_rows.attach_tables(base, tables).orderBy("seq").collect()] == [("T", 1), ("Tables", 3), ("Table (page 3)", 3)]
    assert pdf_rows.usable_documents(df).count() == 1


def small(spark):
    rows = [("d", f"s{i}", "" if i == 0 else "s0", i, t, "", 10, i, i + 1) for i, t in enumerate(["Atlas", "Setup guide", "Usage notes", "FAQ"])]
    sections = spark.createDataFrame(rows, "document_id string, id string, parent_id string, ordinal int, title string, summary string, token_count long, page_start int, page_end int")
    viewed = tree.view(sections).withColumn("content", F.concat(F.lit("body of "), "title"))
    docs = spark.createDataFrame([("d", "Atlas")], "id string, title string")
    queries = spark.createDataFrame([("q", "d", "setup guide")], "query_id string, document_id string, query string")
    return queries, viewed, docs


def test_strategies(spark):
    queries, viewed, docs = small(spark)
    reply = '{"picks": [{"id": "s2", "confidence": 0.9}, {"id": "made-up", "confidence": 1}, {"id": "s1", "confidence": 0.5}]}'
    out = Engine(spark, Scripted({}, reply), Options(strategy="single-pass")).query(queries, viewed, docs).first()
    assert out.section_ids == ["s2", "s1"] and out.confidence == 0.9 and len(out.trace_token) == 64 and not out.abstained
    out = Engine(spark, Scripted({}, reply), Options(strategy="chunked-tree")).query(queries, viewed, docs).first()
    assert out.section_ids == ["s1", "s2"]
    weak = Engine(spark, Scripted({}, reply.replace("0.9", "0.1").replace("0.5", "0.2")), Options(strategy="single-pass")).query(queries, viewed, docs).first()
    assert weak.abstained and weak.trace_token is None and weak.section_ids == []
    lexical = Engine(spark, options=Options(strategy="single-pass", max_sections=1)).query(queries, viewed, docs).first()
    assert lexical.section_ids == ["s1"]
    silent = Engine(spark, Scripted({}, "nonsense"), Options(strategy="single-pass")).query(queries, viewed, docs).first()
    assert silent.section_ids == []


def test_agents(spark):
    queries, viewed, docs = small(spark)
    pages = Scripted({"body of Usage": '{"tool": "done", "answer": "yes", "cited_pages": [[2, 2]], "confidence": 0.8}', "Structure": '{"tool": "get_pages", "pages": "2-3"}'}, '{"tool": "get_document_structure"}')
    engine = Engine(spark, pages, Options(strategy="treewalk"))
    out = engine.answer_by_pages(queries, viewed).first()
    assert out.answer == "yes" and out.hops == 3 and [(c.start, c.end, c.section_ids) for c in out.citations] == [(2, 2, ["s1", "s2"])]
    assert engine.query(queries, viewed, docs).first().section_ids == ["s1", "s2"]
    lost = Engine(spark, Scripted({}, "x"), Options(strategy="treewalk")).answer_by_pages(queries, viewed).first()
    assert lost.hops == 9 and lost.citations is None
    agent = Scripted({"body of FAQ": '{"action": "done", "picks": [{"id": "s3", "confidence": 0.7}]}'}, '{"action": "read", "section_id": "s3"}')
    assert Engine(spark, agent, Options(strategy="agentic")).query(queries, viewed, docs).first().section_ids == ["s3"]


def test_decompose_and_rerank(spark):
    queries, viewed, docs = small(spark)
    script = Scripted({"Plan how": '{"is_multi_hop": true, "sub_questions": ["alpha", "beta"]}', "Question: alpha": '{"picks": [{"id": "s2", "confidence": 0.6}]}', "Score each": '{"scores": [{"id": "s1", "score": 0.9}]}'}, '{"picks": [{"id": "s1", "confidence": 0.7}, {"id": "s2", "confidence": 0.8}]}')
    out = Engine(spark, script, Options(strategy="single-pass", planning=True)).query(queries, viewed, docs).first()
    assert out.section_ids == ["s2", "s1"]
    out = Engine(spark, script, Options(strategy="single-pass", planning=True, rerank=True)).query(queries, viewed, docs).first()
    assert out.section_ids == ["s1", "s2"]
