"""Byte cuts over all documents, those of several bytes a character among them."""

from foliant.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def clipped(t, limit):
    return t.encode()[:limit].decode(errors="ignore")


def documents(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    assert any(len(r.text.encode()) > len(r.text) for r in rows)
    return rows


def test_fallback_summary(spark):
    got = {r.doc_id: r.summary for r in QUERIES["fallback_summary"](spark, SF).collect()}
    for r in documents(spark):
        head = clipped(r.text, 240) + "…" if len(r.text.encode()) > 240 else r.text
        assert got[r.doc_id] == (" ".join(head.split()) if r.text.strip() else r.source)


def test_page_budget_clip(spark):
    got = {r.document_id: (r.n, r.used) for r in QUERIES["page_budget_clip"](spark, SF).collect()}
    for r in documents(spark):
        at, text, used = 0, "", 0
        for piece in r.text.split("\n"):
            if at <= 500:
                text, used = text + clipped(piece, 500 - at), used + 1
            at += len(piece.encode())
        assert got[r.doc_id] == (len(text), used)
