"""Every registered query of the reference operators against its SQL on the smallest tables, and the others against models in plain Python."""

import html
import re

import pytest
from conftest import SF, against_sql

from proofbase.functions import text as tx
from proofbase.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got, want = against_sql(spark, SF, QUERIES[name], ORACLE_SQL[name])
    assert got == want


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


def test_rtl_lines(spark):
    """A line is turned where its final letters say so; brackets alone where only they are wrong."""
    assert {r["line"]: r["fixed"] for r in rows_of(spark, "F26_rtl_lines")} == {"םלוע םולש": "שלום עולם", "plain text": "plain text", "2024 תנש )א( קוח": "2024 תנש (א) קוח", "שלום עולם": "שלום עולם", "": ""}


def test_run_ids_differ(spark):
    from pyspark.sql import functions as F

    from proofbase.functions import web

    ids = [r[0] for r in spark.range(50).select(web.run_id(F.lit("2024-01-02").cast("timestamp"))).collect()]
    assert len(set(ids)) == 50


def test_html_texts(spark):
    """By regular expressions, which the generated pages are plain enough for."""

    def model(page):
        title = re.search(r"<title>(.*?)</title>", page, re.S)
        for tag in "script style noscript svg nav header footer aside form iframe button title".split():
            page = re.sub(rf"(?is)<{tag}\b[^>]*>.*?(</{tag}>|$)", " ", page)
        page = re.sub(r"(?s)<!--.*?-->", "", page)
        found = [x for tag in ("main", "article", "body") for x in [" ".join(re.findall(rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}>|$)", page))] if x.strip()]
        words = html.unescape(re.sub(r"<[^>]+>", " ", found[0])).split() if found else []
        return " ".join(html.unescape(title[1]).split()) if title else "", " ".join(words)

    found = {r["page_id"]: (r["title"], r["text"]) for r in rows_of(spark, "S19_html_text")}
    want = {p["page_id"]: model(p["html"]) for p in pages(spark)}
    squeezed = lambda x: (x[0], re.sub(r"\s+", "", x[1]))
    assert {k: squeezed(v) for k, v in found.items()} == {k: squeezed(v) for k, v in want.items()}


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_sections_hold_the_whole_text(spark):
    parts = {}
    for r in rows_of(spark, "W07_sections"):
        parts.setdefault(r["doc_id"], []).append((r["section"], r["text"]))
    for i, text in documents(spark).items():
        own = [x for _, x in sorted(parts.get(i, []))]
        assert re.sub(r"\s+", "", "".join(own)) == re.sub(r"\s+", "", text or "")
        assert all(0 < len(x) <= 4000 for x in own)
        # no two neighbours would fit together
        assert all(len(a) + 2 + len(b) > 4000 for a, b in zip(own, own[1:], strict=False))


def test_passages(spark):
    """Windows scored and chosen greedily, document by document."""
    norm = tx.normalize_python("thatthe onsh there one")
    terms = [w for w in dict.fromkeys(norm.split()) if w not in tx.stopwords() and (w.isdigit() or len(w) >= 2)]
    need = len(terms) if len(terms) <= 2 else max(2, -(-len(terms) * 6 // 10))
    hits = lambda words: [t for t in terms if t in words or any(w.startswith(t) and len(w) - len(t) <= 3 for w in words)]
    want = {}
    for i, text in documents(spark).items():
        lines = (text or "").split("\n")
        found = []
        for s in range(0, max(1, len(lines) - 2), 2):
            body = tx.normalize_python("\n".join(lines[s : s + 4]))
            got = hits(set(body.split()))
            if len(got) >= need:
                found.append((len(got), norm in body, s + 1, min(len(lines), s + 4)))
        chosen = []
        for n, exact, a, b in sorted(found, key=lambda x: (-(10 * x[0] / len(terms) + 5 * x[1]), x[2])):
            if all(b < x or y < a for *_, x, y in chosen):
                chosen.append((n, exact, a, b))
        if chosen:
            want[i] = [(exact, a, b) for _, exact, a, b in chosen[:12]], len(chosen)
    got = {}
    for r in sorted(rows_of(spark, "W02_F43_L05_V04_passages"), key=lambda r: r["rank"]):
        got.setdefault(r["doc_id"], ([], r["total"]))[0].append((r["exact_phrase"], r["first_line"], r["last_line"]))
    assert got == want and got


def test_every_query_has_sql_or_a_model():
    assert set(QUERIES) - set(ORACLE_SQL) == {"F26_rtl_lines", "S19_html_text", "W07_sections"}
