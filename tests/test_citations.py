"""Quotations, citations, findings and opportunities against plain models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofbase.functions import text as tx
from proofbase.operators import assessment, citations, verification

PAGES = "doc_id string, page_no int, text string"


def found_model(excerpt, content):
    e, body = tx.normalize_python(excerpt), tx.normalize_python(content)
    if len(e) < 15 or not body:
        return False
    if e in body:
        return True
    w = e.split()
    wins = [" ".join(w[i : i + 6]) for i in range(0, len(w) - 5, 3)]
    return bool(wins) and 10 * sum(x in body for x in wins) >= 8 * len(wins)


def located_model(pages, excerpt, doc):
    mine = sorted((p, t or "") for d, p, t in pages if d == doc)
    on = [p for p, t in mine if found_model(excerpt, t)]
    if on:
        return on
    for (p, a), (_, b) in zip(mine, mine[1:], strict=False):
        if found_model(excerpt, a[-2000:] + "\n" + b[:2000]):
            return [p, p + 1]
    return []


def library(seed=4):
    rng = random.Random(seed)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(n))
    shared = words(40)
    pages = [(f"d{d}", p, f"{words(rng.randint(0, 150))} {shared if p % 3 == 0 else ''} {words(30)}") for d in range(6) for p in range(1, 8)]
    pages += [("d0", 9, None), ("d0", 10, ""), ("d1", 20, "É Ñandú Straße " * 8), ("long", 1, words(60_000)), ("long", 2, words(50))]
    excerpts = []
    for d, p, t in pages:
        if not t:
            continue
        for _ in range(6):
            n = rng.choice([12, 16, 25, 60, 150, 400])
            i = rng.randrange(max(1, len(t) - n))
            cut = t[i : i + n]  # begins and ends within words
            excerpts.append((d, cut))
            w = cut.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "changed"
            excerpts.append((d, " ".join(w)))
        after = next((x for e, q, x in pages if e == d and q > p and x is not None), "")
        n = rng.randint(8, 80)
        excerpts += [(d, t[-n:] + " " + after[: rng.randint(8, 80)]), (d, (t[-2300:] + " " + after)[:2600])]
    excerpts += [("d0", shared), ("d5", shared.upper()), ("none", shared), ("d1", "e nandu"), ("d1", "straße é ñandú straße"), ("d2", ""), ("d2", None), ("d3", "not written anywhere in here at all, really not")]
    return pages, [(i, d, e) for i, (d, e) in enumerate(excerpts)]


def test_located_excerpts_equal_the_model(spark):
    pages, excerpts = library()
    df, asked = spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(excerpts, "excerpt_id int, doc_id string, excerpt string")
    got = {r["excerpt_id"]: r for r in citations.locate(df, asked).collect()}
    want = {i: located_model(pages, e, d) for i, d, e in excerpts}
    assert {i: r["pages"] for i, r in got.items()} == want
    assert sum(map(bool, want.values())) > 300 and sum(not x for x in want.values()) > 50 and any(len(x) > 1 for x in want.values())
    # an excerpt of whole words that is found as it is begins where the index says
    texts = {(d, p): tx.normalize_python(t).split() for d, p, t in pages}
    placed = 0
    for i, d, e in excerpts:
        w = tx.normalize_python(e).split()
        if want[i] and len(w) >= 8 and got[i]["start"] is not None:
            body, at = texts[d, want[i][0]], got[i]["start"]
            if " ".join(w) in " ".join(body) and body.count(w[1]) < 3:
                assert body[at + 1 : at + len(w) - 1] == w[1:-1]
                placed += 1
    assert placed > 20


def test_excerpts_in_all_documents_on_a_stored_index(spark, tmp_path):
    pages, excerpts = library(9)
    df = spark.createDataFrame(pages, PAGES)
    index = citations.store_index(df, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(i, e) for i, _, e in excerpts], "excerpt_id int, excerpt string")
    got = {(r["excerpt_id"], r["doc_id"]): r["pages"] for r in citations.locate(df, asked, index, cited=False).collect()}
    long = [(i, e) for i, _, e in excerpts if len(tx.normalize_python(e).split()) >= 6]
    want = {(i, d): p for i, e in long for d in {d for d, *_ in pages} if (p := located_model(pages, e, d))}
    assert got == want


def test_no_pages_and_no_excerpts(spark):
    none, some = spark.createDataFrame([], PAGES), spark.createDataFrame([("d", 1, "one two three four five six seven")], PAGES)
    asked = spark.createDataFrame([(1, "d", "one two three four five six")], "excerpt_id int, doc_id string, excerpt string")
    assert [(r["excerpt_id"], r["pages"]) for r in citations.locate(none, asked).collect()] == [(1, [])]
    assert citations.locate(some, asked.limit(0)).collect() == []
    assert [r["pages"] for r in citations.locate(some, asked).collect()] == [[1]]


# --- what was retrieved

QUOTE = "the importer shall keep the declaration for seven years"


@pytest.fixture(scope="module")
def evidence(spark):
    resources = [("r1", "ok", "https://data.gov.il/dataset/a", f"row: {QUOTE}"), ("r2", "no_matching_records", "https://data.gov.il/dataset/b", None), ("r3", "rejected", "https://example.org/x", QUOTE)]
    urls = [
        ("https://www.gov.il/law", True, "pdf", None, "law", None), ("https://example.org/blog", True, "html", None, None, f"We read: {QUOTE}."), ("https://www.gov.il/down", False, "html", None, None, None),
        ("https://data.gov.il/api/3/action/package_show?id=x", True, "ckan_dataset", None, None, QUOTE), ("https://data.gov.il/r2", True, "csv", "r2", None, None), ("https://www.gov.il/lost", True, "pdf", None, "lost", None), ("https://www.gov.il/page", True, "html", None, None, QUOTE),
    ]
    pages = [("law", 1, "First page."), ("law", 2, f"Section 4: {QUOTE}, in writing."), ("law", 3, "kept in force until the minister"), ("law", 4, "orders otherwise for a product of this kind"), ("other", 1, "text of another document")]
    return assessment.Evidence(
        spark.createDataFrame(resources, "resource_id string, status string, source_url string, evidence_text string"),
        spark.createDataFrame(urls, "url_key string, ok boolean, source_type string, resource_id string, doc_id string, text string"),
        spark.createDataFrame(pages, PAGES),
    )


CITED = {
    # url, excerpt, resource, document, page -> kind, official, status, pages, excerpt found, verified, page mismatch
    "law": (("https://WWW.gov.il/law/", QUOTE, "", "", "p. 2"), ("legal_document", True, "ok", [2], True, True, False)),
    "wrong page": (("https://www.gov.il/law", QUOTE, None, None, "7"), ("legal_document", True, "ok", [2], True, True, True)),
    "across": (("https://www.gov.il/law", "in force until the minister orders otherwise", "", "law", "3-4"), ("legal_document", True, "ok", [3, 4], True, True, False)),
    "not there": (("https://www.gov.il/law", "the importer may discard everything after one day", "", "", ""), ("legal_document", True, "ok", [], False, False, None)),
    "no quote": (("https://www.gov.il/law", "", "", "", "2"), ("legal_document", True, "ok", [], False, False, None)),
    "other document": (("https://www.gov.il/law", QUOTE, "", "unknown", ""), ("legal_document", True, "ok", [], False, False, None)),
    "record": (("https://example.org/a", QUOTE, "r1", "", ""), ("dataset", True, "ok", [], True, True, None)),
    "no records": (("https://data.gov.il/r2", QUOTE, "", "", ""), ("dataset", True, "no_matching_records", [], False, False, None)),
    "rejected": (("https://example.org/x", QUOTE, "r3", "", ""), ("dataset", False, "rejected", [], False, False, None)),
    "blog": (("https://example.org/blog#top", QUOTE, "", "", ""), ("web", False, "ok", [], True, True, None)),
    "down": (("https://www.gov.il/down", QUOTE, "", "", ""), ("legal_document", True, "failed", [], False, False, None)),
    "metadata": (("https://data.gov.il/api/3/action/package_show?id=x", QUOTE, "", "", ""), ("dataset", True, "metadata_only", [], False, False, None)),
    "never": (("https://www.gov.il/never", QUOTE, "", "", ""), ("legal_document", True, "not_retrieved", [], False, False, None)),
    "unknown data": (("https://example.org/never", QUOTE, "r9", "", ""), ("dataset", False, "not_retrieved", [], False, False, None)),
    "lost": (("https://www.gov.il/lost", QUOTE, "", "", ""), ("legal_document", True, "failed", [], False, False, None)),
    "by document": (("https://www.gov.il/never", QUOTE, "", "law", "2"), ("legal_document", True, "ok", [2], True, True, False)),
}


def test_citations_are_verified_by_what_was_retrieved(spark, evidence):
    asked = spark.createDataFrame([(n, *c) for n, (c, _) in CITED.items()], "citation_id string, url string, excerpt string, resource_id string, document_id string, page string").withColumn("extra", F.lit(1))
    got = {r["citation_id"]: tuple(r[x] for x in ("kind", "official", "retrieval_status", "matched_pages", "excerpt_verified", "verified", "page_mismatch")) for r in citations.verify(asked, evidence.resources, evidence.urls, evidence.pages).collect()}
    assert {n for n in CITED if got[n] != CITED[n][1]} - {"other document"} == set()
    # a document that is not the URL's is no source of it; the text of the URL has no such quotation
    assert got["other document"][4:6] == (False, False)


def test_a_quotation_may_be_optional(spark, evidence):
    rows = [("a", "https://www.gov.il/page", "", "", "", "", False), ("b", "https://www.gov.il/page", "", "", "", "", True)]
    df = spark.createDataFrame(rows, "citation_id string, url string, excerpt string, resource_id string, document_id string, page string, require_excerpt boolean")
    got = {r["citation_id"]: (r["verified"], r["note"]) for r in citations.verify(df, evidence.resources, evidence.urls, evidence.pages).collect()}
    assert got == {"a": (True, "retrieved"), "b": (False, "retrieved, no excerpt quoted")}


# --- findings and opportunities

SRC = assessment.SOURCE
FINDING = f"finding_id string, statement string, claim_type string, negative boolean, source {SRC}, legal_checks map<string, struct<status: string, source: {SRC}>>, business struct<based_on: string, generally_available: boolean, differentiator: string, competitor: {SRC}>"
LAW, WRONG, BLOG, DATA = (("https://www.gov.il/law", QUOTE, "", "", "2"), ("https://www.gov.il/law", "the importer may discard everything after one day", "", "", ""), ("https://example.org/blog", QUOTE, "", "", ""), ("https://data.gov.il/x", QUOTE, "r1", "", ""))


def all_checks(source=LAW, status="checked", **other):
    return {n: other.get(n, (status, source)) for n in verification.CHECKS}


def test_findings_are_judged_conservatively(spark, evidence):
    rows = [
        ("full", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(), None),
        # a verified quotation alone is no verified conclusion; it stands for the provision
        ("quote only", "Declarations are kept", "legal_conclusion", None, LAW, {}, None),
        ("no proof", "Declarations are kept", "legal_conclusion", None, WRONG, {}, None),
        ("from data", "Declarations are kept", "legal_conclusion", None, DATA, all_checks(DATA), None),
        ("class from data", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(product_classification=("not applicable", DATA)), None),
        ("claims too much", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(WRONG), None),
        ("contradicted", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(validity=("Contradicted", LAW)), None),
        ("false alarm", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(validity=("contradicted", WRONG)), None),
        ("odd status", "Declarations are kept", "legal_conclusion", None, LAW, all_checks(scope=("verified!", LAW)), None),
        ("negative fact", "Toys are exempt", "fact", None, LAW, all_checks(), None),
        ("flagged", "Toys", "odd", True, LAW, None, None),
        ("fact", "Toys are sold", "fact", None, BLOG, None, None),
        ("bad address", "Toys are sold", "fact", None, ("ftp://x", QUOTE, "", "", ""), None, None),
        ("nothing", None, None, None, None, None, None),
        ("edge", "We keep them", "business_advantage", None, BLOG, None, ("full", False, "", BLOG)),
        ("unbased", "We keep them", "business_advantage", None, BLOG, None, ("gone", False, "", BLOG)),
        ("weak base", "We keep them", "business_advantage", None, BLOG, None, ("quote only", False, "", BLOG)),
        ("for all", "We keep them", "business_advantage", None, BLOG, None, ("full", True, "", BLOG)),
        ("open", "We keep them", "business_advantage", None, BLOG, None, ("full", None, "", BLOG)),
        ("no rival", "We keep them", "business_advantage", None, BLOG, None, ("full", False, "", None)),
        ("based on fact", "We keep them", "business_advantage", None, WRONG, None, ("fact", False, "", None)),
    ]
    df = spark.createDataFrame(rows, FINDING).withColumn("note", F.lit("kept"))
    found = {r["finding_id"]: r for r in assessment.findings(df, evidence).collect()}
    assert {n: (r["source_status"], r["legal_status"], r["business_status"]) for n, r in found.items()} == {
        "full": ("verified", "verified", None), "quote only": ("verified", "partially_verified", None), "no proof": ("unverified", "unverified", None), "from data": ("verified", "unverified", None),
        "class from data": ("verified", "verified", None), "claims too much": ("verified", "unverified", None), "contradicted": ("verified", "contradicted", None), "false alarm": ("verified", "partially_verified", None),
        "odd status": ("verified", "partially_verified", None), "negative fact": ("verified", "unverified", None), "flagged": ("verified", "unverified", None), "fact": ("partially_verified", None, None),
        "bad address": ("unverified", None, None), "nothing": ("unverified", None, None), "edge": ("partially_verified", None, "verified"), "unbased": ("partially_verified", None, "partially_verified"),
        "weak base": ("partially_verified", None, "partially_verified"), "for all": ("partially_verified", None, "unverified"), "open": ("partially_verified", None, "partially_verified"),
        "no rival": ("partially_verified", None, "partially_verified"), "based on fact": ("unverified", None, "unverified"),
    }
    assert found["negative fact"]["legal_notes"][0] == "negative claim not established" and found["flagged"]["claim_type"] == "fact"
    assert found["full"]["matched_pages"] == [2] and found["full"]["note"] == "kept" and found["full"]["legal_notes"] is None
    counted = verification.counters(assessment.findings(df, evidence)).first()
    assert (counted["findings"], counted["legal_conclusions"], counted["legal_verified"], counted["business_verified"], counted["negative_unresolved"], counted["contradicted"]) == (21, 9, 2, 1, 2, 1)


OPPORTUNITY = f"opportunity_id string, name string, regulatory_mechanism string, summary string, classification string, claim_type string, primary array<{SRC}>, secondary array<{SRC}>, contradictory array<{SRC}>, legal_checks map<string, struct<status: string, evidence: array<{SRC}>>>, business struct<status: string, claim: string, differentiator: string, generally_available: boolean, evidence: array<{SRC}>, competitors: array<{SRC}>>"


def test_class_a_needs_everything(spark, evidence):
    def checks(source=LAW):
        return {n: ("checked", [source]) for n in verification.CHECKS}

    edge = ("claimed", "cheaper", "", False, [BLOG], [BLOG])
    make = lambda i, class_="A", primary=(LAW,), legal=None, business=edge, type_="positive", name="Bolts": (i, name, "", None, class_, type_, list(primary), [BLOG], None, checks() if legal is None else legal, business)
    rows = [
        make("all"), make("one bad", primary=(LAW, WRONG)), make("all bad", primary=(WRONG,)), make("data only", primary=(DATA,)), make("no law checked", legal={}), make("class b", "B", (WRONG,)),
        make("negative", legal={}, type_="negative"), make("by words", legal={}, type_=None, name="exempt bolts"), make("rivals", business=("contradicted", "cheaper", "", False, [], [BLOG])), make("no claim", business=None),
    ]
    found = {r["opportunity_id"]: r for r in assessment.opportunities(spark.createDataFrame(rows, OPPORTUNITY), evidence).collect()}
    shown = {n: (r["verification_status"], r["legal_verification"], r["business_verification"], r["classification"], r["downgraded_from"]) for n, r in found.items()}
    assert shown == {
        "all": ("verified", "verified", "verified", "A", None), "one bad": ("partially_verified", "verified", "verified", "B", "A"), "all bad": ("unverified", "verified", "verified", "B", "A"), "data only": ("verified", "verified", "verified", "B", "A"),
        "no law checked": ("verified", "unverified", "partially_verified", "B", "A"), "class b": ("unverified", "verified", "verified", "B", None), "negative": ("verified", "unverified", "partially_verified", "B", "A"),
        "by words": ("verified", "unverified", "partially_verified", "B", "A"), "rivals": ("verified", "verified", "contradicted", "A", None), "no claim": ("verified", "verified", "unverified", "A", None),
    }
    assert found["one bad"]["verification_notes"] == ["downgraded from A to B: primary sources not all verified", "https://www.gov.il/law: retrieved, excerpt not found"]
    assert found["data only"]["verification_notes"][0].endswith("no verified legal text") and found["no law checked"]["verification_notes"][0].endswith("legal applicability not verified")
    assert [n for n, r in found.items() if r["negative_claim"]] == ["negative", "by words"] and "negative claim not established" in found["by words"]["verification_notes"]
    assert found["all"]["unread_primary_sources"] == []
