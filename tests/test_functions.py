import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofbase.functions import codes, rtl, web
from proofbase.functions import text as tx


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normalising_paths_agree(spark):
    texts = ["Être À l'Œuvre", "  Tab\tand​zero", "שָׁלוֹם עולם", "", None, "x_1 2024/5", "Ångström café"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in rows.select("i", tx.normalized(F.col("x")).alias("fast"), tx.normalized_exact(F.col("x")).alias("exact")).collect():
        assert r["fast"] == r["exact"] == tx.normalize_python(texts[r["i"]])


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_normalising_is_idempotent(x):
    once = tx.normalize_python(x)
    assert tx.normalize_python(once) == once or any(ord(ch) > 0x2000 for ch in once)


@pytest.mark.parametrize(
    ("value", "code", "hier"),
    [("6115.10.00.00/2", "6115100000", "611510"), ("-1234", "-1234", "-1234"), ("1000000000", "1000000000", "10"), ("6115000000", "6115000000", "6115"), ("ISO 7", "", ""), ("", "", ""), (None, "", "")],
)
def test_codes(spark, value, code, hier):
    c = codes.normalize_code(F.lit(value).cast("string"))
    assert tuple(one(spark, c.alias("c"), codes.hierarchy_key(c).alias("h"))) == (code, hier)


def test_numeric_code_is_padded(spark):
    assert one(spark, codes.normalize_number(F.lit(705100000)).alias("c"))["c"] == "0705100000"


def test_code_query_needs_two_digits(spark):
    assert tuple(one(spark, codes.code_query(F.lit("7")).alias("a"), codes.code_query(F.lit("87.03")).alias("b"))) == ("", "8703")


@pytest.mark.parametrize(
    ("text", "refs"),
    [("see ISO/IEC 4032-1:2013", [("ISO", "4032", "1")]), ("EPEN 71", []), ("EN 71 part 2, EN 71 part 2", [("EN", "71", "2")]), ('ת"י 1347 חלק 3', [("SI", "1347", "3")]), ("DIN 0933", [("DIN", "933", "")]), (None, [])],
)
def test_standard_refs(spark, text, refs):
    assert [tuple(x) for x in one(spark, codes.standard_refs(F.lit(text).cast("string")).alias("r"))["r"]] == refs


def test_standard_part_matters_only_if_asked(spark):
    found = codes.standard_refs(F.lit("EN 71-2"))
    hit = lambda q: one(spark, codes.standard_matches(found, codes.standard_refs(F.lit(q))).alias("x"))["x"]
    assert (hit("EN 71"), hit("EN 71-2"), hit("EN 71-3"), hit("EN 711")) == (True, True, False, False)


@pytest.mark.parametrize(("term", "token", "hit"), [("תקנה", "התקנות", True), ("תקנה", "תקנת", True), ("רכב", "והרכב", True), ("רכב", "מרכבה", True), ("רכב", "xרכב", False), ("רכב", "רכבzz", False)])
def test_hebrew_match(spark, term, token, hit):
    assert one(spark, tx.hebrew_match(F.lit(term), F.lit(token)).alias("x"))["x"] is hit


def test_numbers_match_whole_words_in_documents(spark):
    vocabulary = F.array(F.lit("20245"), F.lit("tariffs"))
    got = one(spark, tx.document_hits(F.array(F.lit("2024"), F.lit("tariff")), vocabulary).alias("x"))["x"]
    assert got == ["tariff"]


def test_variants_stop_at_first_failure(spark):
    assert one(spark, tx.token_variants(F.lit("והרכב")).alias("x"))["x"] == ["והרכב", "הרכב", "רכב"]
    assert one(spark, tx.token_variants(F.lit("cars")).alias("x"))["x"] == ["cars"]


def test_excerpts(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    found = lambda e: one(spark, tx.excerpt_found(F.lit(e), F.lit(body)).alias("x"))["x"]
    assert found("three four five six") and not found("three four") and not found("alpha beta gamma delta epsilon zeta eta")


def test_url_and_host(spark):
    r = one(spark, web.url_key(F.lit("HTTPS://A.Gov.IL/x/y/?q=1#f")).alias("k"), web.url_key(F.lit("http://h")).alias("r"), web.is_official(F.lit("https://www.gov.il/a")).alias("o"), web.is_official(F.lit("https://notgov.il/a")).alias("n"))
    assert tuple(r) == ("https://a.gov.il/x/y?q=1", "http://h/", True, False)


def test_freshness_and_rounding(spark):
    fresh = lambda d: one(spark, web.freshness(F.lit(d).cast("double")).alias("x"))["x"]
    assert [fresh(x) for x in (1.0, 5.0, 30.0, None)] == ["fresh", "aging", "stale", "stale"]
    assert one(spark, web.passage_score(F.lit(13), F.lit(16), F.lit(False)).alias("x"))["x"] == 8.12


def test_page_mismatch_is_tristate(spark):
    pages = F.array(F.lit(3))
    x = lambda cited: one(spark, web.page_mismatch(F.lit(cited), pages).alias("x"))["x"]
    assert (x("p. 3"), x("p. 9"), x("none")) == (False, True, None)


def test_right_to_left_repair():
    assert rtl.repair("םלוע םולש") == "שלום עולם"
    assert rtl.repair("plain (text)") == "plain (text)"
    assert rtl.repair("שלום עולם") == "שלום עולם"
    assert rtl.logical("2024 תנש")[-4:] == "2024"


def test_checklist_rules(spark):
    status = lambda new, refs, note: one(spark, web.checklist_status(F.lit("open"), F.lit(new), F.array(*map(F.lit, refs)), F.lit(note)).alias("x"))["x"]
    assert status("resolved", ["E1"], "") == "resolved"
    assert status("resolved", ["nothing"], "") == "open"
    assert status("unresolved", ["E1"], " ") == "open"
    assert status("not_applicable", ["x"], "why") == "not_applicable"


def test_run_ids_are_unique(spark):
    made = [r[0] for r in spark.range(50).select(web.run_id(F.current_timestamp())).collect()]
    assert len(set(made)) == 50
