import random
import re

import pytest
from pyspark.sql import functions as F

from proofbase.functions import codes
from proofbase.functions import text as tx
from proofbase.operators import citations, messages, passages, records, retrieval, sequences, verification

TARIFF = [
    (1, "6115000000", "stockings and tights", "1", "ישראל ואוטונומיה"),
    (2, "6115100000", "graduated compression hosiery", "1", "אוטונומיה בלבד"),
    (3, "6115100010", "compression hosiery of cotton", "2", None),
    (4, "8703230000", "motor vehicles", "1", None),
    (5, "1000000000", "cereals, ISO 4032 tested", "1", None),
]
DDL = "rid long, code string, goods string, book string, region string"


def run(spark, q, **kw):
    rows = spark.createDataFrame(TARIFF, DDL)
    own = {retrieval.OWN: codes.normalize_code(F.col("code"))}
    return retrieval.search(rows, "rid", ["goods"], own, q, identifiers=["rid"], direction=records.direction(F.lit(None).cast("string"), F.col("book")), jurisdiction=records.jurisdiction(F.col("region")), **kw)


def shown(df):
    return [(r["rid"], r["match"]) for r in df.where("outcome = 'ranked'").orderBy("rank", "rid").collect()]


def test_item_query_puts_exact_before_parent_and_child(spark):
    assert shown(run(spark, "6115.10.00.00/3")) == [(2, "exact_code"), (1, "parent_code (6115)"), (3, "child_code")]


def test_heading_query_then_children(spark):
    assert [r for r, _ in shown(run(spark, "6115"))] == [1, 2, 3]


def test_unknown_code_has_no_parents(spark):
    assert shown(run(spark, "611599")) == []


def test_scope_is_counted(spark):
    found = retrieval.explain(run(spark, "6115", want_direction="import", want_jurisdiction="israel")).first()
    assert (found["ranked"], found["out_of_scope"]) == (1, 2)


def test_standard_is_verified(spark):
    assert shown(run(spark, "ISO 4032")) == [(5, "exact_standard")]
    assert shown(run(spark, "ISO 403")) == []


def test_identifier_only_match_is_unrelated(spark):
    found = run(spark, "4 vehicles parts zebra")
    assert [r["outcome"] for r in found.collect()] == ["unrelated"]
    assert shown(run(spark, "4 vehicles parts zebra", include_unrelated=True))[0][0] == 4


def test_terms_and_paging(spark):
    found = run(spark, "compression hosiery")
    assert shown(found) == [(2, "all_terms"), (3, "all_terms")]
    page = retrieval.page(found, 1).first()
    assert (page["rid"], page["total"], page["next_offset"]) == (2, 2, 1)
    assert retrieval.page(found, 500, 1).first()["next_offset"] is None


def test_filters(spark):
    assert [r for r, _ in shown(run(spark, "", filters={"book": "2"}))] == [3]
    with pytest.raises(records.FieldError):
        run(spark, "", filters={"nothing": 1})
    rows = spark.createDataFrame(TARIFF, DDL)
    assert records.lenient_filter(rows, {"nothing": 1}).count() == 5


def test_nearest_headings(spark):
    rows = spark.createDataFrame(TARIFF, DDL)
    index = retrieval.code_index(rows, "rid", {retrieval.OWN: codes.normalize_code(F.col("code"))})
    assert [r["heading"] for r in retrieval.nearest_headings(index, "6117").collect()] == ["6115"]


def greedy(hits):
    kept = []
    for s, page, a, b in sorted(hits, key=lambda h: (-h[0], h[1], h[2])):
        if not any(p == page and x <= b and a <= y for _, p, x, y in kept):
            kept.append((s, page, a, b))
    return sorted(kept)


def test_greedy_windows_equal_the_model(spark):
    rng = random.Random(5)
    hits = [(float(rng.randint(1, 4)), rng.randint(1, 3), a, a + 3) for a in range(1, 40, 2)]
    df = spark.createDataFrame([("d", p, a, b, s) for s, p, a, b in hits], "doc string, page int, first_line int, last_line int, score double")
    got = sorted((r["score"], r["page"], r["first_line"], r["last_line"]) for r in passages.without_overlap(df, "doc", "page").collect())
    assert got == greedy(hits)


def test_document_search_finds_the_one_page(spark):
    pages = [("d", n, "\n".join(f"line {i} of page {n}" for i in range(5))) for n in range(1, 141)]
    pages[119] = ("d", 120, "intro\nThe safety permit number 4711\nis required here\nend\nlast")
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    found = passages.search_document(df, "doc_id", "page_no", "safety permit 4711").collect()
    assert {r["page_no"] for r in found} == {120}
    assert passages.search_document(df, "doc_id", "page_no", "permit 471").count() == 0


def test_excerpt_is_located_also_across_pages(spark):
    pages = [("d", 1, "alpha beta gamma delta epsilon zeta eta theta"), ("d", 2, "iota kappa lambda mu nu xi omicron pi rho sigma"), ("d", 3, "unrelated words")]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    asked = spark.createDataFrame([(1, "d", "gamma delta epsilon zeta"), (2, "d", "zeta eta theta iota kappa lambda"), (3, "d", "never written anywhere at all")], "excerpt_id int, doc_id string, excerpt string")
    got = {r["excerpt_id"]: r["pages"] for r in citations.locate(df, asked).collect()}
    assert got == {1: [1], 2: [1, 2], 3: []}


def test_page_read_continues_without_loss(spark):
    text = "\n".join(f"row {i}" for i in range(3000))
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "next")], "doc_id string, page_no int, text string")
    body, offset = "", 0
    while offset is not None:
        r = passages.read_range(df, "doc_id", "page_no", 1, 1, offset=offset).first()
        body += r["body"]
        offset = r["next_offset"]
    assert body == text


def test_verification_truth_table(spark):
    def legal(**status):
        checks = {n: (F.lit(status.get(n, ("checked", True))[0]), F.lit(status.get(n, ("checked", True))[1])) for n in verification.CHECKS}
        return spark.range(1).select(verification.legal_dimension(checks).alias("x")).first()["x"]

    assert legal() == "verified"
    assert legal(scope=("not_checked", True)) == "partially_verified"
    assert legal(provision=("checked", False)) == "unverified"
    assert legal(validity=("contradicted", True)) == "contradicted"
    assert legal(validity=("contradicted", False)) == "partially_verified"


def test_business_needs_more_than_a_general_rule(spark):
    def b(status="claimed", claim="c", general=False, e=1, k=1, legal="verified"):
        return spark.range(1).select(verification.business_dimension(F.lit(status), F.lit(claim), F.lit(general).cast("boolean"), F.lit(e), F.lit(k), F.lit(legal)).alias("x")).first()["x"]

    assert b() == "verified"
    assert b(general=True) == "unverified"
    assert b(general=None) == "partially_verified"
    assert b(e=0, k=0) == "unverified"
    assert b(status="contradicted") == "contradicted"
    assert b(claim="") == "unverified"


def test_sequences(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 5, 4])], "k int, i int, v int")
    assert [r["i"] for r in sequences.out_of_order(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [2, 4]
    assert sequences.longest_streaks(rows, ["k"], ["i"], F.col("v") == 2).first()["streak"] == 2
    assert [r["i"] for r in sequences.within_budget(rows, ["k"], ["i"], F.col("v"), 5).orderBy("i").collect()] == [0, 1, 2]


def test_latest_state_keeps_earlier_reports(spark):
    log = spark.createDataFrame([("r", 1, "running", "partial"), ("r", 2, "failed", None)], "run string, seq int, status string, report string")
    assert tuple(messages.latest_state(log, "run", "seq").first()) == ("r", 2, 2, "failed", "partial")


def test_secrets_are_redacted_in_both_forms(spark):
    secret = 'pa"ss'
    got = spark.createDataFrame([('a pa"ss b pa\\"ss',)], "x string").select(messages.redact(F.col("x"), [secret]).alias("x")).first()["x"]
    assert "pa" not in got


def test_near_duplicates_and_empty(spark):
    near = lambda a, b: spark.range(1).select(tx.near_duplicate(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert near("a b c d e", "e d c b a") and not near("a b", "a c") and not near("", "")


def test_record_query_terms_are_of_whole_texts(spark):
    from conftest import SF

    from proofbase.plans import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["terms"].split(" ") for r in QUERIES["F04_record_query_terms"](spark, SF).collect()}
    late = 0
    for i, x in texts.items():
        words = set(re.findall(r"(?<!\S)[a-z]{5,}(?!\S)", x or ""))
        want = {w[:-1] if w.endswith("s") else w for w in words - set(tx.STOPWORDS_LATIN)}
        assert want <= set(got[i])
        late += len(x) > 300
    assert late > 100


def test_every_turn_is_located_on_all_its_pages(spark, tmp_path):
    from conftest import SF

    from proofbase.plans import QUERIES

    turns = [(1, 1, "the first turn of this conversation"), (1, 2, "quoted: The first turn, of this conversation!"), (1, 3, "short"), (2, 1, "the first turn of this conversation"), (2, 2, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["pages"] for r in QUERIES["F28_V05_located_excerpts"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): [1, 2], (1, 2): [2], (1, 3): [], (2, 1): [1], (2, 2): []}

    said = {(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    found = {(r["conv_id"], r["turn"], r["text"]): r["pages"] for r in QUERIES["F28_V05_located_excerpts"](spark, SF).collect()}
    assert set(found) == said
    for c, n, x in said:
        within = {k for d, k, y in said if d == c and x and len(x) > 60 and y and x in y}
        assert within <= set(found[c, n, x])


def test_near_duplicates_of_a_table_against_all_pairs(spark):
    import random

    from proofbase.operators import records

    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 25))] if i % 3 == 0 else list(rows[-1][1])
        rows.append((i, list(dict.fromkeys([*base[: len(base) - i % 2], f"x{i % 4}"]))))
    rows += [(100, ["the"]), (101, ["the"]), (102, [])]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    found = records.near_duplicates(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w")
    assert {(r["a"], r["b"]) for r in found.collect()} == want and want


def test_numbers_as_codes(spark):
    from proofbase.functions import codes

    got = spark.sql("SELECT * FROM VALUES (705100000D), (-70510000D), (6115.9D), (-0.5D), (12345678901D), (CAST(NULL AS DOUBLE)) t(x)").select(codes.normalize_number(F.col("x")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["0705100000", "-070510000", "6115", "0", "12345678901", ""]
    text = spark.sql("SELECT * FROM VALUES ('\t6115.00 \n'), (' -61 '), ('x') t(x)").select(codes.normalize_code(F.col("x")).alias("c"))
    assert [r["c"] for r in text.collect()] == ["611500", "-61", ""]


def test_documents_searched_last_are_kept():
    from proofbase.operators.passages import IndexedDocuments

    loads = []
    docs = IndexedDocuments(lambda d: loads.append(d) or [(1, f"רכב והרכב {d}"), (2, "word " * int(d))], most=2, budget=12)
    assert "רכב" in docs.pages("1")[0][2] and docs.pages("1")[1][0] == 2
    docs.pages("2"), docs.pages("1"), docs.pages("3"), docs.pages("1"), docs.pages("2")
    assert loads == ["1", "2", "3", "2"] and len(docs) == 2
    small = IndexedDocuments(lambda d: loads.append(d) or [(1, "a b c")], budget=2)
    small.pages("9"), small.pages("9")
    assert loads[-2:] == ["9", "9"] and not len(small)


def mixed(spark, q, **kw):
    """Numbers in code fields, numeric codes without their zero, ids and words."""
    rows = spark.createDataFrame([(1, "7318150000", None, "screws of steel"), (2, None, 708909000, "green beans"), (3, "7320100000", None, "screws and bolts"), (7318, "8481", None, "screws 73")], "rid long, code string, numeric long, goods string")
    fields = {retrieval.OWN: codes.normalize_code(F.col("code")), retrieval.REQUIREMENT: codes.normalize_number(F.col("numeric"))}
    return retrieval.search(rows, "rid", ["goods"], fields, q, identifiers=["rid"], **kw)


def test_numbers_count_where_they_head_a_code(spark):
    found = {r["rid"]: (r["relevance"], r["outcome"], r["match"]) for r in mixed(spark, "7318 screws").collect()}
    assert found[1] == ("direct", "ranked", "all_terms")
    # words alone, or the number in an identifier, are not what was asked for
    assert found[3][:2] == found[7318][:2] == ("unrelated", "unrelated")
    assert set(found) == {1, 3, 7318}
    assert shown(mixed(spark, "731815 steel screws")) == [(1, "all_terms")]


def test_near_misses_within_a_code_never_count(spark):
    assert shown(mixed(spark, "7089 beans")) == [] and shown(mixed(spark, "0708 beans")) == [(2, "all_terms")]
    assert shown(mixed(spark, "73181 screws")) == [] and shown(mixed(spark, "1500 screws")) == []


def test_mixed_query_on_a_stored_index(spark, tmp_path):
    from proofbase.sources.snapshots import build_index

    rows = spark.createDataFrame([(1, "7318150000", "screws of steel"), (2, "8481000000", "screws")], "rid long, code string, goods string")
    fields = {retrieval.OWN: codes.normalize_code(F.col("code"))}
    index = build_index(rows, f"file://{tmp_path}", "rid", F.col("goods"), fields, "a" * 16)
    assert shown(retrieval.search(rows, "rid", ["goods"], fields, "7318 screws", index=index)) == [(1, "all_terms")]
