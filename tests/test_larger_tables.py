"""Queries against their SQL on rows that the small tables lack."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import against_sql

from proofbase.plans import ORACLE_SQL, QUERIES

NOW = datetime(2024, 1, 1)


def same_as_sql(spark, folder, name):
    got, want = against_sql(spark, str(folder), QUERIES[name], ORACLE_SQL[name])
    assert got == want
    return got


def beats(spark, folder):
    """A run that fell silent 120.8 seconds before the last event, which are 120 between the nearest seconds and 121 between the begun ones; ends on the half second."""
    at = [(1, 179.6), (2, 180.5), (3, 179.5), (4, 178.4), (5, 300.4)]
    rows = [(i, NOW + timedelta(seconds=s), i, "view", float(i), "{}") for i, s in at]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(folder / "events.parquet"))


def one_file(folder, name):
    """The table as a file, which DuckDB reads by its name."""
    (part,) = (folder / f"{name}.parquet").glob("part-*")
    part.rename(folder / "part")
    for x in (folder / f"{name}.parquet").iterdir():
        x.unlink()
    (folder / f"{name}.parquet").rmdir()
    (folder / "part").rename(folder / f"{name}.parquet")


def test_silence_is_counted_between_nearest_seconds_in_checkpoints(spark, tmp_path):
    beats(spark, tmp_path)
    one_file(tmp_path, "events")
    assert len(same_as_sql(spark, tmp_path, "K07_T04_next_checkpoints")) == 1


def parts(spark, folder, n=2300):
    """More records with a word of the query than the cap of the ranked page has."""
    name = "CASE WHEN id % 3 = 0 THEN 'blue gear' WHEN id % 3 = 1 THEN 'gear' ELSE 'blue' END"
    rows = spark.range(1, n + 1).selectExpr("id AS p_partkey", f"{name} AS p_name", "'Brand#1' AS p_brand", "IF(id % 5 = 0, 'SMALL', 'LARGE') AS p_type", "int(id % 7) AS p_size", "1.5D AS p_retailprice")
    rows.coalesce(1).write.parquet(str(folder / "part.parquet"))
    one_file(folder, "part")


def test_outcomes_count_all_candidates(spark, tmp_path):
    parts(spark, tmp_path)
    same_as_sql(spark, tmp_path, "P19_P20_A13_V02_outcomes")


def test_silence_is_counted_between_nearest_seconds_in_liveness(spark, tmp_path):
    beats(spark, tmp_path)
    one_file(tmp_path, "events")
    same_as_sql(spark, tmp_path, "T02_liveness")


def test_mixed_search_finds_all_candidates(spark, tmp_path):
    parts(spark, tmp_path)
    assert len(same_as_sql(spark, tmp_path, "V01_F16_mixed_search")) == 2300


def test_terms_are_not_sought_word_by_word(spark):
    """Words are filtered by expressions over the whole text, and the terms are made once a row."""
    from conftest import SF

    plan = QUERIES["F04_record_query_terms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("[^ ]{1,2}") == 1


def test_terms_of_awkward_words(spark):
    from pyspark.sql import functions as F

    from proofbase.functions import text as tx

    rows = spark.createDataFrame([("",), ("a bb ccc classes this datasets 1 12 12 2024s axles oss",), ("the of 7",), ("תקנה ab abc buses 15",), (None,)], "n string")
    got = [tuple(r) for r in rows.select(tx.record_query_terms(F.col("n")), tx.document_query_terms(F.col("n"))).collect()]
    assert got[0] == ([], []) and got[4] == (None, None)
    assert got[1] == (["2024", "axle", "ccc", "classe", "oss", "12"], ["bb", "ccc", "classes", "1", "12", "2024s", "axles", "oss"])
    assert got[2] == (["the", "of", "7"], ["of", "7"])
    assert got[3] == (["abc", "buse", "תקנה", "15"], ["תקנה", "ab", "abc", "buses", "15"])


def kept(monkeypatch):
    """The tables that citations stores, in order."""
    from proofbase.operators import citations

    seen, store = [], citations.stored
    monkeypatch.setattr(citations, "stored", lambda df: seen.append(store(df)) or seen[-1])
    return seen


def test_located_excerpts_move_no_texts_with_their_windows(spark, monkeypatch):
    from conftest import SF

    seen = kept(monkeypatch)
    same_as_sql(spark, SF, "F28_V05_located_excerpts")
    assert seen and all(x.schema["excerpt_id"].dataType.typeName() == "binary" for x in seen if "excerpt_id" in x.columns)
    assert all("text" not in x.columns for x in seen)


def test_opportunities_index_only_windows_of_their_quotations(spark, monkeypatch):
    from conftest import SF

    seen = kept(monkeypatch)
    same_as_sql(spark, SF, "V06_opportunities")
    (windows,), index = [x for x in seen if "m" in x.columns], next(x for x in seen if "at" in x.columns)
    assert index.join(windows, ["doc_id", "g"], "left_anti").count() == 0


def test_findings_index_only_windows_of_their_quotations(spark, monkeypatch):
    from conftest import SF

    seen = kept(monkeypatch)
    same_as_sql(spark, SF, "V07_finding_assessment")
    (windows,), index = [x for x in seen if "m" in x.columns], next(x for x in seen if "at" in x.columns)
    assert index.join(windows, ["doc_id", "g"], "left_anti").count() == 0


def test_only_windows_asked_for_are_indexed(spark, monkeypatch):
    from conftest import SF

    seen = kept(monkeypatch)
    same_as_sql(spark, SF, "V05_benchmark_in_documents")
    (windows,), index = [x for x in seen if "m" in x.columns], next(x for x in seen if "at" in x.columns)
    assert index.join(windows, "g", "left_anti").count() == 0


def test_small_files_are_read_in_batches(spark):
    """Records of files come from one call a batch, and equal those of the table function, which is called for each file."""
    from conftest import SF

    from proofbase.sources import functions_sql

    same_as_sql(spark, SF, "S14_S16_S27_records_in_sql")
    plan = QUERIES["S14_S16_S27_records_in_sql"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDTF" not in plan and "ArrowEvalPython" in plan
    files = [("csv", b"a;b\n1;2\n\n3\n"), ("csv", b""), ("csv", None), ("json", b'[{"x": 1}, {}, {"x": null, "y": "z"}]'), ("json", b"{"), ("xlsx", b"no archive"), ("csv", b"q,'a;b'\n\"1,2\";3\n"), ("json", b"[{}]"), (None, b"a,b\n1,2")] * 130
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id int, kind string, content binary")
    functions_sql.register(spark)
    one = spark.sql("SELECT id, r.* FROM {df}, LATERAL file_records(kind, content) r", df=df).collect()
    many = spark.sql("SELECT id, r.* FROM {df} LATERAL VIEW inline(file_rows(kind, content)) r AS sheet, row_no, cells, problem", df=df).collect()
    assert sorted(map(repr, many)) == sorted(map(repr, one)) and len(one) == 130 * 10


def test_dialects_of_files_of_one_shape():
    import csv
    import random

    from proofbase.sources import formats

    rng, about = random.Random(3), lambda d: (d.delimiter, d.quotechar, d.doublequote, d.skipinitialspace, d.quoting)
    for _ in range(3000):
        head = "".join(rng.choice(["a", "bc", "7", "é", "\r", "\n", "\n", " ", ",", ";", ";", "\t", "|"] + ["'", '"'] * (rng.random() < 0.1)) for _ in range(rng.randint(0, 60)))
        try:
            want = csv.Sniffer().sniff(head, ",;\t|")
        except csv.Error:
            want = csv.excel
        assert about(formats.csv_dialect(head)) == about(want), head


def test_the_index_is_sorted_where_its_rows_are_read(spark, tmp_path):
    """No posting is moved: a record's are in one file, and there are as many files as parts of the table."""
    from conftest import SF
    from pyspark.sql import functions as F

    from proofbase.sources.snapshots import build_index

    for name in ("K05_postings", "J05_L02_term_search", "F17_F18_bm25"):
        same_as_sql(spark, SF, name)
    rows = spark.range(0, 300, 1, 3).selectExpr("id AS rid", "concat('w', id % 7, ' v', id, ' common') AS text")
    index = build_index(rows, str(tmp_path), "rid", F.col("text"), {}, "f" * 64, records=False)
    files = sorted((tmp_path / ("index-" + "f" * 16) / "postings").glob("part-*"))
    found = [[tuple(r) for r in spark.read.parquet(str(f)).select("token", "rid").collect()] for f in files]
    assert len(found) == 3 and all(x == sorted(x) for x in found)
    assert sorted(len({rid for _, rid in x}) for x in found) == [100, 100, 100] and index["sizes"].count() == 300


def test_findings_bring_only_quoted_passages_to_the_labels(spark):
    """Whole texts don't take part in the join with the labels."""
    from conftest import SF

    from proofbase.plans.registry import Tables
    from proofbase.plans.relations import quoted_findings

    rows, _ = quoted_findings(Tables(spark, SF))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring(text")


def plans(monkeypatch, kind):
    """The plans of the tables that citations stores, by their columns."""
    from proofbase.operators import citations

    seen, store = [], citations.stored

    def shown(df):
        seen.append((df.columns, getattr(df._jdf.queryExecution(), kind)().toString()))
        return store(df)

    monkeypatch.setattr(citations, "stored", shown)
    return seen


def test_texts_are_not_tested_before_they_meet_excerpts(spark, monkeypatch):
    """Only pages that an excerpt names are normalised for the test."""
    from conftest import SF

    seen = plans(monkeypatch, "optimizedPlan")
    same_as_sql(spark, SF, "V05_benchmark_in_documents")
    (plan,) = [plan for columns, plan in seen if "pages" in columns]
    assert not [x for x in plan[plan.index("Join") :].splitlines() if "Filter" in x and "regexp_extract_all" in x and "> 0)" in x]


def test_findings_of_one_page_documents_make_no_windows(spark, monkeypatch):
    """A quotation of a document of one page is tested on it: nothing is indexed, and nothing moved for an index."""
    from conftest import SF

    seen = kept(monkeypatch)
    same_as_sql(spark, SF, "V07_finding_assessment")
    (windows,), index = [x for x in seen if "m" in x.columns], next(x for x in seen if "at" in x.columns)
    assert windows.count() == 0 and index.count() == 0


def test_excerpts_are_found_alike_with_and_without_places(spark):
    from proofbase.operators import citations

    w = [f"word{i}" for i in range(60)]
    said = lambda a, b: " ".join(w[a:b])
    pages = spark.createDataFrame([("one", 1, said(0, 30)), ("two", 1, said(0, 20)), ("two", 2, said(20, 40)), ("two", 3, None), ("none", 1, None), ("empty", 4, "")], "doc_id string, page_no int, text string")
    texts = [said(2, 20), said(2, 4), said(15, 26), "ord3 " + said(4, 9) + " wor", said(40, 50), said(3, 30) + " other words", "short", "", None, said(0, 8)[2:-1]]
    rows = [(f"{d}{i}", d, x) for d in ("one", "two", "none", "empty", "missing") for i, x in enumerate(texts)]
    excerpts = spark.createDataFrame(rows, "excerpt_id string, doc_id string, excerpt string")
    found = [{r.excerpt_id: r.pages for r in citations.locate(pages, excerpts, places=p).collect()} for p in (True, False)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert [found[1][f"one{i}"] for i in range(10)] == [[1], [], [1], [1], [], [1], [], [], [], [1]] and found[1]["two2"] == [1, 2]
