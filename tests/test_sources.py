import gzip
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from proofbase.functions import codes
from proofbase.operators import retrieval
from proofbase.sources import catalogue, fetch, formats, snapshots

FIELDS = [{"id": "_id", "type": "int"}, {"id": "code", "type": "numeric"}, {"id": "name", "type": "text"}]
ROWS = [{"_id": i, "code": 705100000 + i, "name": f"row {i}"} for i in range(1, 8)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([tuple(r.values()) for r in rows], "_id long, code long, name string").repartition(3)


@pytest.fixture
def parted(spark):
    """Small tables keep their partitions, so that a version has several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.usefixtures("parted")
def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    folder = str(tmp_path)
    assert snapshots.manifest(spark, folder).count() == 0
    assert snapshots.sync(table(spark), folder, "t", "20240101T000000Z", FIELDS, "2024-01-01T00:00:00Z", expected=7) == "updated"
    rows = snapshots.read_snapshot(spark, folder, "t")
    assert [(r["_id"], str(r["code"])) for r in rows.orderBy("_id").collect()][0] == (1, "705100001")
    assert rows.orderBy("_id").first()["body"] == json.dumps(ROWS[0], separators=(",", ":"))
    assert [(r["dataset"], r["version"], r["row_count"]) for r in snapshots.manifest(spark, folder).collect()] == [("t", "20240101T000000Z", 7)]
    base = tmp_path / "t" / "20240101T000000Z"
    parts = [p for p in os.listdir(base) if p.startswith("part-")]
    assert len(parts) > 1 and sum(p["rows"] for p in json.loads((base / "snapshot.json").read_text())["parts"]) == 7
    lines = gzip.decompress((base / parts[0]).read_bytes())
    (base / parts[0]).write_bytes(gzip.compress(lines.replace(b"row", b"raw", 1)))
    with pytest.raises(snapshots.SnapshotError, match="checksum"):
        snapshots.read_snapshot(spark, folder, "t")
    (base / parts[0]).write_bytes(gzip.compress(lines + lines))
    with pytest.raises(snapshots.SnapshotError, match="count"):
        snapshots.read_snapshot(spark, folder, "t")
    with pytest.raises(snapshots.SnapshotError, match="unknown"):
        snapshots.current(folder, "none")


@pytest.mark.usefixtures("parted")
def test_a_failing_task_leaves_no_version(spark, tmp_path):
    def broken(batches):
        for b in batches:
            if 4 in b.column(0).to_pylist():
                raise ValueError("lost row")
            yield b

    folder = str(tmp_path)
    snapshots.sync(table(spark), folder, "t", "v1", FIELDS, "now")
    rows = table(spark, [r | {"_id": r["_id"] + 1} for r in ROWS])
    # the rows fail in a task of the write itself: the lines are made from what mapInArrow yields
    with pytest.raises(Exception, match="lost row"):
        rows.mapInArrow(broken, rows.schema).select(F.to_json(F.struct("*")).alias("value")).write.format("snapshot").options(dataset="t", version="v2").mode("append").save(folder)
    with pytest.raises(Exception, match="count: 7 rows of 8"):
        snapshots.write_snapshot(rows, folder, "t", "v3", FIELDS, expected=8)
    with pytest.raises(Exception, match="empty"):
        snapshots.write_snapshot(rows.limit(0), folder, "t", "v4", FIELDS)
    # tasks that still ran may have left parts of no version; the next one that is published clears them
    assert [n for n in sorted(os.listdir(tmp_path / "t")) if not n.startswith(".tmp-")] == ["current.json", "v1"] and snapshots.current(folder, "t")["version"] == "v1"
    snapshots.sync(rows, folder, "t", "v2", FIELDS, "now")
    assert sorted(os.listdir(tmp_path / "t")) == ["current.json", "v1", "v2"]


def test_syncs_keep_the_last_valid_version(spark, tmp_path):
    folder, now = str(tmp_path), "2024-01-01T00:00:00Z"
    run = lambda v, rows=ROWS, **kw: snapshots.sync(table(spark, rows), folder, "t", v, FIELDS, now, **kw)
    assert run("v1") == "updated" and run("v2") == "unchanged_content" and snapshots.current(folder, "t")["version"] == "v1"
    for rows, kind, kw in [(ROWS + ROWS[:1], "duplicate_ids", {}), (ROWS[:2], "shrink", {}), (ROWS, "drift", {"recount": lambda: 8})]:
        with pytest.raises(snapshots.SnapshotError) as e:
            run("v3", rows, **kw)
        assert e.value.kind == kind
    assert run("v3", ROWS[:2], allow_shrink=True) == run("v4", ROWS[:3]) == run("v5", ROWS[:4]) == "updated"
    # the two newest stay
    assert sorted(os.listdir(tmp_path / "t")) == ["current.json", "v4", "v5"]


def test_all_current_versions_are_verified_in_one_pass(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for key, rows in {"a": ROWS, "b": ROWS[:3], "c c": ROWS[1:], "d": ROWS}.items():
        snapshots.sync(table(spark, rows), folder, key, "v1", FIELDS, "now")
    part = next(p for p in (tmp_path / "b" / "v1").iterdir() if p.name.startswith("part-"))
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"705", b"706")))
    for p in (tmp_path / "d" / "v1").glob("part-*"):
        p.unlink()
    assert {r["dataset"]: (r["row_count"], r["expected_rows"], r["status"]) for r in snapshots.verify(spark, folder).collect()} == {"a": (7, 7, "ok"), "b": (3, 3, "checksum"), "c c": (6, 6, "ok"), "d": (None, 7, "missing")}


def test_two_newest_versions_stay(tmp_path):
    for v in ("1", "2", "3", "4"):
        os.makedirs(tmp_path / "t" / v)
    os.makedirs(tmp_path / "t" / ".tmp-9")
    assert sorted(snapshots.prune(str(tmp_path / "t"), 2, {"1"})) == [".tmp-9", "2"]


@pytest.mark.parametrize(("rows", "kind"), [([], "empty"), ([(1,), (1,)], "duplicate_ids"), ([(1,), (None,)], "null_ids"), ([(1,)], "shrink")])
def test_validation_faults(spark, rows, kind):
    df = spark.createDataFrame(rows, "_id long")
    with pytest.raises(snapshots.SnapshotError) as e:
        snapshots.validate(df, "_id", previous_rows=10)
    assert e.value.kind == kind


def test_sync_decisions():
    old = {"fingerprint": "a", "content_hash": "c"}
    assert snapshots.sync_decision(old, "a", None, 1) == "unchanged_fingerprint"
    assert snapshots.sync_decision(old, "a", "c", 9) == "unchanged_content"
    assert snapshots.sync_decision(old, "b", "d", 1) == "updated"
    assert snapshots.sync_decision(None, "b", None, None) == "updated"


def test_index_is_built_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "6115000000", "warm socks")], "rid long, code string, goods string")
    make = lambda: snapshots.build_index(rows, str(tmp_path), "rid", F.col("goods"), {retrieval.OWN: codes.normalize_code(F.col("code"))}, "f" * 64)
    first = make()
    before = sorted(os.listdir(tmp_path / ("index-" + "f" * 16) / "codes"))
    assert {r["token"] for r in make()["postings"].collect()} == {"warm", "socks", "6115000000"}
    assert sorted(os.listdir(tmp_path / ("index-" + "f" * 16) / "codes")) == before
    assert first["codes"].first()["hier"] == "6115"


def test_csv_dialects_and_ragged_rows():
    assert list(formats.csv_rows("a;b\n1;2\n;\n".encode("utf-8-sig"))) == [["a", "b"], ["1", "2"]]
    assert list(formats.csv_rows("שם,ערך\nא,1\n".encode("cp1255")))[0] == ["שם", "ערך"]
    header, rows = formats.ingest_csv(b"a,b\n007\n\n1,2,3\n")
    assert header == ["a", "b"] and rows == [{"_row": "1", "a": "007", "b": ""}, {"_row": "3", "a": "1", "b": "2", "_extra": '["3"]'}]
    with pytest.raises(formats.FormatError):
        formats.ingest_csv(b"")


def workbook(sheets):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = lambda row: "".join(f'<c r="{chr(65 + k)}1" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx_and_mixed_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"one": [["k", "v"], ["1", "x"]], "two": [["k"], [" "], ["2"]]}))
    (tmp_path / "b.csv").write_text("k,v\n3,y\n")
    (tmp_path / "c.json").write_text('{"features": [{"properties": {"k": 4}}]}')
    kind = F.regexp_extract("path", "\\.([a-z]+)$", 1)
    rows = formats.read_files(spark, str(tmp_path), kind).orderBy("path", "row_no").collect()
    assert [(r["kind"], r["row_no"], r["cells"]["k"]) for r in rows] == [("xlsx", 0, "1"), ("xlsx", 1, "2"), ("csv", 0, "3"), ("json", 0, "4")]
    with pytest.raises(formats.FormatError):
        list(formats.xlsx_sheets(b"not a zip"))


def test_json_shapes():
    assert formats.json_records([{"a": 1}, 2]) == [{"a": 1}]
    assert formats.json_records({"result": {"records": [{"a": 1}]}}) == [{"a": 1}]
    assert formats.json_records({"x": 1}) is None
    assert formats.envelope_text({"result": {"fields": [{"id": "a"}], "records": [{"a": 1}]}}) == "Columns: a\n1"


def test_html_prefers_main_and_drops_scripts():
    page = "<title>T &amp; U</title><body><nav>menu</nav><main>Hello <script>x()</script> <b>world</b></main>foot</body>"
    assert formats.read_html(page) == ("T & U", "Hello world")
    assert formats.read_html(None) == ("", "")


def test_sections_and_glyphs():
    parts = formats.split_sections("a" * 30 + "\n\n" + "b c " * 10, target=25)
    assert all(len(p) <= 25 for p in parts) and "".join(parts).replace(" ", "").replace("\n", "") == "a" * 30 + "bc" * 10
    assert formats.glyph_line([(0, 5, "a"), (5, 10, "b"), (14, 19, "c")], 10) == "ab c"


def test_safe_addresses():
    ok = lambda u: fetch.is_safe(u, lambda h: ["10.0.0.1"] if h == "inner" else ["93.184.216.34"])
    assert ok("https://host/x") and not ok("http://inner/") and not ok("file:///etc/passwd") and not ok("http://127.0.0.1") and not ok("http://[::1]/")


def test_fetcher_retries_redirects_and_logs(spark):
    answers = {"http://a/": [fetch.Response("http://a/", 503, "0", b""), fetch.Response("/b", 302, "", b"")], "http://a/b": [fetch.Response("http://a/b", 200, "text/plain", b"ok")]}
    f = fetch.Fetcher(open=lambda u: answers[u].pop(0), resolve=lambda h: ["93.184.216.34"], sleep=lambda s: None)
    assert f.get("http://a/").data == b"ok" and f.get("http://a/").data == b"ok"
    assert [r["outcome"] for r in f.log_frame(spark).collect()] == ["sent", "cached"]
    with pytest.raises(fetch.FetchError):
        f.get("http://127.0.0.1/")
    assert fetch.delay(2, None) == 4 and fetch.delay(0, "9") == 9 and fetch.delay(9, None) == 60


@pytest.fixture
def api(tmp_path):
    packages = [{"id": "p1", "name": "socks", "title": "Hosiery imports", "notes": "tariff rows", "resources": [{"id": "r1", "name": "table", "format": "CSV", "url": "u", "datastore_active": "true"}]}]
    (tmp_path / "packages.json").write_text(json.dumps(packages))
    (tmp_path / "r1.json").write_text(json.dumps({"fields": FIELDS, "records": ROWS}))
    return str(tmp_path)


def test_catalogue_source_pages_and_filters(spark, api):
    catalogue.register(spark)
    rows = spark.read.format("catalogue").option("resource", "r1").option("page_rows", "3").load(api)
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 7
    assert [r["name"] for r in rows.where("_id = 4").collect()] == ["row 4"]
    assert catalogue.search_table(spark, api, "r1", "row", limit=2, offset=5).count() == 2
    assert catalogue.packages(spark, api, "hosiery").first()["resource_id"] == "r1"


def test_gate_decides_before_reading(spark, api):
    assert catalogue.read_resource(spark, api, "r1", "aviation fuel")[0] == "rejected"
    assert catalogue.read_resource(spark, api, "r1", "hosiery zebra")[0] == "no_matching_records"
    assert catalogue.read_resource(spark, api, "none", "hosiery")[0] == "failed"


def test_pdf_readers_fall_back_page_by_page():
    def missing(data):
        raise ImportError

    def broken(data):
        return 3, lambda i: ["plain", "x", ""][i] if i != 1 else 1 / 0

    placed = lambda data: (3, lambda i: ["unused", "םלוע םולש", "unused"][i])
    found = formats.read_pdf(b"", None, {"a": broken}, {"b": missing, "c": placed})
    assert found.pages == ["plain", "שלום עולם", ""] and found.methods == ["a", "c", "a"]
    assert found.problems == ["b is not installed", "page 2, a: ZeroDivisionError"]
    hebrew = lambda data: (1, lambda i: "םולש")
    alone = formats.read_pdf(b"", None, {"a": hebrew}, {"b": missing})
    assert alone.pages == ["שלום"] and "may be wrong" in alone.problems[-1]
    assert formats.read_pdf(b"", 1, {"a": broken}, {}).problems == ["1 of 3 pages read"]
    with pytest.raises(formats.FormatError):
        formats.read_pdf(b"", None, {"a": missing}, {})


def test_unreadable_pdfs_are_rows(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    row = formats.read_pdfs(spark, str(tmp_path)).first()
    assert (row["page_no"], row["method"]) == (0, "failed") and row["problems"]


def test_glyphs_make_lines():
    glyphs = [(0, 5, 20.0, 10, "c"), (5, 10, 1.0, 10, "b"), (0, 5, 0.0, 10, "a"), (20, 25, 20.5, 10, "d")]
    assert formats.glyph_lines(glyphs) == ["ab", "c d"]


def test_buttons_go_and_templates_stay():
    assert formats.read_html("<body>a <button>b</button> <template>c</template></body>")[1] == "a c"


def test_search_by_the_stored_index(spark, tmp_path):
    """Variants of prefixed Hebrew words, codes that only another dataset has, several datasets on one page."""
    goods = spark.createDataFrame([(1, "6115000000", "warm socks"), (2, "6101000000", "תקן לרכב"), (3, "61", "chapter")], "rid long, code string, goods string")
    other = spark.createDataFrame([(7, "6199", "only here")], "rid long, code string, goods string")
    code = {retrieval.OWN: codes.normalize_code(F.col("code"))}
    described = {}
    for name, rows in (("goods", goods), ("other", other)):
        index = snapshots.build_index(rows, str(tmp_path / name), "rid", F.col("goods"), code, "a" * 64)
        described[name] = {"rows": rows, "rid": "rid", "fields": ["goods"], "code_fields": code, "index": index}
        made = retrieval.search(rows, "rid", ["goods"], code, "socks").select("rid", "rank").collect()
        assert made == retrieval.search(rows, "rid", ["goods"], code, "socks", index=index).select("rid", "rank").collect()
    hits = lambda q, **how: {(r["dataset"], r["rid"], r["match"]) for r in retrieval.search_datasets(described, q, **how).collect()}
    assert ("goods", "2", "all_terms") in hits("הרכב")
    # 6199 is no code of goods, but a code all the same, so its chapter is found there
    assert ("goods", "3", "parent_code (61)") in hits("6199", chosen=["goods"])
    assert not hits("6198", chosen=["goods"])
    plan = retrieval.text_candidates(described["goods"]["index"]["postings"], ["socks"])._jdf.queryExecution().toString()
    assert "StringStartsWith(token,socks)" in plan
    best = retrieval.page(retrieval.search_datasets(described, "6199"), 5)
    assert [r["dataset"] for r in best.collect()] == ["other", "goods"]


def test_catalogue_calls_go_through_the_fetcher():
    answers = iter([fetch.Response("u", 503, "0", b""), fetch.Response("u", 200, "application/json", b'{"success": true, "result": {"a": 1}}')])
    f = fetch.Fetcher(open=lambda u: next(answers), resolve=lambda h: ["93.184.216.34"], sleep=lambda s: None, most_calls=1)
    assert catalogue.fetch("https://host/api", "x", {"q": "1"}, f) == {"a": 1} == catalogue.fetch("https://host/api", "x", {"q": "1"}, f)
    assert [x["outcome"] for x in f.log] == ["sent", "cached"]
    with pytest.raises(fetch.FetchError):
        catalogue.fetch("https://host/api", "x", {"q": "2"}, f)
    inner = fetch.Fetcher(resolve=lambda h: ["10.0.0.1"], sleep=lambda s: None)
    with pytest.raises(fetch.FetchError):
        catalogue.fetch("https://inner/api", "x", {}, inner)


def test_verified_asset_is_fetched_once(tmp_path):
    import hashlib

    calls = []
    get = lambda: calls.append(1) or b"data"
    path, digest = str(tmp_path / "d" / "a"), hashlib.sha256(b"data").hexdigest()
    assert fetch.verified_asset(path, digest, get) == fetch.verified_asset(path, digest, get) == path and len(calls) == 1
    open(path, "wb").write(b"broken")
    fetch.verified_asset(path, digest, get)
    assert len(calls) == 2
    with pytest.raises(fetch.FetchError):
        fetch.verified_asset(str(tmp_path / "b"), "0" * 64, get)


def test_search_results_flag_primary_sources(spark):
    rows = fetch.search_results(spark, [{"title": "a", "link": "https://www.gov.il/x", "snippet": "s"}, {"title": "b", "url": "https://example.com"}]).collect()
    assert [r["primary_source"] for r in rows] == [True, False]
