"""The run log, the document store, provenance and stubs against plain models."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proofbase.operators import documents, messages, runs
from proofbase.sources import snapshots
from proofbase.streaming import events as streams

NOW = datetime(2024, 1, 1)


def test_run_log_keeps_what_later_entries_do_not_set(spark, tmp_path):
    folder = str(tmp_path / "log")
    write = streams.append_once(folder, ("run_id", "n"))
    schema = spark.createDataFrame([], runs.SCHEMA).schema
    minute = iter(range(1, 100))

    def step(make, ddl, rows, secrets=None):
        at = NOW + timedelta(minutes=next(minute))
        log = spark.read.schema(schema).parquet(folder) if (tmp_path / "log").exists() else spark.createDataFrame([], schema)
        entries = make(spark.createDataFrame([(r[0], at, *r[1:]) for r in rows], "run_id string, at timestamp" + ddl), runs.state(log), secrets)
        write(entries.select(*schema.names), 0)
        write(entries.select(*schema.names), 1)  # a repeated batch changes nothing
        return {r["run_id"]: r for r in runs.state(spark.read.schema(schema).parquet(folder)).collect()}

    made = step(runs.create, ", domain string, config string", [("a", "d", '{"key": "s3cret"}'), ("b", "d", None), ("c", None, None)], ["s3cret"])
    assert {r["status"] for r in made.values()} == {"running"} and made["a"]["config"] == '{"key": "[redacted]"}' and made["a"]["checkpoint_seq"] == 0
    with pytest.raises(Exception, match="run exists: a"):
        step(runs.create, ", domain string, config string", [("a", "d", None)])
    step(runs.checkpoint, ", label string, phase string, state string, summary string", [("a", "x" * 400, "reading", "S1", "{}"), ("b", "one", "reading", "T1", "{}")])
    with pytest.raises(Exception, match="unknown run zz"):
        step(runs.checkpoint, ", label string, phase string, state string, summary string", [("zz", "", "", "", "")])
    two = step(runs.checkpoint, ", label string, phase string, state string, summary string, status string, error string", [("a", "two", "writing", "S2", "{}", None, "slow")])
    assert (two["a"]["checkpoint_seq"], two["a"]["state"], two["a"]["phase"], two["a"]["error"], two["b"]["checkpoint_seq"]) == (2, "S2", "writing", "slow", 1)
    early = step(runs.finish, ", status string, error string, final_report string, partial_report string", [("b", "failed", "e" * 5000, None, "P1")])
    assert (early["b"]["status"], len(early["b"]["error"]), early["b"]["partial_report"], early["b"]["state"]) == ("failed", 4000, "P1", "T1")
    # signs of life are of running runs only, and change no label
    beat = step(runs.heartbeat, "", [("a",), ("b",), ("nobody",)])
    assert beat["a"]["heartbeat_at"] > two["a"]["heartbeat_at"] and beat["a"]["updated_at"] == two["a"]["updated_at"] and beat["b"] == early["b"] and set(beat) == {"a", "b", "c"}
    named = step(runs.heartbeat, ", label string, phase string", [("a", "now reading", None)])
    assert (named["a"]["label"], named["a"]["phase"]) == ("now reading", "writing") and named["a"]["updated_at"] > two["a"]["updated_at"]
    again = step(runs.resume, "", [("b",)])
    assert (again["b"]["status"], again["b"]["error"], again["b"]["label"], again["b"]["partial_report"]) == ("running", "", "resumed", "P1")
    with pytest.raises(Exception, match="no status: done"):
        step(runs.finish, ", status string, error string, final_report string, partial_report string", [("b", "done", "", None, None)])
    last = step(runs.finish, ", status string, error string, final_report string, partial_report string", [("b", "completed", None, "F1", None)])
    assert (last["b"]["status"], last["b"]["final_report"], last["b"]["partial_report"], last["b"]["checkpoint_seq"]) == ("completed", "F1", "P1", 1)
    log = spark.read.schema(schema).parquet(folder)
    assert sorted((r["run_id"], r["seq"], r["label"][:3]) for r in runs.checkpoints(log).collect()) == [("a", 1, "xxx"), ("a", 2, "two"), ("b", 1, "one")]
    # a run with a state that is silent for two minutes can go on; one without a state cannot
    ready = runs.resumable(runs.state(log), F.lit(NOW + timedelta(hours=3))).collect()
    assert [(r["run_id"], r["status"], r["state"]) for r in ready] == [("a", "interrupted", "S2")]


def test_documents_are_stored_once_and_found_by_address(spark):
    ddl = "url string, final_url string, content string, source_type string, fetched_at timestamp"
    h = lambda n: NOW + timedelta(hours=n)
    none = spark.createDataFrame([], "doc_id string, final_url string, source_type string, fetched_at timestamp"), spark.createDataFrame([], "url_key string, doc_id string, fetched_at timestamp")
    first = [("HTTPS://A.org/x/", "https://a.org/y#p", "one", "html", h(0)), ("https://b.org", "", "two", "csv", h(1)), ("https://c.org/", None, "one", "html", h(2)), ("https://d.org/1", None, "three", "pdf", h(3)), ("https://d.org/1", None, "four", "pdf", h(4))]
    new, urls = documents.put(*none, spark.createDataFrame(first, ddl))
    ids = {r["content"]: r["doc_id"] for r in new.collect()}
    assert set(ids) == {"one", "two", "three", "four"} and all(len(x) == 20 for x in ids.values())
    assert {r["url"] for r in new.collect() if r["content"] == "one"} == {"HTTPS://A.org/x/"}
    held = new.select("doc_id", "final_url", "source_type", "fetched_at")
    later, urls = documents.put(held, urls, spark.createDataFrame([("https://b.org", None, "one", "html", h(5)), ("https://e.org", None, "five", "text", h(6))], ddl))
    assert [r["content"] for r in later.collect()] == ["five"]
    held = held.unionByName(later.select(*held.columns))
    asked = spark.createDataFrame([(u,) for u in ("https://a.org/x", "https://A.org/y?", "https://B.org/#z", "https://d.org/1", "https://e.org/", "https://none.org", "not a url", None)], "url string")
    found = {r["url"]: r["doc_id"] for r in documents.documents_of(asked, urls).collect()}
    one = ids["one"]
    assert found["https://a.org/x"] == found["https://B.org/#z"] == one and found["https://d.org/1"] == ids["four"] and found["https://none.org"] is found["not a url"] is found[None] is None
    recent = lambda ttl=86_400, at=6: {r["url"]: r["age_seconds"] for r in documents.cached(asked, urls, held, F.lit(h(at)), ttl).collect()}
    assert {u: a // 3600 for u, a in recent().items() if u != "https://A.org/y?"} == {"https://a.org/x": 6, "https://B.org/#z": 6, "https://d.org/1": 2, "https://e.org/": 0}
    assert set(recent(ttl=7200)) == {"https://d.org/1", "https://e.org/"} and recent(ttl=0) == {} and recent(at=40) == {}


def test_listing_and_provenance(spark, tmp_path):
    folder = str(tmp_path)
    assert snapshots.listing(spark, folder).collect() == [] and snapshots.provenance(spark, folder).collect() == []
    fields = [{"id": "_id", "type": "int"}, {"id": "ItemFullClassification", "type": "text"}]
    rows = spark.createDataFrame([(1, "6115"), (2, "7318")], "_id long, ItemFullClassification string")
    about = {"label": "Tariff", "dataset_title": "The tariff", "publisher": "Office", "license_title": "open", "resource_id": "r1", "source_url": "https://data.gov.il/x"}
    snapshots.sync(rows, folder, "tariff", "v1", fields, "2024-01-01T00:00:00Z", about=about)
    snapshots.sync(rows, folder, "tariff", "v2", fields, "2024-01-05T00:00:00Z", about=about)
    snapshots.sync(rows.select("_id"), folder, "ids", "v7", fields[:1], "2024-01-02T00:00:00Z")
    listed = {r["dataset"]: r.asDict() for r in snapshots.listing(spark, folder).collect()}
    assert listed["tariff"] == {"dataset": "tariff", "label": "Tariff", "title": "The tariff", "resource_name": "", "publisher": "Office", "row_count": 2, "record_id_field": "_id", "fields": ["_id", "ItemFullClassification"], "code_fields": ["ItemFullClassification"], "snapshot_version": "v1", "retrieved_at": "2024-01-01T00:00:00Z", "last_verified_at": "2024-01-05T00:00:00Z", "resource_id": "r1", "source_url": "https://data.gov.il/x"}
    assert listed["ids"]["label"] == "ids" and listed["ids"]["code_fields"] == []
    where = {r["dataset"]: r for r in snapshots.provenance(spark, folder).collect()}
    assert len(where["tariff"]) == 15 and where["tariff"]["license"] == "open" and where["tariff"]["snapshot_content_hash"].startswith("2-") and where["ids"]["publisher"] == ""


STUBS = {
    "search_web": ({"results": [{"title": "t " * 90, "url": "u", "primary_source": True, "snippet": "long"}] * 12}, {"query": "q"}, lambda s: s["query"] == "q" and len(s["results"]) == 10 and len(s["results"][0]["title"]) == 90 and "snippet" not in s["results"][0]),
    "fetch_url": ({"url": "u", "ok": True, "document_id": "doc-1", "text": "x" * 9000, "document": {"unit": "page", "page_count": 3, "status": "complete", "chars": 7}}, {}, lambda s: s["document"] == {"unit": "page", "page_count": 3, "status": "complete"} and s["text"].startswith("[compacted") and "error" not in s),
    "search_document": ({"document_id": "doc-1", "query": "q", "pages_with_matches": list(range(50)), "results": [{"page": 4, "first_line": 1, "last_line": 4, "text": "word " * 100}] * 9}, {}, lambda s: len(s["pages_with_matches"]) == 30 and len(s["results"]) == 5 and s["results"][0]["lines"] == "1-4" and len(s["results"][0]["text"]) == 240),
    "read_document_range": ({"document_id": "doc-1", "source_url": "u", "pages": [{"page": 1, "text": "y" * 500}]}, {}, lambda s: len(s["pages"][0]["start"]) == 160),
    "get_document_status": ({"document_id": "doc-1", "status": "partial", "page_count": 9, "pages_without_text": [2], "issues": ["i"], "methods": ["m"]}, {}, lambda s: s == {"document_id": "doc-1", "status": "partial", "page_count": 9, "pages_without_text": [2], "issues": ["i"]}),
    "search_local_government_records": ({"total_matches": 40, "records": [{"dataset": "d", "record_id": "7", "match": "exact_code", "record_line": "z" * 300, "fields": {}}] * 10}, {"query": "7318", "dataset": "d"}, lambda s: s["total_matches"] == 40 and len(s["records"]) == 8 and s["records"][0]["ref"] == "d:7" and len(s["records"][0]["line"]) == 200 and "note" not in s),
    "get_local_government_record": ({"found": True, "dataset": "d", "record_id": "9", "record_line": "a: b"}, {"record_id": "9"}, lambda s: s["records"] == [{"ref": "d:9", "match": "", "line": "a: b"}] and s["query"] == "9" and s["total_matches"] == 1),
    "search_government_datasets": ({"results": [{"id": "p1", "title": "T", "likely_relevant": True, "notes": "n"}]}, {"query": "q"}, lambda s: s["results"] == [{"id": "p1", "title": "T", "likely_relevant": True}]),
    "inspect_government_dataset": ({"status": "ok", "id": "p1", "title": "T", "resources": [{"id": "r", "name": "n" * 100}] * 12}, {}, lambda s: len(s["resources"]) == 10 and len(s["resources"][0]["name"]) == 80 and "publisher" not in s),
    "read_government_resource": ({"status": "ok", "records": "a | b\n" * 300}, {"resource_id": "r1", "query": "q"}, lambda s: s["resource_id"] == "r1" and len(s["records"]) == 600),
    "get_evidence": ({"evidence_id": "E7", "text": "x" * 3000}, {}, lambda s: s["retrieved_evidence_id"] == "E7"),
    "update_checklist": ({"items": 3}, {}, lambda s: s == {"items": 3}),
    "anything": ({"text": "x" * 3000, "more": 1}, {}, lambda s: list(s) == ["summary"] and len(s["summary"]) == 1200),
}


def test_stubs_keep_what_each_tool_is_cited_by(spark):
    rows = [(tool, json.dumps(result), json.dumps(args)) for tool, (result, args, _) in STUBS.items()]
    rows += [("failed", json.dumps({"error": "no such page", "document_id": "doc-9"}), "{}"), ("fetch_url", json.dumps({"error": "down", "url": "u"}), None), ("none", None, None), ("search_web", "no json " * 300, None), ("search_local_government_records", json.dumps({"total_matches": 0, "records": []}), json.dumps({"query": "x"}))]
    df = spark.createDataFrame(rows, "tool string, result string, args string")
    got = [json.loads(r["s"]) for r in df.select(messages.stub(F.col("tool"), F.lit("E1"), F.col("result"), F.col("args")).alias("s")).collect()]
    kept = [json.loads(g["summary"]) if g.get("summary") else None for g in got]
    assert all(g["evidence_id"] == "E1" and g["compacted"] and g["full_result"] == "get_evidence('E1')" for g in got)
    assert [tool for (tool, (*_, ok)), s in zip(STUBS.items(), kept, strict=False) if not ok(s)] == []
    assert kept[len(STUBS) :] == [{"error": "no such page", "document_id": "doc-9"}, {"error": "down"}, {"summary": ""}, {"summary": ("no json " * 300)[:1199] + "…"}, {"query": "x", "total_matches": 0, "records": [], "note": "Zero matches (not proof of an exemption)."}]




def test_run_log_in_a_database(spark):
    from conftest import SF

    from proofbase.plans.registry import Tables
    from proofbase.plans.state import event_log
    from proofbase.sources import run_store

    url, driver = "jdbc:derby:memory:runs;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    log = event_log(Tables(spark, SF)).cache()
    assert not run_store.exists(spark, url, "run_log", **driver)
    run_store.append(log.where("n <= 3"), url, **driver)
    run_store.append(log, url, **driver)
    run_store.append(log, url, **driver)  # nothing is stored twice
    held = run_store.read_log(spark, url, partitions=3, **driver)
    assert held.rdd.getNumPartitions() == 3 and held.count() == log.count()
    shown = lambda df: sorted(map(str, df.select("run_id", "n", "checkpoint_seq", "created_at", "updated_at", "status", "phase", "label", "state", "final_report", "partial_report").collect()))
    assert shown(runs.state(held)) == shown(runs.state(log))
    points = lambda df: sorted(map(str, runs.checkpoints(df).collect()))
    assert points(held) == points(log)
    newest = [r["run_id"] for r in run_store.latest(spark, url, most=5, **driver).collect()]
    assert newest == [r["run_id"] for r in runs.state(log).orderBy(F.desc("created_at"), "run_id").limit(5).collect()]
    plan = held.where("kind = 'checkpoint' and run_id = '1'").select("run_id", "seq")._jdf.queryExecution().executedPlan().toString().upper()
    scan = plan[plan.index("SCAN JDBC") :]
    assert "EQUALTO(KIND,CHECKPOINT)" in scan and "EQUALTO(RUN_ID,1)" in scan and "FINAL_REPORT" not in scan
