"""Queries of run state, messages, streams and composites (S24-S27, T, V, K, P26-P31) on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbase.operators import messages, records, reports, sequences
from proofbase.plans.registry import Tables, query
from proofbase.streaming import events as streams

TUMBLING = "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


@query("T01_tumbling_batch", TUMBLING)
def t01(t: Tables) -> DataFrame:
    return streams.tumbling(t.events)


@query("T01_tumbling_stream", TUMBLING)
def t01_stream(t: Tables) -> DataFrame:
    """The same plan run as a stream over the table's file, to its end."""
    stream = streams.read_stream(t.spark, t._dir, t.events.schema, "events.parquet")
    return streams.run_available(streams.tumbling(stream), "t01_tumbling").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "T02_sessions",
    """WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 hour, true) AS b FROM events), s AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 hour AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t02(t: Tables) -> DataFrame:
    return streams.sessions(t.events)


@query("T02_liveness", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN epoch(now)::BIGINT - epoch(max(ts))::BIGINT > 120 THEN 'interrupted' ELSE 'running' END AS status FROM events, m GROUP BY user_id, now")
def t02_liveness(t: Tables) -> DataFrame:
    """As of the table's last event, never of the clock."""
    now = t.events.agg(F.max("ts").alias("now"))
    beats = t.events.groupBy("user_id").agg(F.max("ts").alias("beat"))
    return beats.join(F.broadcast(now)).select("user_id", messages.effective_status(F.lit("running"), messages.nearest_second(F.col("beat")), messages.nearest_second(F.col("now"))).alias("status"))


@query("T03_K07_S25_run_state", "SELECT user_id, max(event_id) AS last_seq, count(*) AS checkpoints, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS report FROM events GROUP BY 1")
def t03(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("report"))
    return messages.latest_state(log, "user_id", "event_id")


@query("T05_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def t05(t: Tables) -> DataFrame:
    keyed = t.events.select("user_id", "event_type", F.concat_ws(":", "user_id", "event_type").alias("event_id"))
    return streams.deduplicated(keyed).select("user_id", "event_type")


@query("P26_running_budget", "SELECT event_id, c <= 20 AS admitted FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events)")
def p26(t: Tables) -> DataFrame:
    return sequences.sequence_numbers(t.events, ["user_id"], ["event_id"]).select("event_id", (F.col("seq") <= 20).alias("admitted"))


@query(
    "P27_stubs",
    r"""WITH x AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations), s AS (SELECT conv_id, turn, role, CASE WHEN length(x) <= 90 THEN x ELSE substr(x, 1, 89) || '…' END AS title, CASE WHEN length(x) <= 160 THEN x ELSE substr(x, 1, 159) || '…' END AS start, CASE WHEN length(x) <= 200 THEN x ELSE substr(x, 1, 199) || '…' END AS line FROM x)
    SELECT conv_id, turn, 'E' || turn AS evidence_id, CASE turn % 3 WHEN 0 THEN title WHEN 1 THEN start ELSE line END AS quote, CASE turn % 3 WHEN 2 THEN role || ':' || turn END AS ref, CASE turn % 3 WHEN 0 THEN 'about ' || turn END AS asked FROM s""",
)
def p27(t: Tables) -> DataFrame:
    """Turns as the results of three tools, a web search, pages of a document and records, and what their stubs keep."""
    kind = F.col("turn") % 3
    tool = F.when(kind == 0, "search_web").when(kind == 1, "read_document_range").otherwise("search_local_government_records")
    none = F.lit(None)
    result = (
        F.when(kind == 0, F.to_json(F.struct(F.array(F.struct(F.col("text").alias("title"), F.lit("https://example.org/x").alias("url"))).alias("results"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("doc-1").alias("document_id"), F.array(F.struct(F.col("turn").alias("page"), "text")).alias("pages"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.col("role").alias("dataset"), F.col("turn").cast("string").alias("record_id"), F.col("text").alias("record_line"))).alias("records"))))
    )
    args = F.to_json(F.struct(F.when(kind == 0, F.concat(F.lit("about "), "turn")).otherwise(none).alias("query")))
    stubbed = t.conversations.withColumn("stub", messages.stub(tool, F.concat(F.lit("E"), "turn"), result, args))
    kept = F.get_json_object("stub", "$.summary")
    quote = F.when(kind == 0, F.get_json_object(kept, "$.results[0].title")).when(kind == 1, F.get_json_object(kept, "$.pages[0].start")).otherwise(F.get_json_object(kept, "$.records[0].line"))
    return stubbed.select("conv_id", "turn", F.get_json_object("stub", "$.evidence_id").alias("evidence_id"), quote.alias("quote"), F.get_json_object(kept, "$.records[0].ref").alias("ref"), F.when(kind == 0, F.get_json_object(kept, "$.query")).alias("asked"))


@query("P29_resumable", "SELECT event_id, event_type IN ('error', 'view') AND user_id % 2 = 0 AND value <= 50 AS resumable FROM events")
def p29(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "interrupted").otherwise("completed")
    return t.events.select("event_id", messages.can_resume(F.col("user_id") % 2 == 0, status, F.col("value") > 50).alias("resumable"))


@query(
    "P30_provider_items",
    """SELECT conv_id, turn, 0 AS item_no, CASE role WHEN 'assistant' THEN 'output_text' ELSE role END AS kind, text AS content, CAST(NULL AS VARCHAR) AS ref FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'function_call', 'read {}', 'c' || turn FROM conversations WHERE role = 'assistant'""",
)
def p30(t: Tables) -> DataFrame:
    call = F.array(F.struct(F.concat(F.lit("c"), "turn").alias("id"), F.lit("read").alias("name"), F.lit("{}").alias("arguments")))
    return messages.provider_items(t.conversations.withColumns({"calls": F.when(F.col("role") == "assistant", call), "call_id": F.lit(None).cast("string")}), "conv_id", "turn")


@query("P31_split_output", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS text, count(*) FILTER (role = 'user') AS calls FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') > 0")
def p31(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "message").when(F.col("role") == "user", "function_call").otherwise("reasoning")
    gathered = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), "text", F.lit("read").alias("name")))).alias("output"))
    split = gathered.select("conv_id", messages.split_output(F.col("output")).alias("s"))
    return split.where("s.text <> ''").select("conv_id", "s.text", F.size("s.calls").alias("calls"))


@query("S24_document_pages", "SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE conv_id = 5 ORDER BY turn")
def s24(t: Tables) -> DataFrame:
    return reports.page_listing(t.conversations, "conv_id", 5, "turn")


@query("S26_evidence_page", "SELECT doc_id, substr(text, 1001, 15000) AS page, CASE WHEN length(text) > 16000 THEN 16000 END AS next_offset FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE n_chars > 16000)")
def s26(t: Tables) -> DataFrame:
    wanted = t.documents.where("n_chars > 16000").agg(F.min("doc_id")).first()[0]
    return messages.evidence_page(t.documents.select("doc_id", "text"), "doc_id", str(wanted), 1000)


@query("K06_insert_new", "SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha256(text)")
def k06(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("content"))
    once = hashed.where("doc_id % 2 = 1").groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    return messages.insert_new(hashed.where("doc_id % 2 = 0"), once, "content").select("doc_id")


@query("K08_partial_report", "SELECT lang, to_json({'confirmed': list_sort(list(doc_id::VARCHAR) FILTER (n_chars > 3000)), 'open': list_sort(list(doc_id::VARCHAR) FILTER (n_chars <= 3000))})::VARCHAR AS json FROM documents GROUP BY lang")
def k08(t: Tables) -> DataFrame:
    return messages.partial_report_json(t.documents, "lang", F.col("doc_id").cast("string"), F.col("n_chars") > 3000).select("lang", "json")


@query("K09_trace_export", "SELECT event_id, event_type || ' (' || user_id || ')' AS line FROM events")
def k09(t: Tables) -> DataFrame:
    return reports.trace_lines(t.events, "event_id", "event_type", "user_id")


@query("K10_redacted", "SELECT conv_id, turn, replace(text, 'the', '[redacted]') AS text FROM conversations")
def k10(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", messages.redact(F.col("text"), ["the"]).alias("text"))


@query("V11_novelty", "SELECT event_id, event_id = min(event_id) OVER (PARTITION BY event_type, props) AND value > 1 AS new_evidence FROM events")
def v11(t: Tables) -> DataFrame:
    return messages.novelty(t.events, "event_id", ["event_id"], F.col("event_type"), F.col("props"), F.col("value") <= 1).select("event_id", "new_evidence")


@query("V13_completion_review", "SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AND sum(value) < 2000 AND count(*) < 300 AS review FROM events GROUP BY 1")
def v13(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("o"), F.sum("value").alias("v"), F.count("*").alias("n"))
    return per.select("user_id", messages.needs_review(F.col("o"), F.col("v") < 2000, F.col("n"), 300).alias("review"))


@query(
    "V14_document_status",
    """WITH p AS (SELECT conv_id, count(*) AS n, list(k ORDER BY k) FILTER (turn % 4 = 3) AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1)
    SELECT conv_id, CASE WHEN e IS NULL OR (len(e) = 1 AND (e[1] = 1 OR e[1] = n) AND n > 1) THEN 'complete' ELSE 'partial' END AS status FROM p""",
)
def v14(t: Tables) -> DataFrame:
    from proofbase.sources.formats import document_status

    page = F.when(F.col("turn") % 4 == 3, F.lit(" ")).otherwise(F.col("text"))
    pages = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("t")))), lambda x: x["t"]).alias("pages"))
    return pages.select("conv_id", document_status(F.col("pages")).alias("status"))


@query("P21_L03_gated_rows", "SELECT page_id, len(list_filter(['shop', 'example'], lambda q: contains(lower(url), q))) AS score FROM pages WHERE contains(lower(url), 'example') ORDER BY score DESC, page_id LIMIT 20")
def v03(t: Tables) -> DataFrame:
    """Rows gated by their addresses, scored by the terms, the best twenty."""
    terms = F.array(F.lit("shop"), F.lit("example"))
    got = F.filter(terms, lambda q: F.contains(F.lower("url"), q))
    relevant = t.pages.withColumn("got", got).where(records.metadata_relevant(F.col("got"), terms))
    return relevant.select("page_id", F.size("got").alias("score")).orderBy(F.desc("score"), "page_id").limit(20)


LAKE = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def lake(t: Tables) -> str:
    """Four tables synced as snapshots by the sink; of part, the brand as a classification."""
    from proofbase.session import work_dir
    from proofbase.sources import snapshots

    folder = f"{work_dir(t.spark)}/lake-{uuid.uuid4().hex}"
    for name, key in LAKE.items():
        rows = getattr(t, name)
        rows = rows.withColumnRenamed("p_brand", "p_brand_classification") if name == "part" else rows
        fields = [{"id": c, "type": "int" if kind in ("bigint", "int") else "text"} for c, kind in rows.dtypes]
        snapshots.sync(rows, folder, name, "v1", fields, "2024-01-01T00:00:00Z", key, about={"dataset_title": f"Table {name}", "resource_id": f"r-{name}", "publisher": "tests", "source_url": f"https://example.org/{name}"})
    return folder


@query("K01_K02_V09_snapshots", " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS row_count, count(*) AS expected_rows, 'ok' AS status FROM {n}" for n in LAKE))
def k01(t: Tables) -> DataFrame:
    """All current versions read back and verified in one pass."""
    from proofbase.sources import snapshots

    return snapshots.verify(t.spark, lake(t)).select("dataset", "row_count", "expected_rows", "status")


@query(
    "P04_P05_datasets",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, '{n}' AS label, 'Table {n}' AS title, 'tests' AS publisher, (SELECT count(*) FROM {n}) AS row_count, '{k}' AS record_id_field, list(replace(column_name, 'p_brand', 'p_brand_classification') ORDER BY column_index) AS fields, {['p_brand_classification'] if n == 'part' else []}::VARCHAR[] AS code_fields, 'v1' AS snapshot_version, 'r-{n}' AS resource_id, 'https://example.org/{n}' AS source_url FROM duckdb_columns() WHERE table_name = '{n}'"
        for n, k in LAKE.items()
    ),
)
def p04(t: Tables) -> DataFrame:
    """What is known of every dataset of the lake."""
    from proofbase.sources import snapshots

    return snapshots.listing(t.spark, lake(t)).select("dataset", "label", "title", "publisher", "row_count", "record_id_field", "fields", "code_fields", "snapshot_version", "resource_id", "source_url")
