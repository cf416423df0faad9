"""Queries of the run log and the document store on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbase.operators import documents, messages, runs
from proofbase.plans.registry import Tables, query

KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'checkpoint' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'finished' ELSE 'resumed' END"


def event_log(t: Tables) -> DataFrame:
    """Each user's events as entries of a run's log: views are checkpoints, clicks signs of life, purchases ends with a report, errors resumptions."""
    kind = F.expr(KIND)
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("event_id")
    seq = F.when(kind == "checkpoint", F.count_if(kind == "checkpoint").over(by.rowsBetween(W.unboundedPreceding, 0)))
    text = F.col("value").cast("decimal(38,4)").cast("string")
    on = lambda k, v: F.when(kind == k, v)
    values = {
        "status": F.when(kind == "finished", F.when(F.col("value") > 50, "completed").otherwise("failed")).when(kind != "heartbeat", "running"), "phase": on("checkpoint", F.concat(F.lit("p"), F.col("event_id") % 5)), "label": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("l"), "event_id")),
        "error": F.when(kind == "finished", F.when(F.col("value") > 50, "").otherwise("late")).when(kind.isin("checkpoint", "resumed"), ""), "domain": F.lit(None), "config": F.lit(None), "state": on("checkpoint", text), "summary": on("checkpoint", F.col("event_id").cast("string")),
        "final_report": F.when((kind == "finished") & (F.col("value") > 50), text), "partial_report": F.when((kind == "finished") & (F.col("value") <= 50), text),
    }
    return t.events.select(F.col("user_id").cast("string").alias("run_id"), F.row_number().over(by).cast("long").alias("n"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), seq.alias("seq"), *[v.cast("string").alias(c) for c, v in values.items()])


STATE_SQL = f"""WITH e AS (SELECT *, {KIND} AS kind, value::DECIMAL(38,4)::VARCHAR AS text FROM events)
    SELECT user_id::VARCHAR AS run_id, count(*) AS n, count(*) FILTER (kind = 'checkpoint') AS checkpoint_seq, min(ts) FILTER (kind = 'created') AS created_at, max(ts) FILTER (kind <> 'heartbeat' OR event_id % 3 = 0) AS updated_at, max(ts) AS heartbeat_at,
    max(ts) FILTER (kind IN ('created', 'checkpoint')) AS last_checkpoint_at, arg_max(CASE WHEN kind <> 'finished' THEN 'running' WHEN value > 50 THEN 'completed' ELSE 'failed' END, event_id) FILTER (kind <> 'heartbeat') AS status,
    arg_max('p' || event_id % 5, event_id) FILTER (kind = 'checkpoint') AS phase, arg_max('l' || event_id, event_id) FILTER (event_id % 3 = 0) AS label, arg_max(CASE WHEN kind = 'finished' AND value <= 50 THEN 'late' ELSE '' END, event_id) FILTER (kind IN ('finished', 'checkpoint', 'resumed')) AS error,
    arg_max(text, event_id) FILTER (kind = 'checkpoint') AS state, arg_max(text, event_id) FILTER (kind = 'finished' AND value > 50) AS final_report, arg_max(text, event_id) FILTER (kind = 'finished' AND value <= 50) AS partial_report FROM e GROUP BY 1"""


@query("K07_S25_run_rows", STATE_SQL)
def k07(t: Tables) -> DataFrame:
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return runs.state(event_log(t)).select("run_id", "n", "checkpoint_seq", *[plain(c) for c in ("created_at", "updated_at", "heartbeat_at", "last_checkpoint_at")], "status", "phase", "label", "error", "state", "final_report", "partial_report")


@query(
    "K07_T04_next_checkpoints",
    f"WITH s AS ({STATE_SQL}), e AS (SELECT user_id, max(ts) AS now FROM events GROUP BY 1) SELECT run_id, n + 1 AS n, checkpoint_seq + 1 AS seq, 'go on' AS label, state FROM s WHERE state IS NOT NULL AND (status = 'failed' OR status = 'running' AND epoch((SELECT max(ts) FROM events))::BIGINT - epoch(heartbeat_at)::BIGINT > 120)",
)
def k07_next(t: Tables) -> DataFrame:
    """Runs that failed or fell silent, each with its next checkpoint from the state of its last one, as of the table's last event."""
    current = runs.state(event_log(t))
    now = t.events.agg(messages.nearest_second(F.max("ts")).alias("now"))
    ready = runs.resumable(current.withColumn("heartbeat_at", messages.nearest_second(F.col("heartbeat_at"))).join(F.broadcast(now)), F.col("now"))
    asked = ready.select("run_id", F.col("now").alias("at"), F.lit("go on").alias("label"), F.lit("resumed").alias("phase"), "state", F.lit("{}").alias("summary"))
    return runs.checkpoint(asked, current).select("run_id", "n", "seq", "label", "state")


# pages as fetches: every fifth has the content of another one, and some addresses come twice in other spellings
FETCHED = """f AS (SELECT page_id, split_part(url, '#', 1) AS url, CASE WHEN page_id % 5 = 0 THEN 'same page ' || page_id % 10 ELSE html END AS content, TIMESTAMP '2024-01-01' + to_hours(page_id::INT) AS seen, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' ELSE 'html' END AS kind FROM pages)"""
KEY_SQL = r"""lower(regexp_extract({0}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({0}, '://([^/?#]*)', 1)) || CASE WHEN rtrim(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/') END || regexp_extract({0}, '(\?[^#]+)', 1)"""
DOC_SQL = "'doc-' || substr(sha256(content), 1, 16)"


def fetched(t: Tables) -> DataFrame:
    url = F.substring_index("url", "#", 1)
    return t.pages.select(
        "page_id", url.alias("url"), F.concat(F.lit("https://mirror.example.org/"), F.col("page_id") % 50).alias("final_url"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("same page "), F.col("page_id") % 10)).otherwise(F.col("html")).alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(page_id))").alias("fetched_at"), F.when(F.col("page_id") % 4 == 0, "pdf").when(F.col("page_id") % 4 == 1, "csv").otherwise("html").alias("source_type"),
    )


def _store(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The store after all pages with an even id, then the odd ones, were put into it."""
    none = t.spark.createDataFrame([], "doc_id string"), t.spark.createDataFrame([], "url_key string, doc_id string, fetched_at timestamp_ntz")
    rows = fetched(t)
    first, aliases = documents.put(*none, rows.where("page_id % 2 = 0"))
    second, aliases = documents.put(first, aliases, rows.where("page_id % 2 = 1"))
    return first.unionByName(second), aliases


@query(
    "K06_J17_aliases",
    f"""WITH {FETCHED}, a AS (SELECT {KEY_SQL.format("url")} AS url_key, {DOC_SQL} AS doc_id, seen FROM f UNION ALL SELECT 'https://mirror.example.org/' || page_id % 50, {DOC_SQL}, seen FROM f)
    SELECT url_key, max({{'at': seen, 'doc_id': doc_id}}).doc_id AS doc_id, max(seen) AS fetched_at FROM a GROUP BY 1""",
)
def k06_aliases(t: Tables) -> DataFrame:
    return _store(t)[1]


@query("K06_U07_documents", f"WITH {FETCHED}, d AS (SELECT {DOC_SQL} AS doc_id, page_id, page_id % 2 AS odd, seen FROM f) SELECT doc_id, arg_min(page_id, odd * 1000000 + epoch(seen)::BIGINT / 3600) AS page_id FROM d GROUP BY 1")
def k06_documents(t: Tables) -> DataFrame:
    """Each content once, with the page that brought it first."""
    return _store(t)[0].select("doc_id", "page_id")


@query(
    "J17_T06_cached",
    f"""WITH {FETCHED}, a AS (SELECT {KEY_SQL.format("url")} AS url_key, {DOC_SQL} AS doc_id, seen FROM f UNION ALL SELECT 'https://mirror.example.org/' || page_id % 50, {DOC_SQL}, seen FROM f), u AS (SELECT url_key, max({{'at': seen, 'doc_id': doc_id}}).doc_id AS doc_id FROM a GROUP BY 1),
    d AS (SELECT {DOC_SQL} AS doc_id, arg_min(kind, page_id % 2 * 1000000 + epoch(seen)::BIGINT / 3600) AS kind, arg_min(seen, page_id % 2 * 1000000 + epoch(seen)::BIGINT / 3600) AS seen FROM f GROUP BY 1), n AS (SELECT max(seen) AS now FROM f)
    SELECT page_id, u.doc_id, kind AS source_type, epoch(now)::BIGINT - epoch(d.seen)::BIGINT AS age_seconds FROM pages JOIN u ON u.url_key = {KEY_SQL.format("pages.url")} JOIN d USING (doc_id), n WHERE kind IN ('pdf', 'html', 'text') AND epoch(now)::BIGINT - epoch(d.seen)::BIGINT <= 86400""",
)
def j17_cached(t: Tables) -> DataFrame:
    """Every page's address, with its fragment, looked up among the aliases: recent copies of the kinds that are kept."""
    stored, aliases = _store(t)
    now = fetched(t).agg(F.max("fetched_at").cast("timestamp").alias("now"))
    asked = t.pages.select("page_id", "url").join(F.broadcast(now))
    return documents.cached(asked, aliases, stored, F.col("now")).select("page_id", "doc_id", "source_type", "age_seconds")
