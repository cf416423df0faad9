"""Message history and run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.functions import text as tx

STALE_SECONDS, PAGE_CHARS, LATEST = 120, 15_000, 20


def provider_items(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Chat roles to provider items, in order: an assistant's text and each of its calls, a tool's output; others as they are.

    messages: role, text, calls array<struct<id,name,arguments>>, call_id.
    """
    item = lambda kind, text, ref: F.struct(F.lit(kind).alias("kind"), text.alias("content"), ref.alias("ref"))
    none = F.lit(None).cast("string")
    said = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.array(item("output_text", F.col("text"), none))).otherwise(F.array().cast("array<struct<kind:string,content:string,ref:string>>"))
    calls = F.transform(F.coalesce("calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: item("function_call", F.concat(c["name"], F.lit(" "), c["arguments"]), c["id"]))
    items = (
        F.when(F.col("role") == "assistant", F.concat(said, calls))
        .when(F.col("role") == "tool", F.array(item("function_call_output", F.col("text"), F.col("call_id"))))
        .otherwise(F.array(F.struct(F.col("role").alias("kind"), F.col("text").alias("content"), none.alias("ref"))))
    )
    return messages.select(key, order, F.posexplode(items).alias("item_no", "i")).select(key, order, "item_no", "i.kind", "i.content", "i.ref")


def split_output(output: Column) -> Column:
    """Of an array of (type, text, name): the joined text, the calls' names and the reasoning."""
    pick = lambda kind, f: F.transform(F.filter(output, lambda x: x["type"] == kind), lambda x: x[f])
    return F.struct(F.array_join(pick("message", "text"), "\n").alias("text"), pick("function_call", "name").alias("calls"), F.array_join(pick("reasoning", "text"), "\n").alias("reasoning"))


#: What is read of a tool's result and arguments: fixed names of the tools' answers.
RESULT = (
    "error string, document_id string, url string, ok boolean, title string, source_type string, primary_source boolean, http_status int, query string, source_url string, status string, page_count int, dataset_id string, id string, publisher string, evidence_id string, total_matches long, found boolean, "
    "dataset string, record_id string, record_line string, match string, pages_without_text array<int>, issues array<string>, pages_with_matches array<int>, document struct<unit: string, page_count: int, status: string>, "
    "results array<struct<title: string, url: string, primary_source: boolean, page: int, first_line: int, last_line: int, text: string, id: string, likely_relevant: boolean>>, "
    "pages array<struct<page: int, text: string>>, resources array<struct<id: string, name: string>>, records array<struct<dataset: string, record_id: string, match: string, record_line: string>>"
)
ARGS = "query string, record_id string, dataset string, resource_id string"
SMALL, SUMMARY = 1500, 1200


def stub(tool: Column, evidence: Column, result: Column, args: Column | None = None) -> Column:
    """What remains of a compacted tool result, as JSON: its id, and by the kind of tool the identifiers, citations and short quotes. result and args are JSON; a text that is none is cut, and no result has an empty summary."""
    r, a = F.from_json(result, RESULT), F.from_json(F.lit("{}") if args is None else args, ARGS)
    clip = lambda x, n: tx.short(x, n)
    own = lambda *fields: [r[f].alias(f) for f in fields]
    each = lambda f, n, body: F.transform(F.slice(r[f], 1, n), body)
    record = F.array(F.struct(*own("dataset", "record_id", "match", "record_line")))
    records = F.coalesce(F.when(F.size(r["records"]) > 0, r["records"]), F.when(r["found"], record), F.slice(record, 1, 0))
    none_found = F.when(F.size(records) == 0, "Zero matches (not proof of an exemption).")
    line = lambda x: F.struct(F.concat(x["dataset"], F.lit(":"), x["record_id"]).alias("ref"), F.coalesce(x["match"], F.lit("")).alias("match"), clip(x["record_line"], 200).alias("line"))
    raw_records = F.get_json_object(result, "$.records")
    kinds = {
        ("search_web",): [F.coalesce(a["query"], F.lit("")).alias("query"), each("results", 10, lambda x: F.struct(clip(x["title"], 90).alias("title"), x["url"].alias("url"), x["primary_source"].alias("primary_source"))).alias("results")],
        ("fetch_url",): [*own("url", "ok", "document_id", "title", "source_type", "primary_source", "error", "http_status", "document"), F.lit("[compacted: use search_document / read_document_range on document_id]").alias("text")],
        ("search_document",): [*own("document_id", "query"), F.slice(r["pages_with_matches"], 1, 30).alias("pages_with_matches"), each("results", 5, lambda x: F.struct(x["page"].alias("page"), F.concat_ws("-", x["first_line"], x["last_line"]).alias("lines"), clip(x["text"], 240).alias("text"))).alias("results")],
        ("read_document_range",): [*own("document_id", "source_url"), F.transform(r["pages"], lambda x: F.struct(x["page"].alias("page"), clip(x["text"], 160).alias("start"))).alias("pages"), F.lit("[compacted: read the pages again or use get_evidence]").alias("text")],
        ("get_document_status",): own("document_id", "status", "page_count", "pages_without_text", "issues"),
        ("search_local_government_records", "get_local_government_record"): [F.coalesce(a["query"], a["record_id"]).alias("query"), a["dataset"].alias("dataset"), F.coalesce(r["total_matches"], F.size(records).cast("long")).alias("total_matches"), F.transform(F.slice(records, 1, 8), line).alias("records"), none_found.alias("note")],
        ("search_government_datasets",): [a["query"].alias("query"), each("results", 10, lambda x: F.struct(x["id"].alias("id"), clip(x["title"], 90).alias("title"), x["likely_relevant"].alias("likely_relevant"))).alias("results")],
        ("inspect_government_dataset",): [*own("status", "dataset_id", "id", "title", "publisher"), each("resources", 10, lambda x: F.struct(x["id"].alias("id"), clip(x["name"], 80).alias("name"))).alias("resources")],
        ("read_government_resource",): [r["status"].alias("status"), a["resource_id"].alias("resource_id"), a["query"].alias("query"), F.when(~F.coalesce(raw_records, F.lit("")).rlike("^[\\[{]"), clip(raw_records, 600)).alias("records")],
        ("get_evidence",): [r["evidence_id"].alias("retrieved_evidence_id"), F.lit("re-retrieved evidence (compacted again)").alias("note")],
    }
    failed = r["error"].isNotNull() & (F.coalesce(F.size(F.json_object_keys(result)), F.lit(0)) <= 4)
    kept = F.when(failed, F.to_json(F.struct(*own("error", "document_id"))))
    for names, fields in kinds.items():
        kept = kept.when(tool.isin(*names) & F.json_object_keys(result).isNotNull(), F.to_json(F.struct(*fields)))
    kept = kept.when(F.length(result) <= SMALL, result).otherwise(F.to_json(F.struct(clip(result, SUMMARY).alias("summary"))))
    return F.to_json(F.struct(evidence.alias("evidence_id"), F.lit(True).alias("compacted"), kept.alias("summary"), F.concat(F.lit("get_evidence('"), evidence, F.lit("')")).alias("full_result")))


def latest_state(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The run rows from the append-only log: the last values, the last non-null reports, the number of checkpoints."""
    values = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(F.max(seq).alias("last_seq"), F.count("*").alias("checkpoints"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in values])


def nearest_second(at: Column) -> Column:
    """The nearest whole second, of two equally near ones the even one, as SQL's epoch(at)::BIGINT has it."""
    return F.timestamp_seconds(F.rint(F.unix_micros(at.cast("timestamp")) / 1e6))


def effective_status(status: Column, heartbeat: Column, now: Column) -> Column:
    """A running run without a heartbeat for 120 seconds is interrupted."""
    quiet = heartbeat.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(heartbeat) > STALE_SECONDS)
    return F.when((status == "running") & quiet, "interrupted").otherwise(status)


def can_resume(has_state: Column, status: Column, active: Column) -> Column:
    """P29."""
    return has_state & status.isin("failed", "interrupted") & ~active


def evidence_page(ledger: DataFrame, key: str, wanted: str, offset: int = 0) -> DataFrame:
    """One entry's text from an offset, 15,000 characters, and where it goes on."""
    n = F.length("text")
    return ledger.where(F.col(key).cast("string") == wanted).select(key, F.substring("text", offset + 1, PAGE_CHARS).alias("page"), F.when(n > offset + PAGE_CHARS, F.lit(offset + PAGE_CHARS)).alias("next_offset"))


def redact(c: Column, secrets: list[str]) -> Column:
    """Every secret, as it is and as JSON writes it, is replaced."""
    import json

    for s in secrets:
        if s:
            for form in dict.fromkeys((s, json.dumps(s)[1:-1], json.dumps(s, ensure_ascii=False)[1:-1])):
                c = F.replace(c, F.lit(form), F.lit("[redacted]"))
    return c


def needs_review(open_items: Column, budget_left: Column, step: Column, cap: int) -> Column:
    """Open questions, budget and steps are left."""
    return (open_items > 0) & budget_left & (step < cap)


def novelty(rows: DataFrame, ref: str, order: list[str], tool: Column, key: Column, empty: Column) -> DataFrame:
    """Whether a tool result brings evidence: not empty, and the first of its key."""
    from proofbase.operators.sequences import first_seen

    seen = first_seen(rows, F.concat_ws("\u0001", tool, key), order, ref)
    return seen.withColumn("new_evidence", F.col("is_first") & ~empty)


def partial_report_json(findings: DataFrame, group: str, text: Column, confirmed: Column) -> DataFrame:
    """Per group a JSON document of confirmed and open findings, and its Markdown."""
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, text)))
    both = findings.groupBy(group).agg(pick(confirmed).alias("confirmed"), pick(~confirmed).alias("open"))
    bullets = lambda name: F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("- "), tx.markdown(x))), "\n")
    markdown = F.concat(F.lit("## Confirmed\n"), bullets("confirmed"), F.lit("\n## Open\n"), bullets("open"))
    return both.select(group, F.to_json(F.struct("confirmed", "open")).alias("json"), markdown.alias("markdown"))


def insert_new(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose content is not stored yet, one per content."""
    fresh = incoming.join(store.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return fresh.dropDuplicates([key])
