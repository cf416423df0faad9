"""Queries of as-of and interval joins, stream-stream joins, whole-table ranks and similar words on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbase.operators import fuzzy, temporal
from proofbase.plans.registry import Tables, query
from proofbase.streaming import events as streams


@query(
    "ext_as_of_view",
    """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts
    QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) = 1""",
)
def as_of_view(t: Tables) -> DataFrame:
    """The last view before each purchase of a user."""
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    return temporal.as_of(of("purchase"), of("view"), "user_id", "ts", "ts", "event_id").select("event_id", F.col("_right.event_id").alias("view_id"))


@query(
    "ext_as_of_orders",
    """WITH b AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT o.o_orderkey, b.o_orderkey AS before FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ASOF LEFT JOIN b ON o.o_custkey = b.o_custkey AND o.o_orderdate >= b.o_orderdate""",
)
def as_of_orders(t: Tables) -> DataFrame:
    """The last finished order of a customer at or before each other one."""
    done, other = (t.orders.where(x).select("o_orderkey", "o_custkey", "o_orderdate") for x in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    return temporal.as_of(other, done, "o_custkey", "o_orderdate", "o_orderdate", "o_orderkey", 90 * temporal.DAY).select("o_orderkey", F.col("_right.o_orderkey").alias("before"))


@query("ext_interval_join", "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 hour")
def interval_join(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    return temporal.within(of("view"), of("purchase"), "user_id", "ts", "ts", 6 * 3600).select(F.col("_left.event_id").alias("view_id"), F.col("_right.event_id").alias("purchase_id"))


def _calls(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user's views as calls and purchases as results."""
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("run_id"), F.lit(0).alias("call_id"), "ts")
    return of("view"), of("purchase")


ANSWERED = "SELECT v.user_id::VARCHAR AS run_id, v.ts AS called, p.ts AS answered FROM (SELECT * FROM events WHERE event_type = 'view') v {} JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 3 hour"


@query("J11_T04_answered", ANSWERED.format("LEFT"))
def answered(t: Tables) -> DataFrame:
    return streams.answered(*_calls(t.events), within="3 hours").select("run_id", "called", "answered")


@query("J11_T04_answered_stream", ANSWERED.format("INNER"))
def answered_stream(t: Tables) -> DataFrame:
    """The same as two streams to their end; calls without a result are given only as their time passes, so those with one are shown."""
    views, _ = _calls(streams.read_stream(t.spark, t._dir, t.events.schema, "events.parquet"))
    _, buys = _calls(streams.read_stream(t.spark, t._dir, t.events.schema, "events.parquet"))
    found = streams.run_available(streams.answered(views, buys, "3 hours"), "j11_answered", "append").where("answered is not null")
    return found.select("run_id", F.col("called").cast("timestamp_ntz").alias("called"), F.col("answered").cast("timestamp_ntz").alias("answered"))


@query(
    "ext_whole_table_ranks",
    """SELECT l_orderkey, l_linenumber, row_number() OVER w AS row_number, rank() OVER r AS rank, dense_rank() OVER r AS dense_rank, round(percent_rank() OVER r, 12) AS percent_rank, round(cume_dist() OVER r, 12) AS cume_dist, ntile(7) OVER w AS ntile
    FROM lineitem WINDOW w AS (ORDER BY l_quantity, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey), r AS (ORDER BY l_quantity, l_shipdate)""",
)
def ranks(t: Tables) -> DataFrame:
    """Every line's place by quantity and date, without a sort of the table in one task."""
    found = temporal.ranks(t.lineitem, [F.col("l_quantity"), F.col("l_shipdate")], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], 7)
    return found.select("l_orderkey", "l_linenumber", "row_number", "rank", "dense_rank", F.round("percent_rank", 12).alias("percent_rank"), F.round("cume_dist", 12).alias("cume_dist"), "ntile")


WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) AS word FROM {1})"


@query("ext_similar_words", f"SELECT a.word AS asked, b.word AS word, levenshtein(a.word, b.word)::INT AS distance FROM {WORDS.format('text', 'benchmark')} a JOIN {WORDS.format('text', 'documents')} b ON abs(length(a.word) - length(b.word)) <= 2 AND levenshtein(a.word, b.word) <= 2")
def similar(t: Tables) -> DataFrame:
    """Every word of the documents within two edits of a word of the benchmark."""
    words = lambda rows: rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return fuzzy.similar_words(words(t.benchmark), fuzzy.word_index(words(t.documents)))


@query(
    "A09_merged_profiles",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, min({c}::VARCHAR) AS low, max({c}::VARCHAR) AS high, count(DISTINCT {c}) AS exact, true AS near FROM lineitem" for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")),
)
def profiles_of_lines(t: Tables) -> DataFrame:
    """Profiles of a hundred parts of the table, merged; near: the estimate of distinct values is within five standard errors of the count."""
    from proofbase.sources import profiles

    columns = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    parts = profiles.profile(t.lineitem.select(*columns), [F.col("l_orderkey") % 100])
    exact = t.lineitem.agg(*[F.count_distinct(c).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("exact")) for c in columns])))
    found = profiles.merged(parts).join(exact, F.col("column") == F.col("_c"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.col("exact") * 0.08, F.lit(1.0))
    return found.select("column", "n", "nulls", "low", "high", "exact", near.alias("near"))
