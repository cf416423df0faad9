"""Run state as an append-only log: its writes and the rows that follow from it.

Every write is rows of the log: (run_id, n, at, kind, seq, and what it sets). n counts a run's
entries, so a repeated batch is known by (run_id, n) and streaming.append_once() stores it once.
Writes take a table of requests, one a run, and the state that they follow; checks are made
row by row in the plan. What an entry doesn't set stays as it was, so a finish without a report
keeps an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.operators.messages import redact

# The statuses of a run, and how much of a label and an error is kept.
STATUSES = ("running", "completed", "failed", "interrupted")
LABEL_CHARS, ERROR_CHARS = 300, 4000
SET = ("status", "phase", "label", "error", "domain", "config", "state", "summary", "final_report", "partial_report")
SCHEMA = "run_id string, n long, at timestamp, kind string, seq long, " + ", ".join(f"{x} string" for x in SET)


def state(log: DataFrame) -> DataFrame:
    """One row a run: what was last set of each value, the times and the number of checkpoints, from one aggregation with partial sums."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    at = lambda cond: F.max(F.when(cond, F.col("at")))
    kind = F.col("kind")
    return log.groupBy("run_id").agg(
        F.max("n").alias("n"), F.coalesce(F.max("seq"), F.lit(0)).alias("checkpoint_seq"), F.min(F.when(kind == "created", F.col("at"))).alias("created_at"),
        at((kind != "heartbeat") | F.col("label").isNotNull()).alias("updated_at"), F.max("at").alias("heartbeat_at"), at(kind.isin("created", "checkpoint")).alias("last_checkpoint_at"), *[last(c) for c in SET],
    )


def checkpoints(log: DataFrame) -> DataFrame:
    """The checkpoint log."""
    return log.where("kind = 'checkpoint'").select("run_id", "seq", "at", "label", "phase", "status", "summary")


def _entries(requests: DataFrame, kind: str, n: Column, seq: Column, given: dict[str, Column], secrets: list[str]) -> DataFrame:
    def stored(c: str) -> Column:
        x = given.get(c, F.col(f"`{c}`") if c in requests.columns else F.lit(None)).cast("string")
        x = F.substring(x, 1, LABEL_CHARS) if c == "label" else F.substring(x, 1, ERROR_CHARS) if c == "error" else x
        # Secrets are replaced before anything is stored
        return redact(x, secrets).alias(c)

    return requests.select(F.col("run_id").cast("string").alias("run_id"), n.cast("long").alias("n"), F.col("at").cast("timestamp").alias("at"), F.lit(kind).alias("kind"), seq.cast("long").alias("seq"), *[stored(c) for c in SET])


def _known(requests: DataFrame, current: DataFrame) -> DataFrame:
    now = current.select(F.col("run_id").alias("_id"), F.col("n").alias("_n"), F.col("checkpoint_seq").alias("_seq"), F.col("status").alias("_status"))
    return requests.join(now, F.col("run_id").cast("string") == F.col("_id"), "left")


def _next() -> Column:
    return F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("unknown run "), F.coalesce(F.col("run_id").cast("string"), F.lit("NULL"))))).otherwise(F.col("_n") + 1)


def create(requests: DataFrame, current: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """requests(run_id, at, domain, config, state): the first entry of each run; a run that exists is an error."""
    joined = _known(requests, current)
    n = F.when(F.col("_id").isNotNull(), F.raise_error(F.concat(F.lit("run exists: "), F.col("_id")))).otherwise(F.lit(1))
    return _entries(joined, "created", n, F.lit(0), {"status": F.lit("running"), "phase": F.lit("mapping"), "label": F.lit("created"), "summary": F.lit("{}")}, secrets or [])


def checkpoint(requests: DataFrame, current: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """requests(run_id, at, label, phase, state, summary, status and error if not running and none): the next checkpoint of each run."""
    joined = _known(requests, current)
    given = {c: F.coalesce(F.col(c), F.lit(d)) if c in requests.columns else F.lit(d) for c, d in (("status", "running"), ("error", ""))}
    return _entries(joined, "checkpoint", _next(), F.col("_seq") + 1, given, secrets or [])


def heartbeat(requests: DataFrame, current: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """requests(run_id, at, label and phase if any): a sign of life of runs that are running; others get no entry. A label alone makes it an update."""
    joined = _known(requests, current).where("_status = 'running'")
    phase = F.when(F.col("label").isNotNull(), F.col("phase")) if {"label", "phase"} <= set(requests.columns) else F.lit(None)
    return _entries(joined, "heartbeat", F.col("_n") + 1, F.lit(None), {"phase": phase}, secrets or [])


def finish(requests: DataFrame, current: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """requests(run_id, at, status, error, final_report, partial_report): ends runs; a status that is none is an error, a report that isn't given keeps the earlier one."""
    status = F.when(F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no status: "), F.coalesce("status", F.lit("NULL")))))
    error = F.coalesce("error", F.lit("")) if "error" in requests.columns else F.lit("")
    return _entries(_known(requests, current), "finished", _next(), F.lit(None), {"status": status, "error": error}, secrets or [])


def resume(requests: DataFrame, current: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """requests(run_id, at): runs go on from their last checkpoint; their error is taken back."""
    return _entries(_known(requests, current), "resumed", _next(), F.lit(None), {"status": F.lit("running"), "error": F.lit(""), "label": F.lit("resumed")}, secrets or [])


def resumable(current: DataFrame, now: Column, stale_seconds: int = 120) -> DataFrame:
    """Runs with a state that failed, were interrupted or have been silent too long, with the checkpoint to go on from."""
    from proofbase.operators.messages import effective_status

    shown = current.withColumn("status", effective_status(F.col("status"), F.col("heartbeat_at"), now))
    return shown.where(F.col("state").isNotNull() & F.col("status").isin("failed", "interrupted"))
