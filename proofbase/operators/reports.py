"""Roll-ups, listings and exports over findings, calls, pages and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATEST_RUNS = 20


def status_histogram(rows: DataFrame, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """(status, n) for each listed status, zeros too, in one pass."""
    counts = rows.agg(*[F.count_if(F.col(status) == x).alias(x) for x in statuses])
    return counts.unpivot([], list(statuses), "status", "n")


def method_histogram(rows: DataFrame, key: str, method: str) -> DataFrame:
    """Per key the methods with their counts, as sorted method:count."""
    counts = rows.groupBy(key, method).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(":", method, "n"))).alias("histogram"))


def phase_summary(calls: DataFrame, key: str, tool: str, evidence: str, at: str) -> DataFrame:
    """Per key its tools, its evidence ids in order, the number of calls and the last one's time."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(evidence)), lambda x: x.cast("string")), ",")
    return calls.groupBy(key).agg(F.array_sort(F.collect_set(tool)).alias("tools"), ids.alias("evidence"), F.count("*").alias("n"), F.max(at).alias("last"))


def funnel(log: DataFrame, key: str, seq: str, outcome: str, stages: dict[str, str]) -> DataFrame:
    """How many keys ended in each stage; stages: result column -> outcome of a key's last row."""
    last = log.groupBy(key).agg(F.max_by(outcome, seq).alias("_t"))
    return last.agg(*[F.count_if(F.col("_t") == value).alias(name) for name, value in stages.items()])


def document_totals(pages: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """Per document its pages, characters, pages with text and its longest page, the first of equal ones."""
    n = F.length(text)
    longest = F.max_by(page, F.struct(n.alias("n"), (-F.col(page)).alias("p")))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.count_if(F.trim(text) != "").alias("with_text"), longest.alias("longest"))


def grouped_findings(findings: DataFrame, group: str, ref: str, parts: dict[str, Column]) -> DataFrame:
    """Per group the references of each part, sorted, null where there are none, and the number of findings. A report row holds its references, so they lie in one task."""
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(ref))))
    found = findings.groupBy(group).agg(*[some(cond).alias(name) for name, cond in parts.items()], F.count("*").alias("n"))
    return found.withColumns({name: F.when(F.size(name) > 0, F.col(name)) for name in parts})


def bodies(records: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """The records whose key is asked for."""
    return records.join(ids.select(F.col(id_).alias("_id")), F.col(key) == F.col("_id"), "left_semi")


def seams(pages: DataFrame, key: str, page: str, width: int, text: str = "text") -> DataFrame:
    """The end of each page, a bar and the beginning of the next one; null on the last page."""
    after = F.lead(text).over(W.partitionBy(key).orderBy(page))
    end = F.when(F.length(text) > width, F.substring(text, -width, width)).otherwise(F.col(text))
    return pages.select(key, page, F.concat(end, F.lit("/"), F.substring(after, 1, width)).alias("seam"))


def trace_lines(log: DataFrame, key: str, label: str, detail: str) -> DataFrame:
    """A line per log row."""
    return log.select(key, F.concat(F.col(label), F.lit(" ("), F.col(detail).cast("string"), F.lit(")")).alias("line"))


def best_rows(rows: DataFrame, key: str, terms: Column, words: Column, most: int) -> DataFrame:
    """The rows with the most terms, then in order of key."""
    return rows.select(key, F.size(F.array_intersect(terms, words)).alias("score")).orderBy(F.desc("score"), key).limit(most)


def latest_runs(runs: DataFrame, key: str, created: str, most: int = LATEST_RUNS) -> DataFrame:
    """The runs created last."""
    return runs.orderBy(F.desc(created), key).limit(most).select(key, created)


def page_listing(pages: DataFrame, key: str, wanted: object, page: str, text: str = "text") -> DataFrame:
    """One document's pages in order, with their lengths."""
    return pages.where(F.col(key) == F.lit(wanted)).orderBy(page).select(key, page, F.length(text).alias("chars"))
