"""Cross-site line dedup by distinct-site spread, in DataFrame operations only.

A line's hash is aggregated with a HyperLogLog sketch of the sites it is on (sketches merge
map-side, so a line on every page is no single task's work). Lines whose estimate is clearly
over SITES are boilerplate, clearly below are not; those near it are counted exactly. All
occurrences of boilerplate lines are removed.

A line: what stands between newlines, trimmed of spaces, if anything is left. Its site: the
document's source; a null source counts as one site.

Defined cases: a null text has no lines and stays null; an empty text stays empty; blank lines
stay; rows with equal doc_id are handled apart (by their texts); an empty table gives no rows;
other columns are kept, and columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

SITES = 5
#: log2 of a sketch's registers: a standard error of about 1.6 in 100.
LG_K = 12
#: An estimate within this share of SITES (at least one site) is checked exactly.
NEAR = 0.25


def _trimmed(line: F.Column) -> F.Column:
    return F.trim(line)


def _hashes(text: F.Column) -> F.Column:
    return F.transform(F.split(text, "\n"), lambda x: F.when(_trimmed(x) != "", F.xxhash64(_trimmed(x), F.lit(7))))


def boilerplate(docs: DataFrame, sites: int = SITES, near: float = NEAR) -> DataFrame:
    """The hashes of lines on at least `sites` sites."""
    site = F.coalesce(F.col("source"), F.lit("\0"))
    lines = docs.select(site.alias("site"), F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line")).where("line is not null")
    margin = max(1.0, near * sites)
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("spread"), F.count("*").alias("n"))
    # a line on `sites` sites is in as many documents
    likely = c.stored(spread.where((F.col("n") >= sites) & (F.col("spread") > sites - margin)).select("line", "spread"))
    sure = likely.where(F.col("spread") > sites + margin).select("line")
    unsure = c.stored(likely.where(F.col("spread") <= sites + margin).select(F.col("line").alias("_l")))
    exact = lines.join(unsure, F.col("line") == F.col("_l"), "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return c.stored(sure.unionByName(exact.select("line")))


def line_dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with text without its boilerplate lines, n_lines (those with a character) and n_removed."""
    # a result's name in the input gives way, all other columns come back under their own names
    docs = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("n_lines", "n_removed")])
    docs, own = c.hidden(docs, ("doc_id", "source", "text"))
    common = boilerplate(docs, sites).select(F.col("line").alias("_c"))
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    used = keyed.select("_row", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line")).where("line is not null")
    gone = used.join(common, F.col("line") == F.col("_c"), "left_semi").distinct().groupBy(F.col("_row").alias("_r")).agg(F.collect_set("line").alias("_gone"))
    # the same join at every size: what is removed grows with the corpus, so it is no broadcast
    joined = keyed.join(c.stored(gone).hint("merge"), F.col("_row") == F.col("_r"), "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<bigint>")))
    line = lambda x: F.xxhash64(_trimmed(x), F.lit(7))
    goes = lambda x: (_trimmed(x) != "") & F.array_contains(F.col("_gone"), line(x))
    parts = F.split("text", "\n")
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(parts, lambda x: _trimmed(x) != "")), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.when(F.size("_gone") > 0, F.size(F.filter(parts, goes))), F.lit(0)).cast("long"),
        "text": F.when(F.size("_gone") > 0, F.array_join(F.filter(parts, lambda x: ~goes(x)), "\n")).otherwise(F.col("text")),
    }).select(*own, "n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE = f"""
WITH s AS (SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT trim(line, ' ') AS t FROM s WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= {SITES}),
k AS (SELECT s.doc_id, s.i, s.line, trim(s.line, ' ') <> '' AS full_line, b.t IS NOT NULL AS gone FROM s LEFT JOIN b ON trim(s.line, ' ') = b.t)
SELECT doc_id, count(*) FILTER (full_line)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id
"""
