"""The document store: contents once, addresses as aliases, and lookups of recent copies by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.functions import web

#: A copy is used for a day, if it is one of these kinds.
TTL_SECONDS, CACHED_TYPES = 86_400, ("pdf", "html", "text")


def content_id(content: Column) -> Column:
    """equal bytes have one id."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16))


def put(documents: DataFrame, urls: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fetched(url, final_url, content, fetched_at, ...) -> (documents that are new, all aliases after it).

    A content that is stored, or comes twice, keeps its first document. Both addresses of every
    fetch point to its document, and a later fetch of an address replaces what it pointed to.
    documents has doc_id; urls is (url_key, doc_id, fetched_at).
    """
    keyed = fetched.withColumns({"doc_id": content_id(F.col("content").cast("binary")), "final_url": F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))})
    rest = [c for c in keyed.columns if c != "doc_id"]
    # map-side first by content, so that a page found everywhere is one row a task
    first = keyed.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("fetched_at", "url")).alias("_f")).select("doc_id", "_f.*")
    new = first.join(documents.select(F.col("doc_id").alias("_d")), F.col("doc_id") == F.col("_d"), "left_anti")
    named = keyed.select(F.explode(F.array_distinct(F.array(web.url_key(F.col("url")), web.url_key(F.col("final_url"))))).alias("url_key"), "doc_id", "fetched_at").where("url_key is not null")
    both = urls.select("url_key", "doc_id", "fetched_at").unionByName(named)
    latest = both.groupBy("url_key").agg(F.max(F.struct("fetched_at", "doc_id")).alias("_l"))
    return new, latest.select("url_key", "_l.doc_id", "_l.fetched_at")


def documents_of(asked: DataFrame, urls: DataFrame) -> DataFrame:
    """asked(url, ...) with the document that the address points to, or NULL: a join on the normalised address."""
    alias = urls.select(F.col("url_key").alias("_u"), F.col("doc_id"))
    return asked.withColumn("_k", web.url_key(F.col("url"))).join(alias, F.col("_k") == F.col("_u"), "left").drop("_k", "_u")


def cached(asked: DataFrame, urls: DataFrame, documents: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The asked addresses that need no fetch: their document is of a kind that is kept and at most `ttl` seconds old. documents(doc_id, final_url, source_type, fetched_at, ...); now may be a column of asked."""
    stored = documents.select(F.col("doc_id").alias("_d"), "final_url", "source_type", "fetched_at").where(F.col("source_type").isin(*CACHED_TYPES))
    met = documents_of(asked, urls).join(stored, F.col("doc_id") == F.col("_d"))
    aged = met.withColumn("age_seconds", F.unix_timestamp(now) - F.unix_timestamp(F.col("fetched_at").cast("timestamp")))
    return aged.where((F.col("age_seconds") <= ttl) & F.lit(ttl > 0)).drop("_d", "fetched_at")
