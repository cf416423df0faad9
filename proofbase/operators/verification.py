"""Evidence verification in three dimensions, ranking and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.functions import web

# The legal checks, and the order of statuses and classes.
CHECKS = ("provision", "scope", "validity", "exceptions", "product_classification")
STATUS_ORDER = {"verified": 0, "partially_verified": 1, "unverified": 2, "contradicted": 3}
CLASS_ORDER = {"A": 0, "B": 1, "C": 2}


def source_ok(s: Column) -> Column:
    return F.coalesce(s["official"] & s["verified"] & s["excerpt_verified"], F.lit(False))


def source_dimension(sources: Column) -> Column:
    """Of an array of sources: all good, some, or none."""
    ok, n = F.size(F.filter(sources, source_ok)), F.size(sources)
    return F.when((n > 0) & (ok == n), "verified").when(ok > 0, "partially_verified").otherwise("unverified")


def source_dimension_rows(sources: DataFrame, claim: str, ok: Column) -> DataFrame:
    """A18 as an aggregation over one row per cited source."""
    good = F.count_if(ok)
    return sources.groupBy(claim).agg(F.when(good == F.count("*"), "verified").when(good > 0, "partially_verified").otherwise("unverified").alias("source_status"))


def check_ok(name: str, evidence: Column) -> Column:
    """A check's evidence: good official sources, for all but the classification a legal text."""
    good = F.filter(evidence, source_ok)
    return F.size(good if name == "product_classification" else F.filter(good, lambda s: s["kind"] == "legal_document")) > 0


def legal_dimension(checks: dict[str, tuple[Column, Column]]) -> Column:
    """Of (status, evidence ok) per check: any verified contradiction; all verified; the provision verified; else unverified."""
    bad, good = F.lit(False), F.lit(True)
    for status, ok in checks.values():
        bad = bad | ((status == "contradicted") & ok)
        good = good & status.isin("checked", "not_applicable") & ok
    status, ok = checks["provision"]
    return F.when(bad, "contradicted").when(good, "verified").when(status.isin("checked", "not_applicable") & ok, "partially_verified").otherwise("unverified")


def business_dimension(status: Column, claim: Column, general: Column, evidence: Column, competitors: Column, legal: Column) -> Column:
    """Of the claimed status, claim text, tri-state general availability, good evidence counts and the legal status."""
    some = (evidence > 0) | (competitors > 0)
    complete = general.isNotNull() & (evidence > 0) & (competitors > 0) & (legal == "verified")
    return (
        F.when((status == "contradicted") & some, "contradicted")
        .when(F.coalesce(claim, F.lit("")) == "", "unverified")
        .when(F.coalesce(general, F.lit(False)), "unverified")
        .when(complete, "verified")
        .when(some, "partially_verified")
        .otherwise("unverified")
    )


def final_class(class_: Column, source: Column, legal_sources: Column, legal: Column) -> Column:
    """Class A needs verified sources, a legal text and a verified legal dimension; else it is B."""
    return F.when((class_ == "A") & ~((source == "verified") & (legal_sources > 0) & (legal == "verified")), "B").otherwise(class_)


def _ordinal(c: Column, order: dict[str, int]) -> Column:
    found = F.lit(len(order))
    for k, v in order.items():
        found = F.when(c == k, v).otherwise(found)
    return found


def ranked(rows: DataFrame, tie: str, most: int) -> DataFrame:
    """Class, legal, source and business status, then scores; the first `most`."""
    order = [_ordinal(F.col("classification"), CLASS_ORDER), *[_ordinal(F.col(n), STATUS_ORDER) for n in ("legal_status", "source_status", "business_status")], F.desc("business_score"), F.desc("confidence"), F.col(tie)]
    return rows.orderBy(*order).limit(max(0, most))


def counters(findings: DataFrame) -> DataFrame:
    """The nine separate counters."""
    legal, business = F.col("claim_type") == "legal_conclusion", F.col("claim_type") == "business_advantage"
    ok = lambda n: F.coalesce(F.col(n) == "verified", F.lit(False))
    contradicted = F.coalesce(F.col("legal_status") == "contradicted", F.lit(False)) | F.coalesce(F.col("business_status") == "contradicted", F.lit(False))
    return findings.agg(
        F.count("*").alias("findings"), F.count_if(ok("source_status")).alias("source_verified"), F.count_if(legal).alias("legal_conclusions"),
        F.count_if(legal & ok("legal_status")).alias("legal_verified"), F.count_if(business).alias("business_claims"), F.count_if(business & ok("business_status")).alias("business_verified"),
        F.count_if("negative_claim").alias("negative_claims"), F.count_if(F.col("negative_claim") & ~ok("legal_status")).alias("negative_unresolved"), F.count_if(contradicted).alias("contradicted"),
    )


def retrieval_of(citations: DataFrame, by_resource: DataFrame, by_url: DataFrame, by_document: DataFrame) -> DataFrame:
    """Each citation's retrieval: by resource id, else by URL key, whose resource is looked up too, else by document."""
    keyed = citations.withColumn("_url", web.url_key(F.col("url")))
    urls = by_url.select(F.col("url_key").alias("_u"), F.col("status").alias("url_status"), F.col("resource_id").alias("_ur"))
    one = by_resource.select(F.col("resource_id").alias("_r1"), F.col("status").alias("resource_status"))
    two = by_resource.select(F.col("resource_id").alias("_r2"), F.col("status").alias("url_resource_status"))
    docs = by_document.select(F.col("document_id").alias("_d"), F.col("status").alias("document_status"))
    joined = keyed.join(one, F.col("resource_id") == F.col("_r1"), "left").join(urls, F.col("_url") == F.col("_u"), "left")
    joined = joined.join(two, F.col("_ur") == F.col("_r2"), "left").join(docs, F.col("document_id") == F.col("_d"), "left")
    found = F.coalesce("resource_status", "url_resource_status", "url_status", "document_status", F.lit("not_retrieved"))
    return joined.withColumn("retrieval_status", found).drop("_url", "_u", "_ur", "_r1", "_r2", "_d", "resource_status", "url_status", "url_resource_status", "document_status")


def inherited_legal(business: DataFrame, legal: DataFrame, based_on: str, finding: str) -> DataFrame:
    """A business finding's legal status is its base's; without one, unverified."""
    base = legal.select(F.col(finding).alias("_f"), F.col("legal_status").alias("_s"))
    return business.join(base, F.col(based_on) == F.col("_f"), "left").withColumn("legal_status", F.coalesce("_s", F.lit("unverified"))).drop("_f", "_s")


def references_exist(refs: DataFrame, known: list[DataFrame]) -> DataFrame:
    """The references that name a known evidence, finding, document page or URL."""
    every = known[0]
    for k in known[1:]:
        every = every.unionByName(k)
    return refs.join(every.select(F.col("ref").alias("_ref")).distinct(), F.col("ref") == F.col("_ref"), "left_semi")
