"""Findings and opportunities assessed in three dimensions from nested evidence (V06, V07; A18-A20, J10, L06, P24, V05).

Nested sources are exploded, equal ones verified once, and the verdicts put back in place. Nothing
that a finding says of its own verification counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.operators import citations, records, verification
from proofbase.session import stored

FIELDS = ("url", "excerpt", "resource_id", "document_id", "page")
SOURCE = "struct<" + ",".join(f"{x}:string" for x in FIELDS) + ">"
CLAIM_TYPES = ("fact", "legal_conclusion", "business_advantage")
_VERDICT = ("kind", "official", "retrieval_status", "matched_pages", "excerpt_verified", "verified", "page_mismatch", "note")


@dataclass
class Evidence:
    """What was retrieved, as in citations.resolved() and citations.verify()."""

    resources: DataFrame
    urls: DataFrame
    pages: DataFrame


def _ref(role: str | Column, source: Column, require: bool) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), F.lit(require).alias("require"), source.cast(SOURCE).alias("s"))


def _refs(role: str, sources: Column, require: bool) -> Column:
    return F.transform(F.coalesce(sources, F.array().cast(f"array<{SOURCE}>")), lambda s: _ref(role, s, require))


def with_verdicts(rows: DataFrame, key: str, refs: Column, evidence: Evidence) -> DataFrame:
    """rows with _refs, the verdicts of its sources by role, in order. Sources without a web address are left out."""
    valid = F.filter(refs, lambda r: F.coalesce(F.trim(r["s"]["url"]).rlike("^https?://"), F.lit(False)))
    flat = rows.select(F.col(key).alias("_k"), F.posexplode(valid).alias("_i", "_r"))
    flat = flat.select("_k", "_i", "_r.role", F.col("_r.require").alias("require_excerpt"), "_r.s.*").withColumn("citation_id", F.sha2(F.to_json(F.struct("require_excerpt", *FIELDS)), 256))
    judged = citations.verify(flat.select("citation_id", "require_excerpt", *FIELDS).dropDuplicates(["citation_id"]), evidence.resources, evidence.urls, evidence.pages)
    verdict = F.struct("role", F.col("url"), *[F.col(f"_v.{x}").alias(x) for x in _VERDICT])
    back = flat.join(judged.select("citation_id", F.struct(*_VERDICT).alias("_v")), "citation_id").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", verdict.alias("v")))).alias("_back"))
    return rows.join(back, F.col(key) == F.col("_k"), "left").withColumn("_refs", F.transform("_back", lambda x: x["v"])).drop("_k", "_back")


def _of(role: str) -> Column:
    """The verdicts of a role; none is an empty array."""
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in _SHAPE.items()])), 1, 0)
    return F.coalesce(F.filter("_refs", lambda r: r["role"] == role), none)


_SHAPE = {"role": "string", "url": "string", "kind": "string", "official": "boolean", "retrieval_status": "string", "matched_pages": "array<int>", "excerpt_verified": "boolean", "verified": "boolean", "page_mismatch": "boolean", "note": "string"}


def _status(checks: Column, name: str) -> Column:
    """A check's claimed status in its normal form."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(checks[name]["status"], F.lit("")))), "[ -]", "_")
    return F.when(x.isin("checked", "contradicted", "not_applicable"), x).otherwise("not_checked")


def _legal(statuses: dict[str, Column]) -> tuple[Column, Column]:
    """A19 of the checks' statuses and verified evidence, and what each lacks."""
    ok = {n: verification.check_ok(n, _of(f"check:{n}")) for n in verification.CHECKS}
    status = verification.legal_dimension({n: (statuses[n], ok[n]) for n in verification.CHECKS})
    lacks = [F.when(statuses[n] == "not_checked", f"{n}: not checked").when(~ok[n], F.concat(F.lit(f"{n}: "), statuses[n], F.lit(", evidence not verified"))) for n in verification.CHECKS]
    return status, F.array_compact(F.array(*lacks))


def _good(sources: Column) -> Column:
    return F.size(F.filter(sources, lambda s: F.coalesce(s["verified"] & s["excerpt_verified"], F.lit(False))))


def findings(rows: DataFrame, evidence: Evidence) -> DataFrame:
    """rows(finding_id, statement, claim_type, negative, source, legal_checks: map of name to (status, source), business: (based_on, generally_available, differentiator, competitor)) with source_status, legal_status, business_status and their grounds.

    A finding's own quotation is its provision if none is given. A negative statement that is no
    legal conclusion establishes nothing in law. A business claim takes the legal status of the
    finding it is based on, within the same table.
    """
    checks = F.col("legal_checks")
    type_ = F.when(F.col("claim_type").isin(*CLAIM_TYPES), F.col("claim_type")).otherwise("fact")
    cited = lambda n: F.coalesce(F.trim(checks[n]["source"]["url"]).rlike("^https?://"), F.lit(False))
    own_provision = (_status(checks, "provision") == "not_checked") & ~cited("provision")
    ready = rows.withColumns({"claim_type": type_, "negative_claim": F.coalesce("negative", F.lit(False)) | records.is_negative([F.col("statement")]), "_own": own_provision})
    of_check = [F.when(F.col("_own"), _ref("check:provision", F.col("source"), True)).otherwise(_ref("check:provision", checks["provision"]["source"], True))]
    of_check += [_ref(f"check:{n}", checks[n]["source"], True) for n in verification.CHECKS[1:]]
    legal_refs = F.when(F.col("claim_type") == "legal_conclusion", F.array(*of_check)).otherwise(F.slice(F.array(*of_check), 1, 0))
    rival = F.when(F.col("claim_type") == "business_advantage", F.array(_ref("competitor", F.col("business")["competitor"], True))).otherwise(F.slice(F.array(of_check[0]), 1, 0))
    judged = with_verdicts(ready, "finding_id", F.concat(F.array(_ref("own", F.col("source"), True)), legal_refs, rival), evidence)
    own = F.get(_of("own"), F.lit(0))
    good = F.coalesce(own["verified"] & own["excerpt_verified"], F.lit(False))
    source_status = F.when(good & own["official"], "verified").when(good, "partially_verified").otherwise("unverified")
    asked = (F.col("claim_type") == "legal_conclusion") | F.col("negative_claim")
    claimed = {n: F.when(F.col("claim_type") != "legal_conclusion", "not_checked").otherwise(_status(checks, n)) for n in verification.CHECKS}
    claimed["provision"] = F.when((F.col("claim_type") == "legal_conclusion") & F.col("_own"), "checked").otherwise(claimed["provision"])
    legal, lacks = _legal(claimed)
    judged = judged.withColumns({
        "source_status": source_status, "official": F.coalesce(own["official"], F.lit(False)), "matched_pages": F.coalesce(own["matched_pages"], F.array().cast("array<int>")), "page_mismatch": own["page_mismatch"], "verification_note": own["note"],
        "legal_status": F.when(asked, legal), "legal_notes": F.when(asked & (legal != "verified"), F.when(F.col("negative_claim"), F.concat(F.array(F.lit("negative claim not established")), lacks)).otherwise(lacks)), "_evidence": _good(_of("own")), "_rivals": _good(_of("competitor")),
    })
    judged = stored(judged.drop("_refs"))
    # The statuses are joined from the same table, by the id that a claim is based on
    business = judged.where("claim_type = 'business_advantage'").withColumn("based_on", F.trim(F.col("business")["based_on"]))
    based = verification.inherited_legal(business.select("finding_id", "based_on"), judged.select("finding_id", "legal_status"), "based_on", "finding_id").select(F.col("finding_id").alias("_f"), F.col("legal_status").alias("_base"))
    joined = judged.join(based, F.col("finding_id") == F.col("_f"), "left")
    general = F.col("business")["generally_available"]
    claim = F.concat_ws("", F.trim("statement"), F.trim(F.col("business")["differentiator"]))
    advantage = verification.business_dimension(F.lit("claimed"), claim, general, F.col("_evidence"), F.col("_rivals"), F.coalesce("_base", F.lit("unverified")))
    return joined.withColumn("business_status", F.when(F.col("claim_type") == "business_advantage", advantage)).drop("_own", "_evidence", "_rivals", "_f", "_base")


def opportunities(rows: DataFrame, evidence: Evidence) -> DataFrame:
    """rows(opportunity_id, name, regulatory_mechanism, summary, classification, claim_type, primary, secondary, contradictory: arrays of sources, legal_checks: map of name to (status, evidence), business: (status, claim, differentiator, generally_available, evidence, competitors)) with the three statuses, the final class, what it was downgraded from and why.

    Class A needs all primary sources official, read and quoted, a legal text among them, and every
    legal check verified; a verified quotation alone is no verified conclusion.
    """
    checks, business = F.col("legal_checks"), F.col("business")
    parts = [_refs("primary", F.col("primary"), True), _refs("secondary", F.col("secondary"), False), _refs("contradictory", F.col("contradictory"), False)]
    parts += [_refs(f"check:{n}", checks[n]["evidence"], True) for n in verification.CHECKS]
    parts += [_refs("advantage", business["evidence"], True), _refs("competitor", business["competitors"], True)]
    judged = with_verdicts(rows, "opportunity_id", reduce(F.concat, parts), evidence)
    primary = _of("primary")
    n, ok = F.size(primary), F.size(F.filter(primary, lambda s: s["official"] & s["verified"]))
    legal_texts = F.size(F.filter(primary, lambda s: s["official"] & s["verified"] & (s["kind"] == "legal_document")))
    verified = F.when((ok > 0) & (ok == n), "verified").when(ok > 0, "partially_verified").otherwise("unverified")
    legal, lacks = _legal({x: _status(checks, x) for x in verification.CHECKS})
    stated = F.lower(F.trim(F.coalesce("claim_type", F.lit(""))))
    negative = F.when(stated == "negative", True).when(stated == "positive", False).otherwise(records.is_negative([F.col(x) for x in ("name", "regulatory_mechanism", "summary")]))
    judged = judged.withColumns({"verification_status": verified, "legal_verification": legal, "negative_claim": negative, "_texts": legal_texts, "_lacks": lacks})
    claim = F.concat_ws("", F.trim(business["claim"]), F.trim(business["differentiator"]))
    advantage = verification.business_dimension(F.coalesce(business["status"], F.lit("claimed")), claim, business["generally_available"], _good(_of("advantage")), _good(_of("competitor")), F.col("legal_verification"))
    final = verification.final_class(F.col("classification"), F.col("verification_status"), F.col("_texts"), F.col("legal_verification"))
    reason = F.when(F.col("verification_status") != "verified", "primary sources not all verified").when(F.col("_texts") == 0, "no verified legal text").otherwise("legal applicability not verified")
    moved = F.when((F.col("classification") == "A") & (final == "B"), F.lit("A"))
    notes = F.array_compact(F.array(
        F.when(moved.isNotNull(), F.concat(F.lit("downgraded from A to B: "), reason)), F.when(F.col("negative_claim") & (F.col("legal_verification") != "verified"), "negative claim not established"), F.when(F.col("verification_status") == "unverified", "no official source verified"),
        F.when(F.exists(primary, lambda s: s["kind"] == "dataset"), "a dataset is no proof of an obligation in force"),
    ))
    unverified = F.transform(F.filter(primary, lambda s: ~(s["official"] & s["verified"])), lambda s: F.concat(s["url"], F.lit(": "), s["note"]))
    return judged.withColumns({
        "business_verification": advantage, "unread_primary_sources": F.transform(F.filter(primary, lambda s: s["retrieval_status"] != "ok"), lambda s: s["url"]), "verification_notes": F.concat(notes, unverified),
        "legal_notes": F.col("_lacks"), "downgraded_from": moved, "_final": final,
    }).withColumn("classification", F.col("_final")).drop("_refs", "_texts", "_lacks", "_final")
