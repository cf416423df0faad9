"""URL, JSON, date and enum functions (F30-F47) and small cell functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of official sources, metadata endpoints, references and statuses.
OFFICIAL_DOMAINS = ("gov.il", "knesset.gov.il", "court.gov.il", "boi.org.il", "sii.org.il")
METADATA_URL = "^[^?#]*/action/(package_search|package_show|resource_show)([?#]|$)"
EVIDENCE_REF = "^(E[0-9]+|F[0-9]+|doc-[0-9a-f]{8,}(:[0-9]+)?|https?://\\S+)$"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def url_key(url: Column) -> Column:
    """lower scheme and host, no trailing slash, parameters or fragment; the query stays."""
    scheme, rest = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    path = F.rtrim(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), ";[^/]*$", ""), F.lit("/"))
    query = F.regexp_extract(rest, "(\\?.+)$", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^[^@]*@|:[0-9]+$", "")


def is_official(url: Column, domains: tuple[str, ...] = OFFICIAL_DOMAINS) -> Column:
    """the host is a listed domain or below one."""
    h = host(url)
    found = F.lit(False)
    for d in domains:
        found = found | (h == d) | h.endswith("." + d)
    return found


def slug_query(title: Column, url: Column) -> Column:
    """a query from the title, else from the last part of the path."""
    last = F.regexp_replace(F.element_at(F.split(F.rtrim(F.regexp_replace(url, "[?#].*$", ""), F.lit("/")), "/"), -1), "\\.[A-Za-z0-9]+$", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(last), "[-_+]+", " "), "\\s+", " "))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title)).otherwise(words)


def is_metadata_url(url: Column) -> Column:
    """F34."""
    return url.rlike(METADATA_URL)


def json_object(text: Column) -> Column:
    """from the first brace to the last; '' if there is none."""
    return F.regexp_extract(text, "(?s)\\{.*\\}", 0)


def enum_value(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    """lower case, spaces and hyphens as underscores; anything else is the default."""
    x = F.translate(F.lower(F.trim(c)), " -", "__")
    return F.when(x.isin(*allowed), x).otherwise(default)


def web_items(items: Column) -> Column:
    """the items with an http(s) address."""
    return F.filter(items, lambda x: x.rlike("^https?://"))


def is_evidence_ref(c: Column) -> Column:
    """F39."""
    return c.rlike(EVIDENCE_REF)


def iso_time(c: Column) -> Column:
    """strict; NULL for anything else."""
    return F.try_to_timestamp(c, F.lit(ISO_FORMAT))


def age_days(then: Column, now: Column) -> Column:
    """Days between, to one decimal, halves to even."""
    return F.bround((F.unix_timestamp(now) - F.unix_timestamp(then)) / F.lit(86400), 1)


def freshness(age: Column, fresh: float = 2, stale: float = 8) -> Column:
    """Of an age in days; NULL counts as stale."""
    return F.when(age.isNull(), "stale").when(age <= fresh, "fresh").when(age <= stale, "aging").otherwise("stale")


def content_id(c: Column) -> Column:
    """doc- and 16 hex digits of the SHA-256."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(c, 256), 1, 16))


def retry_delay(attempt: Column, asked: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """doubling from base or what the server asks, at most cap."""
    return F.least(F.greatest(F.lit(base) * F.pow(F.lit(2.0), attempt), F.coalesce(asked, F.lit(0.0))), F.lit(cap))


def passage_score(got: Column, terms: Column, exact: Column) -> Column:
    """ten times the share of terms, five more for the exact phrase, halves to even."""
    return F.bround(10 * got / terms + F.when(exact, 5).otherwise(0), 2)


def page_mismatch(cited: Column, pages: Column) -> Column:
    """whether no cited number is a matched page; NULL without a cited number or a match."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(cited, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return F.when((F.size(numbers) > 0) & (F.size(pages) > 0), ~F.arrays_overlap(numbers, pages))


def slug(c: Column) -> Column:
    """an identifier from a question."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", ""), 1, 40)


def checklist_status(old: Column, new: Column, refs: Column, note: Column) -> Column:
    """resolved needs a valid reference, unresolved and not_applicable a note; otherwise the status stays."""
    asked = F.lower(F.trim(new))
    bad = (asked == "resolved") & (F.size(F.filter(refs, is_evidence_ref)) == 0)
    bad = bad | (asked.isin("unresolved", "not_applicable") & (F.trim(F.coalesce(note, F.lit(""))) == ""))
    return F.when(asked.isin("open", "resolved", "unresolved", "not_applicable") & ~bad, asked).otherwise(old)


def run_id(now: Column) -> Column:
    """a UTC stamp and 16 random hex digits."""
    return F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))


def clean_cell(c: Column, limit: int = 200) -> Column:
    """No controls, line breaks as spaces, trimmed, cut."""
    from proofbase.functions.text import strip_controls

    return F.substring(F.trim(F.translate(strip_controls(c), "\n", " ")), 1, limit)


def truthy(c: Column) -> Column:
    """P16."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def kind_of(content_type: Column, url: Column, head: Column) -> Column:
    """Pdf, json, xlsx, csv or else html, from the content type, the first characters and the path."""
    ct, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_replace(url, "[?#].*$", ""))
    first = F.substring(F.regexp_replace(F.coalesce(head, F.lit("")), "^\\s+", ""), 1, 1)
    sheet = ct.contains("spreadsheetml") | ct.contains("ms-excel")
    return (
        F.when(ct.contains("pdf") | head.startswith("%PDF-") | path.endswith(".pdf"), "pdf")
        .when(ct.contains("json") | (first.isin("{", "[") & ~ct.contains("html")), "json")
        .when(path.rlike("\\.xls[xm]$") | (sheet & ~path.endswith(".csv")), "xlsx")
        .when(ct.contains("csv") | path.endswith(".csv"), "csv")
        .otherwise("html")
    )
