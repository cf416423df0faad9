"""Quotations found through a positional index of hashed word windows, and citations verified against what was retrieved.

A quotation counts as found where the page contains it, or 80 % of its six-word windows, each as a
string, so the outer words of a window may be parts of longer ones and its four inner words are
whole. The index therefore holds windows of four words. Of an excerpt's m windows a match has all
but m / 5, so one of its m / 5 + 1 rarest is there: these are looked up, and the pages that they
name are read and tested. No excerpt meets a page with which it shares no window.

The words around a page break are indexed with the page before it. Excerpts of fewer than six words
have no window; they are sought in the pages of the document that they cite, which is an equi-join,
and so are citations of documents of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.functions import text as tx
from proofbase.functions import web
from proofbase.session import stored

INNER, SIZE, STEP, LEAST_CHARS, MISSING, EDGE = 4, 6, 3, 15, 5, 2000

# Kinds of retrieved files that are data, and of those that only describe data.
DATASET_TYPES = ("csv", "xlsx", "json", "ckan_resource", "ckan_dataset", "ckan_datastore")
METADATA_TYPES = ("ckan_resource", "ckan_dataset")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, size: int = INNER) -> Column:
    """A hash of each window of `size` hashed words, in order."""
    one = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
    made = tx.let(hashes, lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: one(h, i))))
    return F.coalesce(made, F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return tx.tokens(tx.normalized(text))


def position_index(pages: DataFrame) -> DataFrame:
    """(g, doc_id, page_no, at, across) of every window: its hash, its first word's place on the page, and whether it goes on to the next page."""
    hashed = lambda text: word_hashes(_words(text))
    win = lambda g, at, across: F.struct(g.alias("g"), at.alias("at"), F.lit(across).alias("across"))
    own = pages.select("doc_id", "page_no", hashed(F.col("text")).alias("_h")).select("doc_id", "page_no", F.inline(F.transform(window_hashes(F.col("_h")), lambda g, i: win(g, i, False))))
    # a break is crossed by windows of the last and first three words, so only these are brought together
    ends = pages.select("doc_id", "page_no", hashed(F.col("text")).alias("_h"), F.slice(hashed(F.substring(F.coalesce("text", F.lit("")), 1, EDGE)), 1, INNER - 1).alias("_first"))
    ends = ends.select("doc_id", "page_no", F.size("_h").alias("_n"), F.slice("_h", F.greatest(F.lit(1), F.size("_h") - INNER + 2), INNER - 1).alias("_last"), "_first")
    met = ends.withColumn("_next", F.lead("_first").over(W.partitionBy("doc_id").orderBy("page_no"))).where("_next is not null")
    seam = met.select("doc_id", "page_no", F.inline(F.transform(window_hashes(F.concat("_last", "_next")), lambda g, i: win(g, i + F.col("_n") - F.size("_last"), True))))
    return own.unionByName(seam).select("g", "doc_id", "page_no", "at", "across")


def store_index(pages: DataFrame, path: str) -> DataFrame:
    """The index as Parquet, in ranges of hash and document: a window found everywhere takes as many ranges as it needs."""
    pages.transform(position_index).repartitionByRange("g", "doc_id").sortWithinPartitions("g", "doc_id").write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def asked_windows(asked: DataFrame, own: list[str]) -> DataFrame:
    """(excerpt_id, doc_id if one is cited, m, g, i): the windows of asked (excerpt_id, words) whose inner words are looked up, of m."""
    starts = F.sequence(F.lit(0), F.size("words") - SIZE, F.lit(STEP))
    wins = tx.let(window_hashes(word_hashes(F.col("words"))), lambda h: F.transform(starts, lambda i: F.struct(F.get(h, i + 1).alias("g"), i.alias("i"))))
    return asked.where(F.size("words") >= SIZE).select("excerpt_id", *own, F.size(starts).alias("m"), F.inline(wins))


def candidates(index: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(excerpt_id, doc_id, page_no, start, here, across): the places that the rarest asked windows name. index: those of windows asked for. keys: g, and doc_id if a document is cited."""
    own = [k for k in keys if k != "g"]
    often = index.groupBy(*keys).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("excerpt_id", *own).orderBy(F.coalesce("n", F.lit(0)), "i"))
    probes = windows.join(often, keys, "left").withColumn("_r", rank).where((F.col("_r") <= F.floor(F.col("m") / MISSING) + 1) & F.col("n").isNotNull())
    met = index.join(probes.select("excerpt_id", *keys, "i"), keys)
    return met.groupBy("excerpt_id", "doc_id", "page_no").agg(F.min(F.col("at") - F.col("i") - 1).alias("start"), F.bool_or(~F.col("across")).alias("here"), F.bool_or("across").alias("across"))


def _seams(pages: DataFrame) -> DataFrame:
    """The two edges of each page break."""
    w = W.partitionBy("doc_id").orderBy("page_no")
    seam = F.concat(F.substring("text", -EDGE, EDGE), F.lit("\n"), F.substring(F.lead("text").over(w), 1, EDGE))
    return pages.select("doc_id", "page_no", F.lead("page_no").over(w).alias("next_no"), seam.alias("seam")).where("next_no is not null")


def _found_in(body: str) -> Column:
    """Whether e is found. In one expression, as a condition on the text alone would be tested on every text before it meets its excerpts."""
    return tx.let(tx.normalized(F.col(body)), lambda n: tx.excerpt_found(F.col("e"), n))


def locate(pages: DataFrame, excerpts: DataFrame, index: DataFrame | None = None, cited: bool = True, places: bool = True) -> DataFrame:
    """(excerpt_id, doc_id, pages, start): the pages with the quotation, or the two that it spans, and its first word's place on the first one.

    cited: excerpts name a document (excerpt_id, doc_id, excerpt), and each has a row, with no pages
    if it isn't found. Else they are sought in all pages and have a row for each document with them.
    places: without, start may be null, and a cited document of one page is read without an index.
    """
    spark = pages.sparkSession
    pages = pages.select("doc_id", "page_no", "text")
    own, keys = ["doc_id"] if cited else [], ["excerpt_id", "doc_id"]
    # ids may be long or hold texts: 128 bits stand for them until the end
    short = F.unhex(F.md5(F.to_json(F.struct("excerpt_id")).cast("binary")))
    asked = excerpts.select(short.alias("excerpt_id"), *own, tx.normalized(F.col("excerpt")).alias("e")).withColumn("words", tx.tokens(F.col("e"))).where(F.length("e") >= LEAST_CHARS)
    # stored, so that their size is known: where few are asked for, no page is moved
    several = stored(pages.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")) if cited else None
    some = (lambda df: df) if places or not cited else (lambda df: df.join(several, "doc_id", "left_semi"))
    windows = stored(asked_windows(some(asked), own))
    every = position_index(some(pages)) if index is None else index
    held = stored(every.join(windows.select("g", *own).distinct(), ["g", *own], "left_semi"))
    near = stored(candidates(held, windows, ["g", *own]))
    e = asked.select("excerpt_id", *own, "e")
    named = ["excerpt_id", "doc_id", "page_no", "start"]
    by_page = near.where("here").select(*named)
    by_seam = near.select("excerpt_id", "doc_id", F.col("page_no").alias("_p"), "start")
    if cited:
        brief = asked.where(F.size("words") < SIZE).select("excerpt_id", "doc_id")
        if not places:
            brief = brief.unionByName(asked.where(F.size("words") >= SIZE).join(several, "doc_id", "left_anti").select("excerpt_id", "doc_id"))
        all_pages = stored(brief.join(pages.select("doc_id", "page_no"), "doc_id").withColumn("start", F.lit(None).cast("int")).select(*named))
        by_page = by_page.unionByName(all_pages)
        by_seam = by_seam.unionByName(all_pages.withColumnRenamed("page_no", "_p"))
    # of all pages few are named, of a cited document's most
    read = pages if cited else pages.join(near.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    on = by_page.join(e, ["excerpt_id", *own]).join(read, ["doc_id", "page_no"]).where(_found_in("text"))
    on = stored(on.groupBy(*keys).agg(F.array_sort(F.collect_set("page_no")).alias("pages"), F.min_by("start", "page_no").alias("start")))
    # a break is tried only where no page has the excerpt, and only the pages of such documents are brought together
    left = by_seam.join(on.select(*keys), keys, "left_anti")
    left = stored(left.join(several, "doc_id", "left_semi") if cited else left)
    seams = _seams(pages.join(left.select("doc_id").distinct(), "doc_id", "left_semi"))
    before = left.join(seams.select("doc_id", F.col("page_no").alias("_q"), "next_no"), (left["doc_id"] == seams["doc_id"]) & (F.col("_p") == F.col("next_no"))).select("excerpt_id", left["doc_id"], F.col("_q").alias("page_no"), F.lit(None).cast("int").alias("start"))
    tried = left.withColumnRenamed("_p", "page_no").unionByName(before).groupBy(*keys, "page_no").agg(F.min("start").alias("start"))
    across = tried.join(e, ["excerpt_id", *own]).join(seams, ["doc_id", "page_no"]).where(_found_in("seam"))
    across = across.groupBy(*keys).agg(F.min(F.struct("page_no", "start")).alias("_s")).select(*keys, F.array("_s.page_no", F.col("_s.page_no") + 1).alias("pages"), "_s.start")
    found = on.unionByName(across).withColumnRenamed("excerpt_id", "_id")
    asking = excerpts.select("excerpt_id", *own, short.alias("_id"))
    if not cited:
        return asking.join(found, "_id").select("excerpt_id", "doc_id", "pages", "start")
    kind = spark.createDataFrame([], pages.schema).select(F.array("page_no").alias("p")).schema["p"].dataType
    return asking.join(found, ["_id", "doc_id"], "left").select("excerpt_id", "doc_id", F.coalesce("pages", F.array().cast(kind)).alias("pages"), "start")


def quotations(excerpts: DataFrame, documents: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """W08, F24 for a table of excerpts against all documents: (excerpt_id, doc_id, share) of the windows that a document has as whole words.

    Candidates meet by the window's 64-bit hash; no pair is compared that shares none. The windows
    asked for are few beside a corpus, so the documents' windows are joined where they are read.
    """
    asked = excerpts.withColumn("_w", word_hashes(_words(F.col("excerpt")))).where(F.size("_w") >= size)
    every = F.transform(F.sequence(F.lit(0), F.size("_w") - size, F.lit(step)), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)]))
    wins = asked.select("excerpt_id", F.size(every).alias("n"), F.explode(F.array_distinct(every)).alias("g"))
    grams = documents.select("doc_id", F.explode(window_hashes(word_hashes(_words(F.col("text"))), size)).alias("g"))
    met = grams.join(wins, "g").distinct().groupBy("excerpt_id", "doc_id", "n").agg(F.count("*").alias("got"))
    return met.select("excerpt_id", "doc_id", (F.col("got") / F.col("n")).alias("share"))


def resolved(citations: DataFrame, resources: DataFrame, urls: DataFrame, documents: DataFrame) -> DataFrame:
    """What was retrieved for each citation: its resource, else the resource, document or text of its URL.

    resources(resource_id, status, source_url, evidence_text), urls(url_key, ok, source_type,
    resource_id, doc_id, text), documents(doc_id); one row for each key.
    """
    full = lambda n: F.when(F.col(n) != "", F.col(n))
    u = urls.select(F.col("url_key").alias("_u"), F.col("ok").alias("_ok"), F.col("source_type").alias("_type"), F.col("resource_id").alias("_ur"), F.col("doc_id").alias("_ud"))
    r = lambda k: resources.select(F.col("resource_id").alias(f"_r{k}"), F.struct("resource_id", "status", "source_url").alias(f"_record{k}"))
    d = lambda k: documents.select(F.col("doc_id").alias(f"_d{k}")).distinct()
    joined = citations.withColumns({"_key": web.url_key(F.trim(F.coalesce("url", F.lit("")))), "_rid": full("resource_id"), "_did": full("document_id")})
    joined = joined.join(u, F.col("_key") == F.col("_u"), "left").join(r(1), F.col("_rid") == F.col("_r1"), "left").join(r(2), F.col("_ur") == F.col("_r2"), "left").join(d(1), F.col("_did") == F.col("_d1"), "left")
    joined = joined.withColumn("_record", F.coalesce("_record1", "_record2"))
    # a document that the citation names and that is not the URL's is none
    chosen = F.coalesce("_d1", F.when(F.col("_did").isNull() | (F.col("_did") == F.col("_ud")), full("_ud")))
    joined = joined.withColumn("_doc", chosen).join(d(2), F.col("_doc") == F.col("_d2"), "left")
    official = web.is_official(F.coalesce("url", F.lit(""))) | F.coalesce(web.is_official(F.col("_record.source_url")), F.lit(False))
    listed = F.coalesce(F.col("_type").isin(*DATASET_TYPES), F.lit(False))
    data = F.when(F.col("_u").isNotNull(), listed).otherwise(F.col("_rid").isNotNull())
    read = F.coalesce("_ok", F.lit(False)) | F.col("_doc").isNotNull()
    described = web.is_metadata_url(F.coalesce("url", F.lit(""))) | F.coalesce(F.col("_type").isin(*METADATA_TYPES), F.lit(False))
    status = F.when(F.col("_record").isNotNull(), F.col("_record.status")).when(read & described, "metadata_only").when(read & F.col("_doc").isNotNull() & F.col("_d2").isNull(), "failed").when(read, "ok").when(F.col("_u").isNotNull(), "failed").otherwise("not_retrieved")
    kind = F.when(F.col("_record").isNotNull() | data | (status == "metadata_only"), "dataset").when(official, "legal_document").otherwise("web")
    content = F.when(status != "ok", None).when(F.col("_record").isNotNull(), F.concat(F.lit("resource:"), "_record.resource_id")).when(F.col("_doc").isNotNull(), F.concat(F.lit("document:"), "_doc")).otherwise(F.concat(F.lit("url:"), "_key"))
    return joined.withColumns({"official": official, "kind": kind, "retrieval_status": status, "_content": content}).drop("_key", "_rid", "_did", "_u", "_ok", "_type", "_ur", "_ud", "_r1", "_r2", "_record1", "_record2", "_record", "_d1", "_d2", "_doc")


def verify(citations: DataFrame, resources: DataFrame, urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations (citation_id, url, excerpt, resource_id, document_id, page, require_excerpt if not always) with kind, official, retrieval_status, matched_pages, excerpt_verified, verified, page_mismatch and note.

    Records and texts of URLs are looked through like documents of one page. Only what is cited is indexed.
    """
    own = citations.columns
    found = stored(resolved(citations, resources, urls, pages))
    one = F.lit(1).alias("page_no")
    contents = (
        pages.select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text")
        .unionByName(resources.select(F.concat(F.lit("resource:"), F.col("resource_id").cast("string")).alias("doc_id"), one, F.col("evidence_text").alias("text")))
        .unionByName(urls.select(F.concat(F.lit("url:"), "url_key").alias("doc_id"), one, "text"))
    )
    asked = found.where("_content is not null and excerpt <> ''").select(F.col("citation_id").alias("excerpt_id"), F.col("_content").alias("doc_id"), "excerpt")
    cited = stored(contents.join(asked.select("doc_id").distinct(), "doc_id", "left_semi"))
    located = locate(cited, asked, places=False).select(F.col("excerpt_id").alias("citation_id"), F.col("pages").alias("_pages"))
    joined = found.join(located, "citation_id", "left").withColumn("_pages", F.coalesce("_pages", F.array().cast("array<int>")))
    need = F.coalesce("require_excerpt", F.lit(True)) if "require_excerpt" in own else F.lit(True)
    retrieved, quoted = F.col("retrieval_status") == "ok", F.size("_pages") > 0
    of_document = F.coalesce(F.col("_content").startswith("document:"), F.lit(False))
    note = (
        F.when(~retrieved, F.concat(F.lit("not evidence: "), "retrieval_status"))
        .when(~F.col("official"), "retrieved, not an official source")
        .when(need & (F.coalesce("excerpt", F.lit("")) == ""), "retrieved, no excerpt quoted")
        .when((F.coalesce("excerpt", F.lit("")) != "") & ~quoted, "retrieved, excerpt not found")
        .otherwise(F.when(quoted, "excerpt found").otherwise("retrieved"))
    )
    matched = F.when(of_document, F.col("_pages")).otherwise(F.array().cast("array<int>"))
    return joined.select(
        *[F.col(f"`{x}`") for x in own], "kind", "official", "retrieval_status", matched.alias("matched_pages"), (retrieved & quoted).alias("excerpt_verified"), (retrieved & (quoted | ~need)).alias("verified"),
        web.page_mismatch(F.col("page"), matched).alias("page_mismatch"), note.alias("note"),
    )
