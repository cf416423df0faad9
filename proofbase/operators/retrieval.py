"""Code index, postings, hybrid record search and its explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.functions import codes
from proofbase.functions import text as tx
from proofbase.operators import records

CANDIDATES, NEAREST, EXAMPLES = 2000, 6, 5
OWN, REQUIREMENT, PARENT_LINK = "own", "requirement", "parent_link"


def code_index(rows: DataFrame, rid: str, fields: dict[str, Column]) -> DataFrame:
    """(rid, field, code, hier) of each code field; set fields to expressions of normalised codes."""
    entries = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("code")) for n, c in fields.items()])
    flat = rows.select(F.col(rid).alias("rid"), F.explode(entries).alias("e")).select("rid", "e.field", "e.code").where("code <> ''")
    return flat.withColumn("hier", codes.hierarchy_key(F.col("code")))


def postings(rows: DataFrame, rid: str, text: Column) -> DataFrame:
    """(rid, token) once per record."""
    normed = rows.select(F.col(rid).alias("rid"), tx.normalized(text).alias("_n"))
    return normed.select("rid", F.explode(tx.index_terms(F.col("_n"))).alias("token"))


def with_codes(rows: DataFrame, code_fields: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """rows with a column for each code field's normalised codes, and the names of these."""
    names = [f"_code_{n}" for n in code_fields]
    return rows.withColumns(dict(zip(names, code_fields.values(), strict=True))) if names else rows, names


def exact_codes(index: DataFrame, code: str, hier: str) -> DataFrame:
    """J01."""
    hit = index.where((F.col("code") == code) | (F.col("hier") == hier))
    return hit.select("rid", F.lit("exact_code").alias("match"), F.when(F.col("field") == PARENT_LINK, 0.5).otherwise(0.0).alias("rank"), F.lit(0).alias("seq"))


def child_codes(index: DataFrame, hier: str) -> DataFrame:
    """A prefix of the children's keys, which Parquet's statistics can prune by; the cap keeps the lowest rids."""
    hit = index.where(F.col("field").isin(OWN, REQUIREMENT) & F.col("hier").startswith(hier) & (F.col("hier") != hier))
    return hit.orderBy("rid").limit(CANDIDATES).select("rid", F.lit("child_code").alias("match"), F.lit(2.0).alias("rank"), F.lit(1).alias("seq"))


def parent_codes(index: DataFrame, hier: str, everywhere: DataFrame, code: str) -> DataFrame:
    """Records on the ancestors, if the code has children here or exists in any dataset. everywhere: the codes of all datasets."""
    digits, sign = hier.lstrip("-"), "-" if hier.startswith("-") else ""
    parents = [sign + digits[:n] for n in range(2, len(digits), 2)]
    below = index.where(F.col("field").isin(OWN, REQUIREMENT) & F.col("hier").startswith(hier) & (F.col("hier") != hier)).select(F.lit(True).alias("_known"))
    exists = everywhere.where((F.col("code") == code) | (F.col("hier") == hier)).select(F.lit(True).alias("_known")).unionByName(below).limit(1)
    hit = index.where(F.col("field").isin(OWN, REQUIREMENT) & F.col("hier").isin(*parents or [""])).join(F.broadcast(exists), how="left_semi")
    label = F.concat(F.when(F.col("field") == REQUIREMENT, "requirement_on_parent_code (").otherwise("parent_code ("), "hier", F.lit(")"))
    return hit.select("rid", label.alias("match"), (1 + (len(digits) - F.length(F.ltrim("hier", F.lit("-")))) / 100).alias("rank"), F.lit(2).alias("seq"))


def code_relatives(index: DataFrame, asked: DataFrame) -> DataFrame:
    """J02, J03 for a table of codes: every key's prefixes are exploded, so both directions are equi-joins."""
    up = asked.select("q", "hier", F.explode(codes.ancestors(F.col("hier"))).alias("_p"))
    parents = up.join(index.withColumnRenamed("hier", "_h"), F.col("_p") == F.col("_h")).select("q", "rid", F.lit("parent_code").alias("match"))
    down = index.select("rid", F.explode(codes.ancestors(F.col("hier"))).alias("_p"))
    children = asked.join(down, F.col("hier") == F.col("_p")).select("q", "rid", F.lit("child_code").alias("match"))
    same = asked.join(index.select("rid", F.col("hier").alias("_h")), F.col("hier") == F.col("_h")).select("q", "rid", F.lit("exact_code").alias("match"))
    return same.unionByName(parents).unionByName(children).distinct()


def _prefixed(index: DataFrame, terms: list[str]) -> DataFrame:
    """The postings that a variant of a term begins, with got, the terms. The prefixes reach the scan, whose statistics prune by token."""
    begins = {t: reduce(lambda a, b: a | b, [F.col("token").startswith(v) for v in tx.term_variants(t)]) for t in terms if t}
    if not begins:
        return index.where("false").withColumn("got", F.array().cast("array<string>"))
    hit = index.where(reduce(lambda a, b: a | b, begins.values()))
    return hit.withColumn("got", F.array_compact(F.array(*[F.when(x, F.lit(t)) for t, x in begins.items()])))


def text_candidates(index: DataFrame, terms: list[str], most: int | None = CANDIDATES) -> DataFrame:
    """Records with a token that a term or its variants without proclitics begin, with the terms found; the cap keeps the lowest rids, as the text rank is constant."""
    hit = _prefixed(index, terms)
    found = hit.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_set("got"))).alias("prefix_hits"))
    return found if most is None else found.orderBy("rid").limit(most)


def posting_sizes(index: DataFrame) -> DataFrame:
    """(rid, n_tokens) of the postings."""
    return index.groupBy("rid").agg(F.count("*").alias("n_tokens"))


def bm25(index: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, sizes: DataFrame | None = None) -> DataFrame:
    """F18, the opt-in extension: (rid, bm25) with statistics over the whole index; one term per prefix, sums negated. sizes: stored posting_sizes, else counted."""
    size = posting_sizes(index) if sizes is None else sizes
    whole = size.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))
    tf = _prefixed(index, terms).select("rid", F.explode("got").alias("term")).groupBy("rid", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # a row per term asked for, and one row
    joined = tf.join(F.broadcast(df), "term").join(size, "rid").join(F.broadcast(whole))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("avg_tokens")))
    return joined.groupBy("rid").agg((-F.sum(part)).alias("bm25"))


def text_rank(share: Column, relevance: Column, score: Column | None = None) -> Column:
    """3 and what coverage lacks, 5 more for unrelated records."""
    return 3 + (1 - share) + (F.lit(0.0) if score is None else score / 1000) + F.when(relevance == "unrelated", 5).otherwise(0)


def best_hits(hits: list[DataFrame]) -> DataFrame:
    """One row per record with the least rank; of equal ranks the strategy that came first, then the match that sorts first."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)
    own = [n for n in both.columns if n not in ("rid", "rank", "seq")]
    best = both.groupBy("rid").agg(F.min(F.struct("rank", "seq", *own)).alias("_b"))
    return best.select("rid", "_b.rank", *[f"_b.{n}" for n in own])


def nearest_headings(index: DataFrame, code: str) -> DataFrame:
    """The six headings of the chapter nearest to the code's, with their records."""
    heading = F.substring("code", 1, 4)
    counts = index.where((F.col("field") == OWN) & F.col("code").startswith(code[:2])).groupBy(heading.alias("heading")).agg(F.count("*").alias("records"))
    away = F.when(F.col("heading").rlike("^[0-9]+$"), F.abs(F.col("heading").cast("int") - int(code[:4]))).otherwise(10**9)
    return counts.withColumn("distance", away.cast("long")).orderBy("distance", "heading").limit(NEAREST)


def search(
    rows: DataFrame, rid: str, fields: list[str], code_fields: dict[str, Column], query: str, *, identifiers: list[str] | None = None, filters: dict[str, object] | None = None,
    direction: Column | None = None, jurisdiction: Column | None = None, want_direction: str = "any", want_jurisdiction: str = "any", include_unrelated: bool = False,
    index: dict[str, DataFrame] | None = None, everywhere: DataFrame | None = None, most: int | None = CANDIDATES,
) -> DataFrame:
    """Every candidate record of the query with match, rank, relevance and outcome.

    index: the stored codes and postings of these rows (snapshots.build_index), else both are made
    from the rows. everywhere: the codes of all datasets, for J04; else those of this one.
    most: how many candidates of the terms are looked at, those with the lowest rids; None for all.

    outcome, tested in this order: filtered, out_of_scope, unrelated, ranked. page() cuts the
    ranked ones; explain() counts the others. The strategy (standard reference, code, or terms)
    follows from the query's form on the driver; everything else is one plan. Numbers among the
    terms also count where they head a code (F16); near misses within a code never do.
    """
    spark = rows.sparkSession
    own_columns = rows.columns
    rows, coded = with_codes(rows, code_fields)
    if filters:
        records.validate_filters(rows, filters)
    identifiers = identifiers or []
    form = spark.range(1).select(codes.standard_refs(F.lit(query)).alias("refs"), codes.code_query(F.lit(query)).alias("code"), codes.hierarchy_key(codes.code_query(F.lit(query))).alias("hier"), tx.record_query_terms(tx.normalized(F.lit(query))).alias("terms")).first()
    text = F.concat_ws(" ", *[F.col(n).cast("string") for n in fields + identifiers + coded])
    stored = index or {}
    posted = lambda: stored["postings"] if "postings" in stored else postings(rows, rid, text)
    hits: list[DataFrame] = []
    shape = ("rid", "match", "rank", "seq", "relevance")
    if form["refs"]:
        wanted = F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in ("scheme", "number", "part")]) for r in form["refs"]])
        numbers = sorted({r["number"] for r in form["refs"]})
        candidates = text_candidates(posted(), numbers, most).select(F.col("rid").alias("_c"))
        named = rows.join(candidates, F.col(rid) == F.col("_c"), "left_semi")  # J06: filter, then verify
        own = F.concat_ws(" ; ", *[F.col(n).cast("string") for n in fields])
        hits.append(named.where(codes.standard_matches(codes.standard_refs(own), wanted)).select(F.col(rid).alias("rid"), F.lit("exact_standard").alias("match"), F.lit(0.0).alias("rank"), F.lit(0).alias("seq"), F.lit("direct").alias("relevance")))
    else:
        terms = form["terms"]
        if form["code"]:
            own = stored["codes"] if "codes" in stored else code_index(rows, rid, code_fields)
            found = [exact_codes(own, form["code"], form["hier"]), child_codes(own, form["hier"]), parent_codes(own, form["hier"], own if everywhere is None else everywhere, form["code"])]
            hits += [h.withColumn("relevance", F.lit("direct")) for h in found]
            terms = [form["code"].lstrip("-")]
        if terms:
            wanted = F.array(*[F.lit(t) for t in terms])
            candidates = text_candidates(posted(), terms, most).select(F.col("rid").alias("_c"))
            body = records.field_terms(rows.join(candidates, F.col(rid) == F.col("_c"), "left_semi"), wanted, fields + coded, identifiers, code_of={n: F.col(n) for n in coded})
            judged = body.where((F.size("got") > 0) | (F.size("id_only") > 0)).withColumn("relevance", records.relevance(F.col("got"), F.col("id_only"), wanted))
            share = tx.coverage(F.col("got"), wanted)
            label = F.when(share == 1, "all_terms").otherwise(F.concat(F.lit("terms "), F.array_join(F.array_sort("got"), ",")))
            hits.append(judged.select(F.col(rid).alias("rid"), label.alias("match"), text_rank(share, F.col("relevance")).alias("rank"), F.lit(3).alias("seq"), "relevance"))
    if filters and not query:
        hits.append(rows.select(F.col(rid).alias("rid"), F.lit("filter").alias("match"), F.lit(5.0).alias("rank"), F.lit(4).alias("seq"), F.lit("direct").alias("relevance")))
    if not hits:
        hits.append(spark.createDataFrame([], "rid long, match string, rank double, seq int, relevance string"))
    best = best_hits([h.select(*shape) for h in hits]).withColumnRenamed("rid", "_rid")
    passes = reduce(lambda a, b: a & b, [records._equals(k, v) for k, v in (filters or {}).items()], F.lit(True))
    none = F.lit(None).cast("string")
    in_scope = records.scope_allowed(none if direction is None else direction, none if jurisdiction is None else jurisdiction, want_direction, want_jurisdiction)
    outcome = F.when(~passes, "filtered").when(~in_scope, "out_of_scope").when((F.col("relevance") == "unrelated") & F.lit(not include_unrelated), "unrelated").otherwise("ranked")
    found = rows.join(best, F.col(rid) == F.col("_rid")).withColumn("outcome", outcome)
    return found.select(*[F.col(f"`{n}`") for n in own_columns if n != "rid"], F.col("_rid").alias("rid"), "match", "relevance", "rank", "outcome")


def search_datasets(datasets: dict[str, dict], query: str, chosen: list[str] | None = None, **how: object) -> DataFrame:
    """V01, U02, J04 over several datasets: (dataset, rid, match, rank, relevance, outcome), for page() and explain().

    datasets: name -> the arguments of search() that describe it (rows, rid, fields, code_fields,
    identifiers, direction, jurisdiction, index). Whether a code exists is asked of all of them,
    also where only the chosen ones are searched.
    """
    codes_of = lambda d: d["index"]["codes"] if d.get("index") else code_index(d["rows"], d["rid"], d["code_fields"])
    everywhere = reduce(DataFrame.unionByName, [codes_of(d).select("code", "hier") for d in datasets.values()])
    found = []
    for name in chosen or list(datasets):
        hit = search(**datasets[name], query=query, everywhere=everywhere, **how)
        found.append(hit.select(F.lit(name).alias("dataset"), F.col("rid").cast("string").alias("rid"), "match", "rank", "relevance", "outcome"))
    return reduce(DataFrame.unionByName, found)


def page(found: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of the ranked records, with the total and the next offset."""
    limit, offset = records.clamp(limit, 1, 25, 10), max(0, offset)
    ranked = found.where("outcome = 'ranked'")
    total = ranked.agg(F.count("*").alias("total"))
    shown = ranked.orderBy("rank", "rid").offset(offset).limit(limit)
    return shown.join(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))


def explain(found: DataFrame) -> DataFrame:
    """How many candidates were ranked, out of scope, filtered or unrelated, with the first unrelated ones."""
    counts = found.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("ranked", "out_of_scope", "filtered", "unrelated")])
    first = found.where("outcome = 'unrelated'").orderBy("rank", "rid").limit(EXAMPLES).agg(F.array_sort(F.collect_list("rid")).alias("examples"))
    return counts.join(F.broadcast(first))


def completeness(datasets: DataFrame, validation: DataFrame, status: DataFrame) -> DataFrame:
    """Left lookups of a dataset's validation and freshness."""
    return datasets.join(validation, "dataset", "left").join(status, "dataset", "left")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
