"""Projections and predicates over record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.functions import text as tx
from proofbase.functions import web

FIELD_CHARS, SCAN_ROWS, LINE_CHARS = 1500, 20_000, 600

# Wordings of claims that something is not required.
NEGATIVE = (
    r"(?i)\bexempt|\bexemption|not required|no requirement|does not apply|doesn't apply|not subject to|"
    r"no licen[cs]e|without (?:a )?licen[cs]e|no permit|no approval|not regulated|no restriction|"
    r"פטור|פטורה|פטורים|אינו טעון|אינה טעונה|אינם טעונים|אין צורך|אין חובה|לא נדרש|אינו נדרש|אינה נדרשת|"
    r"לא חל|אינו חל|אינה חלה|אין דרישה|ללא רישיון|ללא רשיון|ללא אישור|לא חייב|אינו חייב"
)


class FieldError(ValueError):
    """A filter or field restriction names a column that the dataset does not have."""


def record_line(names: list[str]) -> Column:
    """Name: value of the non-empty columns, joined by bars; long values are cut."""

    def part(name: str) -> Column:
        x = tx.strip_controls(F.col(name))
        cut = F.when(F.length(x) > FIELD_CHARS, F.concat(F.substring(x, 1, FIELD_CHARS), F.lit("…"))).otherwise(x)
        return F.when(F.col(name).isNotNull() & (F.col(name).cast("string") != ""), F.concat(F.lit(f"{name}: "), cut))

    return F.concat_ws(" | ", *[part(n) for n in names])


def result(rows: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows with record_id, dataset and record_line."""
    return rows.withColumns({"record_id": F.col(key).cast("string"), "dataset": F.lit(dataset), "record_line": record_line(rows.columns)})


def get_records(rows: DataFrame, dataset: str, key: str, ids: list[str]) -> DataFrame:
    """One row per asked id; found = false where there is none."""
    asked = rows.sparkSession.createDataFrame([(str(i).strip(),) for i in ids], "record_id string")
    known = rows.withColumn("_id", F.col(key).cast("string"))
    return asked.join(known, F.col("record_id") == F.col("_id"), "left").select(F.lit(dataset).alias("dataset"), "record_id", F.col("_id").isNotNull().alias("found"), *rows.columns)


def _equals(name: str, value: object) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == F.lit(str("" if value is None else value).strip())


def validate_filters(rows: DataFrame, filters: dict[str, object], most: int = 5) -> None:
    """At most five pairs of known fields and scalars."""
    if len(filters) > most:
        raise FieldError(f"at most {most} filters are allowed")
    if unknown := sorted(set(filters) - set(rows.columns)):
        raise FieldError(f"unknown field(s) {unknown}; known: {rows.columns}")
    if odd := [k for k, v in filters.items() if isinstance(v, (list, dict, set, tuple))]:
        raise FieldError(f"filter values of {odd} must be scalar")


def exact_filter(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Trimmed equality on every pair; NULL equals ''."""
    validate_filters(rows, filters)
    return rows.where(reduce(lambda a, b: a & b, [_equals(k, v) for k, v in filters.items()], F.lit(True)))


def lenient_filter(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """As P07 on cleaned cells, but pairs of unknown columns are ignored."""
    tests = [web.clean_cell(F.col(k).cast("string")) == str(v).strip() for k, v in filters.items() if k in rows.columns]
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def restrict(rows: DataFrame, datasets: list[str] | str | None) -> DataFrame:
    """P10: the named datasets; nothing, 'all' or '*' stands for all."""
    if datasets in (None, "", "all", "*", []):
        return rows
    return rows.where(F.col("dataset").isin(*([datasets] if isinstance(datasets, str) else datasets)))


def direction(book: Column, book_id: Column) -> Column:
    """Import or export by the book's name, else by its number; NULL where neither is given."""
    name, number = F.trim(F.coalesce(book, F.lit(""))), F.substring_index(F.trim(F.coalesce(book_id.cast("string"), F.lit(""))), ".", 1)
    known = (name != "") | (number != "")
    is_import = (name == "יבוא") | ((name == "") & (number == "1"))
    is_export = (name == "יצוא") | ((name == "") & (number == "2"))
    return F.when(known, F.when(is_import, "import").when(is_export, "export").otherwise("unknown"))


def jurisdiction(region: Column) -> Column:
    """Of the region's text; NULL without one."""
    x = F.trim(F.coalesce(region, F.lit("")))
    return F.when(x != "", F.when(x.contains("בלבד"), "autonomy_only").when(x.contains("ישראל"), "israel_and_autonomy").otherwise("unknown"))


def scope_allowed(direction_: Column, jurisdiction_: Column, want_direction: str = "any", want_jurisdiction: str = "any") -> Column:
    """Only the opposite direction is excluded; israel drops what is autonomy's only; autonomy drops unknown regions."""
    d, j = F.coalesce(direction_, F.lit("")), F.coalesce(jurisdiction_, F.lit(""))
    ok = F.lit(True)
    if want_direction != "any":
        ok = ok & ~(d.isin("import", "export") & (d != want_direction))
    if want_jurisdiction == "israel":
        ok = ok & (j != "autonomy_only")
    if want_jurisdiction == "autonomy":
        ok = ok & j.isin("", "autonomy_only", "israel_and_autonomy")
    return ok


def bounded(rows: DataFrame, order: list[str], most: int = SCAN_ROWS) -> DataFrame:
    """The first rows in order; the bound is the operator."""
    return rows.orderBy(*order).limit(most)


def rendered(cells: list[Column]) -> Column:
    """Cleaned cells joined by bars."""
    return F.concat_ws(" | ", *[web.clean_cell(c) for c in cells])


def passage_lines(documents: DataFrame, terms: Column, whole_words: bool = False) -> DataFrame:
    """The non-blank lines with a term, trimmed and cut, with their place."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "_line")).where(F.trim("_line") != "")
    words = F.array_distinct(tx.tokens(tx.normalized(F.col("_line"))))
    hit = F.arrays_overlap(words, terms) if whole_words else F.size(tx.matched_terms(terms, words)) > 0
    return lines.where(hit).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.substring(F.trim("_line"), 1, LINE_CHARS).alias("line"))


def field_terms(rows: DataFrame, terms: Column, fields: list[str], identifiers: list[str], whole_words: bool = False, code_of: dict[str, Column] | None = None) -> DataFrame:
    """Got, the terms in the fields; where_, the fields; id_only, terms in identifier columns alone. Numbers are whole words, or heads of the normalised code in a field of code_of (F16)."""
    if unknown := sorted(set(fields + identifiers) - set(rows.columns)):
        raise FieldError(f"unknown field(s) {unknown}")

    def hits(name: str) -> Column:
        words = F.array_distinct(tx.tokens(tx.normalized(F.col(name).cast("string"))))
        if whole_words:
            return F.array_intersect(terms, words)
        found = tx.variant_hits(terms, words)
        if (code := (code_of or {}).get(name)) is not None:
            found = F.array_union(found, F.filter(terms, lambda t: tx.is_digits(t) & F.length(t).isin(4, 6, 8) & code.startswith(t)))
        return found

    none = F.array().cast("array<string>")
    got = reduce(F.array_union, [hits(n) for n in fields], none)
    ids = reduce(F.array_union, [hits(n) for n in identifiers], none)
    found = rows.withColumns({"got": got, "_ids": ids, "where_": F.array_compact(F.array(*[F.when(F.size(hits(n)) > 0, F.lit(n)) for n in fields]))})
    return found.withColumn("id_only", F.array_except("_ids", "got")).drop("_ids")


def relevance(got: Column, id_only: Column, terms: Column) -> Column:
    """Unrelated, weak or direct."""
    numbers = F.filter(terms, tx.is_digits)
    share = F.size(got) / F.size(terms)
    return (
        F.when(F.size(got) == 0, "unrelated")
        .when((F.size(numbers) > 0) & (F.size(F.array_intersect(numbers, got)) == 0), "unrelated")
        .when((F.size(terms) > 1) & (share < 0.5), "unrelated")
        .when(share < 1, "weak")
        .otherwise("direct")
    )


def metadata_relevant(got: Column, terms: Column) -> Column:
    """A matched term of four letters, two matched terms, or only short terms asked for and one matched."""
    long_ = lambda x: F.length(x) >= 4
    return F.when(F.size(terms) == 0, False).otherwise(F.exists(got, long_) | (F.size(got) >= 2) | ((F.size(got) > 0) & F.forall(terms, lambda x: ~long_(x))))


def page_range(rows: DataFrame, page: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """An open end stays open."""
    if first is not None:
        rows = rows.where(F.col(page) >= first)
    return rows if last is None else rows.where(F.col(page) <= last)


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """An argument within its bounds."""
    return max(low, min(high, int(default if value is None else value)))


def is_negative(texts: list[Column]) -> Column:
    """Whether any text claims an exemption or that nothing is required."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit("")).rlike(NEGATIVE) for t in texts])


def near_duplicates(rows: DataFrame, key: str, words: str, threshold: float = 0.8) -> DataFrame:
    """F25, U04 over a table: pairs (a, b, jaccard) of rows whose distinct words are alike to the threshold.

    Two such rows share one of each's rarest size - ceil(threshold * size) + 1 words, in order of
    their frequency; only these are joined, so words that are common to many rows pair none.
    """
    flat = rows.select(F.col(key).alias("_k"), F.size(words).alias("_n"), F.explode(words).alias("_w"))
    often = flat.groupBy("_w").agg(F.count("*").alias("_f"))
    ranked = flat.join(often, "_w").groupBy("_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_r"))
    rarest = F.slice("_r", 1, F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1)
    index = ranked.select("_k", "_n", F.explode(rarest).alias("_e")).where("_e._f > 1").select("_k", "_n", F.col("_e._w").alias("_w"))
    other = index.select(F.col("_k").alias("_k2"), F.col("_n").alias("_n2"), "_w")
    close = (F.col("_n") >= F.col("_n2") * threshold - 1e-9) & (F.col("_n2") >= F.col("_n") * threshold - 1e-9)
    pairs = index.join(other, "_w").where((F.col("_k") < F.col("_k2")) & close).select(F.col("_k").alias("a"), F.col("_k2").alias("b")).distinct()
    one, two = rows.select(F.col(key).alias("a"), F.col(words).alias("_wa")), rows.select(F.col(key).alias("b"), F.col(words).alias("_wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", tx.jaccard(F.col("_wa"), F.col("_wb")).alias("jaccard")).where(F.col("jaccard") >= threshold)
