"""Long documents: passage windows, page reads, previews."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.functions import text as tx
from proofbase.functions import web

WINDOW, STEP, RESULTS, PAGES_SHOWN, SNIPPET = 4, 2, 12, 60, 1200
CACHED_DOCUMENTS, CACHED_WORDS = 8, 500_000
READ_CHARS, READ_PAGES, PREVIEW_CHARS, EDGE = 12_000, 10, 6000, 2000


def needed(terms: Column) -> Column:
    """All of one or two terms, else 60 % of them, rounded up, and two at least."""
    n = F.size(terms)
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.6 - 1e-9))).cast("int")


def windows(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with first_line, last_line and lines of each window of 4 lines, every 2."""
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - WINDOW + STEP) - 1, F.lit(STEP))
    cut = F.transform(starts, lambda i: F.struct((i + 1).alias("first_line"), F.least(n, i + WINDOW).alias("last_line"), F.slice(lines, i + 1, WINDOW).alias("lines")))
    return pages.withColumn("_w", F.explode(cut)).select(*pages.columns, "_w.first_line", "_w.last_line", "_w.lines")


def passage_hits(pages: DataFrame, terms: Column, phrase: Column, text: str = "text") -> DataFrame:
    """Windows with enough terms, their score; pages that can't have them are left out first."""
    whole = F.array_distinct(tx.tokens(tx.normalized(F.col(text))))
    likely = pages.where(F.size(tx.document_hits(terms, whole)) >= needed(terms))
    # lines are normalised once and every window puts its own together
    lined = likely.withColumns({"_l": F.split(F.col(text), "\n"), "_x": F.split(tx.normalized_lines(F.col(text)), "\n")})
    n = F.size("_l")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - WINDOW + STEP) - 1, F.lit(STEP))
    cut = lined.withColumn("_i", F.explode(starts)).withColumns({
        "first_line": F.col("_i") + 1, "last_line": F.least(n, F.col("_i") + WINDOW), "lines": F.slice("_l", F.col("_i") + 1, WINDOW), "_n": F.array_join(F.filter(F.slice("_x", F.col("_i") + 1, WINDOW), lambda x: x != ""), " "),
    }).drop("_i", "_l", "_x")
    cut = cut.withColumn("got", tx.document_hits(terms, F.array_distinct(tx.tokens(F.col("_n")))))
    exact = (F.size(F.split(phrase, " ")) > 1) & F.contains(F.col("_n"), phrase)
    scored = cut.where(F.size("got") >= needed(terms)).withColumns({"exact_phrase": exact, "score": web.passage_score(F.size("got"), F.size(terms), exact)})
    return scored.withColumn("snippet", F.substring(F.trim(F.array_join("lines", "\n")), 1, SNIPPET)).drop("_n", "lines")


def without_overlap(hits: DataFrame, key: str, page: str) -> DataFrame:
    """By score, then place, each window that meets no kept one on its page, for the windows of W01, which meet only the one before and the one after.

    Such a window is kept if every neighbour that comes first by score is dropped. So along a
    slope of scores every second window stays, counted from its top, and one between two slopes
    stays if both would keep it: two passes of a running minimum over a page, and no fold.
    """
    place = W.partitionBy(key, page).orderBy("first_line")
    row = F.struct("score", "first_line", "last_line")
    before, after = F.lag(row).over(place), F.lead(row).over(place)
    meets = lambda x: F.coalesce((x["first_line"] <= F.col("last_line")) & (F.col("first_line") <= x["last_line"]), F.lit(False))
    first = lambda x: meets(x) & F.coalesce((x["score"] > F.col("score")) | ((x["score"] == F.col("score")) & (x["first_line"] < F.col("first_line"))), F.lit(False))
    placed = hits.withColumns({"_i": F.row_number().over(place), "_b": first(before), "_a": first(after)})
    top_before = F.max(F.when(~F.col("_b"), F.col("_i"))).over(place.rowsBetween(W.unboundedPreceding, 0))
    top_after = F.min(F.when(~F.col("_a"), F.col("_i"))).over(place.rowsBetween(0, W.unboundedFollowing))
    kept = ((F.col("_i") - top_before) % 2 == 0) & ((top_after - F.col("_i")) % 2 == 0)
    return placed.withColumn("_kept", kept).where("_kept").select(*hits.columns)


def search_document(pages: DataFrame, key: str, page: str, query: str, most: int = RESULTS) -> DataFrame:
    """The best passages per document with the totals: rank, passages in all, pages with any."""
    # the query's form is found on the driver, as an expression it would be computed for every row
    norm = tx.normalized(F.lit(query))
    form = pages.sparkSession.range(1).select(norm.alias("norm"), tx.document_query_terms(norm).alias("terms")).first()
    terms = F.array(*[F.lit(t) for t in form["terms"]]) if form["terms"] else F.array().cast("array<string>")
    hits = without_overlap(passage_hits(pages, terms, F.lit(form["norm"])), key, page)
    order = W.partitionBy(key).orderBy(F.desc("score"), page, "first_line")
    whole = W.partitionBy(key)
    ranked = hits.withColumns({"rank": F.row_number().over(order), "total": F.count("*").over(whole), "pages": F.slice(F.array_sort(F.collect_set(page).over(whole)), 1, PAGES_SHOWN)})
    return ranked.where(F.col("rank") <= min(most, RESULTS))


def page_ranges(rows: DataFrame, key: str, page: str) -> DataFrame:
    """Gaps and islands as text, such as 1-3, 7."""
    island = F.col(page) - F.row_number().over(W.partitionBy(key).orderBy(page))
    runs = rows.select(key, page).distinct().withColumn("_i", island).groupBy(key, "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def read_range(pages: DataFrame, key: str, page: str, first: int, last: int, most_chars: int = READ_CHARS, offset: int = 0) -> DataFrame:
    """Pages of a range until the budget is used, at most ten; body, and where to continue.

    A first page that alone exceeds the budget is cut at its last newline in the second half of
    the budget, or at the budget.
    """
    asked = pages.where(F.col(page).between(first, min(last, first + READ_PAGES - 1)))
    body = F.when(F.col(page) == first, F.substring("text", offset + 1, 1 << 30)).otherwise(F.col("text"))
    cut = asked.withColumn("_body", body).withColumn("_used", F.sum(F.length("_body")).over(W.partitionBy(key).orderBy(page).rowsBetween(W.unboundedPreceding, 0)))
    head = F.substring("_body", 1, most_chars)
    newline = F.length(head) - F.position(F.lit("\n"), F.reverse(head))
    at = F.when((F.position(F.lit("\n"), head) > 0) & (newline > most_chars // 2), newline).otherwise(most_chars)
    fits = F.col("_used") <= most_chars
    shown = cut.where(fits | (F.col(page) == first)).withColumns({
        "partial": ~fits | ((F.col(page) == first) & F.lit(offset > 0)),
        "body": F.when(fits, F.col("_body")).otherwise(F.substring(F.col("_body"), F.lit(1), at.cast("int"))),
        "next_offset": F.when(~fits, at + offset),
    })
    return shown.select(key, page, "body", "partial", F.col("next_offset").cast("long").alias("next_offset"))


def preview(pages: DataFrame, key: str, page: str, chars: int = PREVIEW_CHARS, unit: str = "page") -> DataFrame:
    """The beginning with page markers and whether it is all; a page is cut only where 200 characters remain."""
    marker = F.concat(F.lit(f"[{unit} "), F.col(page).cast("string"), F.lit("]\n"))
    order = W.partitionBy(key).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    marked = pages.withColumn("_m", marker).withColumn("_n", F.length("_m") + F.length("text"))
    placed = marked.withColumn("_used", F.coalesce(F.sum(F.col("_n") + 2).over(order), F.lit(0)))
    over = F.col("_used") + F.col("_n") > chars
    first_over = placed.withColumn("_over", over).withColumn("_k", F.sum(F.col("_over").cast("int")).over(W.partitionBy(key).orderBy(page).rowsBetween(W.unboundedPreceding, 0)))
    room = F.lit(chars) - F.col("_used") - F.length("_m")
    part = F.when(F.col("_k") == 0, F.concat("_m", "text")).when((F.col("_k") == 1) & F.col("_over") & (room > 200), F.concat(F.col("_m"), F.substring(F.col("text"), F.lit(1), room.cast("int")), F.lit("\n[... preview ends ...]")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(page).alias("p"), part.alias("t"))))), lambda x: x["t"]), "\n\n")
    return first_over.groupBy(key).agg(joined.alias("preview"), (F.max("_k") == 0).alias("whole"))


class IndexedDocuments:
    """The pages of the documents searched last, with their words, in memory: at most `most` documents and `budget` words with variants.

    A document over the budget is indexed but not kept. For one process; tables of documents are
    searched by search_document().
    """

    def __init__(self, load: Callable[[str], list[tuple[int, str]]], most: int = CACHED_DOCUMENTS, budget: int = CACHED_WORDS):
        self._load, self._most, self._budget = load, most, budget
        self._held: OrderedDict[str, tuple[int, list[tuple[int, str, frozenset[str]]]]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def pages(self, doc_id: str) -> list[tuple[int, str, frozenset[str]]]:
        """(page, text, words with variants) of a document."""
        if doc_id in self._held:
            self._held.move_to_end(doc_id)
            return self._held[doc_id][1]
        found = [(n, text, frozenset(v for w in tx.normalize_python(text).split() for v in tx.term_variants(w))) for n, text in self._load(doc_id)]
        size = sum(len(words) for *_, words in found)
        if size <= self._budget:
            self._held[doc_id] = (size, found)
            while len(self._held) > self._most or sum(n for n, _ in self._held.values()) > self._budget:
                self._held.popitem(last=False)
        return found
