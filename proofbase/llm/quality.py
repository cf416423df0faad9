"""Quality rules with thresholds that adapt to each language and source.

One pass over the texts gives each document's base measures. Mergeable quantile sketches
(Spark's approx_percentile summaries, merged map-side first) per (lang, source) give fences
around the bulk of each group; a document outside its group's fences, or failing the base
rule, is rejected. The outer quantiles alone set how far a fence lies from the median. A group
of under POOL documents has too few for them and takes the fences of its language. Groups are
joined back by key, null keys included.

Defined cases: a null or empty text has no words and fails the base rule; null lang or source
form groups of their own; repeated rows are judged row by row; an empty table gives no rows;
other columns pass through untouched unless they bear the name of a result column, in which
case the result column takes their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: The rank error of a sketch is its rows over this.
ACCURACY = 10_000
#: A group of fewer documents (those that pass the base rule) is judged by its language.
POOL = 200
#: measure -> (lower quantile or None, upper quantile, reach, one). A fence lies reach times the distance from the
#: median to the quantile beyond that quantile. Symbols take the upper tenth, as junk may be the uppermost twentieth;
#: repeats are rare, so a lesser quantile of theirs is 0. `one` is an occurrence's part of the rate, times the words:
#: a rate that only a single occurrence puts beyond the upper fence is within.
MEASURES = {
    "mean_word_len": (0.1, 0.9, 3.0, 0.0),
    "symbol_rate": (None, 0.9, 3.0, 1.0),
    "dup_line_rate": (None, 0.99, 1.0, 10.0),
    "repeat_rate": (None, 0.98, 1.0, 3.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _line_repeats(t: c.Texts) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line."""
    data, n = t.data, len(t)
    out = np.zeros(n, np.int64)
    if not len(data):
        return out
    newline = data == 10
    begins = np.zeros(len(data), bool)
    begins[1:] = newline[:-1]
    begins[t.at[:-1][t.at[:-1] < t.at[1:]]] = True
    start = np.flatnonzero(begins & ~newline)
    if not len(start):
        return out
    code = c.mix(c.string_codes(data, ~newline, start))
    worded = np.add.reduceat((c.SPACE_WORDS[data]).astype(np.int32), start) > 0
    row = np.searchsorted(t.at, start, "right") - 1
    code, row = code[worded], row[worded]
    order = np.lexsort((code, row))
    again = ~c.distinct(row[order], code[order])
    return np.bincount(row[order][again], minlength=n)


def _repeat_words(w: c.Words, n: int) -> np.ndarray:
    """Per row: words in 3-word windows found twice or more in the row."""
    out = np.zeros(n, np.int64)
    ok = np.flatnonzero(c.whole_windows(w, 3))
    if not len(ok):
        return out
    code = c.grams(w.code, 3)[ok] + c.mix(w.row[ok].astype(c.U64))
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(w.code), bool)
    at = ok[twice]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return np.bincount(w.row[hit], minlength=n)


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in c.texts(batches):
        w = c.words(t, c.SPACE_WORDS, lower=False)
        lead = (t.data & 0xC0) != 0x80
        found = {
            "n_words": np.diff(w.first),
            "word_chars": c.run_sums(lead & c.SPACE_WORDS[t.data], t.at),
            "n_symbols": c.run_sums(_symbol[t.data], t.at),
            "n_dup_lines": _line_repeats(t),
            "n_repeat_words": _repeat_words(w, len(t)),
        }
        yield c.with_columns(t, {n: pa.array(x, pa.int64()) for n, x in found.items()})


def base_measures(docs: DataFrame) -> DataFrame:
    """docs with the base measures."""
    return docs.mapInArrow(measure_batches, c.extended(docs.schema, ", ".join(f"{n} long" for n in BASE)))


def with_rates(measured: DataFrame) -> DataFrame:
    """The measures that the fences judge, and base_failed."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return measured.withColumns({
        "mean_word_len": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / words * 10,
        "repeat_rate": F.col("n_repeat_words") / words,
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def fences(rated: DataFrame) -> DataFrame:
    """One row per (lang, source): the lower and upper fence of each measure, from those that pass the base rule. Reads rated twice."""
    aggs = [F.count("*").alias("n")]
    for m, (low, high, *_) in MEASURES.items():
        aggs.append(F.percentile_approx(m, [0.5 if low is None else low, high, 0.5], ACCURACY).alias(f"q_{m}"))
    passed = rated.where(~F.col("base_failed"))
    groups = passed.groupBy("lang", "source").agg(*aggs)
    pooled = passed.groupBy(F.col("lang").alias("p_lang")).agg(*[x.alias(f"p_{m}") for x, m in zip(aggs[1:], MEASURES, strict=True)])
    found = groups.join(pooled, F.col("lang").eqNullSafe(F.col("p_lang")))
    cols = [F.col("lang").alias("g_lang"), F.col("source").alias("g_source")]
    for m, (low, _, reach, _) in MEASURES.items():
        q = F.when(F.col("n") >= POOL, F.col(f"q_{m}")).otherwise(F.col(f"p_{m}"))
        cols.append((q[2] - (q[2] - q[0]) * (1 + reach) if low is not None else F.lit(None).cast("double")).alias(f"lo_{m}"))
        cols.append((q[2] + (q[1] - q[2]) * (1 + reach)).alias(f"hi_{m}"))
    return found.select(*cols)


def judge(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept: the base rule holds and no measure lies beyond its group's fences."""
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    inside = reduce(
        lambda a, b: a & b,
        [F.coalesce(F.col(m) >= F.col(f"lo_{m}"), F.lit(True)) & F.coalesce(F.col(m) - F.lit(one) / words <= F.col(f"hi_{m}"), F.lit(True)) for m, (*_, one) in MEASURES.items()],
    )
    return rated.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & inside).drop(*limits.columns)


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` columns, the base measures, base_failed and kept, one row per row of docs."""
    # the measures are small beside the texts: kept once, read by the sketches and by the filter
    rated = with_rates(c.stored(base_measures(docs.select(*keep, "text")).drop("text")))
    return judge(rated, c.stored(fences(rated)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", *BASE, "base_failed", "kept", "lang", "source")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns: measured again where they are read, so no text is shuffled."""
    limits = c.stored(fences(with_rates(c.stored(base_measures(docs.select("lang", "source", "text")).drop("text")))))
    docs, own = c.hidden(docs, ("lang", "source", "text"))
    return judge(with_rates(base_measures(docs)), limits).where("kept").select(*own)


def _oracle() -> str:
    """The query in SQL: exact quantiles, which the sketches' are on tables of up to ACCURACY documents a group."""
    quantile = lambda m, q: f"quantile_disc({m}, {q}) FILTER (NOT base_failed)"
    parts, tests = [], []
    for m, (low, high, reach, one) in MEASURES.items():
        for k, q in (("a", 0.5 if low is None else low), ("b", high), ("c", 0.5)):
            parts.append(f"{quantile(m, q)} AS {m}_{k}")
        pick = lambda k, m=m: f"CASE WHEN g.n >= {POOL} THEN g.{m}_{k} ELSE p.{m}_{k} END"
        if low is not None:
            tests.append(f"coalesce({m} >= {pick('c')} - ({pick('c')} - {pick('a')}) * {1 + reach}, true)")
        tests.append(f"coalesce({m} - {one}::DOUBLE / greatest(n_words, 1) <= {pick('c')} + ({pick('b')} - {pick('c')}) * {1 + reach}, true)")
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g3, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_len, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_rate, n_dup_lines / greatest(n_words, 1)::DOUBLE * 10 AS dup_line_rate,
      n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_rate, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
g AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n, {", ".join(parts)} FROM r GROUP BY lang, source),
p AS (SELECT lang, {", ".join(parts)} FROM r GROUP BY lang)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept, r.lang, r.source
FROM r LEFT JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source LEFT JOIN p ON r.lang IS NOT DISTINCT FROM p.lang
"""


ORACLE = _oracle()
