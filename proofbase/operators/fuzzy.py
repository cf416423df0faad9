"""Words within an edit distance of two, by an index of parts that such words must share.

A short word and another within two edits have a common remainder when at most two letters of each
are deleted, so short words are indexed by their remainders. A long word is cut into three parts,
one of which two edits leave whole, at most two places from where it was (the partition of Li, Deng
and Feng, 2011); so a long word is three rows, not thousands. Candidates are verified by their distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters up to which a word is indexed by its remainders.
SHORT, DISTANCE = 8, 2


def _without_one(w: Column) -> Column:
    n = F.length(w)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def remainders(w: Column) -> Column:
    """The word, and what is left of it without one or two letters."""
    one = F.array_distinct(_without_one(w))
    return F.array_distinct(F.concat(F.array(w), one, F.flatten(F.transform(one, _without_one))))


def _cuts(n: Column) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of a word's three parts; the last ones are longer."""
    base, more = F.floor(n / 3).cast("int"), n % 3
    sizes = [base, base + F.when(more > 1, 1).otherwise(0), base + F.when(more > 0, 1).otherwise(0)]
    return [(F.lit(1), sizes[0]), (sizes[0] + 1, sizes[1]), (sizes[0] + sizes[1] + 1, sizes[2])]


def word_index(words: DataFrame, word: str = "word") -> DataFrame:
    """(key, word) rows of distinct words: 'r:' and a remainder, or the length, the part's number and the part."""
    w = F.col(word)
    parts = F.array(*[F.concat_ws(":", F.length(w), F.lit(k), F.substring(w, a, n)) for k, (a, n) in enumerate(_cuts(F.length(w)))])
    keys = F.when(F.length(w) <= SHORT, F.transform(remainders(w), lambda x: F.concat(F.lit("r:"), x))).otherwise(parts)
    return words.select(w.alias("word")).where("word is not null").distinct().select(F.explode(keys).alias("key"), "word")


def _moved(w: Column, size: Column, part: int) -> Column:
    """The keys of a part of words of `size` letters that w has, up to two places from where they have it."""
    start, length = _cuts(size)[part]
    places = F.filter(F.transform(F.sequence(F.lit(-DISTANCE), F.lit(DISTANCE)), lambda s: (start + s).cast("int")), lambda i: (i >= 1) & (i + length - 1 <= F.length(w)))
    return F.when(size > SHORT, F.transform(places, lambda i: F.concat_ws(":", size, F.lit(part), F.substring(w, i, length))))


def _probes(w: Column) -> Column:
    """The keys under which words within two edits of w are indexed."""
    n = F.length(w)
    short = F.when(n <= SHORT + DISTANCE, F.transform(remainders(w), lambda x: F.concat(F.lit("r:"), x))).otherwise(F.array().cast("array<string>"))
    long = [_moved(w, n + d, k) for d in range(-DISTANCE, DISTANCE + 1) for k in range(3)]
    return F.array_distinct(F.concat(short, F.flatten(F.array_compact(F.array(*long)))))


def similar_words(asked: DataFrame, index: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(asked, word, distance) of every indexed word within `distance` (two at most) edits of each asked one (word)."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the index is made for distances up to {DISTANCE}")
    words = asked.select(F.col("word").alias("asked")).where("asked is not null").distinct()
    met = words.select("asked", F.explode(_probes(F.col("asked"))).alias("key")).join(index, "key").select("asked", "word").distinct()
    return met.withColumn("distance", F.levenshtein("asked", "word", distance)).where("distance >= 0")
