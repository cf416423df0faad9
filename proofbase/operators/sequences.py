"""Ordered logs: monotony, streaks, budgets, boundaries, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.functions import text as tx


def _until(keys: list[str], order: list[str], last: int = 0) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def out_of_order(rows: DataFrame, keys: list[str], arrival: list[str], value: str) -> DataFrame:
    """Rows whose value does not exceed the one that arrived before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*arrival))
    return rows.withColumn("_b", before).where(F.col(value) <= F.col("_b")).drop("_b")


def sequence_numbers(rows: DataFrame, keys: list[str], arrival: list[str], name: str = "seq") -> DataFrame:
    """1, 2, ... per key."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*arrival)))


def recent_start(messages: DataFrame, key: str, order: str, rounds: int, first: int = 2, role: str = "assistant") -> DataFrame:
    """Per key the place of the `rounds`-th last assistant message, not before `first`."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    found = messages.where(F.col("role") == role).withColumn("_n", nth).where(F.col("_n") == rounds).select(key, F.col(order).alias("_at"))
    return messages.select(key).distinct().join(found, key, "left").select(key, F.greatest(F.coalesce("_at", F.lit(first)), F.lit(first)).alias("start"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first counts."""
    return rows.where(F.lit(True)).withColumn("_b", F.lag(value).over(W.partitionBy(*keys).orderBy(*order))).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def longest_streaks(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Per key the longest run of rows where flag holds."""
    numbered = rows.withColumns({"_f": flag, "_r": F.row_number().over(W.partitionBy(*keys).orderBy(*order))})
    islands = numbered.where("_f").withColumn("_i", F.col("_r") - F.row_number().over(W.partitionBy(*keys).orderBy("_r")))
    runs = islands.groupBy(*keys, "_i").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("streak"))
    return rows.select(*keys).distinct().join(runs, keys, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def first_seen(rows: DataFrame, key: Column, order: list[str], ref: str) -> DataFrame:
    """seen_in, the reference of the key's first row, and is_first. One aggregation, no window over a hot key."""
    keyed = rows.withColumn("_k", F.md5(key.cast("string").cast("binary")))  # 128 bits stand for a long key
    first = keyed.groupBy("_k").agg(F.min_by(ref, F.struct(*order)).alias("seen_in"))
    return keyed.join(first, keyed["_k"].eqNullSafe(first["_k"])).withColumn("is_first", F.col(ref) == F.col("seen_in")).drop("_k")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, most: int) -> DataFrame:
    """Leading rows until the budget is used; the first row always stays."""
    placed = rows.withColumns({"_u": F.sum(size).over(_until(keys, order)), "_r": F.row_number().over(W.partitionBy(*keys).orderBy(*order))})
    return placed.where((F.col("_u") <= most) | (F.col("_r") == 1)).drop("_u", "_r")


def last_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def unanswered(messages: DataFrame, key: str, order: str) -> DataFrame:
    """User messages whose next message is not the assistant's: an anti join on the place."""
    answers = messages.where("role = 'assistant'").select(F.col(key).alias("_k"), (F.col(order) - 1).alias("_o"))
    return messages.where("role = 'user'").join(answers, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left_anti")


def usage(rows: DataFrame, phase: Column, value: str) -> DataFrame:
    """Totals and per phase in one pass; NULL phase is the total."""
    return rows.withColumn("phase", phase).rollup("phase").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"), F.count("*").alias("calls"))


def compaction_start(messages: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """Per key the estimated tokens, and from which message the last two rounds (one if those exceed the budget) are kept."""
    cost = tx.estimated_tokens(F.col("text")) + 4
    sized = messages.withColumn("_c", cost)
    total = sized.groupBy(key).agg(F.sum("_c").alias("tokens"))
    two = recent_start(messages, key, order, 2).withColumnRenamed("start", "two")
    one = recent_start(messages, key, order, 1).withColumnRenamed("start", "one")
    tail = sized.join(two, key).where(F.col(order) >= F.col("two")).groupBy(key).agg(F.sum("_c").alias("tail"))
    both = total.join(two, key).join(one, key).join(tail, key, "left")
    start = F.when(F.col("tokens") <= budget, F.lit(0)).when(F.coalesce("tail", F.lit(0)) <= budget, F.col("two")).otherwise(F.col("one"))
    return both.select(key, "tokens", start.cast("long").alias("start"))
