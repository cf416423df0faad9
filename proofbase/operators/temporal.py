"""As-of and interval joins, and ranks over whole tables, without a task that holds a whole key or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.session import stored

DAY = 86_400


def _stretch(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tie: str, seconds: int = DAY) -> DataFrame:
    """left with _right, the last row of right of the same key at or before its time (of equal times the greatest `tie`), or NULL.

    Both sides are sorted once, together, and a row takes the last right one before it. A key's
    rows are cut into stretches of time, each with the last row of those before it, so a key with a
    third of all rows is as many pieces of work as it has stretches. Rows without key or time match nothing.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), own.alias("_left"))
    alone = a.where("_k is null or _t is null")
    a = a.where("_k is not null and _t is not null").withColumn("_s", _stretch(F.col("_t"), seconds))
    row = F.struct(F.col(right_ts).alias("_t"), F.col(tie).alias("_i"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("row"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), row.alias("_r")).where("_k is not null and _t is not null").withColumn("_s", _stretch(F.col("_t"), seconds))
    none = F.lit(None).cast(b.schema["_r"].dataType)
    # the last row before each stretch, from one row a key and stretch
    lasts = b.groupBy("_k", "_s").agg(F.max_by("_r", F.struct("_t", "_r._i")).alias("_r")).unionByName(a.select("_k", "_s").distinct().withColumn("_r", none))
    lasts = lasts.groupBy("_k", "_s").agg(F.first("_r", ignorenulls=True).alias("_r"))
    before = W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select("_k", "_s", F.last("_r", ignorenulls=True).over(before).alias("_r")).where("_r is not null")
    nothing = F.lit(None).cast(a.schema["_left"].dataType)
    both = (
        a.select("_k", "_s", "_t", F.lit(2).alias("_side"), "_left", none.alias("_r"))
        .unionByName(b.select("_k", "_s", "_t", F.lit(1).alias("_side"), nothing.alias("_left"), "_r"))
        .unionByName(carried.select("_k", "_s", F.col("_r._t").alias("_t"), F.lit(0).alias("_side"), nothing.alias("_left"), "_r"))
    )
    last = F.last("_r", ignorenulls=True).over(W.partitionBy("_k", "_s").orderBy("_t", "_side", "_r._i").rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("_m", last).where("_side = 2").select("_left", F.col("_m.row").alias("_right"))
    return met.unionByName(alone.select("_left", F.lit(None).cast(met.schema["_right"].dataType).alias("_right"))).select("_left.*", "_right")


def within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs (_left, _right) of the same key with right's time from left's time to `seconds` later.

    An equi-join on key and bucket of time: a left row is sent to its own bucket and the next, so
    no key meets as a whole and no pair further apart than two buckets is compared.
    """
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_a"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_b"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_right"))
    spot = _stretch(F.col("_a"), seconds)
    a = a.withColumn("_s", F.explode(F.array(spot, spot + 1)))
    b = b.withColumn("_s", _stretch(F.col("_b"), seconds))
    later = F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))
    return a.join(b, ["_k", "_s"]).where(later.between(0, seconds * 1_000_000)).select("_left", "_right")


def ranks(rows: DataFrame, order: list[Column], tie: list[Column], tiles: int = 4) -> DataFrame:
    """rows with row_number, rank, dense_rank, percent_rank, cume_dist and ntile over the whole table.

    The table is cut into ranges of its order, which keep equal keys together, and each range
    counts for itself; what lies before it is the sum of the counts of the ranges before. Only
    these counts, a row a range, are added up in one place.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[o.alias(n) for n, o in zip(names, order, strict=True)], *[x.alias(f"_t{i}") for i, x in enumerate(tie)])
    ranged = stored(keyed.repartitionByRange(*names).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p", *names).agg(F.count("*").alias("_n")).groupBy("_p").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    every = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"), F.coalesce(F.sum("_d").over(every), F.lit(0)).alias("_distinct"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    part = W.partitionBy("_p").orderBy(*names)
    # a row a range: their number is that of the shuffle's partitions
    placed = ranged.join(F.broadcast(offsets), "_p")
    number = (F.row_number().over(part.orderBy(*names, *[f"_t{i}" for i in range(len(tie))])) + F.col("_before")).alias("row_number")
    rank = F.rank().over(part) + F.col("_before")
    upto = F.count("*").over(part.rangeBetween(W.unboundedPreceding, 0)) + F.col("_before")
    ranked = placed.select(*[F.col(f"`{c}`") for c in rows.columns], number, rank.alias("rank"), (F.dense_rank().over(part) + F.col("_distinct")).alias("dense_rank"), upto.alias("_upto"), "_all")
    share = F.when(F.col("_all") > 1, (F.col("rank") - 1) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    # the first `all % tiles` tiles have one row more
    size, more = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
    long = (size + 1) * more
    tile = F.when(F.col("row_number") <= long, F.floor((F.col("row_number") - 1) / (size + 1)) + 1).otherwise(more + F.floor((F.col("row_number") - long - 1) / F.greatest(size, F.lit(1))) + 1)
    return ranked.withColumns({"percent_rank": share, "cume_dist": F.col("_upto") / F.col("_all"), "ntile": tile.cast("int")}).drop("_upto", "_all")
