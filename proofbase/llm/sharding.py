"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is 60 bits of the MD5 of its id. A directory entry of depth d holds the keys
that share d leading bits; only an entry whose bytes exceed the limit is split, on the next bit.
Depths are found without touching the texts again: bytes are summed once per fine cell, sums of
all prefixes of the cells follow, and a cell's depth is the least at which its prefix fits.
Cells that are still too large at STEP bits take STEP more, alone.

Defined cases: a null or empty text has no bytes but is placed; null and repeated ids are placed
by their common key, so their rows share a shard; an entry that holds a single key can't be split
further and stays, alone, with fits = false if it is over the limit; an empty table gives no rows;
other columns are kept, and columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

BITS, STEP = 60, 12
#: The query's limit of bytes a shard.
LIMIT = 1 << 20


def key_of(doc_id: str = "doc_id") -> F.Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _prefix(key: F.Column, depth: F.Column | int) -> F.Column:
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def directory(keyed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, bytes, docs, fits) of every directory entry, from rows (key, n_bytes, docs), one per key."""
    sums = [F.sum("n_bytes").alias("n_bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high")]
    left = keyed.select("key", "n_bytes", "docs", F.col("key").alias("low"), F.col("key").alias("high"))
    entries = None
    top = 0
    while True:
        deep = min(BITS, top + STEP)
        cells = c.stored(left.groupBy(_prefix(F.col("key"), deep).alias("cell")).agg(*sums))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(deep))))
        every = c.stored(levels.groupBy("depth", F.call_function("shiftright", "cell", (F.lit(deep) - F.col("depth")).cast("int")).alias("prefix")).agg(*sums).withColumnRenamed("n_bytes", "bytes"))
        # an entry exists where it fits, or can't be split, and its parent is too large
        over = (F.col("bytes") > limit) & (F.col("low") != F.col("high"))
        parents = every.where(over & (F.col("depth") < deep)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"))
        split = every.alias("e").join(parents.alias("p"), (F.col("e.depth") == F.col("p.depth")) & (F.call_function("shiftright", F.col("e.prefix"), F.lit(1)) == F.col("p._p")), "left_semi")
        live = (split.unionByName(every.where(F.col("depth") == 0)) if top == 0 else split).withColumn("over", over)
        live = c.stored(live)
        done = live.where(~F.col("over")).select("prefix", "depth", "bytes", "docs", (F.col("bytes") <= limit).alias("fits"))
        entries = done if entries is None else entries.unionByName(done)
        again = live.where(F.col("over") & (F.col("depth") == deep)).select(F.col("prefix").alias("_cell"))
        if deep == BITS or again.isEmpty():
            return c.stored(entries)
        left = left.join(again, _prefix(F.col("key"), deep) == F.col("_cell"), "left_semi")
        top = deep


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, shard (its prefix as bits), depth, shard_bytes and fits."""
    results = ["n_bytes", "shard", "depth", "shard_bytes", "fits"]
    docs, own = c.hidden(docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in results]), ("doc_id", "text"))
    keyed = docs.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "_key": key_of()})
    keys = c.stored(keyed.groupBy(F.col("_key").alias("key")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("docs")))
    entries = directory(keys, limit)
    depths = sorted(r["depth"] for r in entries.select("depth").distinct().collect())  # at most BITS + 1 numbers
    # a key lies in one entry: the one whose prefix it has, at that entry's depth
    spots = F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("key"), d).alias("p")) for d in depths or [0]])
    bits = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))
    placed = (
        keys.select(F.col("key").alias("_k"), F.explode(spots).alias("_s"))
        .join(entries, (F.col("_s.d") == F.col("depth")) & (F.col("_s.p") == F.col("prefix")))
        .select("_k", bits.alias("shard"), F.col("depth"), F.col("bytes").alias("shard_bytes"), "fits")
    )
    return keyed.join(c.stored(placed).hint("merge"), F.col("_key") == F.col("_k")).select(*own, *results)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return shards(docs)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
l AS (SELECT unnest(range(0, {BITS} + 1)) AS depth),
s AS (SELECT depth, key >> ({BITS} - depth)::INT AS prefix, sum(n_bytes) AS b, min(key) = max(key) AS one FROM d, l GROUP BY ALL),
x AS (SELECT d.doc_id, d.n_bytes, d.key, s.depth, s.prefix, s.b, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) AS r
      FROM d JOIN s ON s.prefix = d.key >> ({BITS} - s.depth)::INT WHERE s.b <= {LIMIT} OR s.one)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth::INT) END AS shard, depth::INT AS depth, b::BIGINT AS shard_bytes, b <= {LIMIT} AS fits
FROM x WHERE r = 1
"""
