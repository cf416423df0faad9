"""Streams of run events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofbase.session import work_dir

LATE, SESSION_GAP, STALE_SECONDS, BUCKET = "1 hour", "1 hour", 120, "_bucket"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    """Appended Parquet files as a stream of events, with a watermark on ts."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; the same code for batch and stream."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """A user's events without a gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


class Liveness(StatefulProcessor):
    """Emits a run as interrupted when event time passes its last heartbeat by 120 seconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max(int(x.timestamp() * 1000) for part in rows for x in part["ts"])
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self.last.update((newest,))
        self.handle.registerTimer(newest + STALE_SECONDS * 1000)
        yield pd.DataFrame({"user_id": [], "last": [], "status": []}).astype({"user_id": "int64", "status": "str"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last": [last], "status": ["interrupted"]})

    def close(self) -> None:
        pass


def liveness(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(Liveness(), "user_id long, last long, status string", "append", "EventTime")


def answered(calls: DataFrame, results: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each call (run_id, call_id, ts) with the time of each result within the interval, NULL if there is none.

    An equi-join on run and call with bounds on both times, the same for tables and streams: a
    stream keeps a row no longer than the watermarks and the interval ask, and gives a call
    without a result when that time has passed.
    """
    width = F.expr(f"INTERVAL {within}")
    c, r = calls.select("run_id", "call_id", F.col("ts").alias("called")), results.select(F.col("run_id").alias("_r"), F.col("call_id").alias("_c"), F.col("ts").alias("answered"))
    met = (F.col("run_id") == F.col("_r")) & (F.col("call_id") == F.col("_c")) & (F.col("answered") >= F.col("called")) & (F.col("answered") <= F.col("called") + width)
    return c.join(r, met, "leftOuter").select("run_id", "call_id", "called", "answered")


def run_into(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything available, into Parquet below folder, from where the last run of the same folder ended; complete results replace each other."""
    spark, rows = stream.sparkSession, f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        q = writer.format("parquet").option("path", rows).start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything available, once: a stream's result to compare with the batch's."""
    return run_into(stream, f"{work_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}", mode)


def append_once(folder: str, keys: tuple[str, str] = ("run_id", "seq"), buckets: int = 64):
    """A foreachBatch sink that appends only (run, seq) pairs not stored yet, so a repeated batch changes nothing. The log lies in folders by a hash of the run, of which a batch reads those of its runs."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(F.col(keys[0]).cast("string")), F.lit(buckets)).cast("int").alias(BUCKET)
        fresh = batch.dropDuplicates(list(keys)).select("*", bucket)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            mine = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
            stored = spark.read.schema(fresh.schema).parquet(folder).where(F.col(BUCKET).isin(*mine or [-1])).select(*keys)
            fresh = fresh.join(stored, list(keys), "left_anti")
        fresh.write.mode("append").partitionBy(BUCKET).parquet(folder)

    return write
