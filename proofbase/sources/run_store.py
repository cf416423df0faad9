"""The run log in a database: partitioned scans with pushed filters, and appends that a repeated batch doesn't double.

Any JDBC address serves (the driver's jar is the session's matter). A scan is cut by the entries'
numbers, whose bounds are one row; filters on run and kind and the columns asked for go to
the database. What follows from the log is runs.state(), as for one in Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.operators import runs

#: Columns that are compared in the database have bounded texts there; they are never NULL.
COLUMN_TYPES = "run_id VARCHAR(80), kind VARCHAR(20)"


def read_log(spark: SparkSession, url: str, table: str = "run_log", partitions: int = 8, **options: str) -> DataFrame:
    """All entries of the log, in `partitions` scans by number."""
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    low, high = source(query=f'SELECT MIN("n") AS low, MAX("n") AS high FROM {table}').load().first()
    if low is None:
        return source(dbtable=table).load().transform(_named)
    bounds = {"partitionColumn": "n", "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}
    return source(dbtable=table, **bounds).load().transform(_named)


def _named(rows: DataFrame) -> DataFrame:
    """Databases may spell names in capitals."""
    return rows.select(*[F.col(f"`{c}`").alias(c.lower()) for c in rows.columns])


def append(entries: DataFrame, url: str, table: str = "run_log", **options: str) -> None:
    """Entries that the table doesn't have yet, by (run_id, n); a new table is made by the first ones."""
    spark = entries.sparkSession
    writer = entries.write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=COLUMN_TYPES, **options)
    if exists(spark, url, table, **options):
        stored = read_log(spark, url, table, **options).select(F.col("run_id").alias("_r"), F.col("n").alias("_n"))
        fresh = entries.join(stored, (F.col("run_id") == F.col("_r")) & (F.col("n") == F.col("_n")), "left_anti")
        writer = fresh.write.format("jdbc").options(url=url, dbtable=table, **options)
    writer.mode("append").save()


def exists(spark: SparkSession, url: str, table: str, **options: str) -> bool:
    jdbc = spark._jvm.org.apache.spark.sql.execution.datasources.jdbc
    given = spark._jvm.PythonUtils.toScalaMap({"url": url, "dbtable": table, **options})
    return jdbc.JdbcUtils.tableExists(spark._jvm.java.sql.DriverManager.getConnection(url), jdbc.JdbcOptionsInWrite(given))


def latest(spark: SparkSession, url: str, table: str = "run_log", most: int = 20, **options: str) -> DataFrame:
    """The runs created last, by their state."""
    return runs.state(read_log(spark, url, table, **options)).orderBy(F.desc("created_at"), "run_id").limit(most)
