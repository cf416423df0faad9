"""Versioned snapshots: scan, validation, change detection, publishing, retention."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbase.sources import sink
from proofbase.sources.sink import SnapshotError

# Descriptor types. Numbers stay exact; dates stay text, as they are never computed on.
TYPES = {"int": T.LongType(), "numeric": T.DecimalType(38, 0), "text": T.StringType(), "timestamp": T.StringType()}
ABOUT = ("label", "dataset_title", "resource_name", "resource_id", "dataset_id", "publisher", "license_title", "source_url", "data_api_url", "resource_last_modified")
CODE_FIELD = "(?i)classification"
LEAST_SHARE, VERIFY_DAYS, KEPT_VERSIONS, CURRENT = 0.5, 7, 2, "current.json"


def schema_of(fields: list[dict[str, str]]) -> T.StructType:
    """The schema from a descriptor; never inferred."""
    return T.StructType([T.StructField(f["id"], TYPES.get(f["type"], T.StringType())) for f in fields])


def profile(rows: DataFrame, key: str, previous_rows: int | None = None) -> DataFrame:
    """Count, missing and repeated ids, bounds, contiguity and the ratio to the previous version, in one pass."""
    n, low, high = F.count("*"), F.min(key), F.max(key)
    return rows.agg(
        n.alias("row_count"), F.count_if(F.col(key).isNull()).alias("null_ids"), (n - F.count_distinct(key)).alias("duplicate_ids"), low.alias("low"), high.alias("high"),
        (high - low + 1 == n).alias("contiguous"), (n / F.lit(previous_rows)).alias("ratio"),
    )


def validate(rows: DataFrame, key: str, expected: int | None = None, previous_rows: int | None = None, allow_shrink: bool = False) -> dict:
    """The profile, or a SnapshotError of its first fault."""
    found = profile(rows, key, previous_rows).first().asDict()
    if not found["row_count"]:
        raise SnapshotError("empty", "no rows")
    if expected is not None and found["row_count"] != expected:
        raise SnapshotError("count", f"{found['row_count']} rows of {expected}")
    if found["null_ids"]:
        raise SnapshotError("null_ids", f"{found['null_ids']} rows without id")
    if found["duplicate_ids"]:
        raise SnapshotError("duplicate_ids", f"{found['duplicate_ids']} repeated ids")
    if previous_rows and not allow_shrink and found["ratio"] < LEAST_SHARE:
        raise SnapshotError("shrink", f"only {found['row_count']} of {previous_rows} rows are left")
    return found


def signature(rows: DataFrame, key: Column, digest: Column) -> DataFrame:
    """A hash over the sorted key:hash of all parts."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", key.cast("string"), digest)))
    return rows.agg(F.sha2(F.array_join(parts, "|"), 256).alias("signature"))


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per id: added, removed, updated or unchanged, by a hash of all other columns."""
    digest = lambda d: F.xxhash64(*[c for c in d.columns if c != key])
    a = old.select(F.col(key).alias("_a"), digest(old).alias("_ha"))
    b = new.select(F.col(key).alias("_b"), digest(new).alias("_hb"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_ha") == F.col("_hb"), "unchanged").otherwise("updated")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def write_snapshot(rows: DataFrame, folder: str, key: str, version: str, fields: list[dict[str, str]], order: str = "_id", expected: int | None = None) -> dict:
    """Rows in the order of their ids as compact JSON lines of a new version, written by the tasks; the descriptor. An error, such as a failing task or another count than expected, leaves no version behind."""
    spark = rows.sparkSession
    sink.register(spark)
    sorted_ = rows.repartitionByRange(F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{order}`"))
    lines = sorted_.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
    options = {"dataset": key, "version": version, "descriptor": json.dumps({"dataset": key, "fields": fields, "id_field": order}, ensure_ascii=False)} | ({} if expected is None else {"expected": str(expected)})
    if version in sink.names(f"{folder}/{key}"):
        raise SnapshotError("exists", f"{key} has a version {version}")
    lines.write.format("snapshot").options(**options).mode("append").save(folder)
    return sink.read_json(f"{folder}/{key}/{version}", "snapshot.json")


def lines_of(spark: SparkSession, folder: str, versions: dict[str, str]) -> DataFrame:
    """(dataset, value) of every stored line of these versions, by dataset."""
    paths = [f"{folder}/{key}/{version}/part-*.jsonl.gz" for key, version in versions.items()]
    # .../dataset/version/part
    at = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(paths).select(F.url_decode(F.element_at(at, -3)).alias("dataset"), "value")


def verify(spark: SparkSession, folder: str, versions: dict[str, str] | None = None) -> DataFrame:
    """(dataset, version, row_count, expected_rows, status ok, count, checksum or missing) of these versions, or of all current ones, from one pass over their lines."""
    versions = {r["dataset"]: r["version"] for r in manifest(spark, folder).select("dataset", "version").collect()} if versions is None else versions
    metas = [(k, v, m["row_count"], m["content_hash"]) if (m := sink.read_json(f"{folder}/{k}/{v}", "snapshot.json")) else (k, v, None, None) for k, v in versions.items()]
    stated = spark.createDataFrame(metas, "dataset string, version string, expected_rows long, content_hash string")
    held = {k: v for k, v in versions.items() if any(n.startswith("part-") for n in sink.names(f"{folder}/{k}/{v}"))}
    if not held:
        return stated.select("dataset", "version", F.lit(None).cast("long").alias("row_count"), "expected_rows", F.lit("missing").alias("status"))
    sums = lines_of(spark, folder, held).groupBy("dataset").agg(F.count("*").alias("row_count"), *sink.content_sums(F.col("value")))
    half = lambda c: F.lpad(F.lower(F.conv((F.col(c) % F.lit(str(sink.HALF)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")
    digest = F.concat(F.lower(F.conv(F.col("row_count").cast("string"), 10, 16)), F.lit("-"), half("high_sum"), half("low_sum"))
    status = F.when(F.col("row_count").isNull() | F.col("expected_rows").isNull(), "missing").when(F.col("row_count") != F.col("expected_rows"), "count").when(F.col("_digest") != F.col("content_hash"), "checksum").otherwise("ok")
    return stated.join(sums.select("dataset", "row_count", digest.alias("_digest")), "dataset", "left").select("dataset", "version", "row_count", "expected_rows", status.alias("status"))


def publish(folder: str, meta: dict, now: str, fingerprint: str | None = None, keep: int = KEPT_VERSIONS, about: dict[str, str] | None = None) -> dict:
    """Makes the version current, in one rename, and drops old ones. about: what is known of its source (ABOUT)."""
    key = meta["dataset"]
    entry = {k: (about or {}).get(k, "") for k in ABOUT} | {k: meta[k] for k in ("dataset", "version", "content_hash", "row_count", "storage")} | {"retrieved_at": now, "verified_at": now, "fingerprint": fingerprint, "id_field": meta.get("id_field", "_id")}
    sink.write_json(f"{folder}/{key}", CURRENT, entry)
    prune(f"{folder}/{key}", keep, {meta["version"]})
    return entry


def prune(folder: str, keep: int, protect: set[str]) -> list[str]:
    """The newest versions and the protected ones stay; leftovers of broken writes go."""
    every = [n for n in sink.names(folder) if n != CURRENT and not n.endswith(".tmp")]
    versions = sorted((n for n in every if not n.startswith(".tmp-")), reverse=True)
    gone = [n for i, n in enumerate(versions) if i >= keep and n not in protect] + [n for n in every if n.startswith(".tmp-")]
    for n in gone:
        sink.remove(f"{folder}/{n}")
    return gone


def sync(rows: DataFrame, folder: str, key: str, version: str, fields: list[dict[str, str]], now: str, order: str = "_id", expected: int | None = None, fingerprint: str | None = None, recount: Callable[[], int] | None = None, allow_shrink: bool = False, about: dict[str, str] | None = None) -> str:
    """Writes, reads back, validates and publishes a version, or keeps the previous one: updated or unchanged_content. Any fault, such as an export whose total changed while it was read, is an error that leaves the previous version current."""
    spark = rows.sparkSession
    before = sink.read_json(f"{folder}/{key}", CURRENT)
    meta = write_snapshot(rows, folder, key, version, fields, order, expected)
    try:
        if recount is not None and recount() != meta["row_count"]:
            raise SnapshotError("drift", f"the total of {meta['row_count']} changed")
        status = verify(spark, folder, {key: version}).first()["status"]
        if status != "ok":
            raise SnapshotError(status, f"{key} read back differs from what was written")
        validate(rows_of(spark, folder, key, version), order, expected, before and before["row_count"], allow_shrink)
    except BaseException:
        sink.remove(f"{folder}/{key}/{version}")
        raise
    if before and sync_decision(before, fingerprint or "", meta["content_hash"], None) == "unchanged_content":
        sink.remove(f"{folder}/{key}/{version}")
        sink.write_json(f"{folder}/{key}", CURRENT, before | (about or {}) | {"verified_at": now, "fingerprint": fingerprint})
        return "unchanged_content"
    publish(folder, meta, now, fingerprint, about=about)
    return "updated"


def sync_decision(previous: dict | None, fingerprint: str, content: str | None, age_days: float | None) -> str:
    """Unchanged by fingerprint within a week, unchanged by content, or updated."""
    if previous and previous.get("fingerprint") == fingerprint and age_days is not None and age_days < VERIFY_DAYS:
        return "unchanged_fingerprint"
    if previous and content is not None and previous.get("content_hash") == content:
        return "unchanged_content"
    return "updated"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The current versions; none is an empty table."""
    ddl = "dataset string, version string, content_hash string, row_count long, retrieved_at string, verified_at string, fingerprint string, storage string, id_field string, " + ", ".join(f"{k} string" for k in ABOUT)
    found = [f"{folder}/{k}/{CURRENT}" for k in sink.names(folder) if CURRENT in sink.names(f"{folder}/{k}")]
    return spark.read.schema(ddl).json(found, multiLine=True) if found else spark.createDataFrame([], ddl)


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Where the current version of each dataset is from. Its dates are those of retrieval and update, never legal ones."""
    names = {
        "dataset": "dataset", "dataset_title": "dataset_title", "resource_name": "resource_name", "resource_id": "resource_id", "dataset_id": "dataset_id", "publisher": "publisher", "license": "license_title", "source_url": "source_url", "data_api_url": "data_api_url",
        "snapshot_version": "version", "retrieved_at": "retrieved_at", "last_verified_at": "verified_at", "snapshot_content_hash": "content_hash", "resource_last_modified": "resource_last_modified",
    }
    return manifest(spark, folder).select(*[F.coalesce(F.col(v), F.lit("")).alias(k) for k, v in names.items()], F.lit("retrieval and update dates, not legal effective dates").alias("date_note"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The datasets with their fields, which of these hold codes, their rows and provenance; the descriptors of all current versions are read as one table."""
    held = manifest(spark, folder)
    paths = [f"{folder}/{r['dataset']}/{r['version']}/snapshot.json" for r in held.select("dataset", "version").collect()]
    ddl = "dataset string, fields array<struct<id: string, type: string>>"
    described = (spark.read.schema(ddl).json(paths, multiLine=True) if paths else spark.createDataFrame([], ddl)).select(F.col("dataset").alias("_d"), F.transform("fields", lambda x: x["id"]).alias("fields"))
    named = provenance(spark, folder).join(held.select(F.col("dataset").alias("_h"), "row_count", "id_field", "label"), F.col("dataset") == F.col("_h")).join(described, F.col("dataset") == F.col("_d"))
    label = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("dataset")).alias("label")
    return named.select(
        "dataset", label, F.col("dataset_title").alias("title"), "resource_name", "publisher", "row_count", F.col("id_field").alias("record_id_field"), "fields", F.filter("fields", lambda x: x.rlike(CODE_FIELD)).alias("code_fields"),
        "snapshot_version", "retrieved_at", "last_verified_at", "resource_id", "source_url",
    )


def current(folder: str, key: str) -> dict:
    """The current entry, or an error for unknown and never validated datasets."""
    if key not in (known := sink.names(folder)):
        raise SnapshotError("unknown", f"{key}; known: {known}")
    entry = sink.read_json(f"{folder}/{key}", CURRENT)
    if not entry:
        raise SnapshotError("never_validated", key)
    return entry


def rows_of(spark: SparkSession, folder: str, key: str, version: str) -> DataFrame:
    """The rows of a version, typed by its descriptor, with the raw line as body."""
    meta = sink.read_json(f"{folder}/{key}/{version}", "snapshot.json")
    return lines_of(spark, folder, {key: version}).select(F.from_json("value", schema_of(meta["fields"])).alias("r"), F.col("value").alias("body")).select("r.*", "body")


def read_snapshot(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The current rows; count and content are checked first."""
    entry = current(folder, key)
    status = verify(spark, folder, {key: entry["version"]}).first()["status"]
    stated = sink.read_json(f"{folder}/{key}/{entry['version']}", "snapshot.json") or {}
    if status != "ok" or stated.get("content_hash") != entry["content_hash"]:
        raise SnapshotError(status if status != "ok" else "checksum", f"{key} differs from its manifest")
    return rows_of(spark, folder, key, entry["version"])


def build_index(rows: DataFrame, folder: str, rid: str, body: Column, code_fields: dict[str, Column], index_signature: str, records: bool = True) -> dict[str, DataFrame]:
    """Records (if asked for), codes, postings and their sizes as Parquet under the signature; built once, then read. The postings hold the codes as words too."""
    from proofbase.operators import retrieval

    spark = rows.sparkSession
    base = f"{folder}/index-{index_signature[:16]}"
    tables = {"codes": retrieval.code_index(rows, rid, code_fields)} if code_fields else {}
    tables |= {"postings": retrieval.postings(rows, rid, F.concat_ws(" ", body, *code_fields.values()))}
    tables = ({"records": rows} if records else {}) | tables
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_DONE")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        for name, df in tables.items():
            # sorted within files, where the rows are read: statistics of their pages prune lookups by code and token, and nothing is moved
            if order := {"codes": ["hier", "rid"], "postings": ["token", "rid"]}.get(name):
                df = df.sortWithinPartitions(*order)
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        retrieval.posting_sizes(spark.read.parquet(f"{base}/postings")).write.mode("overwrite").parquet(f"{base}/sizes")
        fs.create(fs_path).close()
    return {name: spark.read.parquet(f"{base}/{name}") for name in [*tables, "sizes"]}


def files_signature(rows: DataFrame, *parts: str) -> str:
    """Of the files that rows are read from, by name, length and time, and of what else decides an index."""
    spark = rows.sparkSession
    seen = []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("|".join([*seen, *parts]).encode()).hexdigest()
