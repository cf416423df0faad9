"""The open-data catalogue as a Python data source, and live reads gated by metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from proofbase.sources.fetch import Fetcher

PAGE_ROWS, MOST_LIMIT = 5000, 100
TYPES = {"int": "bigint", "numeric": "decimal(38,0)", "text": "string", "timestamp": "string"}


class CatalogueError(RuntimeError):
    pass


_client: list[Fetcher] = []


def client() -> Fetcher:
    """The fetcher of this process: safe addresses only, spacing, retries, a cap on calls, a cache and log by URL."""
    if not _client:
        _client.append(Fetcher())
    return _client[0]


def fetch(base: str, action: str, params: dict, by: Fetcher | None = None) -> dict:
    """One call with its envelope checked, by the process's fetcher or another. base is an http(s) API root, or a folder of recorded answers."""
    if base.startswith("http"):
        doc = json.loads((by or client()).get(f"{base.rstrip('/')}/{action}?{urlencode(params)}").data)
    else:
        doc = recorded(base, action, params)
    if not isinstance(doc, dict) or not doc.get("success") or "result" not in doc:
        raise CatalogueError(f"{action}: no successful result")
    return doc["result"]


def recorded(base: str, action: str, params: dict) -> dict:
    """The API over a folder: packages.json and <resource>.json with fields and records."""
    if action == "datastore_search":
        with open(f"{base}/{params['resource_id']}.json", encoding="utf-8") as f:
            table = json.load(f)
        rows = table["records"]
        for k, v in json.loads(params.get("filters") or "{}").items():
            rows = [r for r in rows if str(r.get(k)) == str(v)]
        if q := str(params.get("q") or "").lower():
            rows = [r for r in rows if any(q in str(v).lower() for v in r.values())]
        offset, limit = int(params.get("offset", 0)), int(params.get("limit", 20))
        return {"success": True, "result": {"fields": table["fields"], "records": rows[offset : offset + limit], "total": len(rows), "total_was_estimated": table.get("estimated", False)}}
    with open(f"{base}/packages.json", encoding="utf-8") as f:
        packages = json.load(f)
    if action == "package_search":
        q = str(params.get("q") or "").lower()
        found = [p for p in packages if q in json.dumps(p, ensure_ascii=False).lower()]
        start = int(params.get("start", 0))
        return {"success": True, "result": {"count": len(found), "results": found[start : start + int(params.get("rows", 10))]}}
    if action == "package_show":
        return {"success": True, "result": next((p for p in packages if params["id"] in (p["id"], p["name"])), None) or {}}
    found = [r | {"package_id": p["id"]} for p in packages for r in p["resources"] if r["id"] == params["id"]]
    return {"success": bool(found), "result": found[0] if found else None}


def probe(base: str, resource: str) -> tuple[int, list[dict]]:
    """The total and the fields; an estimated total is no total."""
    found = fetch(base, "datastore_search", {"resource_id": resource, "limit": 0})
    if found.get("total_was_estimated"):
        raise CatalogueError("the total is estimated")
    return int(found["total"]), found["fields"]


class _Pages(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.filters = options, schema, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            # equality goes to the API; it compares text, so Spark checks again
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.filters[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        """One partition per page."""
        base, resource = self.options["path"], self.options["resource"]
        params = {"resource_id": resource, "limit": 0, "q": self.options.get("q", ""), "filters": json.dumps({k: str(v) for k, v in self.filters.items()})}
        total = int(fetch(base, "datastore_search", params)["total"])
        size = int(self.options.get("page_rows", PAGE_ROWS))
        return [InputPartition((offset, size, params)) for offset in range(0, max(total, 1), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset, size, params = partition.value
        found = fetch(self.options["path"], "datastore_search", params | {"offset": offset, "limit": size})
        kinds = {f.name: f.dataType.typeName() for f in self.schema}
        for r in found["records"]:
            yield tuple(_cell(r.get(n), kinds[n]) for n in self.schema.names)


class _PageStream(DataSourceStreamReader):
    """The table's rows in the order of their ids, as a stream whose offset is the number of rows read.

    A batch is the rows that came since the last one, a partition a page of it. Rows that are gone,
    a page that is short or ids that do not grow are a drift of the export and fail the batch, so
    nothing of it is committed.
    """

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def _call(self, **params: object) -> dict:
        return fetch(self.options["path"], "datastore_search", {"resource_id": self.options["resource"], "sort": self.options.get("key", "_id"), **params})

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"row": int(self._call(limit=0)["total"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["row"] < start["row"]:
            raise CatalogueError(f"drift: {end['row']} rows of {start['row']} are left")
        size = int(self.options.get("page_rows", PAGE_ROWS))
        return [InputPartition((at, min(size, end["row"] - at))) for at in range(start["row"], end["row"], size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, n = partition.value
        key = self.options.get("key", "_id")
        # the row before the page shows whether the order goes on across pages
        found = self._call(offset=max(0, at - 1), limit=n + (at > 0))["records"]
        ids = [r[key] for r in found]
        if len(found) != n + (at > 0) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise CatalogueError(f"drift: the rows from {at} on changed while they were read")
        kinds = {f.name: f.dataType.typeName() for f in self.schema}
        for r in found[at > 0 :]:
            yield tuple(_cell(r.get(name), kinds[name]) for name in self.schema.names)

    def commit(self, end: dict) -> None:
        pass


def _cell(value: object, kind: str) -> object:
    from decimal import Decimal

    if value is None:
        return None
    return int(value) if kind == "long" else Decimal(str(value)) if kind == "decimal" else str(value)


class CatalogueTable(DataSource):
    """spark.read.format("catalogue").option("resource", id).load(api_root): the rows of a catalogue table."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        _, fields = probe(self.options["path"], self.options["resource"])
        return ", ".join(f"`{f['id']}` {TYPES.get(f['type'], 'string')}" for f in fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _PageStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueTable)


def packages(spark: SparkSession, base: str, query: str, rows: int = 10, start: int = 0) -> DataFrame:
    """Found datasets with their resources, one row per resource."""
    found = fetch(base, "package_search", {"q": query, "rows": min(rows, 20), "start": start})["results"]
    flat = [(p["id"], p.get("title"), p.get("notes"), r["id"], r.get("name"), r.get("format"), str(r.get("datastore_active")), r.get("url")) for p in found for r in (p.get("resources") or [])[:30]]
    return spark.createDataFrame(flat, "dataset_id string, title string, notes string, resource_id string, name string, format string, datastore_active string, url string")


def resource(base: str, resource_id: str) -> dict:
    """S07."""
    return fetch(base, "resource_show", {"id": resource_id})


def search_table(spark: SparkSession, base: str, resource_id: str, q: str = "", filters: dict | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a table query, cut by the API, with the total of matching rows in _total."""
    params = {"resource_id": resource_id, "q": q, "filters": json.dumps({k: str(v) for k, v in (filters or {}).items()}), "limit": max(1, min(limit, MOST_LIMIT)), "offset": max(0, offset)}
    found = fetch(base, "datastore_search", params)
    ddl = ", ".join(f"`{f['id']}` {TYPES.get(f['type'], 'string')}" for f in found["fields"])
    kinds = {f["id"]: {"int": "long", "numeric": "decimal"}.get(f["type"], "string") for f in found["fields"]}
    rows = [tuple(_cell(r.get(n), k) for n, k in kinds.items()) for r in found["records"]]
    return spark.createDataFrame(rows, ddl).withColumn("_total", F.lit(int(found["total"])).cast("long"))


def read_resource(spark: SparkSession, base: str, resource_id: str, query: str, limit: int = 20, read_file: Callable[[dict], DataFrame] | None = None) -> tuple[str, DataFrame | None]:
    """Metadata gate, then a table query or a file scan; ok, no_matching_records (with a sample), rejected or failed."""
    from proofbase.functions import text as tx
    from proofbase.operators import records

    try:
        meta = resource(base, resource_id)
        package = fetch(base, "package_show", {"id": meta["package_id"]})
    except (CatalogueError, OSError):
        return "failed", None
    text = " ".join(str(x or "") for x in (package.get("title"), package.get("notes"), meta.get("name"), meta.get("description")))
    norm, vocabulary = tx.normalized(F.lit(query)), F.array_distinct(tx.tokens(tx.normalized(F.lit(text))))
    terms = tx.extract_terms(norm)
    # the gate is decided before any content is read
    if not spark.range(1).select(records.metadata_relevant(tx.matched_terms(terms, vocabulary), terms)).first()[0]:
        return "rejected", None
    if str(meta.get("datastore_active")).lower() in ("true", "1", "yes"):
        register(spark)
        rows = spark.read.format("catalogue").option("resource", resource_id).load(base)
    elif read_file:
        rows = read_file(meta)
    else:
        return "failed", None
    words = F.array_distinct(tx.tokens(tx.normalized(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]))))
    scored = rows.withColumn("score", F.size(tx.matched_terms(terms, words))).where("score > 0")
    if scored.isEmpty():
        return "no_matching_records", rows.orderBy(rows.columns[0]).limit(5)
    return "ok", scored.orderBy(F.desc("score"), rows.columns[0]).limit(min(limit, 50))
