"""Fetching outside a plan: URL safety, retries, throttling, byte caps, an in-memory call log."""

from __future__ import annotations

import hashlib
import ipaddress
import os
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRIED = {429, 500, 502, 503, 504}
# Top-level names that no public host has.
INNER = frozenset("local localhost internal intranet lan home corp private arpa".split())
MOST_BYTES, MOST_REDIRECTS, ATTEMPTS = 40 << 20, 5, 4


class FetchError(RuntimeError):
    pass


def is_safe(url: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """http(s) to a public address. Names are resolved if a resolver is given; else names that are only known inside a network are refused, and the others left to the fetch, which resolves."""
    parts = urlsplit(url or "")
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False
    host = parts.hostname
    try:
        literal = host.replace(".", "").isdigit() or ":" in host
        if not literal and resolve is None and ("." not in host or host.rsplit(".", 1)[-1] in INNER):
            return False
        found = [host] if host.replace(".", "").isdigit() or ":" in host else (resolve(host) if resolve else [])
        return all(ipaddress.ip_address(x).is_global for x in found) and host != "localhost"
    except (ValueError, OSError):
        return False


@F.arrow_udf(T.BooleanType())
def safe_url(urls: pa.Array) -> pa.Array:
    return pa.array([is_safe(x) for x in urls.to_pylist()], pa.bool_())


def resolved(host: str) -> list[str]:
    return [x[4][0] for x in socket.getaddrinfo(host, None)]


def delay(attempt: int, asked: str | None, base: float = 1.0, cap: float = 60.0) -> float:
    """doubling, or what the server asks, at most cap."""
    try:
        wanted = float(asked) if asked else 0.0
    except ValueError:
        wanted = 0.0
    return min(max(base * 2**attempt, wanted), cap)


@dataclass
class Response:
    url: str
    status: int
    content_type: str
    data: bytes


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def open_once(url: str, most: int = MOST_BYTES) -> Response:
    """One request without redirects, at most `most` bytes."""
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(url, timeout=30) as r:
            data = r.read(most + 1)
            if len(data) > most:
                raise FetchError(f"more than {most} bytes")
            declared = r.headers.get("Content-Length")
            if declared and int(declared) != len(data):
                raise FetchError(f"{len(data)} of {declared} bytes")
            return Response(url, r.status, r.headers.get("Content-Type", ""), data)
    except urllib.error.HTTPError as e:
        return Response(e.headers.get("Location") or url, e.code, e.headers.get("Retry-After") or "", b"")


@dataclass
class Fetcher:
    """Safe fetching with retries, redirects checked hop by hop, spacing, a call cap, and a cache and log by URL."""

    open: Callable[[str], Response] = open_once
    resolve: Callable[[str], list[str]] | None = resolved
    sleep: Callable[[float], None] = time.sleep
    spacing: float = 1.0
    most_calls: int = 100
    log: list[dict] = field(default_factory=list)
    cache: dict[str, Response] = field(default_factory=dict)
    _last: float = 0.0

    def get(self, url: str) -> Response:
        if url in self.cache:
            self.log.append({"url": url, "outcome": "cached", "attempts": 0})
            return self.cache[url]
        if sum(x["outcome"] != "cached" for x in self.log) >= self.most_calls:
            raise FetchError(f"the limit of {self.most_calls} calls is reached")
        at, hops, attempt = url, 0, 0
        while True:
            if not is_safe(at, self.resolve):
                self.log.append({"url": url, "outcome": "failed", "attempts": attempt})
                raise FetchError(f"unsafe address {at}")
            self.sleep(max(0.0, self._last + self.spacing - time.monotonic()))
            self._last = time.monotonic()
            got = self.open(at)
            if 300 <= got.status < 400 and hops < MOST_REDIRECTS:
                at, hops = urljoin(at, got.url), hops + 1
            elif got.status in RETRIED and attempt < ATTEMPTS - 1:
                self.sleep(delay(attempt, got.content_type))
                attempt += 1
            elif got.status == 200:
                self.cache[url] = got
                self.log.append({"url": url, "outcome": "sent", "attempts": attempt + 1})
                return got
            else:
                self.log.append({"url": url, "outcome": "failed", "attempts": attempt + 1})
                raise FetchError(f"status {got.status}")

    def log_frame(self, spark: SparkSession) -> DataFrame:
        """The calls as rows."""
        return spark.createDataFrame([(x["url"], x["outcome"], x["attempts"]) for x in self.log], "url string, outcome string, attempts int")


def verified_asset(path: str, sha256: str, download: Callable[[], bytes]) -> str:
    """A cached file of this hash; fetched again if it is absent or differs, and put in place at once."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() == sha256:
                return path
    data = download()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise FetchError(f"{path}: the hash differs from {sha256}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
    os.replace(f"{path}.tmp", path)
    return path


def search_results(spark: SparkSession, found: list[dict]) -> DataFrame:
    """Web search results as rows, with the official flag."""
    from proofbase.functions.web import is_official

    rows = [(x.get("title"), x.get("link") or x.get("url"), x.get("snippet")) for x in found]
    return spark.createDataFrame(rows, "title string, url string, snippet string").withColumn("primary_source", is_official(F.col("url")))
