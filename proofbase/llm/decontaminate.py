"""Benchmark decontamination with suffix arrays of the training texts.

Each stretch of documents is a shard. Its suffix array holds the word positions from which a
benchmark match can begin: a suffix whose first `lead` words (the length of the shortest
window) are not in the benchmark's vocabulary shares no window with it, so it is left out.
The suffixes of the benchmark are binary-searched in it, those with the same window once: all
suffixes of the shard that share a whole window. Matches that continue each other, word by word
in document and item, are one: the longest of an item in a document is its longest verbatim
match, given with its places. A match shorter than a window is no match.

The benchmark is read in blocks of at most BLOCK_BYTES, each sent to the executors and, if there
are several, given up before the next one is read; their hits are merged per document. One
block needs no merge and no shuffle.

Defined cases: null or empty texts have no words and are never hit; null or empty items have
no windows; items with equal texts are all reported, and an item_id in several rows is one item;
an item without item_id is searched but can't be named, so it counts in n_hit and contaminated
only; ids may have any type and are reported as strings; repeated documents are judged row by
row (with several blocks they are told apart by a row number made before the blocks); an empty
benchmark hits nothing; clashing column names do not matter, as only doc_id and text are read, and
the pipeline's stage keeps all columns as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

WINDOW = 10
#: Benchmark text sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: Suffixes of a shard.
SHARD = 1 << 18


class Suffixes:
    """One block of benchmark items as word numbers, end to end. Items with the same words are one, with several ids."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([x or "" for _, x in items], pa.large_string())})
        codes, rows, done = [], [], 0
        for t in c.texts(iter([batch])):
            w = c.words(t, c.ALNUM_WORDS, lower=True)
            codes.append(w.code)
            rows.append(w.row + done)
            done += len(t)
        code = np.concatenate(codes) if codes else np.zeros(0, c.U64)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.vocabulary, number = np.unique(code, return_inverse=True)
        number = number.astype(np.int32) + 1
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(items))))) if len(items) else np.zeros(1, np.int64)
        seen: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        chosen = []
        for i, (name, _) in enumerate(items):
            words = number[first[i] : first[i + 1]]
            if len(words):
                k = seen.setdefault(words.tobytes(), len(seen))
                if k == len(self.ids):
                    self.ids.append([])
                    chosen.append(i)
                if name is not None and str(name) not in self.ids[k]:
                    self.ids[k].append(str(name))
        n = np.array([first[i + 1] - first[i] for i in chosen], np.int64)
        self.first = np.cumsum(n) - n  # of each distinct item
        number = np.concatenate([number[first[i] : first[i + 1]] for i in chosen]) if chosen else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(n)), n)
        length = np.minimum(n, window)
        # a window starts at each position from which `length` words of its item remain
        place = np.arange(len(number))
        fits = place + length[owner] <= (self.first + n)[owner] if len(number) else np.zeros(0, bool)
        start, self.owner = place[fits], owner
        size = length[owner[fits]] if len(number) else np.zeros(0, np.int64)
        self.lead, self.depth = (int(size.min()), int(size.max())) if len(size) else (0, 0)
        padded = np.concatenate((number, np.zeros(self.depth, np.int32)))
        #: for each length of windows: the distinct ones in order, and the places of each
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.unique(size).tolist():
            at = start[size == k]
            keys, which = np.unique(sortable(padded, at, k), return_inverse=True)
            order = np.argsort(which, kind="stable")
            self.windows.append((k, keys, np.searchsorted(which[order], np.arange(len(keys) + 1)), at[order]))


def sortable(number: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`depth` word numbers from each place, as byte strings in the order of the words."""
    out = np.empty((len(at), depth), ">i4")
    for k in range(depth):
        out[:, k] = number[at + k]
    return out.view(f"S{4 * depth}").ravel()


def matches(shard: np.ndarray, inside: np.ndarray, b: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (shard position, benchmark position, length) where a window of the block occurs.

    shard: word numbers, 0 for words that no item has. inside: words left in the document.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if b.windows and len(shard):
        # positions followed by `lead` known words
        unknown = np.concatenate(([0], np.cumsum(shard == 0)))
        end = np.minimum(np.arange(len(shard)) + b.lead, len(shard))
        begin = np.flatnonzero((unknown[end] == unknown[:-1]) & (inside >= b.lead))
        padded = np.concatenate((shard, np.zeros(b.depth, shard.dtype)))
        for i in range(0, len(begin), SHARD):
            at = begin[i : i + SHARD]
            # the suffix array: positions in the order of their words, to the depth of the longest window
            keys = sortable(padded, at, b.depth)
            order = np.argsort(keys, kind="stable")
            suffix, keys = at[order], keys[order]
            for size, windows, cut, places in b.windows:
                prefix = keys if size == b.depth else np.ascontiguousarray(keys.view("S1").reshape(len(keys), -1)[:, : 4 * size]).view(f"S{4 * size}").ravel()
                low, high = np.searchsorted(prefix, windows, "left"), np.searchsorted(prefix, windows, "right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                where = np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                which, pos = np.repeat(hit, n), suffix[where]
                ok = inside[pos] >= size
                which, pos = which[ok], pos[ok]
                m = cut[which + 1] - cut[which]
                spot = np.repeat(cut[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                found.append((np.repeat(pos, m), places[spot], np.full(int(m.sum()), size)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def longest(row: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, at, place, words) of the longest verbatim match of each item in each row, the first of equal ones."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    item = owner[place]
    order = np.lexsort((at, at - place, item, row))
    row, at, place, size, item = row[order], at[order], place[order], size[order], item[order]
    # windows that follow each other in both texts are one match
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    words = at[np.append(head[1:], len(at)) - 1] - at[head] + size[head]
    best = np.lexsort((at[head], -words, item[head], row[head]))
    one = best[np.append(True, (item[head][best][1:] != item[head][best][:-1]) | (row[head][best][1:] != row[head][best][:-1]))]
    i = head[one]
    return row[i], item[i], at[i], place[i], words[one]


RAW = ("n_words long", "spans array<long>", "items array<string>", "longest array<struct<item_id:string,word:long,item_word:long,words:long>>")
_LONGEST = pa.list_(pa.struct([("item_id", pa.string()), ("word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def hits(docs: DataFrame, items: object, window: int = WINDOW) -> DataFrame:
    """docs with n_words, the hit word spans (start * 2**32 + end), the ids of the occurring items and each one's longest match; items: a broadcast block."""
    known: list[Suffixes] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known:
            known.append(Suffixes(items.value, window))
        b = known[0]
        for t in c.texts(batches):
            w = c.words(t, c.ALNUM_WORDS, lower=True)
            number = np.zeros(len(w.code), np.int32)
            if len(b.vocabulary) and len(w.code):
                spot = np.minimum(np.searchsorted(b.vocabulary, w.code), len(b.vocabulary) - 1)
                number = np.where(b.vocabulary[spot] == w.code, spot + 1, 0).astype(np.int32)
            inside = w.first[w.row + 1] - np.arange(len(w.row))
            at, place, size = matches(number, inside, b)
            spans: list[list[int]] = [[] for _ in range(len(t))]
            ids: list[list[str]] = [[] for _ in range(len(t))]
            best: list[list[dict]] = [[] for _ in range(len(t))]
            order = np.lexsort((at, w.row[at]))
            first, row = at[order], w.row[at[order]]
            end = first + size[order]
            cut = np.searchsorted(row, np.arange(len(t) + 1))
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                x, y = cut[i], cut[i + 1]
                spans[i] = _merged(first[x:y] - w.first[i], end[x:y] - w.first[i])
            for i, item, a, p, n in zip(*(x.tolist() for x in longest(w.row[at], at, place, size, b.owner)), strict=True):
                for name in b.ids[item]:
                    best[i].append({"item_id": name, "word": a - int(w.first[i]), "item_word": p - int(b.first[item]), "words": n})
            for i, found in enumerate(best):
                ids[i] = sorted({x["item_id"] for x in found}) if found else []
            cols = (pa.array(np.diff(w.first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string())), pa.array(best, _LONGEST))
            yield c.with_columns(t, {r.split(" ")[0]: x for r, x in zip(RAW, cols, strict=True)})

    return docs.mapInArrow(run, c.extended(docs.schema, ", ".join(RAW)))


def _merged(start: np.ndarray, end: np.ndarray) -> list[int]:
    """The union of word spans sorted by start, each as start * 2**32 + end."""
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return ((start[first].astype(np.int64) << 32) | reach[last]).tolist()


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many blocks of at most `most` bytes of text (or one item) the items make, and the blocks, read one at a time."""
    sized = benchmark.select("item_id", "text", F.octet_length("text").alias("_n")).where(F.col("_n") > 0)
    total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // most) * 2 if total > most else 1)

    def read() -> Iterator[list[tuple[object, str]]]:
        for k in range(n):
            part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
            yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()]

    return n, read()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (hit word ranges), items (sorted ids of occurring items), longest (their longest matches)."""
    context = docs.sparkSession.sparkContext
    n, parts = blocks(benchmark, block_bytes)
    if n == 1:
        return hits(docs.select("doc_id", "text"), context.broadcast(next(parts)), window).drop("text")
    numbered = c.stored(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text"))
    found = []
    for k, part in enumerate(parts):
        sent = context.broadcast(part)
        some = hits(numbered, sent, window).drop("text")
        found.append(c.stored(some if k == 0 else some.where(F.size("spans") > 0)))  # the first block has all rows
        sent.destroy()
    start = lambda x: F.shiftright(x, 32)
    end = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    joined = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (start(x) <= end(F.element_at(acc, -1))),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.shiftleft(start(F.element_at(acc, -1)), 32).bitwiseOR(F.greatest(end(x), end(F.element_at(acc, -1)))))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return reduce(DataFrame.unionByName, found).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), joined.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("longest")).alias("longest"),
    ).drop("_row")


def digest(found: DataFrame) -> DataFrame:
    spanned = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit((1 << 32) - 1)) - F.shiftright(x, 32))
    return found.select(
        "doc_id", "n_words", spanned.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("longest", lambda x: x["words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    return digest(decontaminate(docs, benchmark))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT k, item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
win AS (SELECT k, item_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM s)),
here AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s))),
m AS (SELECT r, i, k, item_id, j, win.n FROM here JOIN win ON here.g = win.g AND here.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY 1),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY 1),
run AS (SELECT r, k, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, k, i - j ORDER BY i) AS island FROM m WHERE item_id IS NOT NULL),
long AS (SELECT r, max(c) AS longest FROM (SELECT r, count(*) + any_value(n) - 1 AS c FROM run GROUP BY r, k, diagonal, island) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN long USING (r)
"""


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, with all their columns. Each block of the benchmark filters what the one before it left."""
    docs, own = c.hidden(docs, ("text",))
    names = docs.columns
    n, parts = blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_bytes)
    for k, part in enumerate(parts):
        sent = spark.sparkContext.broadcast(part)
        docs = hits(docs, sent).where(F.size("spans") == 0).select(*names)
        if k + 1 < n:  # the block is given up before the next one is read
            docs = c.stored(docs)
            sent.destroy()
    return docs.select(*own)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract, word by word, for tests."""
    import re

    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    wins: dict[tuple, set] = {}
    for i, x in items:
        w = split(x)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [i])
    out = []
    for d, x in docs:
        w, hit, ids = split(x), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= got
        joined = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out
