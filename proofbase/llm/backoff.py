"""Stupid-backoff scores: count tables partitioned by n-gram hash, joined to the documents' n-grams, summed per document.

The relations are kept packed. Documents are dealt to blocks of bounded size by content; a block's
distinct n-grams with their occurrences go, as sorted hashes, to the n-gram's hash range, where the
blocks' rows are merged into the count table and each block's rows are joined with it. The counts
travel back in the rows' order, so only one hash per distinct n-gram of a block is ever sent, and
an n-gram however frequent is one entry per block. A range that a block has nothing in gets no
row, so there are never more rows than n-grams; blocks and ranges have sizes of their own and are
dealt evenly to the tasks (see packed), so a task holds one block or range at a time.

The longest n-grams go in a second round, and only those whose two parts are found elsewhere: an
n-gram that another document has has parts that another document has, and whoever has it sends
it, so the counts that anyone asks for are whole.

A document is scored by what the others say: its own occurrences are subtracted from the counts
(leave one out). For each word the longest n-gram that ends in it and is found elsewhere gives
count / count of its context, times BACKOFF for each word of context given up; a word found
nowhere else gives 1 / (tokens elsewhere + 1).

Defined cases: a null or empty text has no words and scores null; repeated rows and rows with
equal doc_id, null ones too, are documents of their own, so each is evidence for the other; an
empty table gives no rows; doc_id may have any type that can be sorted; only doc_id and text are
read, so clashing extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofbase.llm import common as c
from proofbase.llm import packed as pk

ORDER, BACKOFF = 3, 0.4
#: Words of a block whose n-grams are combined at once.
BLOCK_WORDS = 3 << 19
#: N-grams of a hash range at most, as all of them were distinct.
RANGE_GRAMS = 1 << 23


class Block:
    """The documents of one block and their n-grams."""

    def __init__(self, blobs: pa.ChunkedArray, kind: pa.DataType):
        self.rows = pk.rows_of(blobs, kind)
        codes, owner, done = [], [], 0
        for t in c.texts(iter(self.rows.combine_chunks().to_batches())):
            w = c.words(t, c.SPACE_WORDS, lower=True)
            codes.append(w.code)
            owner.append(w.row + done)
            done += len(t)
        self.code = np.concatenate(codes) if codes else np.zeros(0, c.U64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, hash) of each n-gram within one document."""
        if len(self.code) < n:
            return np.zeros(0, np.int64), np.zeros(0, c.U64)
        ok = np.flatnonzero(self.owner[: len(self.owner) - n + 1] == self.owner[n - 1 :])
        return ok + n - 1, c.grams(self.code, n)[ok]

    def elsewhere(self, n: int, table: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
        """For each word, how often other documents have the n-gram that ends in it; use: which n-grams were asked for. table: corpus counts of the distinct ones in hash order."""
        at, code = self.grams(n)
        if use is not None:
            at, code = at[use[at]], code[use[at]]
        found = np.zeros(len(self.code))
        if len(at):
            _, where = np.unique(code, return_inverse=True)
            # occurrences in the document itself: of the pair (document, n-gram)
            pair = self.owner[at] * np.int64(len(table) + 1) + where
            _, own, many = np.unique(pair, return_inverse=True, return_counts=True)
            found[at] = table[where] - many[own]
        return found


SENT = "range int, block int, sizes array<long>, keys array<binary>, counts array<binary>"
ANSWERED = "block int, range int, round int, sizes array<long>, counts array<binary>"
_LONGS, _BLOBS = pa.list_(pa.int64()), pa.list_(pa.binary())


def _sent(block: int, grams: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """Per hash range that the block has n-grams in: its distinct n-grams of each order. grams: the hashes, by order."""
    found = [np.unique(x, return_counts=True) for x in grams]
    cuts = np.stack([pk.cuts(code, ranges) for code, _ in found])
    ids = np.flatnonzero((cuts[:, 1:] > cuts[:, :-1]).any(axis=0))
    sizes, keys, counts = [], [], []
    for k in ids.tolist():
        spans = [(int(x[k]), int(x[k + 1])) for x in cuts]
        sizes.append([b - a for a, b in spans])
        keys.append([pk.steps(code[a:b]) for (code, _), (a, b) in zip(found, spans, strict=True)])
        counts.append([pk.squeezed(many[a:b].astype(np.uint32)) for (_, many), (a, b) in zip(found, spans, strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.full(len(ids), block), pa.int32()), pa.array(sizes, _LONGS), pa.array(keys, _BLOBS), pa.array(counts, _BLOBS)], names=["range", "block", "sizes", "keys", "counts"])


def _counted(batches: Iterator[pa.RecordBatch], round_: int) -> Iterator[pa.RecordBatch]:
    """For each range: the blocks' counts summed, and sent back in each block's order."""
    for where, rows in pk.grouped(batches):
        blocks, sizes = rows.column("block"), rows.column("sizes").to_pylist()
        keys, counts = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
        out: list[list[bytes]] = [[] for _ in sizes]
        for n in range(len(sizes[0])):
            code = [pk.from_steps(k[n], m[n]) for k, m in zip(keys, sizes, strict=True)]
            many = np.concatenate([pk.restored(k[n], m[n], np.uint32) for k, m in zip(counts, sizes, strict=True)])
            _, spot = np.unique(np.concatenate(code), return_inverse=True)
            total = np.bincount(spot, many)[spot].astype(np.uint64) if len(many) else many.astype(np.uint64)
            cut = np.cumsum([0, *map(len, code)])
            for i in range(len(out)):
                out[i].append(pk.squeezed(total[cut[i] : cut[i + 1]]))
        n = len(out)
        yield pa.RecordBatch.from_arrays([blocks.combine_chunks(), pa.array(np.full(n, where), pa.int32()), pa.array(np.full(n, round_), pa.int32()), pa.array(sizes, _LONGS), pa.array(out, _BLOBS)], names=["block", "range", "round", "sizes", "counts"])


def _tables(answers: pa.Table, round_: int, orders: int) -> list[np.ndarray]:
    """Corpus counts of a block's distinct n-grams in hash order, by order, from the rows of all ranges."""
    answers = answers.filter(pc.field("round") == round_).sort_by("range")
    sizes, counts = answers.column("sizes").to_pylist(), answers.column("counts").to_pylist()
    parts = [[pk.restored(x[n], m[n], np.uint64) for x, m in zip(counts, sizes, strict=True)] for n in range(orders)]
    return [np.concatenate(x).astype(np.float64) if x else np.zeros(0) for x in parts]


def _asked(b: Block, low: list[np.ndarray]) -> np.ndarray:
    """The words that end an n-gram of the last order whose both parts are found elsewhere."""
    whole = np.zeros(len(b.code), bool)
    whole[b.grams(ORDER)[0]] = True
    part = low[-1] > 0
    return whole & part & np.concatenate(([False], part[:-1]))[: len(part)]


def _second(docs: pa.Table, answers: pa.Table, kind: pa.DataType, ranges: int) -> pa.Table:
    """A block and the counts of its shorter n-grams -> its rows of the second round."""
    b = Block(docs.column("docs"), kind)
    low = [b.elsewhere(n + 1, x) for n, x in enumerate(_tables(answers, 1, ORDER - 1))]
    at, code = b.grams(ORDER)
    return pa.Table.from_batches([_sent(docs.column("block")[0].as_py(), [code[_asked(b, low)[at]]], ranges)])


def _scored(docs: pa.Table, answers: pa.Table, kind: pa.DataType, tokens: int) -> pa.Table:
    """A block and all its counts -> its documents' scores."""
    b = Block(docs.column("docs"), kind)
    found = [b.elsewhere(n + 1, x) for n, x in enumerate(_tables(answers, 1, ORDER - 1))]
    found.append(b.elsewhere(ORDER, _tables(answers, 2, 1)[0], _asked(b, found)))
    docs_n, words = len(b.rows), len(b.code)
    n_words = np.bincount(b.owner, minlength=docs_n)
    elsewhere = tokens - n_words[b.owner]
    best = np.where(found[0] > 0, np.log(np.maximum(found[0], 1)) - np.log(np.maximum(elsewhere, 1)), -np.log(elsewhere + 1))
    for n in range(2, ORDER + 1):
        at, _ = b.grams(n)
        best[at] += np.log(BACKOFF)  # a word whose context is shorter gives up nothing
        hit = at[(found[n - 1][at] > 0) & (found[n - 2][at - 1] > 0)]
        best[hit] = np.log(found[n - 1][hit]) - np.log(found[n - 2][hit - 1])
    total = np.bincount(b.owner, best, minlength=docs_n) if words else np.zeros(docs_n)
    none = n_words == 0
    return pa.table({
        "doc_id": b.rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
        "log_score": pa.array(total / np.maximum(n_words, 1), mask=none), "log_total": pa.array(total, mask=none),
    })


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in c.texts(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(c.words(t, c.SPACE_WORDS, lower=True).code)], pa.int64())})


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, log_total (natural log, summed over the words) and log_score (per word)."""
    parts = c.shuffle_partitions(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    kind = to_arrow_type(id_type)
    tokens = docs.select("text").mapInArrow(_word_counts, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks, ranges = pk.number(tokens, BLOCK_WORDS, parts), pk.number(tokens * (ORDER - 1), RANGE_GRAMS, parts)
    dealt = pk.dealt(docs, blocks, parts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in pk.grouped(batches):
            b = Block(rows.column("docs"), kind)
            yield _sent(k, [b.grams(n)[1] for n in range(1, ORDER)], ranges)

    def answered(sent: DataFrame, round_: int) -> DataFrame:
        met = sent.repartitionById(parts, "range").sortWithinPartitions("range")
        return met.mapInArrow(lambda it: _counted(it, round_), ANSWERED).repartitionById(parts, "block")

    one = answered(dealt.sortWithinPartitions("block").mapInArrow(first, SENT), 1)
    # the block's texts are where they were dealt for counting: that exchange serves three times
    both = dealt.groupBy("block").cogroup(one.groupBy("block"))
    two = answered(both.applyInArrow(lambda x, y: _second(x, y, kind, ranges), SENT), 2)
    all_ = dealt.groupBy("block").cogroup(one.unionByName(two).repartitionById(parts, "block").groupBy("block"))
    return all_.applyInArrow(lambda x, y: _scored(x, y, kind, tokens), f"doc_id {id_type.simpleString()}, n_words long, log_score double, log_total double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("log_total", 4).alias("log_total"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS w2, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS w3, len(w) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
s AS (SELECT *, count(*) OVER () AS total,
      count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY doc_id, w1) AS c1,
      CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY doc_id, w2) END AS c2,
      CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) END AS c3 FROM t),
p AS (SELECT *, lag(c1) OVER o AS h1, lag(c2) OVER o AS h2 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, n,
      CASE WHEN i > 2 AND c3 > 0 AND h2 > 0 THEN ln(c3) - ln(h2)
           WHEN i > 1 AND c2 > 0 AND h1 > 0 THEN ln(c2) - ln(h1) + (i > 2)::INT * ln(0.4)
           WHEN c1 > 0 THEN ln(c1) - ln(total - n) + least(i - 1, 2) * ln(0.4)
           ELSE least(i - 1, 2) * ln(0.4) - ln(total - n + 1) END AS x FROM p)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(g.x / len(d.w), 6) AS log_score, round(g.x, 4) AS log_total
FROM d LEFT JOIN (SELECT doc_id, sum(x) AS x FROM q GROUP BY doc_id) g USING (doc_id)
"""
