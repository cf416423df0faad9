"""Toxicity from two Kneser-Ney models, one of toxic and one of ordinary texts.

Levels: word pairs and words (both counted by their distinct predecessors, as copies of a text
would else count as evidence), word beginnings (counted by
distinct words), each per class and each discounted into the next; the last level is shared by
both classes, so a rare expression costs both alike. A text's measures are its
length-normalised log-likelihood ratio and the same ratio over its most toxic passages of a few
words; a logistic curve, fitted on sampled texts that the models have not seen, makes the score.

Fitting uses a bounded sample: at most SAMPLE_ROWS labelled documents a class, as many of each,
in hash order, until SAMPLE_BYTES a class. Scoring reads every whole text.

Defined cases: a null or empty text has no evidence and scores by the curve at zero; documents
without label are scored, not learnt from; a document labelled twice counts as toxic if any row
says so; an id with several texts is learnt from by one of them; null labels are ignored; if either class has no labelled text every score is the share
of toxic labels; repeated rows are scored row by row; clashing columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16 << 20
#: Of the sample, one in CURVE_PART fits the curve and the others the models.
CURVE_PART = 3
STEM_BYTES = 5
DISCOUNT = 0.75
#: Word pairs found less often in both classes together are left to the word level: in samples of this size they are noise (figures in the README).
PAIR_FROM = 6
PASSAGES = (1, 4, 16)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


class Table:
    """Counts by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(x), np.float32)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, self.counts[at], np.float32(0))


def _fresh(code: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One token of each kind of triple: two words before it and itself."""
    earlier = np.concatenate((np.zeros(1, c.U64), before[:-1]))[: len(before)]
    return np.unique(c.mix(c.mix(earlier * c._M2 + before) * c._M1 + code), return_index=True)[1]


def _tokens(t: c.Texts) -> tuple[c.Words, np.ndarray, np.ndarray]:
    """Words, the hashes of their beginnings, and of the pair with the word before (0-word at a text's start)."""
    w = c.words(t, c.ALNUM_WORDS, lower=True)
    data = c.LOWER[t.data]
    stem = np.zeros(len(w.start), c.U64)
    for k in range(STEM_BYTES):
        has = w.start + k < w.end
        stem[has] = c.mix(stem[has] + data[w.start[has] + k].astype(c.U64) + c.U64(1))
    before = np.zeros(len(w.code), c.U64)
    if len(w.code) > 1:
        before[1:] = np.where(w.row[1:] == w.row[:-1], w.code[:-1], c.U64(0))
    return w, stem, before


class Model:
    """One class's counts above the shared last level."""

    def __init__(self, code: np.ndarray, stem: np.ndarray, before: np.ndarray, often: np.ndarray):
        pair = c.mix(before * c._M1 + code)
        keys, first, n = np.unique(pair, return_index=True, return_counts=True)
        kept = np.isin(keys, often, assume_unique=True)
        self.pair = Table(keys[kept], n[kept])
        follow, at = np.unique(before, return_inverse=True)
        self.after = Table(follow, np.bincount(at))  # tokens after a word
        # what its listed pairs leave to the word level: their discounts, and all of the others
        left = np.bincount(at[first], np.where(kept, DISCOUNT, n), len(follow))
        self.left = Table(follow, left)
        words, at, reach = np.unique(code[first], return_index=True, return_counts=True)
        self.word, self.pairs = Table(words, reach), max(1, len(keys))
        self.words = len(words)
        stems, many = np.unique(stem[first][at], return_counts=True)
        self.stem, self.stems = Table(stems, many), len(stems)
        self.stem_total = max(1, self.words)

    def log_likelihoods(self, code: np.ndarray, stem: np.ndarray, before: np.ndarray, shared: np.ndarray, within: np.ndarray) -> np.ndarray:
        """shared: the last level's probability of each word's beginning; within: of the word given its beginning, the same for both classes."""
        d = DISCOUNT
        low = (np.maximum(self.stem(stem) - d, 0) + d * self.stems * shared) / self.stem_total
        word = (np.maximum(self.word(code) - d, 0) + d * self.words * low * within) / self.pairs
        after = self.after(before)
        pair = np.maximum(self.pair(c.mix(before * c._M1 + code)) - d, 0) + self.left(before) * word
        return np.log(np.where(after > 0, pair / np.maximum(after, 1), word) + 1e-300)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


class Scorer:
    def __init__(self, code: np.ndarray, stem: np.ndarray, before: np.ndarray, toxic: np.ndarray):
        own = [np.flatnonzero(x)[_fresh(code[x], before[x])] for x in (~toxic, toxic)]
        once = np.concatenate(own)
        pairs, n = _counted(c.mix(before[once] * c._M1 + code[once]))
        self.models = [Model(code[x], stem[x], before[x], pairs[n >= PAIR_FROM]) for x in own]
        words, at = np.unique(code, return_index=True)
        stems, n = np.unique(stem[at], return_counts=True)
        self.shared, self.total = Table(stems, n), len(words) + 1
        self.weights = np.zeros(len(PASSAGES) + 2)

    def measures(self, t: c.Texts) -> np.ndarray:
        w, stem, before = _tokens(t)
        kinds = self.shared(stem)
        shared, within = (kinds + 0.5) / self.total, 1 / (kinds + 1)
        ordinary, toxic = (m.log_likelihoods(w.code, stem, before, shared, within) for m in self.models)
        ratio = np.clip(toxic - ordinary, -8, 8).astype(np.float64)
        n = np.diff(w.first)
        out = np.zeros((len(t), len(PASSAGES) + 2))
        out[:, 0] = 1
        out[:, 1] = c.run_sums(ratio, w.first) / np.maximum(n, 1)
        total = np.concatenate(([0], np.cumsum(ratio)))
        some = np.flatnonzero(n > 0)
        for k, size in enumerate(PASSAGES):
            end = np.minimum(np.arange(len(ratio)) + size, w.first[w.row + 1] if len(ratio) else 0)
            mean = (total[end] - total[:-1]) / size
            if len(some):
                out[some, 2 + k] = np.maximum.reduceat(mean, w.first[some])
        return out

    def scores(self, t: c.Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(t) @ self.weights, -40, 40)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]], prior: float) -> Scorer:
    """rows: (text, toxic) in the order of the sample; prior: the share of toxic labels."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([x for x, _ in rows], pa.string())})
    label = np.array([y for _, y in rows], bool)
    curve = np.zeros(len(rows), bool)
    for y in (False, True):
        own = np.flatnonzero(label == y)
        curve[own[::CURVE_PART]] = len(own) >= CURVE_PART
    parts, done, measured = [], 0, []
    for t in c.texts(iter([batch])):
        w, stem, before = _tokens(t)
        use = ~curve[done + w.row] if len(w.row) else np.zeros(0, bool)
        parts.append((w.code[use], stem[use], before[use], label[done + w.row][use] if len(w.row) else np.zeros(0, bool)))
        done += len(t)
    scorer = Scorer(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    measured = np.concatenate([scorer.measures(t) for t in c.texts(iter([batch]))])
    scorer.weights = _fit_curve(measured[curve], label[curve].astype(float)) if len(set(label[curve])) == 2 else np.array([0.0, 1.0, *[0.0] * len(PASSAGES)])
    scorer.weights[0] += np.log(prior / (1 - prior))  # the sample has as many of either class
    return scorer


def train(docs: DataFrame, labels: DataFrame) -> bytes | float:
    """A pickled Scorer from the rows that are not held out, or the prior if a class is missing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels without a document teach nothing, so they take no place in the sample
    known = known.join(docs.where(F.length("text") > 0).select(F.col("doc_id").alias("_d")), F.col("doc_id") == F.col("_d"), "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    size = min(SAMPLE_ROWS, counts.get(0, 0), counts.get(1, 0))
    if not size:
        return prior
    order = F.xxhash64("doc_id")
    sample = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(size)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text") > 0)
    texts = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # one text an id, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        used = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if used[y] < SAMPLE_BYTES:
                    used[y] += len(text.encode())
                    rows.append((text, y))
        if {y for _, y in rows} == {0, 1}:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, prior))], pa.binary())], names=["model"])

    # a bounded sample: one task reads it
    found = texts.select("text", F.col("toxic").cast("int").alias("toxic"), order.alias("_o"), "doc_id").repartition(1).sortWithinPartitions("_o", "doc_id", "text")
    model = found.select("text", "toxic").mapInArrow(run, "model binary").collect()
    return bytes(model[0]["model"]) if model else prior


def toxicity(docs: DataFrame, model: bytes | float) -> DataFrame:
    """doc_id and score, one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    known: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known and isinstance(sent.value, bytes):
            known.append(pickle.loads(sent.value))
        for t in c.texts(batches):
            score = known[0].scores(t) if known else np.full(len(t), float(sent.value))
            yield pa.RecordBatch.from_arrays([t.rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
