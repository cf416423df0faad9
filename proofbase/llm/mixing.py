"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives each document posteriors over the domains.
Document rates r >= 0 are fitted by projected gradient so that the expected tokens of each
domain, sum over documents of r * tokens * posterior, match the targets in least squares, with
a small ridge that holds rates near 1 and breaks ties: it is scaled by a domain's target
share and by the share it has, if that is less, so that a scarce domain is met as closely as a
large one. The gradient is one number per
domain, preconditioned by the Gram matrix of the domains over the documents whose rate is not 0
(over all of them where that step leads uphill); a rate is 1 less the posteriors' product with
the summed steps, cut at 0. So a round is one aggregation over all documents, a few rounds
suffice, and no state is kept between them.

Targets: the first domain has GROWTH times its expected tokens; the others their share beside
it, however few they have. Only a domain that is no document's likeliest has none to repeat: its
expected tokens are the faint posteriors of other domains' documents, which would drive most
rates to 0. It keeps REACH times those at most, and the whole ridge.

The classifier is fitted on a bounded sample: at most SAMPLE_ROWS labelled documents a domain,
in hash order, until SAMPLE_BYTES each. Posteriors, sums and rates cover every whole text.

Domains: toxic (toxic label 1), junk (quality 0), good (the others).

Defined cases: null or empty texts have no tokens and posteriors by the curve at zero; unlabelled
documents get posteriors alike; with fewer than two labelled domains posteriors are the label
shares (all good without labels); a domain without a document can't reach its target and keeps its
residual; repeated rows get equal rates; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c

DOMAINS = ("good", "junk", "toxic")
#: Target token shares of the mixture.
WEIGHTS = {"good": 0.90, "junk": 0.07, "toxic": 0.03}
#: The mixture has this many tokens per expected token of the first domain, before its share.
GROWTH, REACH = 1.05, 1.0
#: The weight of (rate - 1) squared, per token, beside the squared misses of the domains' tokens, as parts of their targets.
RIDGE = 1e-3
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
BUCKETS = 1 << 18
ROUNDS, TOLERANCE = 60, 1e-5


def _bins(t: c.Texts) -> tuple[c.Words, np.ndarray]:
    """Each word's feature bucket; and words are also described by their last three bytes, in other buckets."""
    w = c.words(t, c.SPACE_WORDS, lower=True)
    data = c.LOWER[t.data]
    tail = np.zeros(len(w.start), c.U64)
    for k in range(1, 4):
        has = w.end - k >= w.start
        tail[has] = c.mix(tail[has] + data[w.end[has] - k].astype(c.U64) + c.U64(1))
    half = c.U64(BUCKETS // 2)
    return w, np.stack((w.code % half, half + tail % half)).astype(np.int64)


class Classifier:
    def __init__(self, counts: np.ndarray):
        """counts: (domains, BUCKETS), by documents that have the feature."""
        smooth = counts + 0.5 * counts.sum(axis=0, keepdims=True) / max(1.0, counts.sum()) * BUCKETS / 4 + 1e-3
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.logs = (logs - logs.mean(axis=0)).astype(np.float32)
        self.weights = np.zeros((2 * len(DOMAINS) + 1, len(DOMAINS)))

    def measures(self, t: c.Texts) -> np.ndarray:
        w, bins = _bins(t)
        out = np.zeros((len(t), 2 * len(DOMAINS) + 1))
        out[:, 0] = 1
        n = np.diff(w.first)
        some = np.flatnonzero(n > 0)
        for k in range(len(DOMAINS)):
            x = self.logs[k][bins].sum(axis=0)
            out[:, 1 + k] = c.run_sums(x, w.first) / np.maximum(n, 1)
            if len(some):
                out[some, 1 + len(DOMAINS) + k] = np.maximum.reduceat(x, w.first[some])
        return out

    def posteriors(self, t: c.Texts) -> np.ndarray:
        return _softmax(self.measures(t) @ self.weights)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, int]], shares: np.ndarray) -> Classifier:
    batch = pa.RecordBatch.from_pydict({"text": pa.array([x for x, _ in rows], pa.string())})
    label = np.array([y for _, y in rows])
    curve = np.arange(len(rows)) % 3 == 0
    counts, done = np.zeros((len(DOMAINS), BUCKETS)), 0
    for t in c.texts(iter([batch])):
        w, bins = _bins(t)
        row = done + w.row
        for half in bins:
            pairs = np.unique(row * np.int64(BUCKETS) + half)
            doc, b = pairs // BUCKETS, pairs % BUCKETS
            use = ~curve[doc]
            np.add.at(counts, (label[doc[use]], b[use]), 1)
        done += len(t)
    model = Classifier(counts)
    x = np.concatenate([model.measures(t) for t in c.texts(iter([batch]))])[curve]
    y = np.eye(len(DOMAINS))[label[curve]]
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros((x.shape[1], len(DOMAINS)))
    velocity = np.zeros_like(w)
    for _ in range(2000):
        grad = z.T @ (_softmax(z @ w) - y) / max(1, len(z)) + 1e-4 * w
        velocity = 0.9 * velocity - 0.5 * grad
        w += velocity
    model.weights = w / scale[:, None]
    # the sample has about as many of each domain
    own = np.bincount(label[curve], minlength=len(DOMAINS)) / max(1, curve.sum())
    shift = np.log(np.maximum(shares, 1e-9)) - np.log(np.maximum(own, 1e-9))
    model.weights[0] += np.where(own > 0, shift, -30.0)  # a domain without a text is no domain of these documents
    return model


def train(docs: DataFrame, labels: DataFrame) -> bytes | list[float]:
    """A pickled Classifier, or plain shares where there is nothing to tell apart."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select("doc_id", domain.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    # only labels of these documents: an earlier stage may have removed a domain
    known = known.join(docs.select(F.col("doc_id").alias("_d")), F.col("doc_id") == F.col("_d"), "left_semi")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shares = [counts.get(k, 0) / total if total else float(k == 0) for k in range(len(DOMAINS))]
    if len(counts) < 2:
        return shares
    order = F.xxhash64("doc_id", F.lit(4))
    sample = None
    for k in sorted(counts):
        part = known.where(F.col("domain") == k).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text") > 0)
    texts = texts.groupBy("doc_id", "domain").agg(F.max("text").alias("text"))  # one text an id, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        used = [0] * len(DOMAINS)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if used[y] < SAMPLE_BYTES:
                    used[y] += len(text.encode())
                    rows.append((text, y))
        if len({y for _, y in rows}) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, np.array(shares)))], pa.binary())], names=["model"])

    found = texts.select("text", F.col("domain").cast("int").alias("domain"), order.alias("_o"), "doc_id").repartition(1).sortWithinPartitions("_o", "doc_id", "text")
    model = found.select("text", "domain").mapInArrow(run, "model binary").collect()
    return bytes(model[0]["model"]) if model else shares


def memberships(docs: DataFrame, model: bytes | list[float]) -> DataFrame:
    """docs with tokens and p, the posteriors in the order of DOMAINS."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    known: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known and isinstance(sent.value, bytes):
            known.append(pickle.loads(sent.value))
        for t in c.texts(batches):
            p = known[0].posteriors(t) if known else np.tile(np.array(sent.value), (len(t), 1))
            n = np.diff(c.words(t, c.SPACE_WORDS, lower=True).first)
            cut = np.arange(0, p.size + 1, len(DOMAINS), dtype=np.int32)
            yield c.with_columns(t, {"tokens": pa.array(n, pa.int64()), "p": pa.ListArray.from_arrays(cut, pa.array(np.round(p, 9).ravel()))})

    return docs.mapInArrow(run, c.extended(docs.schema, "tokens long, p array<double>"))


def _rate(u: np.ndarray) -> F.Column:
    """The rate for the summed steps u: 1 less their product with the posteriors, cut at 0."""
    dot = F.lit(0.0)
    for k, v in enumerate(u):
        dot = dot + F.col("p")[k] * F.lit(float(v))
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot)


def _state(members: DataFrame, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """At the summed steps u: the expected tokens of the domains, their Gram matrix over the documents with a rate, and half the sum of tokens * rate squared."""
    k = len(DOMAINS)
    rate, p = _rate(u), [F.col("p")[i] for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    some = (rate > 0).cast("double")
    sums = [rate * x for x in p] + [some * p[i] * p[j] for i, j in cells] + [rate * rate / 2]
    row = list(members.agg(*[F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0)).alias(f"x{n}") for n, x in enumerate(sums)]).first())
    gram = np.zeros((k, k))
    for (i, j), v in zip(cells, row[k:-1], strict=True):
        gram[i, j] = gram[j, i] = v
    return np.array(row[:k]), gram, row[-1]


def fit_rates(members: DataFrame, weights: dict[str, float] = WEIGHTS, growth: float = GROWTH, reach: float = REACH, ridge: float = RIDGE) -> tuple[F.Column, np.ndarray, np.ndarray]:
    """The rate as an expression over p; the targets; and the expected domain tokens reached."""
    k = len(DOMAINS)
    likeliest = F.array_position("p", F.array_max("p"))
    row = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *[F.coalesce(F.sum(F.when(likeliest == i + 1, F.col("tokens"))), F.lit(0)) for i in range(k)]).first()
    total, own = max(float(row[0]), 1.0), np.array(row[1:], float)
    share = np.array([weights[d] for d in DOMAINS]) / sum(weights.values())
    u = np.zeros(k)
    now, whole, energy = _state(members, u)
    target = share * growth * now[0] / share[0]
    faint = own == 0
    faint[0] = False
    target[faint] = np.minimum(target[faint], reach * now[faint])
    part = np.where(faint | (target <= 0), 1.0, target / total)
    hold = np.diag(ridge * part * np.where(faint | (now <= 0), part, np.minimum(part, now / total)))
    height = lambda u, energy: (energy + u @ target) / total + u @ hold @ u / 2
    gram, safe = whole, False
    for _ in range(ROUNDS):
        slope = (now - target) / total - hold @ u  # zero where the fit is optimal
        if (np.abs(slope) <= TOLERANCE * part).all():
            break
        step = u + np.linalg.lstsq((whole if safe else gram) / total + hold, slope, rcond=1e-15)[0]
        ahead = _state(members, step)
        if not safe and height(step, ahead[2]) > height(u, energy):
            safe = True  # once more from here: this matrix bounds every curvature, so it never leads uphill
            continue
        u, (now, gram, energy), safe = step, ahead, False
    return F.round(_rate(u), 6), target, now


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, growth: float = GROWTH) -> DataFrame:
    """Per row of docs: doc_id, tokens, p, rate."""
    members = c.stored(memberships(docs.select("doc_id", "text"), train(docs, labels)).drop("text"))
    return members.withColumn("rate", fit_rates(members, weights, growth)[0])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    found = mix(docs, labels)
    return found.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their rates say: the whole part, and once more by a hash of the id for the rest."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rate = fit_rates(c.stored(memberships(docs.select("text"), model).drop("text")))[0]
    luck = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / F.lit(1e6)
    # posteriors again where the texts are read: a rate depends on nothing else, so no text is shuffled
    docs, own = c.hidden(docs, ("doc_id", "text"))
    timed = memberships(docs, model).withColumn("_times", F.floor(rate + luck).cast("int")).where("_times > 0")
    return timed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*own)
