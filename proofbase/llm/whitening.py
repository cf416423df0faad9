"""Embedding whitening by a tiled covariance.

Distinct vectors are cut into row blocks and those into column blocks. The pairs of column blocks
are the tiles; a column block is sent to each of its tiles under its row block, where the two sides
are multiplied, and the products of a tile are summed. The assembled matrix of the dimensions (its
size does not depend on the rows) is decomposed, and every row is projected.

Vectors are floor(256 * c) per entry, as whole numbers; sums and the deviation are exact.

Defined cases: a vector that is null or holds a null or non-finite entry is dropped; a shorter
vector counts as filled with zeros up to the longest; entries beyond 64 bits are cut to that range;
null and repeated ids stay, a row each; a component without variance has null results, as has a
share of no variance at all; a deviation beyond 64 bits is null; no rows give no rows; columns of
the input keep their values, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbase.llm import common as c

SCALE, COMPONENTS = 256, 4
#: Rows of a row block, and the least width of a column block; there are at most four column blocks, so a row is sent at most four times.
ROWS, WIDTH, MOST_BLOCKS = 4096, 32, 4
_X = "_x"


def quantised(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows with a whole-number vector, without those that have none."""
    v = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(v.isNotNull() & finite).withColumn(_X, F.transform(v, lambda e: F.floor(e * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Arrow lists as rows of d numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(i, ROWS).column(0), d)


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(0)]


@dataclass
class Fit:
    """n distinct vectors with sums S; components (rows, unit), their variances and shares, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.mean) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1))
        wide = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in wide], pa.int64())


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for x in _blocks(batches, d):
            n += len(x)
            sums = [a + b for a, b in zip(sums, _exact_sum(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))], names=["k", "v"])

    rows = fit.mapInArrow(part, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()  # d + 1 rows
    found = {r["k"]: int(r["v"]) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def _covariance(fit: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Tiles of column blocks, multiplied by row block, summed by tile, assembled."""
    width = max(WIDTH, -(-d // MOST_BLOCKS))
    count = -(-d // width)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, x in enumerate(_blocks(batches, d)):
            centred = x - mean
            parts = [np.ascontiguousarray(centred[:, b * width : (b + 1) * width]).tobytes() for b in range(count)]
            rows = [(i, j, task + k, b, parts[b]) for i in range(count) for j in range(i, count) for b in {i, j}]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["i", "j", "row_block", "b", "data"])

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        side = {b: np.frombuffer(x, np.float64) for b, x in zip(rows.column("b").to_pylist(), rows.column("data").to_pylist(), strict=True)}
        shaped = [side[b].reshape(-1, min(width, d - b * width)) for b in (i, j)]
        product = shaped[0].T @ shaped[1]
        r, s = np.indices(product.shape)
        return pa.table({"r": pa.array((r + i * width).ravel(), pa.int32()), "s": pa.array((s + j * width).ravel(), pa.int32()), "v": pa.array(product.ravel())})

    cut = fit.mapInArrow(columns, "i int, j int, row_block long, b int, data binary")
    products = cut.groupBy("i", "j", "row_block").applyInArrow(multiply, "r int, s int, v double")
    found = products.groupBy("r", "s").agg(F.sum("v").alias("v")).toPandas()  # one row for each pair of dimensions
    v = np.zeros((d, d))
    r, s = found["r"].to_numpy(int), found["s"].to_numpy(int)
    v[r, s] = v[s, r] = found["v"].to_numpy() / n
    return v


def _identity_error(fit: DataFrame, d: int, found: Fit) -> float | None:
    """The covariance of the whitened fit list, centred first, against the identity."""
    k = len(found.variances)
    used = [i for i in range(k) if found.variances[i] > 0]
    if not used:
        return None

    def summed(shift: np.ndarray, product: bool) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k) if product else k)
            for x in _blocks(batches, d):
                w = found.whitened(x) - shift
                total += w.T @ w if product else w.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

        rows = fit.mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # components squared at most
        out = np.zeros(k * k if product else k)
        for r in rows:
            out[r["k"]] = np.nan if r["v"] is None else r["v"]
        return out / found.n

    mean = summed(np.zeros(k), False)
    covariance = summed(mean, True).reshape(k, k)[np.ix_(used, used)]
    return float(np.abs(covariance - np.eye(len(used))).max())


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, int]:
    """The whitening of quantised rows, and their number of dimensions."""
    fit = c.stored(rows.select(_X).distinct())
    d = fit.agg(F.max(F.size(_X))).first()[0]
    if not d:
        return None, 0
    if fit.where(F.size(_X) < d).limit(1).count():  # vectors that differ by trailing zeros are one
        fit = c.stored(fit.select(F.concat(_X, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(_X))).alias(_X)).distinct())
    n, sums = _totals(fit, d)
    mean = np.array([s / n for s in sums])
    v = _covariance(fit, d, n, mean)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order].T
    values = np.where(values > max(values.max(), 0) * d * np.finfo(float).eps, values, 0.0)
    vectors = vectors * np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(1)])[:, None]
    trace = float(np.trace(v))
    found = Fit(n, sums, vectors, values, values / trace if trace > 0 else np.full(len(order), np.nan))
    found.identity_error = _identity_error(fit, d, found)
    return found, d


_RESULT = "whitened array<double>, deviation long, n long, explained array<double>, identity_error double"


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows with whitened (one number a component, by falling variance), deviation, and the fit's n, explained and identity_error."""
    own, back = c.hidden(rows, ())
    mine = own.columns[[x.lower() for x in rows.columns].index(column.lower())]
    ready = quantised(own, mine)
    found, d = fitted(ready, components)
    schema = c.extended(ready.drop(_X).schema, _RESULT)
    results = ["whitened", "deviation", "n", "explained", "identity_error"]
    kept = [b for b, x in zip(back, rows.columns, strict=True) if x.lower() not in results]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = _matrix(part.column(part.num_columns - 1), d)
                w = found.whitened(x)
                k = w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel(), mask=~np.isfinite(w.ravel())))
                share = pa.array([[None if np.isnan(e) else float(e) for e in found.explained]] * len(x), pa.list_(pa.float64()))
                more = [lists, found.deviations(x), pa.array(np.full(len(x), found.n)), share, pa.array([found.identity_error] * len(x), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], *results])

    if found is None:
        # no dimension at all: every vector is empty
        nothing = F.array().cast("array<double>")
        n = ready.limit(1).count()
        return ready.withColumns({"whitened": nothing, "deviation": F.lit(0).cast("long"), "n": F.lit(n).cast("long"), "explained": nothing, "identity_error": F.lit(None).cast("double")}).select(*kept, *results)
    return ready.mapInArrow(project, T.StructType(schema.fields)).select(*kept, *results)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    # a component's three numbers are one row
    each = F.transform("whitened", lambda w, i: F.struct((i + 1).cast("int").alias("component"), w.alias("whitened"), F.get(F.col("explained"), i).alias("explained")))
    return found.select("vec_id", "n", "deviation", "identity_error", F.inline(each)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
