"""Shared helpers: checkpoints, and vectorised tokenising and hashing of whole texts.

Texts are handled as UTF-8 bytes in one buffer per chunk. A word's hash is a polynomial
over its bytes modulo 2**64, mixed with its length; an n-gram's hash combines word hashes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of our own if there is one process only, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/proofbase-checkpoints").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage cut, partitioning forgotten."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_P_INV = U64(pow(int(_P), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64. Tables of ordinary size are kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = 1 << (n - 1).bit_length()
    made = []
    for base in (_P, _P_INV):
        x = np.full(size, base, U64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U64))
    if size <= 4 * CHUNK_BYTES:
        _powers["up"], _powers["down"] = made
    return made[0], made[1]


def string_codes(data: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The unmixed hash of the bytes from each start to the next one; bytes that do not count are zeros in it. A stretch of bounded size at a time, unless a string is longer."""
    code = np.zeros(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + 2 * CHUNK_BYTES, "right")) - 1) if start[-1] - start[i] > 2 * CHUNK_BYTES else len(start)
        lo, hi = int(start[i]), int(start[j]) if j < len(start) else len(data)
        up, down = powers(hi - lo)
        terms = (data[lo:hi].astype(U64) + U64(1)) * up[: hi - lo]
        terms[~counts[lo:hi]] = 0
        code[i:j] = np.add.reduceat(terms, start[i:j] - lo) * down[start[i:j] - lo]
        i = j
    return code


def byte_classes(pattern: str) -> np.ndarray:
    """For each byte whether it belongs to a word. 'space': all but ASCII white space; 'alnum': letters, digits, non-ASCII."""
    table = np.ones(256, bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


SPACE_WORDS, ALNUM_WORDS = byte_classes("space"), byte_classes("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Texts:
    """Some rows' texts, end to end. Row i is bytes[at[i]:at[i + 1]]."""

    rows: pa.RecordBatch
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


@dataclass
class Words:
    """Word j: bytes[start[j]:end[j]]; row i has the words from first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    row: np.ndarray
    first: np.ndarray


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The batches in chunks of about `most` bytes of text. A null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(col):
            j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
            j = min(max(j, i + 1), len(col))
            yield Texts(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


def words(t: Texts, classes: np.ndarray, lower: bool) -> Words:
    data = LOWER[t.data] if lower else t.data
    inside = classes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = t.at[:-1][t.at[:-1] < t.at[1:]]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    stops = ~inside
    if len(data):
        stops[edge] |= True
    # a word ends where the next non-word byte or the next text begins
    marks = np.append(np.flatnonzero(stops), len(data))
    end = marks[np.searchsorted(marks, start, "right")] if len(start) else start
    code = mix(string_codes(data, inside, start) + (end - start).astype(U64) * _M1)
    row = np.searchsorted(t.at, start, "right") - 1
    first = np.searchsorted(start, t.at)
    return Words(start, end, code, row, first)


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all windows of n codes, in order, without regard to rows."""
    if len(code) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(code) - n + 1, U64)
    for k in range(n):
        out += code[k : len(code) - n + 1 + k] * U64(_GRAM[k % 4] + 2 * (k // 4))
        out = (out << U64(23)) | (out >> U64(41))
    return mix(out)


def whole_windows(w: Words, n: int) -> np.ndarray:
    """Which windows of n words, by their first word, lie within one row."""
    if len(w.row) < n:
        return np.zeros(0, bool)
    return w.row[: len(w.row) - n + 1] == w.row[n - 1 :]


def with_columns(t: Texts, found: dict[str, pa.Array]) -> pa.RecordBatch:
    """The chunk's rows with found columns after their own."""
    names = [n for n in t.rows.schema.names if n not in found]
    return pa.RecordBatch.from_arrays([*(t.rows.column(t.rows.schema.get_field_index(n)) for n in names), *found.values()], names=[*names, *found])


def extended(schema: T.StructType, found: str) -> T.StructType:
    """schema without the columns named in found, and then those."""
    more = T.StructType.fromDDL(found)
    return T.StructType([f for f in schema.fields if f.name not in more.names] + more.fields)


def hidden(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but `keep` under names that no operator uses, and the expressions that give the old columns back."""
    prefix = "_own_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = "_" + prefix
    names = [x if x in keep else f"{prefix}{i}" for i, x in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(x) for n, x in zip(names, docs.columns, strict=True)]


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mask of rows of the sorted pair (a, b) that differ from the one before."""
    out = np.ones(len(a), bool)
    out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the LONG column that Spark knows."""
    return pa.array(x.view(np.int64))
