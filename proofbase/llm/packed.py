"""Documents in compressed blocks, and sorted hashes in compressed rows, for exchanges much smaller than their rows.

A block is an id and the documents dealt to it, in one order whatever order they came in, so a block
built again is the same block. Blocks and hash ranges are dealt by number: number k is work of task
k modulo the tasks, so every task has as many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbase.llm import common as c

#: Bytes of text that a task gathers before it packs them by block.
PACK_BYTES = 48 << 20


def number(total: int, most: int, parts: int) -> int:
    """How many blocks or ranges of at most `most` make up total: a multiple of parts."""
    return parts * max(1, -(-total // (most * parts)))


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("text", pa.large_string())])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) -> (block, documents of it, compressed)."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        text = rows.column("text").cast(pa.large_string())
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", text).sort_by("block").combine_chunks()
        ids = rows.column("block").to_numpy()
        cut = [*np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)]
        rows = rows.select(["doc_id", "text"])
        blobs = [zstandard.compress(rows.slice(a, b - a).combine_chunks().to_batches()[0].serialize(), 3) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids[cut[:-1]]), pa.array(blobs, pa.binary())], names=["block", "docs"])

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > PACK_BYTES:
            yield packed()
            size = 0
    if held:
        yield packed()


def block_of(blocks: int) -> Column:
    """A document's block, by id and text, so rows with equal ids are spread."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def dealt(docs: DataFrame, blocks: int, parts: int) -> DataFrame:
    """docs(doc_id, text) -> (block, docs), each block in one task."""
    placed = docs.select(block_of(blocks).alias("block"), "doc_id", "text")
    return placed.mapInArrow(_packs, "block int, docs binary").repartitionById(parts, "block")


def rows_of(blobs: pa.ChunkedArray, kind: pa.DataType) -> pa.Table:
    """A block's documents (doc_id, text) in order of doc_id, length and text."""
    schema = _schema(kind)
    rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(zstandard.decompress(b.as_py())), schema) for b in blobs], schema)
    rows = rows.append_column("_n", pc.binary_length(rows.column("text")))
    return rows.select(["doc_id", "text"]).take(pc.sort_indices(rows, [("doc_id", "ascending"), ("_n", "ascending"), ("text", "ascending")]))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, by which the batches are in order."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
        for a, b in zip(edge, [*edge[1:], len(ids)], strict=True):
            if held and ids[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(ids[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def squeezed(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed: sorted hashes as differences have few high bytes, counts are mostly 1."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), 3)


def restored(b: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(width, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def steps(keys: np.ndarray) -> bytes:
    """Sorted hashes, as squeezed differences."""
    return squeezed(np.diff(keys, prepend=c.U64(0)))


def from_steps(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(restored(b, n, np.uint64), dtype=c.U64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hash ranges begin and end in the sorted keys."""
    edges = [((k << 64) // ranges) for k in range(ranges)]
    return np.append(np.searchsorted(keys, np.array(edges, c.U64)), len(keys))
