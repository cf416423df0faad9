"""Packing documents into sequences along a space-filling curve.

A document's hashed vector (its token counts in BUCKETS buckets with signs, damped by square roots,
of unit length) is projected to DIMS dimensions; the Hilbert key of the quantised point orders the
documents, so that alike ones are neighbours. Rows are sorted by range of that key, copies of one
text by a mixed row number after it, so that a text found everywhere is no one task's work. Each
range is one stream of tokens, cut into sequences of `LENGTH`; what is left of a range is cut into
sequences of powers of two, so no sequence has padding.

A text is encoded by its pieces: the tokenizer never joins what white space parts, nor plain
letters, digits and marks, so equal pieces are encoded once. Its pre-tokens decide that, so this
holds for the tokenizer named in the query; `whole=True` encodes white-space words as they are.

Long texts are encoded a stretch at a time, at white space, and sent as parts of at most PART tokens,
so that ranges of as many rows are of much the same size; parts that meet again are one piece.

Defined cases: a null text is empty, and an empty one has its end token only; null and repeated ids
stay apart, a row each; an empty table gives no rows; no column but the id and the text is read.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbase.llm import common as c
from proofbase.llm import strings as st

LENGTH, END, PART = 4096, 2, 1024
BUCKETS, DIMS, BITS, SEED = 256, 4, 12, 13
#: Bytes of text encoded at once, and pieces whose ids a task remembers.
TEXT_BYTES, REMEMBERED = 2 << 20, 500_000

SPACE, LETTER, DIGIT, MARK, LATIN, FOLLOWS, OTHER = range(7)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:0x80] = MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[0x30:0x3A] = DIGIT
_KIND[0x80:0xC0] = FOLLOWS
# the first bytes of U+00C0-U+00FF and U+0140-U+017F: letters, but for two signs that are looked for
_KIND[[0xC3, 0xC5]] = LATIN
_RUN = np.array([SPACE, LETTER, DIGIT, MARK, LETTER, LETTER, OTHER], np.uint8)


def pieces(data: np.ndarray, at: np.ndarray, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The pieces of the rows' texts that can be encoded apart, lower-cased where no special token can be meant, and each one's row."""
    kind = _KIND[data]
    inside = kind != SPACE
    word = st.begins(inside, at)
    begin = word
    if not whole and len(data):
        number = np.cumsum(word, dtype=np.int32 if len(data) < 1 << 31 else np.int64) - 1
        after = np.append(data[1:], 0)
        special = (data == 0x3C) & (after == 0x7C)
        odd = (kind == OTHER) | (data == 0x27) | special | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        plain = np.ones(int(number[-1]) + 1, bool)
        plain[number[odd]] = False
        raw = np.zeros(len(plain), bool)
        raw[number[special]] = True
        run = _RUN[kind]
        turn = np.zeros(len(data), bool)
        turn[1:] = (run[1:] != run[:-1]) | (run[1:] == DIGIT)
        if len(plain):
            at_word = np.maximum(number, 0)
            begin = word | (inside & turn & plain[at_word])
            data = np.where(raw[at_word], data, c.LOWER[data])
    start = np.flatnonzero(begin)
    return st.cut(data, inside, start), np.searchsorted(at, start, "right") - 1


#: Pieces that are one pre-token: letters, a digit, or marks.
SINGLE = "^([a-z\u00e0-\u00f6\u00f8-\u00ff\u0153]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)$"


class Encoder:
    """A tokenizer that remembers the ids of pieces."""

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.width = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.width, bool)
        if suffix:
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _places(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [x for x in distinct if x not in self.known]
        if new and not self.whole:
            single = pc.match_substring_regex(pa.array(new, pa.large_string()), SINGLE).to_numpy(zero_copy_only=False)
            self._learn([x for x, s in zip(new, single, strict=True) if s], True)
            self._learn([x for x, s in zip(new, single, strict=True) if not s], False)
        else:
            self._learn(new, False)
        return np.array([self.known[x] for x in distinct], np.int64)

    def _learn(self, new: list[str], single: bool) -> None:
        """Encode and remember pieces; single ones are encoded many at once, as their last tokens tell them apart."""
        if not new:
            return
        given = [" ".join(new[i : i + 256]) for i in range(0, len(new), 256)] if single else new
        lists = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
        ids = np.concatenate(lists)
        ends = np.flatnonzero(self.ends[ids]) + 1 if single else np.cumsum([len(x) for x in lists])
        if len(ends) != len(new):
            return self._learn(new, False)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each row has."""
        found, row = pieces(data, at, self.whole)
        code, distinct = st.encoded(found)
        place = self._places(distinct.to_pylist())[code] if len(code) else code
        first, n = self.first[place], self.first[place + 1] - self.first[place]
        spot = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.ids[spot], np.bincount(row, n, len(at) - 1).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str, whole: bool) -> Encoder:
    """One a process: Spark's workers go on to other tasks with what they remember."""
    return Encoder(path, whole)


def stretches(data: np.ndarray, most: int = TEXT_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about `most` bytes, cut before white space."""
    i = 0
    while i < len(data):
        j = i + most
        while j < len(data):
            spaces = np.flatnonzero(_KIND[data[j : j + most]] == SPACE)
            if len(spaces):
                j += int(spaces[0])
                break
            j += most
        yield data[i : min(j, len(data))]
        i = j


def directions(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token id, and the buckets' projection: fixed by SEED."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, BUCKETS, width), rng.choice([-1.0, 1.0], width), rng.standard_normal((BUCKETS, DIMS))


def points(sums: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hashed vectors -> whole coordinates of BITS bits."""
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    z = damped / np.where(norm > 0, norm, 1) @ projection
    return np.minimum((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates below 2**bits (Skilling's transform, all rows at once)."""
    x = axes.T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(len(x)):
            high = (x[k] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def id_width(vocabulary: int, end: int) -> int:
    """Bytes of an id on its way to its sequence."""
    return 2 if max(vocabulary, end + 1) <= 1 << 16 else 4


def tokenised(docs: DataFrame, path: str, end: int = END, doc_id: str = "doc_id", whole: bool = False) -> DataFrame:
    """Parts of documents: (doc_id, start, doc_tokens, key, salt, ids as little-endian numbers of `id_width()` bytes)."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("start long, doc_tokens long, key long, salt long, ids binary").fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_chunk = encoder(path, whole)
        width = id_width(encode_chunk.width, end)
        bucket, sign, projection = directions(encode_chunk.width)
        task, done = TaskContext.get().partitionId() << 36, 0
        for t in c.texts(batches, "text", TEXT_BYTES):
            if len(t) == 1 and len(t.data) > 2 * TEXT_BYTES:
                parts = [encode_chunk(x, np.array([0, len(x)]))[0] for x in stretches(t.data)]
                ids, n = np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                ids, n = encode_chunk(t.data, t.at)
            row = np.repeat(np.arange(len(t)), n)
            sums = np.bincount(row * BUCKETS + bucket[ids], sign[ids], len(t) * BUCKETS).reshape(-1, BUCKETS)
            key = hilbert(points(sums, projection))
            salt = c.mix((task + done + np.arange(len(t))).astype(np.uint64)).view(np.int64)
            done += len(t)
            # the end token after each document
            ids = np.insert(ids, np.cumsum(n), end).astype(f"<u{width}")
            n = n + 1
            first = np.cumsum(n) - n
            times = -(-n // PART)
            at = np.repeat(np.arange(len(t)), times)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)) * PART
            cuts = (first[at] + start) * width
            held = ids.tobytes()
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(cuts, len(held)).astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([t.rows.column(0).take(place), pa.array(start), pa.array(n[at]), pa.array(key[at]), pa.array(salt[at]), data], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


class Packer:
    """Cuts the streams of the ranges into sequences."""

    def __init__(self, length: int, width: int, schema: pa.Schema):
        self.length, self.width, self.schema = length, width, schema

    def _sequences(self, number: int, sizes: list[int], ids: np.ndarray, first: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        """Sequences of the given sizes from the start of the stream; rows begin at first."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        total = int(ends[-1])
        # a part that follows another one of its document is no piece of its own
        head = rows.column("start").to_numpy() == 0
        head[0] = True
        cut = np.unique(np.concatenate([first[head & (first < total)], begins]))
        size = np.diff(np.append(cut, total))
        row = np.searchsorted(first, cut, "right") - 1
        sequence = np.searchsorted(begins, cut, "right") - 1
        place = pa.array(row)
        start = rows.column("start").to_numpy()[row] + cut - first[row]
        one = pa.StructArray.from_arrays([rows.column("doc_id").combine_chunks().take(place), pa.array(start), pa.array(size), pa.array(cut - begins[sequence]), rows.column("doc_tokens").combine_chunks().take(place)], fields=list(self.schema.field("pieces").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(sequence, np.arange(len(sizes) + 1)).astype(np.int32)), one, type=self.schema.field("pieces").type)
        held = ids[:total].astype("<u4").tobytes()
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(begins, total).astype(np.int64) * 4), pa.py_buffer(held)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(sizes))), pa.array(np.array(sizes, np.int64)), data, lists], schema=self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        left: pa.Table | None = None  # rows that begin, or go on, in a sequence that isn't full
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(["doc_id", "start", "doc_tokens", "ids"])
            rows = rows if left is None else pa.concat_tables([left, rows])
            ids, first = self._stream(rows)
            full = len(ids) // self.length
            if full:
                yield self._sequences(number, [self.length] * full, ids, first, rows)
                number += full
                left = self._rest(rows, ids, first, full * self.length)
            else:
                left = rows
        if left is not None and left.num_rows:
            ids, first = self._stream(left)
            sizes = [1 << b for b in range(self.length.bit_length() - 1, -1, -1) if len(ids) >> b & 1]
            if sizes:
                yield self._sequences(number, sizes, ids, first, left)

    def _stream(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = rows.column("ids").to_pylist()
        n = np.array([len(x) // self.width for x in parts])
        return np.frombuffer(b"".join(parts), f"<u{self.width}"), np.cumsum(n) - n

    def _rest(self, rows: pa.Table, ids: np.ndarray, first: np.ndarray, taken: int) -> pa.Table:
        if taken == len(ids):
            return rows.slice(0, 0)
        row = int(np.searchsorted(first, taken, "right")) - 1
        kept = rows.slice(row)
        gone = taken - int(first[row])
        start = kept.column("start").to_numpy().copy()
        start[0] += gone
        data = kept.column("ids").to_pylist()
        data[0] = data[0][self.width * gone :]
        return pa.table([kept.column("doc_id"), pa.array(start), kept.column("doc_tokens"), pa.array(data, pa.binary())], names=kept.schema.names)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", whole: bool = False) -> DataFrame:
    """(sequence_id, n_tokens, input_ids as little-endian 32-bit numbers, pieces of documents in order) of each sequence; length is a power of two."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    width = id_width(encoder(path, whole).width, end)
    parts = c.stored(tokenised(docs, path, end, doc_id, whole))
    id_type = parts.schema["doc_id"].dataType
    piece = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("start long, length long, offset long, doc_tokens long").fields])
    schema = T.StructType([*T.StructType.fromDDL("sequence_id long, n_tokens long, input_ids binary").fields, T.StructField("pieces", T.ArrayType(piece))])
    from pyspark.sql.pandas.types import to_arrow_schema

    order = ["key", "salt", "start"]
    return parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(Packer(length, width, to_arrow_schema(schema)), schema)


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sequences = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda p: F.expr("substring(input_ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    each = sequences.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    return each.select("p.doc_id", "p.start", "p.length", F.crc32(ids("p")).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
