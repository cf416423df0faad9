"""Suffix-array dedup: bytes covered by a LENGTH-byte string of an earlier document go, the first copy stays.

A longest-previous-factor array over the suffixes of a whole corpus needs them in one order.
Equal strings must meet, so the suffixes are dealt out by content, in steps that lose none.
Documents stay in blocks throughout (see packed); what a block sends is one entry per distinct
string, and its answers come back in that order.

1. Units. Texts are cut at content-defined points; a unit with its next LENGTH - 1 bytes holds
   all windows that start in it. A unit that an earlier document has needs no more work: all
   its windows are hits, and whoever repeats them repeats the earlier document's.
2. Anchors. In each remaining window the GRAM-byte string with the least hash is its anchor;
   equal windows have equal anchors, so only anchors found in two documents matter. A block sends
   its distinct anchors with their counts and learns which ones others have.
3. Suffixes within a block. The suffixes that start at windows of an anchor shared within the
   block are sorted. In suffix order the previous and the next suffix of a smaller document
   have the longest common prefixes with it of all earlier ones: the longer of the two is its
   longest previous factor. Windows whose factor reaches LENGTH are hits; the others go on.
4. Suffixes across blocks. What is first in its block meets the other blocks' by anchor, and is
   judged in the same way. An anchor with very many windows is dealt over several groups; what a
   group finds to be its first is judged again, dealt by the whole window, where each group
   sends the windows of one document only.

Defined cases: doc_id is an integer; a null text is empty; texts under LENGTH bytes lose nothing;
a document with a null doc_id has no place in the order, so it is kept whole and removes nothing;
rows with equal doc_id do not remove each other's bytes, equal texts or not; matches end at a
text's end; an empty table gives no rows; only doc_id and text are read, so clashing extra
columns do not matter; a text longer than a chunk is hashed in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c
from proofbase.llm import packed as pk

LENGTH, GRAM = 50, 24
#: One in so many positions ends a unit.
UNIT = 128
#: Bytes of text in a block, and of text for each hash range, at most.
BLOCK_BYTES, RANGE_BYTES = 12 << 20, 64 << 20
#: Runs of windows of one anchor that are sorted in one group.
GROUP_RUNS = 128
#: Windows sorted at once.
SORT_WINDOWS = 80_000
#: Bytes from a window's start that a suffix is compared by.
DEPTH = 56


class Block:
    """The documents of a block, end to end. Row i is data[at[i]:at[i + 1]]; positions are in data."""

    def __init__(self, blobs: pa.ChunkedArray):
        self.rows = pk.rows_of(blobs, pa.int64())
        parts, at, base = [], [0], 0
        for chunk in self.rows.column("text").chunks:
            text = chunk.fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            parts.append(np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
            at += (offsets[1:] - offsets[0] + base).tolist()
            base += int(offsets[-1] - offsets[0])
        self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.at = np.array(at, np.int64)
        ids = self.rows.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.codes: dict[int, np.ndarray] = {}

    def keep(self, base: int, code: np.ndarray) -> None:
        """The hashes of a stretch are kept for its second reading, in blocks of ordinary size."""
        if len(self.data) <= 2 * BLOCK_BYTES:
            self.codes[base] = code

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, bounds of the pieces from there): each window lies in one piece of one chunk."""
        i, n, most = 0, len(self.at) - 1, c.CHUNK_BYTES
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + most, "right")) - 1)
            a, b = int(self.at[i]), int(self.at[j])
            if b - a <= most:
                yield a, self.at[i : j + 1] - a
            else:
                for s in range(a, b - LENGTH + 1, most):
                    yield s, np.array([0, min(s + most + LENGTH - 1, b) - s])
            i = j

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1


def gram_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the GRAM bytes from each position, which positions have so many left in their piece, and prefix sums for longer strings."""
    n = len(data)
    up, down = c.powers(n + 1)
    total = np.concatenate((np.zeros(1, c.U64), np.cumsum((data.astype(c.U64) + c.U64(1)) * up[:n], dtype=c.U64)))
    code = np.zeros(n, c.U64)
    if n >= GRAM:
        code[: n - GRAM + 1] = c.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    return code, left >= GRAM, total


class Units:
    """The units of a block: windows start in [start, end); two hashes of the bytes from start to end + LENGTH - 1."""

    def __init__(self, b: Block):
        found: list[tuple[np.ndarray, ...]] = []
        for base, at in b.chunks():
            data = b.data[base : base + int(at[-1])]
            if len(data) < LENGTH:
                continue
            code, whole, total = gram_hashes(data, at)
            b.keep(base, code)
            last = np.maximum(at[1:] - LENGTH + 1, at[:-1])  # a piece's windows start before it
            cut = whole & (code % c.U64(UNIT) == 0)
            cut[at[:-1][at[:-1] < at[1:]]] = True
            start = np.flatnonzero(cut)
            piece = np.searchsorted(at, start, "right") - 1
            end = np.minimum(np.append(start[1:], len(data)), last[piece])
            ok = (start < end) & b.known[b.row(base + start)]
            start, end = start[ok], end[ok]
            up, down = c.powers(len(data) + 1)
            # the second hash is of the strings' mixed hashes, so it is independent of the first
            again = np.concatenate((np.zeros(1, c.U64), np.cumsum(code * up[: len(code)], dtype=c.U64)))
            high = c.mix((total[end + LENGTH - 1] - total[start]) * down[start] + (end - start).astype(c.U64) * c._M1)
            low = c.mix((again[end + LENGTH - GRAM] - again[start]) * down[start])
            found.append((base + start, base + end, high, low))
        self.start, self.end, self.high, self.low = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, c.U64), np.zeros(0, c.U64))
        self.doc = b.ids[b.row(self.start)] if len(self.start) else np.zeros(0, np.int64)
        order = np.lexsort((self.doc, self.low, self.high))
        new = np.ones(len(order), bool)
        new[1:] = (self.high[order][1:] != self.high[order][:-1]) | (self.low[order][1:] != self.low[order][:-1])
        self.first = order[new]  # of each distinct unit, the one of the least document, in hash order
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def hits(self, earlier: np.ndarray) -> np.ndarray:
        """Which units an earlier document has; earlier: of the distinct ones, whether another block has it earlier."""
        return (self.doc > self.doc[self.first][self.which]) | earlier[self.which]


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)


SENT = "range int, block int, n long, keys binary, more binary, docs binary"
ANSWER = "block int, range int, round int, n long, found binary"
_SENT = (["range", "block", "n", "keys", "more", "docs"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])
_ANSWER = (["block", "range", "round", "n", "found"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])


def _units_sent(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for block, rows in pk.grouped(batches):
        u = Units(Block(rows.column("docs")))
        high, low, doc = u.high[u.first], u.low[u.first], u.doc[u.first]
        cut = pk.cuts(high, ranges)
        yield _rows(*_SENT, [(k, block, int(b - a), pk.steps(high[a:b]), pk.squeezed(low[a:b]), pk.squeezed(doc[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _units_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: of each block's units, whether another block has it in an earlier document."""
    for where, rows in pk.grouped(batches):
        blocks, n, keys, more, docs = (rows.column(x).to_pylist() for x in ("block", "n", "keys", "more", "docs"))
        high = np.concatenate([pk.from_steps(x, m) for x, m in zip(keys, n, strict=True)])
        low = np.concatenate([pk.restored(x, m, np.uint64) for x, m in zip(more, n, strict=True)])
        doc = np.concatenate([pk.restored(x, m, np.int64) for x, m in zip(docs, n, strict=True)])
        order = np.lexsort((doc, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][new][np.cumsum(new) - 1]
        at = np.cumsum([0, *n])
        yield _rows(*_ANSWER, [(b, where, 1, m, zstandard.compress(np.packbits(doc[i : i + m] > least[i : i + m]).tobytes(), 3)) for b, m, i in zip(blocks, n, at[:-1].tolist(), strict=True)])


def _earlier(answers: pa.Table) -> np.ndarray:
    """The answers to a block's distinct units, in hash order."""
    mine = answers.filter(pc.field("round") == 1).sort_by("range")
    parts = [np.unpackbits(np.frombuffer(zstandard.decompress(x), np.uint8), count=m) for x, m in zip(mine.column("found").to_pylist(), mine.column("n").to_pylist(), strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def least_positions(code: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The position of the least string hash in each window, the leftmost of equal ones. Works in stretches of bounded size."""
    span = LENGTH - GRAM + 1
    out = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 18):
        s = start[i : i + (1 << 18)]
        lo, hi = int(s[0]), int(s[-1]) + span
        part = code[lo:hi]
        best, at = part.copy(), np.arange(lo, hi)
        reach = 1
        while reach < span:  # minima of ever longer stretches, by doubling
            step = min(reach, span - reach)
            other, other_at = best[step:], at[step:]
            less = other < best[: len(other)]
            best, at = np.where(less, other, best[: len(other)]), np.where(less, other_at, at[: len(other_at)])
            reach += step
        out[i : i + len(s)] = at[s - lo]
    return out


class Anchors:
    """The runs of a block's windows that have one anchor: windows start from head to tail. Windows of hit units are left out."""

    def __init__(self, b: Block, u: Units, hit: np.ndarray):
        open_ = np.flatnonzero(~hit)
        open_ = open_[np.argsort(u.start[open_])]
        starts, ends = u.start[open_], u.end[open_]
        found: list[tuple[np.ndarray, ...]] = []
        for base, at in b.chunks():
            data = b.data[base : base + int(at[-1])]
            # the last LENGTH - 1 bytes of a long text's piece begin the next one
            x, y = np.searchsorted(starts, (base, base + min(len(data), c.CHUNK_BYTES)))
            n = ends[x:y] - starts[x:y]
            if not len(n):
                continue
            start = np.repeat(starts[x:y] - base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            code = b.codes[base] if base in b.codes else gram_hashes(data, at)[0]
            spot = least_positions(code, start)
            new = np.append(True, (spot[1:] != spot[:-1]) | (start[1:] != start[:-1] + 1))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start)) - 1
            # mixed again, as least hashes are small and ranges are even
            found.append((c.mix(code[spot[head]]), base + start[head], base + start[tail]))
        self.code, self.head, self.tail = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, c.U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc = b.ids[b.row(self.head)] if len(self.head) else np.zeros(0, np.int64)
        order = np.lexsort((self.doc, self.code))
        code, doc = self.code[order], self.doc[order]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        first = np.flatnonzero(new)
        self.keys = code[first]
        self.count = np.diff(np.append(first, len(code)))
        self.two = doc[first] != doc[np.append(first[1:], len(code)) - 1] if len(first) else np.zeros(0, bool)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1


def _anchors_sent(docs: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    b = Block(docs.column("docs"))
    u = Units(b)
    a = Anchors(b, u, u.hits(_earlier(answers)))
    block, cut = docs.column("block")[0].as_py(), pk.cuts(a.keys, ranges)
    return pa.Table.from_batches([_rows(*_SENT, [(k, block, int(y - x), pk.steps(a.keys[x:y]), pk.squeezed(a.count[x:y].astype(np.uint32)), None) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x])])


def _anchors_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: of each block's anchors, the runs that all blocks have of it; 0 if no other block has it."""
    for where, rows in pk.grouped(batches):
        blocks, n, keys, more = (rows.column(x).to_pylist() for x in ("block", "n", "keys", "more"))
        code = np.concatenate([pk.from_steps(x, m) for x, m in zip(keys, n, strict=True)])
        count = np.concatenate([pk.restored(x, m, np.uint32) for x, m in zip(more, n, strict=True)])
        _, spot, many = np.unique(code, return_inverse=True, return_counts=True)
        total = np.bincount(spot, count).astype(np.uint64)
        total[many < 2] = 0
        at = np.cumsum([0, *n])
        yield _rows(*_ANSWER, [(b, where, 2, m, pk.squeezed(total[spot[i : i + m]])) for b, m, i in zip(blocks, n, at[:-1].tolist(), strict=True)])


def _nearest(doc: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The nearest earlier position of a smaller document, within stretches that begin at head; -1 if there is none."""
    p = np.arange(len(doc)) - 1
    p[head] = -1
    todo = np.flatnonzero((p >= 0) & (doc[p] >= doc))
    while len(todo):
        # all between are no smaller, and neither is anything between there and where it points
        p[todo] = p[p[todo]]
        todo = todo[(p[todo] >= 0) & (doc[p[todo]] >= doc[todo])]
    return p


def previous_factors(data: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, one that starts in a smaller document, up to DEPTH bytes; 0 where it is under LENGTH."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    text = np.concatenate((data, np.zeros(DEPTH - LENGTH, np.uint8)))
    suffix = np.lib.stride_tricks.sliding_window_view(text, DEPTH)[start]
    keys = suffix.view(">u8").astype(np.uint64)
    order = np.lexsort([doc, *keys.T[::-1]])
    keys, doc, suffix = keys[order], doc[order], suffix[order]
    tail = keys[:, LENGTH // 8] >> np.uint64(64 - LENGTH % 8 * 8)
    head = np.ones(n, bool)
    head[1:] = (keys[1:, : LENGTH // 8] != keys[:-1, : LENGTH // 8]).any(axis=1) | (tail[1:] != tail[:-1])
    before = _nearest(doc, head)
    end = np.append(head[1:], True)
    after = n - 1 - _nearest(doc[::-1], end[::-1])[::-1]  # n where there is none
    out = np.zeros(n, np.int64)
    for other in (before, np.where(after < n, after, -1)):
        i = np.flatnonzero(other >= 0)
        equal = suffix[i] == suffix[other[i]]
        common = np.where(equal.all(axis=1), DEPTH, equal.argmin(axis=1))
        out[order[i]] = np.maximum(out[order[i]], common)
    return out


def spans_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Stretches [start, end) joined where they meet: (2, n), in order."""
    if not len(start):
        return np.zeros((2, 0), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack((start[first], reach[np.append(first[1:], len(start)) - 1]))


def windows_of(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, start) of all windows of the runs."""
    n = tail - head + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(head - (np.cumsum(n) - n), n) + np.arange(n.sum())


def window_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), c.U64)
    for i in range(0, len(start), 1 << 16):
        x = np.zeros((min(1 << 16, len(start) - i), DEPTH), np.uint8)
        x[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start[i : i + (1 << 16)]]
        h = np.zeros(len(x), c.U64)
        for word in x.view(np.uint64).T:
            h = c.mix(h * c._M1 + word + c._M2)
        out[i : i + len(x)] = h
    return out


def _local(b: Block, a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, hit) of all windows of anchors that two of the block's documents have."""
    which, start = windows_of(a.head, a.tail) if len(a.head) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ok = a.two[a.which[which]] if len(which) else np.zeros(0, bool)
    which, start = which[ok], start[ok]
    # in order of content, each once per document; cut where the content changes
    code, doc = window_hashes(b.data, start), a.doc[which]
    order = np.lexsort((doc, code))
    fresh = c.distinct(code[order], doc[order])
    one = order[fresh]
    found = np.zeros(len(one), bool)
    new = np.flatnonzero(np.append(True, code[one][1:] != code[one][:-1])) if len(one) else np.zeros(0, np.int64)
    edge = [0]
    while edge[-1] < len(one):
        k = int(np.searchsorted(new, edge[-1] + SORT_WINDOWS, "right")) - 1
        nxt = int(new[k]) if len(new) and new[k] > edge[-1] else int(new[k + 1]) if k + 1 < len(new) else len(one)
        nxt = len(one) if edge[-1] + SORT_WINDOWS >= len(one) else nxt
        found[edge[-1] : nxt] = previous_factors(b.data, start[one[edge[-1] : nxt]], doc[one[edge[-1] : nxt]]) >= LENGTH
        edge.append(nxt)
    hit = np.zeros(len(order), bool)
    hit[order] = found[np.cumsum(fresh) - 1] if len(order) else False
    return which, start, hit


#: Hits (to the block: range -1) and runs of windows (to the range of their anchor or window), packed per block.
MOVED = "dest int, range int, block int, n long, keys binary, docs binary, owners binary, at binary, size binary, bytes binary"
_MOVED = (["dest", "range", "block", "n", "keys", "docs", "owners", "at", "size", "bytes"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6])


def _hit_row(block: int, spans: np.ndarray) -> tuple:
    return block, -1, block, spans.shape[1], None, None, None, pk.squeezed(spans[0]), pk.squeezed(spans[1] - spans[0]), None


def _run_rows(owner: np.ndarray, key: np.ndarray, groups: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, start: np.ndarray, ranges: int) -> list[tuple]:
    """Runs dealt by key, a row per range: bytes data[start:start + size], of the blocks `owner`; groups > 1 marks those to be judged again."""
    order = np.argsort(key, kind="stable")
    cut = pk.cuts(key[order], ranges)
    view, out = data.tobytes(), []
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        i = order[cut[k] : cut[k + 1]]
        text = b"".join([view[s : s + n] for s, n in zip(start[i].tolist(), size[i].tolist(), strict=True)])
        more = (size[i].astype(np.uint32) << np.uint32(1)) | (groups[i] > 1).astype(np.uint32)
        out.append((k, k, None, len(i), pk.steps(key[i]), pk.squeezed(doc[i]), pk.squeezed(owner[i].astype(np.int32)), pk.squeezed(at[i]), pk.squeezed(more), zstandard.compress(text, 3)))
    return out


def _runs_sent(docs: pa.Table, answers: pa.Table, ranges: int, most: int) -> pa.Table:
    """A block's hits from its units and its own suffixes, and the runs of its other windows that may be in other blocks."""
    block = docs.column("block")[0].as_py()
    b = Block(docs.column("docs"))
    u = Units(b)
    unit_hit = u.hits(_earlier(answers))
    a = Anchors(b, u, unit_hit)
    mine = answers.filter(pc.field("round") == 2).sort_by("range")
    parts = [pk.restored(x, m, np.uint64) for x, m in zip(mine.column("found").to_pylist(), mine.column("n").to_pylist(), strict=True)]
    total = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype(np.int64)
    which, start, hit = _local(b, a)
    spans = spans_of(np.concatenate((u.start[unit_hit], start[hit])), np.concatenate((u.end[unit_hit] + LENGTH - 1, start[hit] + LENGTH)))
    out = [_hit_row(block, spans)] if spans.shape[1] else []
    # what goes on: runs without their hits, of anchors that other blocks have
    away = total[a.which] > 0 if len(a.which) else np.zeros(0, bool)
    gone = np.sort(start[hit & away[which]]) if len(start) else start
    run, at = windows_of(a.head[away], a.tail[away]) if away.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keep = ~_member(at, gone)
    run, at = run[keep], at[keep]
    if len(at):
        new = np.append(True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        own = np.flatnonzero(away)[run[head]]
        groups = -(-total[a.which[own]] // most)
        place = c.mix(a.doc[own].view(c.U64) ^ c.mix(at[head].astype(c.U64))) % groups.astype(c.U64)
        key = c.mix(a.code[own] + place * c._M2)
        out += _run_rows(np.full(len(own), block), key, groups, a.doc[own], at[head], at[tail] - at[head] + LENGTH, b.data, at[head], ranges)
    return pa.Table.from_batches([_rows(*_MOVED, out)])


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _judged(batches: Iterator[pa.RecordBatch], ranges: int, again: bool) -> Iterator[pa.RecordBatch]:
    """In order of range: hits pass; the runs of each range are sorted. What is first in one of several groups goes on by its window."""
    for where, rows in pk.grouped(batches):
        if where < 0:
            yield from rows.select(_MOVED[0]).to_batches()
            continue
        n, keys, docs, owners, at, size, text = (rows.column(x).to_pylist() for x in ("n", "keys", "docs", "owners", "at", "size", "bytes"))
        key = np.concatenate([pk.from_steps(x, m) for x, m in zip(keys, n, strict=True)])
        doc = np.concatenate([pk.restored(x, m, np.int64) for x, m in zip(docs, n, strict=True)])
        pos = np.concatenate([pk.restored(x, m, np.int64) for x, m in zip(at, n, strict=True)])
        more = np.concatenate([pk.restored(x, m, np.uint32) for x, m in zip(size, n, strict=True)])
        block = np.concatenate([pk.restored(x, m, np.int32) for x, m in zip(owners, n, strict=True)])
        length = (more >> np.uint32(1)).astype(np.int64)
        data = np.frombuffer(b"".join(map(zstandard.decompress, text)), np.uint8)
        base = np.cumsum(length) - length
        order = np.argsort(key, kind="stable")
        count = np.cumsum((length - LENGTH + 1)[order])
        edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        found: list[tuple[np.ndarray, ...]] = []
        x = 0
        while x < len(order):  # as many whole keys as are sorted at once
            most = (count[x - 1] if x else 0) + SORT_WINDOWS
            k = int(np.searchsorted(edge, x, "right"))
            while k < len(edge) and count[edge[k] - 1] <= most and (k + 1 == len(edge) or count[edge[k + 1] - 1] <= most):
                k += 1
            y = int(edge[k]) if k < len(edge) else len(order)
            runs = order[x:y]
            which, start = windows_of(base[runs], base[runs] + length[runs] - LENGTH)
            which = runs[which]
            hit = previous_factors(data, start, doc[which]) >= LENGTH
            found.append((which, start, hit))
            x = y
        which, start, hit = (np.concatenate(z) for z in zip(*found, strict=True))
        spot, owner = pos[which] + start - base[which], block[which]
        out = []
        order = np.argsort(owner[hit], kind="stable")
        mine, place = owner[hit][order], spot[hit][order]
        edge = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(mine)], strict=True) if len(edge) else ():
            out.append(_hit_row(int(mine[i]), spans_of(place[i:j], place[i:j] + LENGTH)))
        rest = np.flatnonzero(~hit & ((more[which] & np.uint32(1)) > 0))
        if not again and len(rest):
            ones = np.ones(len(rest), np.int64)
            out += _run_rows(owner[rest], window_hashes(data, start[rest]), ones, doc[which[rest]], spot[rest], ones * LENGTH, data, start[rest], ranges)
        yield _rows(*_MOVED, out)


def _removed(docs: pa.Table, hits: pa.Table, texts_too: bool) -> pa.Table:
    b = Block(docs.column("docs"))
    start = [pk.restored(x, m, np.int64) for x, m in zip(hits.column("at").to_pylist(), hits.column("n").to_pylist(), strict=True)]
    size = [pk.restored(x, m, np.int64) for x, m in zip(hits.column("size").to_pylist(), hits.column("n").to_pylist(), strict=True)]
    start = np.concatenate(start) if start else np.zeros(0, np.int64)
    size = np.concatenate(size) if size else start
    # stretches of neighbouring texts may have been joined: cut at the texts' ends, and joined again with a gap between texts
    first, last = b.row(start), b.row(start + size - 1)
    owner = np.repeat(first, last - first + 1)
    owner += np.arange(len(owner)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
    start, end = np.maximum(np.repeat(start, last - first + 1), b.at[owner]), np.minimum(np.repeat(start + size, last - first + 1), b.at[owner + 1])
    some = start < end
    a, z = spans_of((start + owner)[some], (end + owner)[some])
    row = np.searchsorted(b.at + np.arange(len(b.at)), a, "right") - 1
    a, z = a - row - b.at[row], z - row - b.at[row]
    cut = np.searchsorted(row, np.arange(len(b.at)))
    out = []
    for i in range(len(b.at) - 1):
        text, p, q = b.data[b.at[i] : b.at[i + 1]], a[cut[i] : cut[i + 1]].tolist(), z[cut[i] : cut[i + 1]].tolist()
        kept = b"".join([text[x:y].tobytes() for x, y in zip([0, *q], [*p, len(text)], strict=True)])
        out.append((len(text), len(text) - len(kept), len(p), hashlib.sha256(kept).hexdigest(), [x << 32 | y for x, y in zip(p, q, strict=True)], kept if texts_too else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
    cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.table([b.rows.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def substring_dedup(docs: DataFrame, kept_bytes: bool = False, block_bytes: int = BLOCK_BYTES, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start * 2**32 + end) and, if asked for, the kept bytes."""
    parts = c.shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, ranges = pk.number(total, block_bytes, parts), pk.number(total, RANGE_BYTES, parts)
    # the texts are shuffled once; the four uses below share that exchange
    dealt = pk.dealt(docs, blocks, parts)

    def met(sent: DataFrame, judge: object) -> DataFrame:
        return sent.repartitionById(parts, "range").sortWithinPartitions("range").mapInArrow(judge, ANSWER).repartitionById(parts, "block")

    def with_answers(answers: DataFrame, step: object, ddl: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, ddl)

    one = met(dealt.sortWithinPartitions("block").mapInArrow(lambda it: _units_sent(it, ranges), SENT), _units_met)
    two = met(with_answers(one, lambda x, y: _anchors_sent(x, y, ranges), SENT), _anchors_met)
    both = one.unionByName(two).repartitionById(parts, "block")
    runs = with_answers(both, lambda x, y: _runs_sent(x, y, ranges, group_runs), MOVED)
    for again in (False, True):
        moved = runs.repartitionById(parts, "dest").sortWithinPartitions("range").select("range", "dest", *_MOVED[0][2:])
        runs = moved.mapInArrow(lambda it, again=again: _judged(it, ranges, again), MOVED)
    hits = runs.select("block", "n", "at", "size").repartitionById(parts, "block")
    return with_answers(
        hits, lambda x, y: _removed(x, y, kept_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true)::INT AS new FROM hit),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS z FROM k GROUP BY 1, 2),
parts AS (SELECT spans.doc_id, a, z, substr(h, 2 * coalesce(lag(z) OVER o, 0) + 1, 2 * (a - coalesce(lag(z) OVER o, 0))) AS before, h FROM spans JOIN d USING (doc_id) WINDOW o AS (PARTITION BY spans.doc_id ORDER BY a)),
kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h FROM parts GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def brute(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract with a table of all strings, for tests."""
    least: dict[bytes, int] = {}
    raw = [(d, (x or "").encode()) for d, x in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)
