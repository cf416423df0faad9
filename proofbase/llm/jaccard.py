"""Exact n-gram Jaccard self-join with set-relation skipping.

1. A pass over the texts gives each document's set of word shingles as hashes, its size and a
   64-bit class key; equal sets are one class, are joined once, and share all answers.
2. Candidates. How many classes hold a shingle is counted exactly, by blocks of documents and
   ranges of hashes (see packed). Two linked sets of n shingles at most have all but a few in
   common, so their rarest n - ceil(threshold * n) + 1 shingles, in one order for all sets, have
   one in common. Only these are indexed, and of them only those that a second class holds: text
   that many unlike documents share is in no index, as each of them has rarer shingles. A list
   of the index is cut where sizes are too far apart to be linked, and its stretches are chained.
3. Sets that are chained, directly or through others, form a candidate group; a group holds
   all of its members' links. Groups are joined in blocks of bounded size. Within one, lists
   are in size order and whole stretches whose sizes can't reach the threshold are skipped by
   position; a set's overlaps come from those of a set already found similar, by walking only
   the lists of the shingles in which the two differ.
4. A group of several blocks is cut in two independent ways, which joins its dense parts; the
   sets that stay outside its main component are then compared with every block (exact rest).
   That is many only where many sets have nearly the threshold's share of their shingles in
   common with each other, and less than it is linked.

Defined cases: doc_id is an integer; null or empty texts have an empty set, linked with nothing,
component = doc_id; repeated rows and equal sets share a component, whatever their ids; a row
without doc_id takes part, and its component has the least doc_id that there is, null if none;
an empty table gives no rows; only doc_id and text are read, so clashing extra columns do not
matter. Class keys are 64-bit hashes of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbase.llm import common as c
from proofbase.llm import packed as pk
from proofbase.llm.graph import components

#: Words of a shingle and the least similarity, NUM of DEN, by the contract of op8.
SIZE, NUM, DEN = 4, 85, 100
#: The same for the corpus pipeline's stage.
STAGE = (5, 80, 100)
#: Bytes of text in a block, and of text for each hash range, at most.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Sets of a candidate group that are joined in one block.
BLOCK_SETS = 128


def shingles(t: c.Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both."""
    w = c.words(t, c.SPACE_WORDS, lower=True)
    ok = c.whole_windows(w, size)
    code, row = c.grams(w.code, size)[ok], w.row[: len(ok)][ok]
    n = np.diff(w.first)
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            at = w.first[short]
            whole = c.mix(np.add.reduce([w.code[at + i] * c.U64(c._GRAM[i]) for i in range(k)], axis=0) + c.U64(k))
            code, row = np.concatenate((code, whole)), np.concatenate((row, short))
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    fresh = c.distinct(row, code)
    return row[fresh], code[fresh]


def class_keys(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, class key, first token) of each of n rows."""
    first = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(first)
    mixed = np.concatenate((np.zeros(1, c.U64), np.cumsum(c.mix(code + c._M2), dtype=c.U64)))
    return size, c.mix(mixed[first[1:]] - mixed[first[:-1]] + size.astype(c.U64)), first


def _class_batches(batches: Iterator[pa.RecordBatch], words: int = SIZE) -> Iterator[pa.RecordBatch]:
    """Rows with text -> rows with n (the set's size) and key instead."""
    for t in c.texts(batches):
        row, code = shingles(t, words)
        size, key, _ = class_keys(row, code, len(t))
        names = [x for x in t.rows.schema.names if x != "text"]
        cols = [t.rows.column(t.rows.schema.get_field_index(x)) for x in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), c.signed(key)], names=[*names, "n", "key"])


class Sets:
    """The sets of a block that lead their classes: token[first[i]:first[i + 1]] of keys[i], sorted."""

    def __init__(self, blobs: pa.ChunkedArray, wanted: np.ndarray, words: int):
        rows = pk.rows_of(blobs, pa.int64()).select(["text"]).combine_chunks()
        seen, keys, sizes, tokens = np.sort(wanted), [], [], []
        got: set[int] = set()
        for t in c.texts(iter(rows.to_batches())):
            row, code = shingles(t, words)
            size, key, first = class_keys(row, code, len(t))
            key = key.view(np.int64)
            for i in np.flatnonzero((size > 0) & np.isin(key, seen)).tolist():
                if (k := int(key[i])) not in got:
                    got.add(k)
                    keys.append(k)
                    sizes.append(int(size[i]))
                    tokens.append(code[first[i] : first[i + 1]])
        self.keys, self.size = np.array(keys, np.int64), np.array(sizes, np.int64)
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, c.U64)
        self.first = np.concatenate(([0], np.cumsum(self.size))).astype(np.int64)


SENT = "range int, block int, n long, keys binary, more binary, sizes binary"
ANSWER = "block int, range int, n long, found binary, leads array<long>"


def _sent(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["range", "block", "n", "keys", "more", "sizes"])


def _leads(answers: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in answers.column("leads").drop_null().to_pylist())])


def _tokens_sent(docs: pa.Table, answers: pa.Table, words: int, ranges: int) -> pa.Table:
    """A block's distinct shingles with the number of its classes that hold them."""
    code, count = np.unique(Sets(docs.column("docs"), _leads(answers), words).token, return_counts=True)
    block, cut = docs.column("block")[0].as_py() if len(docs) else -1, pk.cuts(code, ranges)
    return _sent([(k, block, int(b - a), pk.steps(code[a:b]), pk.squeezed(count[a:b].astype(np.uint32)), None) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _tokens_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: of each block's shingles, the number of all classes that hold them."""
    for where, rows in pk.grouped(batches):
        blocks, n, keys, more = (rows.column(x).to_pylist() for x in ("block", "n", "keys", "more"))
        code = np.concatenate([pk.from_steps(x, m) for x, m in zip(keys, n, strict=True)])
        count = np.concatenate([pk.restored(x, m, np.uint32) for x, m in zip(more, n, strict=True)])
        _, spot = np.unique(code, return_inverse=True)
        total = np.bincount(spot, count).astype(np.uint64)[spot]
        at = np.cumsum([0, *n]).tolist()
        found = [pk.squeezed(total[i : i + m]) for m, i in zip(n, at[:-1], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([where] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))], names=["block", "range", "n", "found", "leads"])


def indexed(token: np.ndarray, first: np.ndarray, holders: np.ndarray, num: int, den: int) -> np.ndarray:
    """The places of the tokens to index: of each set its rarest n - ceil(num * n / den) + 1 in order of holders and hash, without those that no other set holds."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((token, holders, owner))
    place = np.arange(len(token)) - np.repeat(first[:-1], size)
    many = np.repeat(size + (-num * size // den) + 1, size)
    chosen = order[place < many]
    return chosen[holders[chosen] > 1]


def _entries_sent(docs: pa.Table, answers: pa.Table, words: int, num: int, den: int, ranges: int) -> pa.Table:
    """A block's index entries: shingle, class key and set size."""
    s = Sets(docs.column("docs"), _leads(answers), words)
    counts = answers.filter(pc.is_valid(pc.field("found"))).sort_by("range")
    parts = [pk.restored(x, m, np.uint64) for x, m in zip(counts.column("found").to_pylist(), counts.column("n").to_pylist(), strict=True)]
    _, which = np.unique(s.token, return_inverse=True)
    holders = np.concatenate(parts).astype(np.int64)[which] if parts else np.zeros(0, np.int64)
    at = indexed(s.token, s.first, holders, num, den)
    owner = np.searchsorted(s.first, at, "right") - 1
    order = np.argsort(s.token[at], kind="stable")
    code, key, size = s.token[at][order], s.keys[owner][order], s.size[owner][order].astype(np.uint32)
    block, cut = docs.column("block")[0].as_py() if len(docs) else -1, pk.cuts(code, ranges)
    return _sent([(k, block, int(b - a), pk.steps(code[a:b]), pk.squeezed(key[a:b]), pk.squeezed(size[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _chained(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """For each range: the sets of each list, in order of size, each with the next one if their sizes can be linked."""
    for _, rows in pk.grouped(batches):
        n, keys, more, sizes = (rows.column(x).to_pylist() for x in ("n", "keys", "more", "sizes"))
        code = np.concatenate([pk.from_steps(x, m) for x, m in zip(keys, n, strict=True)])
        key = np.concatenate([pk.restored(x, m, np.int64) for x, m in zip(more, n, strict=True)])
        size = np.concatenate([pk.restored(x, m, np.uint32) for x, m in zip(sizes, n, strict=True)]).astype(np.int64)
        order = np.lexsort((key, size, code))
        code, key, size = code[order], key[order], size[order]
        next_ = np.flatnonzero((code[1:] == code[:-1]) & (den * size[:-1] >= num * size[1:]))
        low, high = np.minimum(key[next_], key[next_ + 1]), np.maximum(key[next_], key[next_ + 1])
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        fresh = c.distinct(low, high) if len(low) else np.zeros(0, bool)
        low, high = low[fresh], high[fresh]
        for i in range(0, len(low), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(high[i : i + (1 << 16)]), pa.array(low[i : i + (1 << 16)])], names=["a", "b"])


def links(sets: list[np.ndarray], keys: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Edges that join the linked sets of one block: a forest with the components of its exact join."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, keys = [sets[i] for i in order], keys[order]
    size = np.array([len(s) for s in sets])
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(keys[0]), int(keys[1]))] if den * both >= num * (size.sum() - both) else []
    token, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    entries = np.sort(number * n + owner)  # the lists end to end, each in size order
    mine = np.split(number, np.cumsum(size)[:-1])

    def stretch(x: int, power: int = 1) -> tuple[int, int]:
        """The sets, by position in size order, whose sizes a chain of `power` links can reach."""
        least, most = size[x], size[x]
        for _ in range(power):
            least, most = -(-num * least // den), den * most // num
        return int(np.searchsorted(size, least, "left")), int(np.searchsorted(size, most, "right"))

    def walked(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of these tokens' lists hold each set of the stretch; the rest of a list is skipped by position."""
        start, end = np.searchsorted(entries, tokens * n + low), np.searchsorted(entries, tokens * n + high)
        length = end - start
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(entries[at] % n, minlength=n)

    free = np.ones(n, bool)
    edges: list[tuple[int, int]] = []
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed] = False
        todo: list[tuple] = [(seed, None)]
        while todo and free.any():
            x, known = todo.pop()
            low, high = stretch(x)
            if known and known[2] <= low and high <= known[3]:
                like, overlap, wide_low, wide_high = known
                gone, come = np.setdiff1d(mine[like], mine[x], True), np.setdiff1d(mine[x], mine[like], True)
                overlap = overlap + walked(come, wide_low, wide_high) - walked(gone, wide_low, wide_high)
            else:
                wide_low, wide_high = stretch(x, 2)
                overlap = walked(mine[x], wide_low, wide_high)
            near = low + np.flatnonzero(free[low:high] & (den * overlap[low:high] >= num * (size[x] + size[low:high] - overlap[low:high])))
            free[near] = False
            for y in near.tolist():
                edges.append((int(keys[x]), int(keys[y])))
                todo.append((y, (x, overlap, wide_low, wide_high)))
    return edges


def _joined(batches: Iterator[pa.RecordBatch], num: int = NUM, den: int = DEN) -> Iterator[pa.RecordBatch]:
    """Rows (grp, block, key, tokens) in order of (grp, block) -> edges of each block."""
    part: list[tuple[int, np.ndarray]] = []
    now = None
    out: list[tuple[int, int]] = []
    for batch in batches:
        grp, block, key = (batch.column(i).to_pylist() for i in range(3))
        col = batch.column(3)
        flat, at = col.flatten().to_numpy().view(c.U64), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False))))
        for i, where in enumerate(zip(grp, block, strict=True)):
            if where != now:
                if len(part) > 1:
                    out += links([s for _, s in part], np.array([k for k, _ in part], np.int64), num, den)
                part, now = [], where
            part.append((key[i], flat[at[i] : at[i + 1]].copy()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
            out = []
    if len(part) > 1 and (out := links([s for _, s in part], np.array([k for k, _ in part], np.int64), num, den)):
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _set_rows(docs: pa.Table, wanted: pa.Table, words: int) -> pa.Table:
    """A block and its members of candidate groups -> (grp, key, sets, tokens)."""
    s = Sets(docs.column("docs"), wanted.column("key").to_numpy(), words)
    order = np.argsort(wanted.column("key").to_numpy())
    rows = wanted.take(pa.array(order[np.searchsorted(wanted.column("key").to_numpy()[order], s.keys)]))
    tokens = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), c.signed(s.token))
    return pa.table([rows.column("grp"), pa.array(s.keys), rows.column("sets"), tokens], names=["grp", "key", "sets", "tokens"])


def _block_edges(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    return rows.select("grp", "block", "key", "tokens").repartition(parts, "grp", "block").sortWithinPartitions("grp", "block").mapInArrow(lambda it: _joined(it, num, den), "a long, b long")


def _blocks(n: str = "sets") -> F.Column:
    return F.ceil(F.col(n) / F.lit(BLOCK_SETS))


def similar_classes(docs: DataFrame, leads: DataFrame, blocks: int, ranges: int, words: int, num: int, den: int) -> DataFrame:
    """(node, root): the components of class keys under links between different sets; leads: (key, block), a block that has the class."""
    parts = c.shuffle_partitions(docs.sparkSession)
    dealt = pk.dealt(docs, blocks, parts)
    own = leads.groupBy("block").agg(F.collect_list("key").alias("leads"))  # of one block, so bounded with it
    none = [F.lit(None).cast("int").alias("range"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("found")]
    first = own.select("block", *none, "leads")
    at_home = lambda df: df.repartitionById(parts, "block").groupBy("block")
    at_range = lambda df: df.repartitionById(parts, "range").sortWithinPartitions("range")
    tokens = dealt.groupBy("block").cogroup(at_home(first)).applyInArrow(lambda x, y: _tokens_sent(x, y, words, ranges), SENT)
    counts = at_range(tokens).mapInArrow(_tokens_met, ANSWER)
    entries = dealt.groupBy("block").cogroup(at_home(first.unionByName(counts))).applyInArrow(lambda x, y: _entries_sent(x, y, words, num, den, ranges), SENT)
    groups = components(at_range(entries).mapInArrow(lambda it: _chained(it, num, den), "a long, b long"))
    count = c.stored(groups.groupBy("root").agg(F.count("*").alias("sets")))
    members = c.stored(groups.join(count, "root").select("node", F.col("root").alias("grp"), "sets"))
    wanted = members.join(leads, F.col("node") == F.col("key")).select("block", "key", "grp", "sets")
    sets = c.stored(pk.dealt(docs, blocks, parts).groupBy("block").cogroup(at_home(wanted)).applyInArrow(lambda x, y: _set_rows(x, y, words), "grp long, key long, sets long, tokens array<long>"))
    first = _block_edges(sets.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), _blocks())), parts, num, den)
    large = sets.where(F.col("sets") > BLOCK_SETS)
    second = _block_edges(large.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), _blocks())), parts, num, den)
    edges = c.stored(first.unionByName(second))
    if large.isEmpty():
        return components(edges)
    rest = _rest(large, components(edges), parts, num, den)
    return components(edges.unionByName(rest))


def _rest(large: DataFrame, joined: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Edges between sets outside their group's main component and any other, block by block: what the two cuts can have missed."""
    label = c.stored(large.select("grp", "key", "sets").join(joined, F.col("key") == F.col("node"), "left").select("grp", "key", "sets", F.coalesce("root", "key").alias("label")))
    sizes = label.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = c.stored(sizes.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most")))
    outside = c.stored(label.join(main, "grp").where(F.col("label") != F.col("main")).select("key", "grp", F.col("sets"), (F.col("sets") - F.col("most")).alias("outs")))
    if outside.isEmpty():
        return joined.sparkSession.createDataFrame([], "a long, b long")
    left = c.stored(outside.join(large.select("key", "tokens"), "key"))
    chunks = F.ceil(F.col("outs") / F.lit(BLOCK_SETS))
    one = left.select("grp", "key", "tokens", F.pmod(F.xxhash64("key", F.lit(3)), chunks).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), _blocks() - 1)).alias("i"))
    outs = c.stored(outside.groupBy("grp").agg(F.max("outs").alias("outs")))
    two = large.join(outs, "grp").select("grp", "key", "tokens", F.pmod(F.xxhash64("key", F.lit(1)), _blocks()).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("j"))
    # a set may be in both halves of a block: once is enough
    both = one.select("grp", "i", "j", "key", "tokens").unionByName(two.select("grp", "i", "j", "key", "tokens"))
    return _block_edges(both.withColumn("block", F.xxhash64("i", "j")), parts, num, den)


def jaccard(docs: DataFrame, words: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links between sets of `words`-word shingles that are num of den alike)."""
    if not 0 < num < den:
        raise ValueError("the threshold lies between 0 and 1")
    found, by_key = labelled(docs.select("doc_id", "text"), words, num, den)
    return found.join(by_key, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def labelled(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """docs without text but with n and key; and per key its component's label and smallest doc_id."""
    parts = c.shuffle_partitions(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, ranges = pk.number(total, BLOCK_BYTES, parts), pk.number(total, RANGE_BYTES, parts)
    placed = docs.withColumn("block", pk.block_of(blocks))
    found = c.stored(placed.mapInArrow(lambda it: _class_batches(it, words), c.extended(placed.drop("text").schema, "n long, key long")))
    classes = c.stored(found.where("n > 0").groupBy("key").agg(F.min("block").alias("block"), F.min("doc_id").alias("lead")))
    linked = similar_classes(docs, classes.select("key", "block"), blocks, ranges, words, num, den)
    rooted = c.stored(classes.join(linked, F.col("key") == F.col("node"), "left").select("key", "lead", F.coalesce("root", "key").alias("label")))
    least = c.stored(rooted.groupBy("label").agg(F.min("lead").alias("component_id")))
    return found, c.stored(rooted.join(least, "label").select(F.col("key").alias("_key"), "label", "component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id, and one only where rows are repeated. docs: a table as it is read from files, so its rows keep their numbers."""
    docs, own = c.hidden(docs, ("doc_id", "text"))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found, by_key = labelled(numbered.select("doc_id", "text", "_row"), *STAGE)
    first = found.where("n > 0").join(by_key, F.col("key") == F.col("_key")).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row")).alias("m"))
    kept = c.stored(first.select(F.col("m._row").alias("_kept")).unionByName(found.where("n = 0").select(F.col("_row").alias("_kept"))))
    return numbered.join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi").select(*own)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {SIZE} THEN list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS m FROM t GROUP BY 1)
SELECT n.doc_id, n::BIGINT AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id
"""


def brute(docs: list[tuple[int, str | None]], size: int = SIZE, num: int = NUM, den: int = DEN) -> list[tuple]:
    """The contract by comparing all pairs that share a shingle, for tests."""
    import re

    sets = {}
    for d, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    where: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    up = {d: d for d in sets}

    def top(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    for a in sorted(sets):
        for b in {b for g in sets[a] for b in where[g] if b > a}:
            both = len(sets[a] & sets[b])
            if den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), top(d)) for d, s in sets.items())
