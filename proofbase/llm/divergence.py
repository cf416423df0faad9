"""Source divergence audit by integer-dictionary encoding.

Each language's kept terms (those in at least MIN_DOCS of its documents) are sorted by their UTF-8
bytes and cut into chunks. Within a chunk a term's id is its place, found by binary search, and a
group's occurrences are one dense vector, a bincount over the ids. Ids follow the order of the
bytes, so (chunk, id) breaks ties as the terms would, and only the ten terms a group reports are
turned back into text.

Vectors of two sources meet in tiles of at most about BLOCK sources a side and one chunk, so no task
holds a whole vocabulary or all sources; sums over chunks are ordinary aggregation. Chunks are cut
at terms chosen by their hash, on average every `CHUNK` terms (more with over CHUNK * MOST_CUTS
terms, so that at most about MOST_CUTS cuts of CUT_BYTES bytes are sent to the tasks).

All values are exact integers: proportions in parts of a thousand million, by long division.

Defined cases: null text, lang and source are read as ''; a language with no kept term has pairs of
value 0 and no terms; repeated rows and ids are documents of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofbase.llm import common as c
from proofbase.llm import strings as st

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
CHUNK, MOST_CUTS, CUT_BYTES, BLOCK = 1024, 65_536, 64, 64
#: Bytes of text whose terms are counted at once.
TEXT_BYTES = 6 << 20

TERMS = np.zeros(256, bool)
TERMS[0x41:0x5B] = TERMS[0x61:0x7B] = TERMS[0x80:] = True

_COUNTED = "lang string, source string, term string, n long, docs long"
_ROUTED = "lang string, source string, term string, n long, chunk int, block int, blocks int"
_DICTIONARY = "lang string, chunk int, blocks int, terms array<string>, totals array<bigint>"
_ENCODED = "lang string, source string, chunk int, block int, blocks int, counts array<bigint>, n long"
_FOUND = "lang string, source string, item string, value long, chunk int, id int"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _table(ddl: str, columns: list) -> pa.Table:
    return pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(columns, _arrow(ddl), strict=True)], schema=_arrow(ddl))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, occurrences, documents) of each stretch, and one without a term for each group that it has."""
    for t in c.texts(batches, "text", TEXT_BYTES):
        data = c.LOWER[t.data]
        inside = TERMS[data]
        start = np.flatnonzero(st.begins(inside, t.at))
        term, terms = st.encoded(st.cut(data, inside, start))
        row = np.searchsorted(t.at, start, "right") - 1
        lang, langs = st.encoded(t.rows.column(1))
        source, sources = st.encoded(t.rows.column(2))
        groups, group = np.unique(lang * len(sources) + source, return_inverse=True)
        width = max(1, len(terms))
        once, times = np.unique(row * width + term, return_counts=True)  # a document's term
        key, place = np.unique(group[once // width] * width + once % width, return_inverse=True)
        n = np.bincount(place, times, len(key)).astype(np.int64)
        docs = np.bincount(place, minlength=len(key)).astype(np.int64)
        of = np.concatenate([groups[key // width], groups])
        named = pa.concat_arrays([terms.take(pa.array(key % width)), pa.nulls(len(groups), terms.type)]).cast(pa.string())
        none = np.zeros(len(groups), np.int64)
        yield from _table(_COUNTED, [langs.take(pa.array(of // len(sources))).cast(pa.string()), sources.take(pa.array(of % len(sources))).cast(pa.string()), named, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))]).to_batches()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms, with a row without a term for each group."""
    own = docs.select(*[F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")).alias(x) for x in ("text", "lang", "source")])
    return own.mapInArrow(_counted, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _short(terms: pa.Array) -> np.ndarray:
    """The first bytes of each term; they sort as the terms do, but for ties."""
    return np.array(terms.cast(pa.binary()).to_pylist(), f"S{CUT_BYTES}")


class Router:
    """The chunk of a term and the block of a source, alike for the dictionary and the counts."""

    def __init__(self, cuts: dict[str, np.ndarray], blocks: dict[str, int]):
        self.cuts, self.blocks = cuts, blocks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(batch.column(0)).to_pylist():
                rows = table.filter(pc.equal(table.column("lang"), lang))
                cuts, blocks = self.cuts.get(lang), self.blocks.get(lang, 1)
                source, sources = st.encoded(rows.column("source"))
                block = np.array([xxhash.xxh64_intdigest(x.encode()) % blocks for x in sources.to_pylist()], np.int32)[source]
                bare = pc.is_null(rows.column("term")).to_numpy()
                chunk = np.zeros(len(rows), np.int32)
                if cuts is not None:
                    term, terms = st.encoded(rows.column("term").fill_null(""))
                    chunk = np.searchsorted(cuts, _short(terms), "right").astype(np.int32)[term]
                # a group's row without a term goes to every chunk: the group has a vector there, of zeros at least
                times = np.where(bare, 1 + (0 if cuts is None else len(cuts)), 1)
                at = np.repeat(np.arange(len(rows)), times)
                within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                chunk = np.where(bare[at], within, chunk[at]).astype(np.int32)
                rows = rows.take(pa.array(at))
                yield from _table(_ROUTED, [rows.column("lang"), rows.column("source"), rows.column("term"), rows.column("n"), pa.array(chunk), pa.array(block[at]), pa.array(np.full(len(at), blocks, np.int32))]).to_batches()


def _dictionary(key: tuple, rows: pa.Table) -> pa.Table:
    """A chunk's terms in the order of their bytes, with the language's occurrences."""
    terms = np.array(rows.column("term").cast(pa.binary()).to_pylist(), object)
    order = pa.array(np.argsort(terms, kind="stable"))
    return _table(_DICTIONARY, [[key[0].as_py()], [key[1].as_py()], rows.column("blocks").slice(0, 1), [rows.column("term").take(order).to_pylist()], [rows.column("n").take(order).to_pylist()]])


def _encode(key: tuple, dictionary: pa.Table, rows: pa.Table) -> pa.Table:
    """One dense vector of the chunk for each source of the block."""
    if not rows.num_rows:
        return _arrow(_ENCODED).empty_table()
    kept = np.array([x.encode() for x in dictionary.column("terms")[0].as_py()], object) if dictionary.num_rows else np.zeros(0, object)
    source, sources = st.encoded(rows.column("source"))
    vectors = np.zeros((len(sources), len(kept)), np.int64)
    named = ~pc.is_null(rows.column("term")).to_numpy()
    if named.any() and len(kept):
        term, terms = st.encoded(rows.column("term").filter(pa.array(named)))
        sought = np.array(terms.cast(pa.binary()).to_pylist(), object)
        ids = np.minimum(np.searchsorted(kept, sought), len(kept) - 1)
        found = (kept[ids] == sought).astype(bool)
        hit = found[term]
        # counts are whole numbers of up to 63 bits, so they are added as such
        np.add.at(vectors, (source[named][hit], ids[term][hit]), rows.column("n").to_numpy()[named][hit])
    n, k = len(sources), len(kept)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(vectors.ravel()))
    return _table(_ENCODED, [[key[0].as_py()] * n, sources.cast(pa.string()), [key[1].as_py()] * n, [key[2].as_py()] * n, [rows.column("blocks")[0].as_py()] * n, flat, vectors.sum(1)])


def proportions(vectors: np.ndarray, totals: np.ndarray, width: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (N + 2 V)), by long division in thousands, so that nothing overflows."""
    whole = (totals + 2 * width)[:, None]
    q, rest = np.divmod(vectors + 2, whole)
    for _ in range(3):
        rest = rest * 1000
        q = q * 1000 + rest // whole
        rest = rest % whole
    return q + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of divergences of the tile's pairs of sources over the chunk; in a block's own tile also the ten best terms of each of its sources."""
    lang, chunk, low, high = (k.as_py() for k in key)
    whole = pc.is_null(rows.column("source")).to_numpy()
    block = rows.column("block").to_numpy()
    counts = np.array(rows.column("counts").combine_chunks().flatten().to_numpy(), np.int64).reshape(rows.num_rows, -1)
    names = rows.column("source").to_pylist()
    width = rows.column("width")[0].as_py()
    out: list[tuple] = []
    if counts.shape[1]:
        p = proportions(counts, rows.column("total").to_numpy(), width)
    else:
        p = np.ones_like(counts)
    left, right = np.flatnonzero(~whole & (block == low)), np.flatnonzero(~whole & (block == high))
    for k, i in enumerate(left):
        others = right[k + 1 :] if low == high else right
        values = divergences(p[i], p[others]).sum(1)
        for j, v in zip(others, values.tolist(), strict=True):
            out += [(names[i], names[j], v, None, None), (names[j], names[i], v, None, None)]
    if low == high and whole.any() and counts.shape[1]:
        q = p[np.flatnonzero(whole)[0]]
        for i in left:
            ids = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = divergences(p[i][ids], q[ids])
            best = np.lexsort((ids, -values))[:TOP]
            out += [(names[i], None, v, chunk, x) for v, x in zip(values[best].tolist(), ids[best].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return _table(_FOUND, [[lang] * len(out), *columns])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from each other source's (`pair`), and the terms that set it apart from its language (`term`)."""
    counted = c.stored(counts(docs))
    kept = c.stored(counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).drop("docs"))
    every = max(chunk, kept.count() // MOST_CUTS)
    # about one term in `every` is a cut: MOST_CUTS short strings at most, whatever the vocabulary
    chosen = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(every)) == 0).select("lang", F.substring(F.encode("term", "utf-8"), 1, CUT_BYTES).alias("cut"))
    cuts: dict[str, list[bytes]] = {}
    for r in chosen.distinct().collect():
        cuts.setdefault(r["lang"], []).append(bytes(r["cut"]))
    # languages of more than one block of sources only
    wide = counted.where("term is null").groupBy("lang").count().where(F.col("count") > block).collect()
    router = Router({x: np.sort(np.array(v, f"S{CUT_BYTES}")) for x, v in cuts.items()}, {r["lang"]: -(-r["count"] // block) for r in wide})

    routed_terms = kept.select("lang", F.lit("").alias("source"), "term", "n").mapInArrow(router, _ROUTED)
    dictionary = c.stored(routed_terms.groupBy("lang", "chunk").applyInArrow(_dictionary, _DICTIONARY))
    per_block = dictionary.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    routed = counted.select("lang", "source", "term", "n").mapInArrow(router, _ROUTED)
    vectors = c.stored(per_block.groupBy("lang", "chunk", "block").cogroup(routed.groupBy("lang", "chunk", "block")).applyInArrow(_encode, _ENCODED))

    langs = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).alias("width"), F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    widths = langs.select(F.col("lang").alias("_l"), "width")
    groups = vectors.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("n").alias("total"))
    sized = groups.join(widths, "_l", "left").select("_l", "_s", "total", F.coalesce("width", F.lit(0)).alias("width"))
    own = vectors.join(sized, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).drop("_l", "_s", "n")
    tiled = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = per_block.join(langs.withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l")).select(
        "lang", F.lit(None).cast("string").alias("source"), "chunk", "block", "blocks", F.col("totals").alias("counts"), "total", "width", F.col("block").alias("other")
    )
    tiles = tiled.unionByName(whole).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    found = c.stored(tiles.groupBy("lang", "chunk", "low", "high").applyInArrow(_tile, _FOUND))

    pairs = found.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = found.where("item is null").withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id"))).where(F.col("rank") <= TOP)
    spelt = best.drop("item").join(dictionary.select(F.col("lang").alias("_l"), F.col("chunk").alias("_c"), "terms"), (F.col("lang") == F.col("_l")) & (F.col("chunk") == F.col("_c")))
    terms = spelt.withColumn("item", F.element_at("terms", F.col("id") + 1))
    names = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return names(ranked, "pair").unionByName(names(terms, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS q FROM kept WINDOW w AS (PARTITION BY lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
