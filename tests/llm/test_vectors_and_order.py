"""Source divergence, embedding whitening and curve packing against brute force, on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from proofbase.llm import common, divergence, packing, whitening
from proofbase.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
DDL = "doc_id long, text string, lang string, source string"

# --- source divergence


def divergence_brute(rows, min_docs=10, top=10):
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted((w for w, n in Counter(w for d in mine for w in set(d[2])).items() if n >= min_docs), key=str.encode)

        def p(ws, kept=kept):
            n = Counter(w for w in ws if w in set(kept))
            total = sum(n.values())
            return n, [1 + floor(Fraction(10**9 * (n[w] + 2), total + 2 * len(kept))) for w in kept]

        f = lambda a, b: (a - b) ** 2 // (a + b)
        groups = {s: p([w for d in mine if d[1] == s for w in d[2]]) for s in {d[1] for d in mine}}
        _, q = p([w for d in mine for w in d[2]])
        for s, (n, own) in groups.items():
            pairs = [(-sum(map(f, own, other)), t.encode()) for t, (_, other) in groups.items() if t != s]
            terms = [(-f(a, b), w.encode()) for w, a, b in zip(kept, own, q, strict=True) if n[w] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(3)
    pool = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "ñ", "漢字", "zz" + "x" * 70 + "a", "zz" + "x" * 70 + "b", "ﬁ", "🎉"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "Z", None])
        rows.append((i, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [(1, "Same text, same id", "en", "a")] * 12 + [(None, None, "en", "empty"), (5, "", None, None), (6, "one two", "de", "x"), (7, "1 2 3", "de", "y"), (8, "a1b_c-d", "en", "a")]
    rows += [(200, "tie tie2 " + "wal " * 400_000, "en", "b")]
    return rows


@pytest.mark.parametrize(("chunk", "block"), [(4096, 64), (8, 2)])
def test_divergence(spark, chunk, block):
    # one chunk and block, and many of both
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, DDL).withColumns({"term": F.lit("clash"), "value": F.lit(1), "_l": F.lit(0)}).repartition(5)
    assert sorted(map(tuple, divergence.divergence(docs, chunk=chunk, block=block).collect())) == divergence_brute(rows)


def test_divergence_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], DDL)).collect() == []


def test_proportions_do_not_overflow():
    counts = np.array([[10**14, 0, 3]])
    total = counts.sum(1)
    assert divergence.proportions(counts, total, 3)[0].tolist() == [1 + floor(Fraction(10**9 * (int(n) + 2), int(total[0]) + 6)) for n in counts[0]]


# --- embedding whitening


def vectors():
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 40)) * np.linspace(0.1, 2, 40)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(900 + i, base[3]) for i in range(50)] + [(7, base[9]), (None, base[10]), (700, None), (701, [None] * 40), (702, [nan] * 40), (703, [1.0] * 39 + [inf]), (704, [0.5, -0.001]), (705, []), (706, [-0.0] * 40)]
    return rows


def whitened_brute(rows, components=4):
    d = max(len(v) for _, v in rows if v)
    x = [(i, [floor(256 * float(np.float32(e))) for e in v] + [0] * (d - len(v))) for i, v in rows if v is not None and all(e is not None and abs(e) < inf for e in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array([[e - s / n for e, s in zip(v, sums, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(m.T @ m / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, v in x:
        dev = sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True))
        centred = np.array([e - s / n for e, s in zip(v, sums, strict=True)])
        out.append((i, n, dev, centred @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()))
    return out


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "_x": F.lit(1), "note": F.col("vec_id")}).repartition(4)
    found = whitening.whiten(df).collect()
    assert found[0].__fields__ == ["vec_id", "embedding", "_x", "note", "whitened", "deviation", "n", "explained", "identity_error"]
    want = whitened_brute(rows)
    assert len(found) == len(want)
    key = lambda i, dev, w: (i is None, i, dev, round(abs(w[0]), 6))
    got = sorted(found, key=lambda r: key(r["vec_id"], r["deviation"], r["whitened"]))
    want = sorted(want, key=lambda r: key(r[0], r[2], r[3]))
    signs = np.sign(np.array(got[5]["whitened"]) * want[5][3])
    for g, w in zip(got, want, strict=True):
        assert (g["vec_id"], g["n"], g["deviation"]) == w[:3]
        assert np.allclose(np.array(g["whitened"]), w[3] * signs, atol=1e-9)
        assert np.allclose(g["explained"], w[4], rtol=1e-9)
        assert g["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 0, [None, None], [None, None], None)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and abs(r["explained"][0] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in line)


def test_whitening_of_nothing(spark):
    ddl = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [nan])], ddl)).collect() == []
    assert [(r["vec_id"], r["n"], r["whitened"]) for r in whitening.whiten(spark.createDataFrame([(1, []), (2, [])], ddl)).collect()] == [(1, 1, []), (2, 1, [])]


def test_wide_entries_have_exact_deviations(spark):
    rows = [(1, [2.0**20, 1.0]), (2, [-(2.0**20), 3.0]), (3, [2.0**52, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = {i: [int(256 * e) for e in v] for i, v in rows}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    exact = {i: sum((3 * v[k] - sums[k]) ** 2 for k in range(2)) for i, v in x.items()}
    assert got == {i: v if v < 1 << 63 else None for i, v in exact.items()}
    assert None in got.values()


def test_whitening_query(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/embeddings.parquet")
    want = {(i, k + 1): (n, dev, w[k], e[k]) for i, n, dev, w, e in whitened_brute(list(zip(*(table.column(c).to_pylist() for c in ("vec_id", "embedding")), strict=True))) for k in range(4)}
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, dev, w, e = want[r["vec_id"], r["component"]]
        sign = signs.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert (r["n"], r["deviation"]) == (n, dev) and abs(sign * w - r["whitened"]) < 1e-9 and abs(e - r["explained"]) < 1e-9 and r["identity_error"] < 1e-9


# --- packing

HARD = [
    None, "", "a", "It's don't l'eau 'tis DON'T", "é, è; ñ! ÀÉ Œuvre", "x×y a÷b", "abc<|endoftext|>def <|ENDOFTEXT|>", "12345 3,14 1a2b", "é, ,̸", "İstanbul ſ ŉ", "漢字 かな。.", "a b　c «bonjour» …. ---...",
    "\x01a\x1c b\x85c", "ﬁ ½ ² Ⅷ", "x" * 3000, "\n\n a \t b\r\nc\x0bd\x0c", "🎉🎉 a🎉, 'S 'LL", "Å K",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("whole", [False, True])
def test_pieces_encode_as_whole_texts(tokenizer, whole):
    made = packing.Encoder(PATH, whole)
    texts = [x or "" for x in HARD]
    for t in common.texts([pa.record_batch([pa.array(texts)], names=["text"])], "text"):
        ids, n = made(t.data, t.at)
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(n))] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(texts * 20).encode()
    parts = list(packing.stretches(np.frombuffer(long, np.uint8), 100))
    assert b"".join(x.tobytes() for x in parts) == long
    assert [i for x in parts for i in made(x, np.array([0, len(x)]))[0].tolist()] == tokenizer.encode(long.decode(), add_special_tokens=False).ids


def test_hilbert_key_is_a_curve():
    cube = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(cube, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(cube[np.argsort(key)], axis=0)).sum(1).max() == 1


def check_packed(rows, pieces, tokenizer, length):
    """Every id of every row lies in one piece, sequences are gapless, full or a power of two."""
    ids = [[*e.ids, 2] for e in tokenizer.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    wanted = Counter((i, tuple(x)) for (i, _), x in zip(rows, ids, strict=True))
    by_id = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        by_id[i].append(x)
    spans = defaultdict(list)
    for r in pieces:
        matching = [x for x in by_id[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert matching and r["length"] > 0
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in spans.values():
        end = 0
        for offset, n in sorted(placed):
            assert offset == end
            end += n
        assert end <= length and (end & (end - 1)) == 0
    assert sum(n for placed in spans.values() for _, n in placed) == sum(len(x) for x in ids)
    for i, x in ((k[0], k[1]) for k, n in wanted.items() if len(by_id[k[0]]) == 1):
        own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(x)


def as_pieces(df):
    out = []
    for s in df.collect():
        ids = np.frombuffer(s["input_ids"], "<u4")
        assert len(ids) == s["n_tokens"]
        out += [p.asDict() | {"sequence_id": s["sequence_id"], "ids_crc32": zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]].tobytes())} for p in s["pieces"]]
    return out


@pytest.mark.parametrize("length", [8, 4096])
def test_packing(spark, tokenizer, length, monkeypatch):
    rng = random.Random(8)
    # alike, unlike, repeated, null and long rows; parts are cut within documents too
    rows = [(i, x) for i, x in enumerate(HARD)] + [(100 + i, " ".join(rng.choice("the of and cat dog house".split()) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(500, "the same text " * 50)] * 40 + [(None, "no id"), (None, "no id"), (501, "word and word " * 25_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "key": F.lit(1)}).repartition(5)
    check_packed(rows, as_pieces(packing.pack(docs, PATH, length)), tokenizer, length)


def test_long_texts_go_in_stretches(spark, tokenizer):
    text = " ".join(f"word{i % 977}, it's {i}" for i in range(520_000))  # over two stretches
    assert len(text) > 2 * packing.TEXT_BYTES
    check_packed([(1, text), (2, "b")], as_pieces(packing.pack(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), PATH)), tokenizer, 4096)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_neighbours_are_alike(spark):
    """Documents of one language lie together far more often than by chance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    order = [r["doc_id"] for r in packing.tokenised(docs, PATH).orderBy("key", "salt").select("doc_id").collect()]
    together = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:], strict=False)])
    shares = np.array(list(Counter(lang.values()).values())) / len(lang)
    assert together > (shares**2).sum() + 0.15


def test_packing_query(spark, tokenizer):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    check_packed(rows, [r.asDict() for r in QUERIES["op13_curve_packing"](spark, SF).collect()], tokenizer, 4096)
