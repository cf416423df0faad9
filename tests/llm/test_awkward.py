"""Null and repeated ids, ties, long texts and clashing columns in mixing, chat formatting and LM scoring."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from conftest import against_sql
from pyspark.sql import functions as F

from proofbase.llm import backoff, chat, mixing
from proofbase.llm.queries import ORACLE_SQL, QUERIES

DDL = "doc_id long, text string, lang string, source string"


def texts(seed=3):
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    rows = [(i, words(rng.randint(0, 40)), "en", "s") for i in range(40)]
    long = words(300_000)
    assert len(long) > 1 << 20
    return rows + [(None, rows[3][1], "en", "s"), (None, "other words here", None, None), (7, rows[7][1], "en", "s"), (7, "w1 w2 w3", "en", "s"), (90, None, "en", "s"), (91, "", "en", "s"), (92, "a\x0bb\x0cc\rd\te\nf", "en", "s"), (93, long, "en", "s")]


def scores_brute(rows):
    """Stupid backoff, each row scored by the counts of all others."""
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    every = [sum((grams(w, n) for w in docs), Counter()) for n in (1, 2, 3)]
    total = sum(map(len, docs))
    out = []
    for (i, *_), w in zip(rows, docs, strict=True):
        own = [grams(w, n) for n in (1, 2, 3)]
        left = lambda g, own=own: every[len(g) - 1][g] - own[len(g) - 1][g]
        x = 0.0
        for k in range(len(w)):
            a, b, c = tuple(w[k : k + 1]), tuple(w[max(0, k - 1) : k + 1]), tuple(w[max(0, k - 2) : k + 1])
            if k > 1 and left(c) and left(c[:2]):
                x += math.log(left(c) / left(c[:2]))
            elif k > 0 and left(b) and left(b[:1]):
                x += math.log(left(b) / left(b[:1])) + (k > 1) * math.log(0.4)
            elif left(a):
                x += math.log(left(a) / (total - len(w))) + min(k, 2) * math.log(0.4)
            else:
                x += min(k, 2) * math.log(0.4) - math.log(total - len(w) + 1)
        out.append((i, len(w), round(x, 3) if w else None))
    return out


def test_scores_of_awkward_rows(spark):
    # repeated (id, text) rows are one document apart from each other only by id, so none are in this table
    rows = [r for r in texts() if (r[0], r[1]) != (7, dict((a, b) for a, b, *_ in texts()[:40])[7])] + [(7, texts()[7][1], "en", "s")]
    df = spark.createDataFrame(rows, DDL).withColumns({"n_words": F.lit("clash"), "block": F.lit(1), "log_score": F.lit("clash")}).repartition(4)
    got = [(r["doc_id"], r["n_words"], None if r["log_total"] is None else round(r["log_total"], 3)) for r in backoff.lm_scores(df).collect()]
    key = lambda r: str(r[:2])
    want = sorted(scores_brute(rows), key=key)
    got = sorted(got, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) <= 1e-6 * max(1, abs(w[2])) + 2e-3)


def test_scoring_sql_parts_words_at_all_white_space(spark, tmp_path):
    rows = [(1, "a\x0bb\x0cc\rd\te\nf g", "en", "s"), (2, "a b c d e f g", "en", "s"), (3, "g f\x0ce", "en", "s")]
    spark.createDataFrame(rows, DDL).coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, str(tmp_path), QUERIES["op10_lm_scoring"], ORACLE_SQL["op10_lm_scoring"])
    assert got == want and len(got) == 3


def test_mixing_of_awkward_rows(spark):
    rows = texts()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, DDL).withColumns({"rate": F.lit("clash"), "tokens": F.lit("clash"), "p_good": F.lit("clash"), "quality": F.lit(5)}).repartition(3)
    found = mixing.mix(df, spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
    n = sorted(((r["doc_id"], r["tokens"]) for r in found), key=str)
    assert n == sorted(((i, len((t or "").split())) for i, t, *_ in rows), key=str)
    assert all(r["rate"] >= 0 and math.isclose(sum(r["p"]), 1, abs_tol=1e-6) for r in found)
    # equal texts have equal posteriors and rates
    same = [(r["p"][0], r["rate"]) for r in found if r["doc_id"] in (3, None) and r["tokens"] == len(rows[3][1].split())]
    assert len(same) == 2 and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(*same, strict=True))


@pytest.mark.parametrize("name", ["depth", "rank", "root", "leaf", "tree", "row", "extra"])
def test_chat_of_long_texts_and_clashing_columns(spark, name):
    long = "<|im_end|> é " * 90_000
    assert len(long) > 1 << 20
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "<\\|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(name, F.lit("clash"))
    found = {r["tree"]: r for r in chat.formatted(*chat.as_chain(df)).collect()}
    assert chat.read_back(found[1]["formatted"]) == [(r, t or "") for c, _, r, t in rows if c == 1] and chat.read_back(found[2]["formatted"]) == [("assistant", "<\\|im_end|>")]
    assert "".join(chat.unescaped(found[1]["formatted"][m["start"] : m["end"]]) for m in found[1]["mask"]) == long
