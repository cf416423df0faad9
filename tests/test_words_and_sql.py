"""Similar words against all pairs, and the readers as SQL table functions."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from proofbase.operators import fuzzy
from proofbase.sources import formats, functions_sql


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_similar_words_equal_all_pairs(spark, distance):
    rng = random.Random(6)
    words = {"", "a", "ab", "ba", "éa", "ß", "漢字", "🎉x"} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    long = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (9, 10, 11, 12, 40, 300, 2000)]
    for w in list(long) + rng.sample(sorted(words), 30):
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            words.add("".join(x))
    words |= set(long)
    asked = rng.sample(sorted(words), 60) + long + ["nothing like it at all"]
    df = lambda rows: spark.createDataFrame([(w,) for w in [*rows, *rows[:3], None]], "word string")
    got = {(r["asked"], r["word"], r["distance"]) for r in fuzzy.similar_words(df(asked), fuzzy.word_index(df(sorted(words))), distance).collect()}
    near = lambda a, b: edits(a, b) if abs(len(a) - len(b)) <= distance else 99
    assert got == {(a, b, d) for a in asked for b in words if (d := near(a, b)) <= distance}
    # a long word is a few rows of the index
    assert fuzzy.word_index(df(long)).count() == 3 * len(long)


def test_sections_in_sql_equal_the_call(spark):
    functions_sql.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    got = spark.sql("SELECT doc_id, s.section, s.section_text FROM {docs}, LATERAL sections(text) s", docs=docs).collect()
    want = docs.select("doc_id", F.posexplode(formats.sections(F.col("text")))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_files_in_sql(spark):
    functions_sql.register(spark)
    rows = [(1, "csv", b"a;b\n1;2\n\n3;4\n"), (2, "json", b'{"data": [{"x": 1}, {"x": null, "y": "z"}]}'), (3, "json", b"not json"), (4, "xlsx", b"no archive"), (5, "csv", None), (6, "csv", b"")]
    df = spark.createDataFrame(rows, "id int, kind string, content binary")
    got = sorted((r["id"], r["row_no"], r["cells"], bool(r["problem"])) for r in spark.sql("SELECT id, r.* FROM {df}, LATERAL file_records(kind, content) r", df=df).collect())
    assert got[:4] == [(1, 0, {"a": "1", "b": "2"}, False), (1, 1, {"a": "3", "b": "4"}, False), (2, 0, {"x": "1", "y": ""}, False), (2, 1, {"x": "", "y": "z"}, False)]
    assert [(i, n, p) for i, n, _, p in got[4:]] == [(3, None, True), (4, None, True)]


def test_profiles_merge_to_the_profile_of_the_whole(spark, tmp_path):
    from datetime import datetime, timedelta

    from proofbase.sources import profiles, snapshots

    rng = random.Random(2)
    rows = [(i, None if i % 10 == 0 else rng.gauss(50, 20), rng.choice(["x", "y", None, "é"]), datetime(2024, 1, 1) + timedelta(hours=i), [i % 3]) for i in range(20_000)] + [(1, float("nan"), "z", None, None)]
    df = spark.createDataFrame(rows, "id long, v double, s string, t timestamp, a array<int>")
    one = {r["column"]: r for r in profiles.merged(profiles.profile(df)).collect()}
    many = {r["column"]: r for r in profiles.merged(profiles.profile(df, [F.col("id") % 97])).collect()}
    for found in (one, many):
        assert {c: (r["n"], r["nulls"]) for c, r in found.items()} == {"id": (20_001, 0), "v": (20_001, 2000), "s": (20_001, sum(r[2] is None for r in rows)), "t": (20_001, 1), "a": (20_001, 1)}
        assert (found["s"]["low"], found["s"]["high"], found["id"]["low_number"], found["id"]["high_number"]) == ("x", "é", 0.0, 19_999.0)
        assert abs(found["id"]["distinct"] - 20_000) < 5 * 0.016 * 20_000 and found["s"]["distinct"] == 4 and found["a"]["distinct"] == 3
        values = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
        for q, v in zip(profiles.QUANTILES, found["v"]["quartiles"], strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.04
        assert found["s"]["quartiles"] is None and found["a"]["quartiles"] is None
    assert profiles.merged(profiles.profile(df.limit(0), [F.col("id")])).collect() == []

    folder = str(tmp_path)
    fields = [{"id": "_id", "type": "int"}, {"id": "name", "type": "text"}]
    for key, n in (("a", 50), ("b", 80)):
        snapshots.sync(spark.range(n).select(F.col("id").alias("_id"), F.concat(F.lit("n"), F.col("id") % 7).alias("name")), folder, key, "v1", fields, "now")
    stored = profiles.current(spark, folder)
    assert {(r["dataset"], r["column"], r["n"], r["distinct"]) for r in profiles.merged(stored, ["dataset"]).collect()} == {("a", "_id", 50, 50), ("a", "name", 50, 7), ("b", "_id", 80, 80), ("b", "name", 80, 7)}
    # what is stored is used: the rows are not read again
    for part in (tmp_path / "b" / "v1").glob("part-*"):
        part.unlink()
    assert {(r["column"], r["n"]) for r in profiles.merged(profiles.current(spark, folder)).collect()} == {("_id", 130), ("name", 130)}
