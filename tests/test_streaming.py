from datetime import datetime, timedelta

import pytest

from proofbase.streaming import events as streams

DDL = "event_id long, user_id long, ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1)


def rows():
    return [(i, i % 3, START + timedelta(minutes=7 * i), "view" if i % 2 else "click", float(i)) for i in range(60)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, folder):
    batch = spark.read.parquet(folder)
    stream = streams.read_stream(spark, folder, batch.schema, "*.parquet")
    got = streams.run_available(streams.tumbling(stream, "1 hour"), "hourly")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(streams.tumbling(batch, "1 hour"))


def test_append_once_is_idempotent(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 2, "b")], "run_id string, seq int, note string")
    write = streams.append_once(str(tmp_path / "log"))
    write(log, 0)
    write(log, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_sessions_split_at_the_gap(spark):
    late = [(100, 0, START + timedelta(hours=20), "view", 1.0)]
    found = streams.sessions(spark.createDataFrame([r for r in rows() if r[1] == 0] + late, DDL))
    assert sorted(r["n"] for r in found.collect()) == [1, 20]


def test_append_once_reads_only_the_runs_of_the_batch(spark, tmp_path):
    ddl, folder = "run_id string, seq int, note string", str(tmp_path / "log")
    write = streams.append_once(folder)
    write(spark.createDataFrame([("1", 1, "a"), ("2", 1, "b")], ddl), 0)
    write(spark.createDataFrame([("2", 1, "b"), ("2", 2, "c"), ("3", 1, "d")], ddl), 1)
    found = spark.read.schema(ddl).parquet(folder).collect()
    assert sorted((r["run_id"], r["seq"]) for r in found) == [("1", 1), ("2", 1), ("2", 2), ("3", 1)]
    # as many folders as buckets at most, whatever the number of runs
    write(spark.createDataFrame([(str(i), 9, "e") for i in range(300)], ddl), 2)
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("_bucket=")]) <= 64
    assert spark.read.schema(ddl).parquet(folder).count() == 304


def test_liveness_emits_silent_runs(spark, tmp_path):
    """Event time that other runs advance past a run's last heartbeat by two minutes and the watermark."""
    rows = [(1, 1, START, "beat", 0.0), (2, 2, START + timedelta(hours=3), "beat", 0.0), (3, 2, START + timedelta(hours=6), "beat", 0.0)]
    folder = str(tmp_path / "beats")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for r in rows:
            spark.createDataFrame([r], DDL).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.read_stream(spark, folder, spark.read.parquet(folder).schema, "*.parquet")
        found = streams.run_available(streams.liveness(stream), "silent", "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert (1, "interrupted") in {(r["user_id"], r["status"]) for r in found}


def calls_and_results():
    calls = [(f"r{i % 4}", i, START + timedelta(minutes=5 * i)) for i in range(80)]
    late = [("r0", 900, START + timedelta(days=3)), ("r1", 901, START + timedelta(days=4))]
    results = [(r, c, ts + timedelta(minutes=c % 14)) for r, c, ts in calls if c % 3] + [("r9", 5, START), ("r0", 900, START + timedelta(days=3)), ("r1", 901, START + timedelta(days=4))]
    return calls + late, results


CALL_DDL = "run_id string, call_id long, ts timestamp"


def test_calls_meet_their_results_across_restarts(spark, tmp_path):
    """A stream that is ended in the middle and started again gives the rows of the batch."""
    calls, results = calls_and_results()
    want = sorted(map(tuple, streams.answered(spark.createDataFrame(calls, CALL_DDL), spark.createDataFrame(results, CALL_DDL)).collect()), key=str)
    for name, rows in (("calls", calls), ("results", results)):
        (tmp_path / name).mkdir()

    def feed(k):
        # files come in order of time, in five goes
        for name, rows in (("calls", calls), ("results", results)):
            part = sorted(rows, key=lambda r: r[2])[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
            spark.createDataFrame(part, CALL_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        schema = spark.createDataFrame([], CALL_DDL).schema
        a, b = (streams.read_stream(spark, str(tmp_path / n), schema, "*.parquet") for n in ("calls", "results"))
        return streams.run_into(streams.answered(a, b), str(tmp_path / "out"))

    for k in range(5):
        feed(k)
        found = run()
    got = sorted(map(tuple, found.collect()), key=str)
    assert len(got) == len(set(got)) and set(got) <= set(want)
    # only what the watermark has not passed yet is still held back
    missing = [r for r in want if r not in set(got)]
    assert all(r[1] >= 900 and r[3] is None for r in missing)
    assert sum(r[3] is None for r in got) > 30 and sum(r[3] is not None for r in got) > 30


def test_catalogue_as_a_stream(spark, tmp_path):
    """Each page is read once across restarts; a table that changes under the stream fails the batch."""
    import json

    from proofbase.sources import catalogue

    def answer(rows):
        (tmp_path / "t.json").write_text(json.dumps({"fields": [{"id": "_id", "type": "int"}, {"id": "name", "type": "text"}], "records": rows}))

    def run():
        stream = spark.readStream.format("catalogue").option("resource", "t").option("page_rows", "3").load(str(tmp_path))
        return sorted(tuple(r) for r in streams.run_into(stream, f"{tmp_path}/out").collect())

    catalogue.register(spark)
    rows = [{"_id": i, "name": f"n{i}"} for i in range(1, 8)]
    answer(rows)
    assert run() == [(i, f"n{i}") for i in range(1, 8)]
    # what was read is not read again, even if it would differ now
    answer([r | {"name": "changed"} for r in rows] + [{"_id": i, "name": f"n{i}"} for i in range(8, 12)])
    assert run() == [(i, f"n{i}") for i in range(1, 12)]
    assert run() == [(i, f"n{i}") for i in range(1, 12)]
    more = [{"_id": i, "name": f"n{i}"} for i in range(1, 12)]
    for broken in (more + [{"_id": 11, "name": "again"}], more[:5]):
        answer(broken)
        with pytest.raises(Exception, match="drift"):
            run()
        assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 11
