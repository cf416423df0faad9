from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from proofbase.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def norm(v):
    """Values of Spark and of the reference database in one form."""
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return norm(list(v.values()))
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return repr(v)


def against_sql(spark, sf_dir, build, sql):
    """(Spark's rows, SQL's rows), both sorted and in one form."""
    import duckdb

    con = duckdb.connect()
    for n in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {n[:-8]} AS SELECT * FROM '{sf_dir}/{n}'")
    df = build(spark, sf_dir)
    names = ",".join(f'"{x}"' for x in df.columns)
    want = con.sql(f"SELECT {names} FROM ({sql})").fetchall()
    return sorted(map(norm, map(tuple, df.collect()))), sorted(map(norm, want))
