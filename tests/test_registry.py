"""Every registered query against its SQL twin."""

import math
import os

import duckdb
import pytest

from gridloom.plans import audio, documents, records, regions  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return repr(x)

    return sorted(tuple(map(cell, r)) for r in rows)


KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS.get(k, k) for c, k in got.dtypes} == kinds
    rows = comparable(got.select(*columns).collect())
    expected = comparable(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(rows) == len(expected)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
