"""Every query of the package against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from phonora.plans import queries as plans
from phonora.session import TABLES

SF = "/root/testdata/sf0.001"

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    def plain(x):
        return round(x, 6) if isinstance(x, float) else list(x) if isinstance(x, list | tuple) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    want = con.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_turn_edits(spark):
    import pyarrow.parquet as pq

    turns = sorted(pq.read_table(f"{SF}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"]))
    got = {(r["conv_id"], r["turn"]): tuple(r)[2:] for r in plans.q56_turn_edits(spark, SF).collect()}
    pairs = [(a, b) for a, b in zip(turns, turns[1:], strict=False) if a["conv_id"] == b["conv_id"]]
    assert len(got) == len(pairs)
    for a, b in pairs:
        x, y = a["text"].split(), b["text"].split()
        i, d, s, c = got[a["conv_id"], a["turn"]]
        assert (s + d + c, i + s + c) == (len(x), len(y))
        if len(x) * len(y) < 3000:  # the table cell by cell
            row = list(range(len(y) + 1))
            for p in range(1, len(x) + 1):
                last, row[0] = row[0], p
                for q in range(1, len(y) + 1):
                    last, row[q] = row[q], min(row[q] + 1, row[q - 1] + 1, last + (x[p - 1] != y[q - 1]))
            assert row[-1] == i + d + s
