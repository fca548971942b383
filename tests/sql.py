"""Compare a query with its SQL on the small tables."""

from pathlib import Path

import pytest


def rows(found, columns):
    plain = lambda v: v.asDict() if hasattr(v, "asDict") else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr([plain(v) for v in r]) for r in found), columns


def assert_equal(spark, query, sql, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    said = con.execute(sql)
    order = [d[0] for d in said.description]
    assert sorted(order) == names
    theirs = [[r[order.index(n)] for n in names] for r in said.fetchall()]
    ours = [[r[n] for n in names] for r in df.collect()]
    assert rows(ours, names) == rows(theirs, names)
