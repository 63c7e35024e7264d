"""Every query with an oracle gives the oracle's rows at the smallest scale that exercises it."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from binomia.plans import catalogue

DIR = "/root/testdata/sf0.001"


def _text(v) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(_text, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, DIR)
    order = sorted(df.columns)
    rows = sorted("|".join(map(_text, r)) for r in df.select(*order).collect())
    cur = oracle.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert rows == sorted("|".join(_text(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_summary_lists_every_excluded_paper(spark):
    q = catalogue.queries()
    row, papers = q["r7_summary"](spark, DIR).first(), q["p9_exclusion"](spark, DIR).collect()
    assert papers and len(papers) == row["excluded"]
    assert row["excluded_papers"].split(";") == [f"{p.doc_id}:{p.doi}:{p.title}:{p.unknown}" for p in sorted(papers)]
