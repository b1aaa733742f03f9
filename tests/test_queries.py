"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seqloom.plans import catalog

DATA = "/root/testdata/sf0.001"
QUICK = [n for n in sorted(catalog.oracle_sql()) if n.startswith(("a", "b2", "b3", "c2", "c6", "c7", "c9", "d1", "d2", "e"))]


def value(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, DATA)
    order = sorted(df.columns)
    con = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == order
    want = sorted(tuple(value(r[names.index(c)]) for c in order) for r in con.fetchall())
    assert sorted(tuple(value(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_batch_classification_keeps_reads_in_their_tasks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["c103_batch_classify"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin [kmer") == 2 and "SortMergeJoin [kmer" not in plan
