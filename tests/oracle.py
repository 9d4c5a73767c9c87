"""A query's rows against its SQL's rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    out = []
    for r in frame[columns].itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r))
    return columns, sorted(out, key=str)


def agree(spark, sf_dir, query, sql):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).execute(sql).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
