"""A DataFrame against DuckDB's answer."""

import os

import duckdb


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=order)
    assert got == sorted(map(tuple, cur.fetchall()), key=order)
