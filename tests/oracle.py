"""Compares a query's rows with those of its DuckDB SQL, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differing(con, sql, df):
    """Number of oracle rows, and rows found on one side alone."""
    want, got = con.execute(sql).to_arrow_table(), df.toArrow()
    assert sorted(want.column_names) == sorted(got.column_names)
    names = ", ".join(f'"{c}"' for c in sorted(want.column_names))
    con.register("want", want)
    con.register("got", got)
    sides = [con.execute(f"SELECT count(*) FROM (SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b})").fetchall()[0][0] for a, b in (("want", "got"), ("got", "want"))]
    return want.num_rows, sum(sides)
