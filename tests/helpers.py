"""Comparison of a query's rows with its SQL's, as the driver does it."""

import glob
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False)), key=repr)
