"""Row sets of a Spark query and of its SQL, in one spelling."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spelled(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted("|".join(spelled(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, text):
    got = con.execute(text)
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(spelled(r[i]) for i in order) for r in got.fetchall())
