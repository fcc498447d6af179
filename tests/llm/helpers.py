"""Small tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """rows: (doc_id, text) or full rows; extra: (name, value) columns that clash with names used inside."""
    from pyspark.sql import functions as F

    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name, value in extra:
        df = df.withColumn(name, F.lit(value))
    return df


def duck(sql, **tables):
    """Rows of a DuckDB query over Arrow tables."""
    import duckdb

    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.sql(sql).df()


def same(ours, theirs):
    """Whether two pandas frames hold the same rows."""
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    import numbers

    import pandas as pd

    def value(v):
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else v

    plain = lambda f: sorted((tuple(value(v) for v in r) for r in f[names].astype(object).itertuples(index=False)), key=str)
    assert plain(ours) == plain(theirs)
