"""Comparison of frames with DuckDB results; joins of plans."""

import math
from pathlib import Path

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) == "<NA>":
        return None
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return round(float(value), 7)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool):
        return int(value)
    return value


def broadcast_joins(df):
    """Joins by key of a plan that broadcast a side."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)
