"""Compares a query's rows with those of its DuckDB twin, column by column."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    return v


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(map(_cell, r)) for r in rows), key=repr)


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in got.fetchall()]


def difference(df: DataFrame, sf_dir: str, sql: str) -> str | None:
    """What differs, or None."""
    names, want = duck_rows(sf_dir, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} against {names}"
    got = _sorted([tuple(r) for r in df.select(*names).collect()])
    want = _sorted(want)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {str(bad[0])[:600]}" if bad else None
