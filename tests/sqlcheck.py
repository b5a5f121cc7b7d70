"""Holding a query's rows against its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb


def _level(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return tuple(map(_level, v)) if isinstance(v, list) else v


def assert_same(query, sql, spark, directory):
    df = query(spark, directory)
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in Path(directory).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    rows = db.execute(sql)
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    own = Counter(tuple(_level(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(_level(r[names.index(c)]) for c in order) for r in rows.fetchall())
    assert own == theirs, (list((own - theirs).items())[:3], list((theirs - own).items())[:3])
