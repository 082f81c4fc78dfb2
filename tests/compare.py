"""Rows of a DataFrame against rows of a DuckDB query, whatever their order."""

from decimal import Decimal


def plain(v):
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, (int, bool)) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
