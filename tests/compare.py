"""Comparison of a query's rows with its SQL, regardless of order."""

import decimal
import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return int(v) if isinstance(v, bool) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(duck, sql):
    rel = duck.sql(sql)
    cols = list(rel.columns)
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), Counter(str(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
