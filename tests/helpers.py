"""Comparison of result sets without regard to order."""

import math
from collections import Counter
from decimal import Decimal


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same_as_sql(df, duck, sql):
    found = duck.sql(sql)
    a, b = table(df.columns, [tuple(r) for r in df.collect()]), table(found.columns, found.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1], list((a[1] - b[1]).items())[:3] + list((b[1] - a[1]).items())[:3]
