"""Results of both engines as comparable multisets."""

from __future__ import annotations

import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return v


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = got.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [names.index(c) for c in columns]
    other = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    assert mine == other, (list((mine - other).items())[:3], list((other - mine).items())[:3])
