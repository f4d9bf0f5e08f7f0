"""Rows of any engine in one form, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from typing import Any


def plain(v: Any) -> Any:
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())
