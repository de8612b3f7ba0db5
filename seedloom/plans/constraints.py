"""CHECK constraints: read once, then used both to generate and to verify."""

from __future__ import annotations

import math
import re

import numpy as np

from ..functions import generators as g
from .model import ColumnConstraint, ColumnModel

_NUMBER = r"\(*\s*'?(-?\d+(?:\.\d+)?)"
_LOWER = re.compile(r"(>=?)\s*" + _NUMBER)
_UPPER = re.compile(r"(<=?)\s*" + _NUMBER)
_BETWEEN = re.compile(r"\bbetween\s+" + _NUMBER + r"'?\)*(?:::\w+)?\s+and\s+" + _NUMBER, re.I)


def _item(raw: str) -> str:
    """A list item without casts, parentheses and quotes."""
    raw = re.sub(r"::[\w \[\]()]+$", "", raw.strip().strip("()").strip()).strip().strip("()").strip()
    if len(raw) > 1 and raw[0] == raw[-1] == "'":
        return raw[1:-1].replace("''", "'")
    return raw


def _items(text: str) -> list[str]:
    from .model import _split

    return [v for v in map(_item, _split(text)) if v]


def parse_check(text: str | None) -> ColumnConstraint | None:
    """The values or the range that a check allows; None where it says anything else, so that nothing wrong is generated.

    Commas inside quotes stay in their value, each bound has its own
    inclusivity, and both bounds are needed for a range.
    """
    if not text:
        return None
    bare = re.sub(r"'(?:[^']|'')*'", "''", text).lower()
    if re.search(r"<>|!=|\bor\b|\bnot\b|~|\blike\b", bare):
        return None
    if m := re.search(r"array\s*\[((?:'(?:[^']|'')*'|[^\]'\[]|\[\])*)\]", text, re.I):
        values = _items(m[1])
    elif m := re.search(r"\bin\s*\((.*)\)", text, re.I | re.S):
        depth, end = 1, len(m[1])
        for i, c in enumerate(m[1]):
            depth += (c == "(") - (c == ")")
            if not depth:
                end = i
                break
        values = _items(m[1][:end])
    elif "'" in text and not re.search(r"[<>]|\bbetween\b", bare):
        values = [v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", text)]
    else:
        if m := _BETWEEN.search(text):
            return ColumnConstraint(least=float(m[1]), most=float(m[2]))
        low, high = _LOWER.search(text), _UPPER.search(text)
        if not (low and high):
            return None
        return ColumnConstraint(least=float(low[2]), least_inclusive=low[1] == ">=", most=float(high[2]), most_inclusive=high[1] == "<=")
    return ColumnConstraint(values=tuple(values)) if values else None


_WHOLE = {"INTEGER": "INT", "SMALLINT": "SMALLINT", "TINYINT": "SMALLINT", "BIGINT": "BIGINT"}
_CAST = {**_WHOLE, "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "REAL": "FLOAT", "BOOLEAN": "BOOLEAN", "DATE": "DATE"}


def generator(column: ColumnModel, c: ColumnConstraint) -> g.Gen | None:
    """A generator of allowed values only; None where the column's type has none."""
    kind = column.type_name
    if c.values:
        cast = f"DECIMAL({min(column.size or 18, 38)},{column.digits or 0})" if kind in ("DECIMAL", "NUMERIC") else _CAST.get(kind, "STRING")
        return g.weighted({v: 1 for v in c.values}, cast)
    if kind in _WHOLE:
        least = math.ceil(c.least) + (not c.least_inclusive and float(c.least).is_integer())
        most = math.floor(c.most) - (not c.most_inclusive and float(c.most).is_integer())
        return g.integer(least, most + 1, sql_type=_WHOLE[kind]) if least <= most else None
    if kind in ("DECIMAL", "NUMERIC"):
        scale = 2 if column.digits is None else column.digits
        unit = 10**scale
        least = math.ceil(round(c.least * unit, 6)) + (not c.least_inclusive and round(c.least * unit, 6).is_integer())
        most = math.floor(round(c.most * unit, 6)) - (not c.most_inclusive and round(c.most * unit, 6).is_integer())
        size = min(column.size or 18, 38)
        # whole units of the last place: no rounding can leave the range
        return g.Gen("ranged_decimal", 1, lambda d, u, n: f"CAST(CAST({least} + {u[0]} % {most - least + 1} AS DECIMAL(38,0)) / CAST({unit} AS DECIMAL(12,0)) AS DECIMAL({size},{scale}))") if least <= most else None
    if kind in ("DOUBLE", "FLOAT", "REAL"):
        low, high, open_low, open_high = c.least, c.most, not c.least_inclusive, not c.most_inclusive
        if kind != "DOUBLE":  # the nearest numbers of single precision inside the bounds
            low, high = _single(low, math.inf, open_low), _single(high, -math.inf, open_high)
            open_low = open_high = False
        try:
            return g.between(low, high, not open_low, not open_high, "DOUBLE" if kind == "DOUBLE" else "FLOAT")
        except ValueError:
            return None
    return None


def _single(bound: float, towards: float, is_open: bool) -> float:
    """The first number of single precision from a bound on towards the other; the bound itself unless it is open."""
    near = np.float32(bound)
    outside = float(near) < bound if towards > 0 else float(near) > bound
    if outside or (is_open and float(near) == bound):
        near = np.nextafter(near, np.float32(towards))
    return float(near)


def predicate(name: str, c: ColumnConstraint) -> str:
    """SQL that holds for the values that the constraint allows."""
    if c.values:
        return f"CAST({name} AS STRING) IN ({', '.join(g.SPARK.quote(v) for v in c.values)})"
    return f"{name} {'>=' if c.least_inclusive else '>'} {c.least} AND {name} {'<=' if c.most_inclusive else '<'} {c.most}"
