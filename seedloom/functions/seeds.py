"""Column seeds: a base seed and a column's identity give the seed of its draws."""

from __future__ import annotations

from .mixing import signed


def _int32(v: int) -> int:
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v


def string_hash(text: str) -> int:
    """The polynomial hash of base 31 over UTF-16 code units, in 32 bits."""
    raw = text.encode("utf-16-be")
    h = 0
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2])) & 0xFFFFFFFF
    return _int32(h)


def identity_hash(*parts: str | int | None) -> int:
    """Hash of a tuple of strings, integers and nulls, in 32 bits."""
    h = 1
    for p in parts:
        h = 31 * h + (0 if p is None else p if isinstance(p, int) else string_hash(p))
    return _int32(h)


def column_seed(base: int, name: str, table: str | None = None, schema: str | None = None, catalog: str | None = None, type_name: str | None = None, ordinal: int | None = None) -> int:
    return signed(base * 1_000_003 + identity_hash(name, table, schema, catalog, type_name, ordinal))
