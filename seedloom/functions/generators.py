"""Generators: SQL expressions of draws and the row index.

A generator says how many draws a value takes and writes its formula for a
dialect of SQL, so the formula that Spark runs can be checked by another engine.
All are pure: the same seed and row give the same value wherever the row is.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .mixing import SECOND, duck_draws, mix64, signed, with_draws, with_mixed, wrapping

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: 2020-01-01T00:00:00Z in milliseconds, the instant that default windows hang on, and a day.
INSTANT, DAY = 1_577_836_800_000, 86_400_000


class Dialect:
    """What the two engines write differently."""

    name = "spark"

    def div(self, a: str, b: int | str) -> str:
        return f"(({a}) div {b})"

    def pick(self, items: Sequence[str], index: str) -> str:
        return f"element_at(array({', '.join(items)}), CAST({index} AS INT) + 1)"

    def millis(self, e: str) -> str:
        return f"CAST(timestamp_millis({e}) AS TIMESTAMP_NTZ)"

    def day(self, base: str, e: str) -> str:
        return f"date_add(DATE '{base}', CAST({e} AS INT))"

    def text(self, e: str) -> str:
        return f"CAST({e} AS STRING)"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def real(self) -> str:
        return "FLOAT"

    def binary(self, hexes: str) -> str:
        return f"unhex({hexes})"

    def array(self, items: Sequence[str]) -> str:
        return f"array({', '.join(items)})"

    def quote(self, v) -> str:
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Duck(Dialect):
    name = "duck"

    def div(self, a, b):
        return f"(({a}) // {b})"

    def pick(self, items, index):
        return f"([{', '.join(items)}])[CAST({index} AS INT) + 1]"

    def millis(self, e):
        return f"make_timestamp(({e}) * 1000)"

    def day(self, base, e):
        return f"CAST(DATE '{base}' + CAST({e} AS INT) AS DATE)"

    def text(self, e):
        return f"CAST({e} AS VARCHAR)"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def real(self):
        return "REAL"

    def binary(self, hexes):
        return f"unhex({hexes})"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def quote(self, v):
        return "'" + str(v).replace("'", "''") + "'"


SPARK, DUCK = Dialect(), Duck()
Formula = Callable[[Dialect, list[str], str], str]


@dataclass(frozen=True)
class Text:
    """A text of `size` characters of a pool, made of the draw number `first`.

    An expression for each character would outgrow the limits of generated code: eight characters come from
    one step over two numbers, by arithmetic on the bytes of a long. formula(text, draws, row) is the value, in either dialect.
    """

    pool: str
    size: int
    first: int
    formula: Callable[[str, list[str], str], str]

    @property
    def steps(self) -> int:
        return -(-self.size // 8)

    def bases(self) -> list[int]:
        """Two numbers for each step, by which the draw is changed."""
        return [mix64(j) for j in range(2 * self.steps)]

    def spark(self, draw: str) -> str:
        """Needs `wrapping`."""
        n, mask = len(self.pool), 0x0000FFFF0000FFFF
        changed = f"({draw} ^ b) * {signed(SECOND)}L"
        numbers = lambda which: f"transform(array({', '.join(f'{b}L' for b in which)}), b -> {changed} ^ shiftrightunsigned({changed}, 29))"
        # a quarter of a number is a place in the pool, as its share of 2**16; two quarters at once
        half = lambda z: f"(shiftrightunsigned(({z} & {mask}L) * {n}L, 16) & {mask}L)"
        places = lambda z: f"({half(z)} | shiftleft({half(f'shiftrightunsigned({z}, 16)')}, 8))"
        every = 0x0101010101010101
        # for all eight bytes: 1 where the place is `least` or more
        beyond = lambda least: f"shiftrightunsigned((e + {every * (128 - least)}L) & {signed(every * 128)}L, 7)"
        letter = f"e + {every * ord(self.pool[0])}L"
        if len(self.pool) > 26:  # capital letters, small letters, digits
            letter += f" + {beyond(26)} * {ord('a') - ord('Z') - 1}L"
        if len(self.pool) > 52:
            letter += f" - {beyond(52)} * {ord('z') + 1 - ord('0')}L"
        both = self.bases()
        packed = f"zip_with({numbers(both[::2])}, {numbers(both[1::2])}, (p, q) -> {places('p')} | shiftleft({places('q')}, 16))"
        whole = f"CAST(unhex(array_join(transform({packed}, e -> hex({letter})), '')) AS STRING)"
        return whole if self.size % 8 == 0 else f"substr({whole}, 1, {self.size})"

    def duck(self, draw: str) -> tuple[str, Callable[[str], str]]:
        """The list of numbers, and from its name the text: character by character."""
        every = "18446744073709551616::UHUGEINT"
        bases = ", ".join(f"{b & ((1 << 64) - 1)}::UBIGINT" for b in self.bases())
        changed = f"list_transform([{bases}], lambda b: (xor({draw}::UBIGINT, b)::UHUGEINT * {SECOND}::UHUGEINT % {every})::UBIGINT)"
        numbers = f"list_transform({changed}, lambda y: xor(y, y >> 29))"
        # of each step the quarters of its second and first number by turns, the highest ones first
        which = [2 * k + 1 + second for k in range(self.steps) for second in (1, 1, 0, 0, 1, 1, 0, 0)][: self.size]
        shift = [16 * q for _ in range(self.steps) for q in (3, 2, 3, 2, 1, 0, 1, 0)][: self.size]
        chars = lambda name: f"list_aggregate(list_transform(range(1, {self.size + 1}), lambda i: substr('{self.pool}', CAST(1 + (((({name})[{which}[i]] >> {shift}[i]::UBIGINT) & 65535::UBIGINT) * {len(self.pool)}) // 65536 AS INT), 1)), 'string_agg', '')"
        return numbers, chars


@dataclass(frozen=True)
class Gen:
    """kind, draws a value takes, formula(dialect, draws, row). mixed: columns of mix64 that the formula names.

    text: another way to the same value.
    """

    kind: str
    draws: int
    formula: Formula = field(compare=False)
    mixed: Mapping[str, str] = field(default_factory=dict, compare=False)
    params: Mapping = field(default_factory=dict)
    text: Text | None = field(default=None, compare=False)

    def sql(self, dialect: Dialect, draws: list[str], row: str) -> str:
        return self.formula(dialect, draws, row)


def _unit(d: Dialect, u: str) -> str:
    return f"(CAST({d.div(u, 1024)} AS DOUBLE) * CAST(1.1102230246251565e-16 AS DOUBLE))"


def _range(start: int, end: int) -> int:
    if start < -(1 << 63) or end > 1 << 63:
        raise ValueError("bounds must fit in 64 bits")
    if end < start:
        raise ValueError(f"end {end} is before start {start}")
    return max(1, end - start)


def integer(start: int = 0, end: int = (1 << 31) - 1, kind: str = "integer", sql_type: str = "INT") -> Gen:
    """Uniform in [start, end); start where they are equal."""
    width = _range(start, end)
    if width >= 1 << 63:
        raise ValueError("a range takes fewer than 2**63 values")
    return Gen(kind, 1, lambda d, u, n: f"CAST({start} + {u[0]} % {width} AS {sql_type})", params={"start": start, "end": end})


def long(start: int = 0, end: int = (1 << 63) - 1) -> Gen:
    return integer(start, end, "long", "BIGINT")


def short(start: int = 0, end: int = 32767) -> Gen:
    if not (-32768 <= start <= 32767 and -32768 <= end <= 32768):
        raise ValueError("short bounds are outside 16 bits")
    return integer(start, end, "short", "SMALLINT")


def double(start: float = 0.0, end: float = 1.7976931348623157e308) -> Gen:
    if end < start:
        raise ValueError("end is before start")
    return Gen("double", 1, lambda d, u, n: f"(CAST({start!r} AS DOUBLE) + CAST({end - start!r} AS DOUBLE) * {_unit(d, u[0])})", params={"start": start, "end": end})


def between(least: float, most: float, least_inclusive: bool = True, most_inclusive: bool = True, sql_type: str = "DOUBLE") -> Gen:
    """Uniform between two bounds, each of which can be a value or not."""
    low, high = (least if least_inclusive else math.nextafter(least, math.inf)), (most if most_inclusive else math.nextafter(most, -math.inf))
    if low > high:
        raise ValueError("no number lies between the bounds")
    # 2**53 steps, the last of which is the upper bound; rounding can't leave the range
    unit = lambda d, u: f"(CAST({d.div(u, 1024)} AS DOUBLE) / CAST(9007199254740991.0 AS DOUBLE))"
    value = lambda d, u: f"least(greatest(CAST({low!r} AS DOUBLE) + CAST({high - low!r} AS DOUBLE) * {unit(d, u)}, CAST({low!r} AS DOUBLE)), CAST({high!r} AS DOUBLE))"
    return Gen("between", 1, lambda d, u, n: value(d, u[0]) if sql_type == "DOUBLE" else f"CAST({value(d, u[0])} AS {d.real()})", params={"least": least, "most": most, "least_inclusive": least_inclusive, "most_inclusive": most_inclusive})


def single(start: float = 0.0, end: float = 3.4028234663852886e38) -> Gen:
    g = double(start, end)
    return Gen("float", 1, lambda d, u, n: f"CAST({g.sql(d, u, n)} AS {d.real()})", params=g.params)


def decimal(precision: int, scale: int) -> Gen:
    """A random number of whole and fraction digits, no leading zeros, "1" where nothing is left; precision at most 25."""
    if scale > precision:
        raise ValueError("scale is larger than precision")
    precision = min(precision, 25)
    scale = min(scale, precision)
    whole = precision - scale

    def digits(d: Dialect, u: str, v: str, most: int, count: str) -> str:
        """`count` of `most` digits from two draws."""
        long_ = f"concat(lpad({d.text(f'{u} % 1000000000000000')}, 15, '0'), lpad({d.text(f'{v} % 1000000000000000')}, 15, '0'))"
        return f"substr({long_}, 1, CAST({count} AS INT))" if most else "''"

    def formula(d: Dialect, u: list[str], n: str) -> str:
        w = digits(d, u[0], u[1], whole, f"(1 + {u[4]} % {max(1, whole)})" if whole else "0")
        f = digits(d, u[2], u[3], scale, f"(1 + {d.div(u[4], 64)} % {max(1, scale)})" if scale else "0")
        head = f"ltrim({w}, '0')" if d.name == "duck" else f"trim(LEADING '0' FROM {w})"
        head = head if whole else "''"
        number = f"concat(CASE WHEN {head} = '' THEN '{'1' if not scale else '0'}' ELSE {head} END, {d.quote('.') if scale else d.quote('')}, {f})"
        return f"CAST({number} AS DECIMAL({precision},{scale}))"

    return Gen("decimal", 5, formula, params={"precision": precision, "scale": scale})


def scaled_decimal(start: float, end: float, scale: int, precision: int = 18) -> Gen:
    """Uniform in [start, end), rounded half up to a scale: may round up to end."""
    unit_ = 10**scale
    lo, width = round(start * unit_ * 1000), max(1, round((end - start) * unit_ * 1000))
    # thousandths of the last place, rounded in whole numbers
    return Gen("scaled_decimal", 1, lambda d, u, n: f"CAST(CAST({d.div(f'{lo} + {u[0]} % {width} + 500', 1000)} AS DECIMAL(38,0)) / CAST({unit_} AS DECIMAL(12,0)) AS DECIMAL({precision},{scale}))", params={"start": start, "end": end, "scale": scale, "precision": precision})


def boolean() -> Gen:
    return Gen("boolean", 1, lambda d, u, n: f"({u[0]} % 2 = 1)")


def bit() -> Gen:
    return Gen("bit", 1, lambda d, u, n: f"CAST({u[0]} % 2 AS INT)")


def _hexes(d: Dialect, u: list[str], n: int) -> str:
    """2n lower-case hexadecimal digits."""
    parts = [f"lpad(lower(hex({x} % 281474976710656)), 12, '0')" for x in u]
    return f"substr(concat({', '.join(parts)}, ''), 1, {2 * n})"


def binary(size: int = 25) -> Gen:
    size = max(1, min(size, 25))
    return Gen("binary", -(-size // 6), lambda d, u, n: d.binary(_hexes(d, u, size)), params={"size": size})


def character() -> Gen:
    return Gen("character", 1, lambda d, u, n: f"chr(CAST(97 + {u[0]} % 26 AS INT))")


def _chars(d: Dialect, u: list[str], pool: str, n: int, per: int) -> list[str]:
    size = len(pool)
    return [f"substr('{pool}', CAST(1 + {d.div(u[i // per], size ** (i % per))} % {size} AS INT), 1)" for i in range(n)]


def _per(pool: str) -> int:
    """Characters of a pool that one draw gives, with some bits to spare."""
    return int(58 / math.log2(len(pool)))


def string(size: int | None = 10, letters: bool = True, numbers: bool = False) -> Gen:
    """Exactly min(size, 2000) characters of letters, digits or both."""
    size = min(10 if size is None else size, 2000)
    pool = LETTERS * letters + DIGITS * numbers
    if size < 1 or not pool:
        raise ValueError("a string needs a size of 1 at least and a pool")
    per = _per(pool)
    text = Text(pool, size, 0, lambda t, u, n: t)
    return Gen("string", -(-size // per), lambda d, u, n: f"concat({', '.join(_chars(d, u, pool, size, per))})", params={"size": size, "letters": letters, "numbers": numbers}, text=text)


def variable_string(least: int, most: int, letters: bool = True, numbers: bool = False) -> Gen:
    """A length uniform in [max(least, 1), most]."""
    least, most = max(least, 1), min(most, 2000)
    whole = string(most, letters, numbers)
    cut = lambda text, u: f"substr({text}, 1, CAST({least} + {u} % {most - least + 1} AS INT))"
    text = Text(whole.text.pool, most, 1, lambda t, u, n: cut(t, u[0]))
    return Gen("variable_string", whole.draws + 1, lambda d, u, n: cut(whole.sql(d, u[1:], n), u[0]), params={"least": least, "most": most, "letters": letters, "numbers": numbers}, text=text)


def bit_string(size: int = 1) -> Gen:
    size = max(1, min(size, 25))
    return Gen("bit_string", 1, lambda d, u, n: f"concat({', '.join(_chars(d, u, '01', size, 58))})", params={"size": size})


def uuid() -> Gen:
    """Version 4."""

    def formula(d: Dialect, u: list[str], n: str) -> str:
        a, b, c = (f"lpad(lower(hex({x} % 281474976710656)), 12, '0')" for x in u)
        return f"concat(substr({a}, 1, 8), '-', substr({a}, 9, 4), '-4', substr({b}, 1, 3), '-', substr('89ab', CAST(1 + {d.div(u[1], 281474976710656)} % 4 AS INT), 1), substr({b}, 4, 3), '-', {c})"

    return Gen("uuid", 3, formula)


def inet() -> Gen:
    """Four octets from 1 to 255."""
    return Gen("inet", 1, lambda d, u, n: "concat(" + ", '.', ".join(d.text(f"1 + {d.div(u[0], 255**k)} % 255") for k in range(4)) + ")")


def cidr() -> Gen:
    return Gen("cidr", 1, lambda d, u, n: "concat(" + ", '.', ".join(d.text(f"1 + {d.div(u[0], 255**k)} % 255") for k in range(3)) + ", '.0/24')")


def mac(octets: int = 6) -> Gen:
    if octets not in (6, 8):
        raise ValueError("an address has 6 or 8 octets")
    return Gen("mac", 2, lambda d, u, n: "concat(" + ", ':', ".join(f"substr({_hexes(d, u, 8)}, {2 * k + 1}, 2)" for k in range(octets)) + ")", params={"octets": octets})


def interval() -> Gen:
    """Years-months days hours:minutes:seconds."""
    return Gen(
        "interval",
        1,
        lambda d, u, n: f"concat({d.text(f'1 + {u[0]} % 9')}, '-', {d.text(f'1 + {d.div(u[0], 9)} % 11')}, ' ', {d.text(f'1 + {d.div(u[0], 99)} % 29')}, ' ', {d.text(f'1 + {d.div(u[0], 2871)} % 23')}, ':', {d.text(f'1 + {d.div(u[0], 66033)} % 59')}, ':', {d.text(f'1 + {d.div(u[0], 3895947)} % 59')})",
    )


def xml(tag: str = "value") -> Gen:
    body = string(16, True, True)
    return Gen("xml", body.draws, lambda d, u, n: f"concat('<{tag}>', {body.sql(d, u, n)}, '</{tag}>')", params={"tag": tag})


def jsonb(fields: int = 4) -> Gen:
    """Keys of 8 letters; text of 12, whole number, fraction and truth value by turns."""
    if fields < 1:
        raise ValueError("fields must be positive")
    key, text = string(8), string(12)

    def formula(d: Dialect, u: list[str], n: str) -> str:
        parts = []
        for i in range(fields):
            own = u[4 * i : 4 * i + 4]
            value = (f"concat('\"', {text.sql(d, own[1:3], n)}, '\"')", d.text(f"{own[3]} % 1000000"), f"concat('0.', lpad({d.text(f'{own[3]} % 10000')}, 4, '0'))", f"CASE WHEN {own[3]} % 2 = 1 THEN 'true' ELSE 'false' END")[i % 4]
            parts.append(f"concat('\"', {key.sql(d, own[:1], n)}, '\":', {value})")
        joined = ", ',', ".join(parts)
        return f"concat('{{', {joined}, '}}')"

    return Gen("jsonb", 4 * fields, formula, params={"fields": fields})


def integer_array(size: int = 3) -> Gen:
    return Gen("integer_array", size, lambda d, u, n: d.array([f"CAST({x} % 4294967296 - 2147483648 AS INT)" for x in u]), params={"size": size})


def string_array(size: int = 3, length: int = 10) -> Gen:
    one = string(length)
    return Gen("string_array", size * one.draws, lambda d, u, n: d.array([one.sql(d, u[i * one.draws : (i + 1) * one.draws], n) for i in range(size)]), params={"size": size, "length": length})


def null(sql_type: str = "STRING") -> Gen:
    """LOB and struct stand-ins: always null."""
    return Gen("null", 0, lambda d, u, n: f"CAST(NULL AS {sql_type if d.name == 'spark' else {'STRING': 'VARCHAR', 'BINARY': 'BLOB'}.get(sql_type, sql_type)})", params={"sql_type": sql_type})


def timestamp(start: int = INSTANT - 100 * DAY, end: int = INSTANT + 100 * DAY) -> Gen:
    """Uniform milliseconds since the epoch in [start, end)."""
    width = _range(start, end)
    return Gen("timestamp", 1, lambda d, u, n: d.millis(f"{start} + {u[0]} % {width}"), params={"start": start, "end": end})


def instant(start: int = 0, end: int = INSTANT + 100 * DAY) -> Gen:
    g = timestamp(start, end)
    return Gen("instant", 1, g.formula, params=g.params)


def date(base: str = "2019-09-23", days: int = 200) -> Gen:
    return Gen("date", 1, lambda d, u, n: d.day(base, f"{u[0]} % {days}"), params={"base": base, "days": days})


def time(start: int = 0, end: int = INSTANT + 100 * 3_600_000) -> Gen:
    """The time of day of a uniform instant, as text."""
    width = _range(start, end)

    def formula(d: Dialect, u: list[str], n: str) -> str:
        s = d.div(f"{start} + {u[0]} % {width}", 1000) + " % 86400"
        part = lambda by, of: f"lpad({d.text(f'{d.div(s, by)} % {of}')}, 2, '0')"
        return f"concat({part(3600, 24)}, ':', {part(60, 60)}, ':', {part(1, 60)})"

    return Gen("time", 1, formula, params={"start": start, "end": end})


def fixed_timestamp(as_of: str) -> Gen:
    """One instant for all rows, in place of a wall clock."""
    return Gen("fixed_timestamp", 0, lambda d, u, n: f"CAST('{as_of}' AS {'TIMESTAMP_NTZ' if d.name == 'spark' else 'TIMESTAMP'})", params={"as_of": as_of})


def current_timestamp() -> Gen:
    """The clock: different from run to run on purpose."""
    return Gen("current_timestamp", 0, lambda d, u, n: "current_timestamp()")


def skewed_timestamp(start: int = INSTANT, end: int = INSTANT + 5 * 365 * DAY, skew: float = 3.0) -> Gen:
    """start + u ** (1 / skew) of the range, to the second: later instants are likelier."""
    if skew <= 0:
        raise ValueError("skew must be positive")
    return Gen("skewed_timestamp", 1, lambda d, u, n: d.millis(f"{start} + CAST(round(round(power({_unit(d, u[0])}, {1 / skew!r}), 9) * {end - start}.0 / 1000.0, 0) AS BIGINT) * 1000"), params={"start": start, "end": end, "skew": skew})


def constant(value, sql_type: str = "STRING") -> Gen:
    return Gen("constant", 0, lambda d, u, n: f"CAST({d.quote(value)} AS {sql_type if d.name == 'spark' or sql_type != 'STRING' else 'VARCHAR'})", params={"value": str(value), "sql_type": sql_type})


def sequential(start: int = 0, end: int = (1 << 31) - 2) -> Gen:
    """start, start + 1 ... end, and again."""
    if end < start:
        raise ValueError("end is before start")
    return Gen("sequential", 0, lambda d, u, n: f"CAST({start} + {n} % {end - start + 1} AS INT)", params={"start": start, "end": end})


def key_component(start: int = 1, repeat: int = 1, cycle: int = 1) -> Gen:
    """One axis of a dense product of keys."""
    if repeat < 1 or cycle < 1:
        raise ValueError("repeat and cycle must be positive")
    return Gen("key_component", 0, lambda d, u, n: f"CAST({start} + {d.div(n, repeat)} % {cycle} AS INT)", params={"start": start, "repeat": repeat, "cycle": cycle})


def child_count(least: int, most: int, seed: int) -> Gen:
    """least + floorMod(mix64(row + seed), most - least + 1)."""
    if not 0 <= least <= most:
        raise ValueError("counts need 0 <= least <= most")
    k = most - least + 1
    return Gen("child_count", 0, lambda d, u, n: f"CAST({least} + ((__count % {k}) + {k}) % {k} AS INT)", {"__count": str(seed)}, {"least": least, "most": most, "seed": seed})


def grouped_prefix(group: int, prefix: int, inner: Gen) -> Gen:
    """The inner value in the first rows of each group, else null; the inner row counts only those."""
    if not 0 <= prefix <= group or group < 1:
        raise ValueError("a prefix lies within its group")

    def formula(d: Dialect, u: list[str], n: str) -> str:
        return f"CASE WHEN {n} % {group} < {prefix} THEN {inner.sql(d, u, f'({d.div(n, group)} * {prefix} + {n} % {group})')} END"

    return Gen("grouped_prefix", inner.draws, formula, inner.mixed, {"group": group, "prefix": prefix, "inner": inner.kind})


def weighted(weights: Mapping, sql_type: str = "STRING") -> Gen:
    """Values in the order of their text, each with its share of the weights."""
    items = sorted(weights.items(), key=lambda x: str(x[0]))
    if not items or any(w <= 0 for _, w in items):
        raise ValueError("weights must be positive, and there must be one")
    total, at, cuts = float(sum(w for _, w in items)), 0.0, []
    for _, w in items:
        at += w / total
        cuts.append(at)

    def formula(d: Dialect, u: list[str], n: str) -> str:
        whens = " ".join(f"WHEN {_unit(d, u[0])} < CAST({c!r} AS DOUBLE) THEN {d.quote(v)}" for (v, _), c in zip(items[:-1], cuts))
        last = d.quote(items[-1][0])
        value = f"CASE {whens} ELSE {last} END" if whens else last
        return f"CAST({value} AS {sql_type if d.name == 'spark' or sql_type != 'STRING' else 'VARCHAR'})"

    return Gen("weighted", 1, formula, params={"weights": {str(k): v for k, v in items}, "sql_type": sql_type})


def normal(mean: float = 0.0, deviation: float = 1.0, least: float = -1.7976931348623157e308, most: float = 1.7976931348623157e308, digits: int = 6) -> Gen:
    """Gaussian by Box and Muller on two draws, clamped to [least, most], rounded."""
    if deviation < 0 or least > most:
        raise ValueError("a normal takes a deviation of 0 or more, and least <= most")

    def formula(d: Dialect, u: list[str], n: str) -> str:
        z = f"sqrt(-2.0 * ln(1.0 - {_unit(d, u[0])})) * cos(6.283185307179586 * {_unit(d, u[1])})"
        return f"least(greatest(round(CAST({mean!r} AS DOUBLE) + CAST({deviation!r} AS DOUBLE) * ({z}), {digits}), CAST({least!r} AS DOUBLE)), CAST({most!r} AS DOUBLE))"

    return Gen("normal", 2, formula, params={"mean": mean, "deviation": deviation, "least": least, "most": most})


def normal_integer(mean: float, deviation: float, least: int, most: int) -> Gen:
    g = normal(mean, deviation, float(least), float(most))
    return Gen("normal_integer", 2, lambda d, u, n: f"CAST(floor({g.sql(d, u, n)} + 0.5) AS INT)", params={"mean": mean, "deviation": deviation, "least": least, "most": most})


#: Ranks up to which the cumulative distribution is a literal.
ZIPF_LITERAL = 10_000


def zipf_cdf(size: int, exponent: float) -> list[float]:
    if size < 1 or size > 50_000_000 or exponent < 0:
        raise ValueError("a Zipf distribution takes 1 to 50,000,000 ranks and an exponent of 0 or more")
    weights = [k**-exponent for k in range(1, size + 1)]
    total, at, out = math.fsum(weights), 0.0, []
    for w in weights:
        at += w / total
        out.append(at)
    return out


def zipf(start: int = 1, size: int = 100, exponent: float = 1.0) -> Gen:
    """P(k) falls as k ** -exponent over [start, start + size): a search in a literal table; see zipf_column for large ones."""
    if size > ZIPF_LITERAL:
        raise ValueError(f"a literal table takes {ZIPF_LITERAL} ranks; use zipf_column")
    cdf = zipf_cdf(size, exponent)

    def formula(d: Dialect, u: list[str], n: str) -> str:
        # a search tree of comparisons, by halves
        def tree(lo: int, hi: int) -> str:
            if lo == hi:
                return str(start + lo)
            mid = (lo + hi) // 2
            return f"CASE WHEN {_unit(d, u[0])} < CAST({cdf[mid]!r} AS DOUBLE) THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

        if size <= 64:
            return f"CAST({tree(0, size - 1)} AS INT)"
        table = ", ".join(f"CAST({c!r} AS DOUBLE)" for c in cdf[:-1])
        if d.name == "spark":
            # the number of ranks whose share lies below the draw, by halving steps
            steps = ", ".join(str(1 << k) for k in reversed(range((size - 1).bit_length())))
            found = f"aggregate(array({steps}), 0, (p, s) -> CASE WHEN coalesce(get(array({table}), p + s - 1) <= {_unit(d, u[0])}, false) THEN p + s ELSE p END)"
            return f"CAST({start} + {found} AS INT)"
        return f"CAST({start} + len(list_filter([{table}], lambda c: c <= {_unit(d, u[0])})) AS INT)"

    return Gen("zipf", 1, formula, params={"start": start, "size": size, "exponent": exponent})


#: Code points that are neither unassigned, private nor surrogates, as Python's character tables have them: ranges first..last.
def _assigned() -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Cn", "Co", "Cs"):
            continue
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def any_text(size: int = 10) -> Gen:
    """`size` code points, uniform over all that are assigned."""
    if not 1 <= size <= 2000:
        raise ValueError("a text has 1 to 2000 code points")
    ranges = _assigned()
    before = [0]
    for a, b in ranges:
        before.append(before[-1] + b - a + 1)
    starts, firsts = ", ".join(map(str, before[1:-1])), ", ".join(str(a - n) for (a, _), n in zip(ranges, before))
    steps = ", ".join(str(1 << k) for k in reversed(range((len(ranges) - 1).bit_length())))

    def formula(d: Dialect, u: list[str], n: str) -> str:
        at = f"CAST(x % {before[-1]} AS INT)"
        if d.name == "duck":
            place = f"len(list_filter([{starts}], lambda c: c <= {at}))"
            return f"list_aggregate(list_transform([{', '.join(u)}], lambda x: chr({at} + ([{firsts}])[{place} + 1])), 'string_agg', '')"
        spot = f"aggregate(array({steps}), 0, (p, s) -> CASE WHEN coalesce(get(array({starts}), p + s - 1) <= {at}, false) THEN p + s ELSE p END)"
        # the decoder takes a first U+FEFF for a byte order mark: one goes before the text's own characters
        return f"decode(unhex(concat('0000FEFF', array_join(transform(array({', '.join(u)}), x -> lpad(hex({at} + get(array({firsts}), {spot})), 8, '0')), ''))), 'UTF-32')"

    return Gen("any_text", size, formula, params={"size": size})


def with_columns(df: DataFrame, row: str, gens: Mapping[str, tuple]) -> DataFrame:
    """df with a generated column for each name: (generator, seed), or those and a row expression of its own.

    row is an expression of the row index. No shuffle.
    """
    keep = [f"`{c}`" for c in df.columns]
    draws, mixed, texts, at = {}, {}, {}, {}
    for k, (name, (g, seed, *own)) in enumerate(gens.items()):
        at[name] = [f"__d{k}_{j}" for j in range(g.text.first + 1 if g.text else g.draws)]
        draws |= {c: (seed, j, *own) for j, c in enumerate(at[name])}
        mixed |= {f"{c}{k}": f"{own[0] if own else row} + {e}L" for c, e in g.mixed.items()}
        if g.text:
            texts[f"__t{k}"] = g.text.spark(f"`{at[name][-1]}`")
    out = with_mixed(with_draws(df, row, draws), mixed)
    if texts:
        with wrapping(df.sparkSession):
            out = out.selectExpr("*", *(f"{sql} AS `{n}`" for n, sql in texts.items()))
    made = []
    for k, (name, (g, _, *own)) in enumerate(gens.items()):
        where = own[0] if own else row
        sql = g.text.formula(f"`__t{k}`", at[name], where) if g.text else g.sql(SPARK, at[name], where)
        for c in g.mixed:
            sql = sql.replace(c, f"{c}{k}")
        made.append(f"{sql} AS `{name}`")
    return out.selectExpr(*keep, *made)


def duck_columns(source: str, row: str, gens: Mapping[str, tuple[Gen, int]], select: str = "*") -> str:
    """The SQL by which DuckDB makes the same columns."""
    from .mixing import duck_mixed

    draws, mixed, at, numbers, texts = {}, {}, {}, {}, {}
    for k, (name, (g, seed)) in enumerate(gens.items()):
        at[name] = [f"d{k}_{j}" for j in range(g.text.first + 1 if g.text else g.draws)]
        draws |= {c: (seed, j) for j, c in enumerate(at[name])}
        mixed |= {f"{c}{k}": f"{row}::HUGEINT + ({e})" for c, e in g.mixed.items()}
        if g.text:
            numbers[f"n{k}"], chars = g.text.duck(at[name][-1])
            texts[f"t{k}"] = chars(f"n{k}")
    chain, last = duck_draws(source, row, draws, "a"), "a"
    if mixed:
        chain, last = f"{chain}, {duck_mixed('a', mixed, 'b')}", "b"
    if texts:
        chain += f", c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in numbers.items())} FROM {last}), d AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in texts.items())} FROM c)"
        last = "d"
    made = []
    for k, (name, (g, _)) in enumerate(gens.items()):
        sql = g.text.formula(f"t{k}", at[name], row) if g.text else g.sql(DUCK, at[name], row)
        for c in g.mixed:
            sql = sql.replace(c, f"{c}{k}")
        made.append(f"{sql} AS {name}")
    return f"WITH {chain} SELECT {select}, {', '.join(made)} FROM {last}"


#: Kinds that a descriptor carries whole: kind -> factory of its parameters.
DESCRIBED: dict[str, Callable[..., Gen]] = {
    "integer": integer, "long": long, "short": short, "double": double, "float": single, "decimal": decimal, "scaled_decimal": scaled_decimal, "boolean": boolean, "bit": bit, "binary": binary, "character": character,
    "string": string, "variable_string": variable_string, "bit_string": bit_string, "uuid": uuid, "inet": inet, "cidr": cidr, "mac": mac, "interval": interval, "xml": xml, "jsonb": jsonb,
    "integer_array": integer_array, "string_array": string_array, "null": null, "timestamp": timestamp, "instant": lambda start, end: instant(start, end), "date": date, "time": time, "fixed_timestamp": fixed_timestamp,
    "current_timestamp": current_timestamp, "skewed_timestamp": skewed_timestamp, "constant": constant, "sequential": sequential, "key_component": key_component, "child_count": child_count,
    "weighted": weighted, "normal": normal, "zipf": zipf, "any_text": any_text,
}
