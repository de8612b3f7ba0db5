"""Realistic values: names by column-name rules, and correlated people and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generators import Gen, weighted, with_columns
from .mixing import with_mixed

FIRST_NAMES = ("Ada", "Bruno", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Keiko", "Luca", "Mira", "Nadia", "Otto", "Priya", "Quinn", "Rosa", "Sven", "Tara")
LAST_NAMES = ("Abbott", "Brandt", "Castillo", "Dorsey", "Eriksen", "Fischer", "Grant", "Hartley", "Ibarra", "Jansen", "Keller", "Lindqvist", "Moreau", "Nolan", "Okafor", "Petrov", "Quigley", "Rossi", "Silva", "Tanaka")
COMPANIES = ("Alder Works", "Bluefield Trading", "Cobalt Systems", "Driftwood Supply", "Evergreen Foods", "Fairway Logistics")
STREETS = ("Cedar Lane", "Elm Street", "Harbor Road", "Mill Avenue", "Oak Street", "Park Drive")
COUNTRY = "United States"
#: city, state, name of the state, ZIP code, area code; a larger table can be read with read_places
PLACES = (
    ("Albany", "NY", "New York", "12207", "518"), ("Austin", "TX", "Texas", "78701", "512"), ("Boise", "ID", "Idaho", "83702", "208"), ("Boston", "MA", "Massachusetts", "02108", "617"),
    ("Chicago", "IL", "Illinois", "60601", "312"), ("Denver", "CO", "Colorado", "80202", "303"), ("Helena", "MT", "Montana", "59601", "406"), ("Miami", "FL", "Florida", "33130", "305"),
    ("Phoenix", "AZ", "Arizona", "85004", "602"), ("Portland", "OR", "Oregon", "97204", "503"), ("Raleigh", "NC", "North Carolina", "27601", "919"), ("Seattle", "WA", "Washington", "98101", "206"),
)


def read_places(spark: SparkSession, path: str, most: int = 10_000) -> tuple[tuple[str, ...], ...]:
    """Places of a CSV of five columns, read by Spark from wherever the executors can read; lines that start with # and the header are passed over.

    The table becomes part of the plans that use it: more than `most` rows are refused.
    """
    rows = spark.read.option("comment", "#").csv(path, schema="city string, state string, state_name string, zip string, area string").filter("area is not null and city != 'city'").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} places")
    return tuple(tuple(r) for r in rows)


def _pick(values: Sequence[str], size: int | None = None) -> Gen:
    cut = {v[:size] if size else v for v in values}
    return weighted(dict.fromkeys(cut, 1))


def _text(formula) -> Gen:
    return Gen("semantic", 2, formula)


def _email(size: int | None) -> Gen:
    def formula(d, u, n):
        name = d.pick([d.quote(v.lower()) for v in FIRST_NAMES], f"{u[0]} % {len(FIRST_NAMES)}")
        whole = f"concat({name}, {d.text(f'{u[1]} % 1000000')}, '@example.com')"
        return f"substr({whole}, 1, {size})" if size else whole

    return _text(formula)


def _digits(pattern: str, size: int | None) -> Gen:
    """# stands for a digit."""

    def formula(d, u, n):
        parts, k = [], 0
        for c in pattern:
            parts.append(d.text(f"{d.div(u[0], 10**k)} % 10") if c == "#" else d.quote(c))
            k += c == "#"
        whole = f"concat({', '.join(parts)})"
        return f"substr({whole}, 1, {size})" if size else whole

    return _text(formula)


def _full(size: int | None) -> Gen:
    def formula(d, u, n):
        first = d.pick([d.quote(v) for v in FIRST_NAMES], f"{u[0]} % {len(FIRST_NAMES)}")
        last = d.pick([d.quote(v) for v in LAST_NAMES], f"{u[1]} % {len(LAST_NAMES)}")
        whole = f"concat({first}, ' ', {last})"
        return f"substr({whole}, 1, {size})" if size else whole

    return _text(formula)


#: Fixed values and order: the first pattern that matches a whole column name, letter case apart, decides. An email_address is an email.
RULES = (
    (".*email.*", _email),
    (".*first_?name.*", lambda s: _pick(FIRST_NAMES, s)),
    (".*last_?name.*", lambda s: _pick(LAST_NAMES, s)),
    (".*user_?name.*", lambda s: _pick([f.lower() + x.lower() for f in FIRST_NAMES[:8] for x in LAST_NAMES[:8]], s)),
    (".*full_?name.*|name", _full),
    (".*phone.*", lambda s: _digits("(###) 555-01##", s)),
    (".*company.*", lambda s: _pick(COMPANIES, s)),
    (".*(url|website).*", lambda s: _digits("https://www.example.com/####", s)),
    (".*city.*", lambda s: _pick([p[0] for p in PLACES], s)),
    (".*(state|province).*", lambda s: _pick([p[2] for p in PLACES], s)),
    (".*country.*", lambda s: _pick([COUNTRY], s)),
    (".*(zip|postal).*", lambda s: _pick([p[3] for p in PLACES], s)),
    (".*(street|address).*", lambda s: _pick([f"{10 * (i + 1)} {x}" for i, x in enumerate(STREETS)], s)),
)


def plugin(registry) -> None:
    """The rules as a plugin of a registry."""
    for pattern, make in RULES:
        registry.by_name(pattern, lambda column, make=make: make(column.size))


def person_gens(seed: int) -> dict[str, tuple[Gen, int]]:
    return {"first": (_pick(FIRST_NAMES), seed), "last": (_pick(LAST_NAMES), seed + 1)}


def with_person(df: DataFrame, row: str, seed: int, name: str = "person") -> DataFrame:
    """df with a struct first, last, full, handle, email that agree with one another; the row index makes handles unique."""
    made = with_columns(df, row, {"__first": person_gens(seed)["first"], "__last": person_gens(seed)["last"]})
    handle = F.concat(*(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")) for c in ("__first", "__last")), F.expr(f"CAST({row} AS STRING)"))
    made = made.withColumn("__handle", handle)
    entity = F.struct(F.col("__first").alias("first"), F.col("__last").alias("last"), F.concat_ws(" ", "__first", "__last").alias("full"), F.col("__handle").alias("handle"), F.concat("__handle", F.lit("@example.com")).alias("email"))
    return made.withColumn(name, entity).drop("__first", "__last", "__handle")


def with_place(df: DataFrame, row: str, seed: int, name: str = "place", places: Sequence[tuple[str, ...]] = PLACES) -> DataFrame:
    """df with a struct city, state, state_name, zip, area, country: places[floorMod(mix64(seed + row), size)]."""
    items = ", ".join("named_struct({})".format(", ".join(f"'{k}', '{v.replace(chr(39), chr(92) + chr(39))}'" for k, v in zip(("city", "state", "state_name", "zip", "area", "country"), (*p, COUNTRY)))) for p in places)
    mixed = with_mixed(df, {"__at": f"{row} + {seed}L"})
    return mixed.withColumn(name, F.expr(f"element_at(array({items}), CAST(pmod(__at, {len(places)}) AS INT) + 1)")).drop("__at")
