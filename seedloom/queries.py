"""The engine's queries over the test tables, and SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import generators as g
from .functions import keys, semantic
from .functions.generators import duck_columns, with_columns
from .functions.mixing import FIRST, GAMMA, SECOND, duck_draws, duck_mixed
from .operators import catalog, verify
from .functions.seeds import column_seed
from .plans import constraints, dialects, graph, tpcc
from .plans.engine import FillConfig, TableConfig, fill
from .plans.model import ColumnConstraint, ColumnModel, parse_ddl
from .plans.registry import Registry, resolve
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- generators, on the orders' index ---

_GENERATORS: dict[str, tuple[dict[str, g.Gen], dict[str, tuple[str, str]]]] = {
    # name: generators, and columns that both engines show in another form: (Spark's, DuckDB's expression)
    "uniform_numbers": ({"i": g.integer(), "near": g.integer(-5, 6), "l": g.long(), "s": g.short(), "d": g.double(0.0, 1.0), "f": g.single(0.0, 1.0), "flag": g.boolean(), "b": g.bit()}, {"f": ("CAST(f AS DOUBLE) AS f", "CAST(f AS DOUBLE) AS f")}),
    "decimals": ({"a": g.decimal(10, 2), "b": g.decimal(4, 4), "c": g.scaled_decimal(0, 0.2, 4), "e": g.decimal(25, 0)}, {c: (f"CAST({c} AS DOUBLE) AS {c}",) * 2 for c in "abc"} | {"e": ("CAST(e AS STRING) AS e", "CAST(e AS VARCHAR) AS e")}),
    "random_text": ({"letters": g.string(10), "mixed": g.string(24, True, True), "digits": g.string(16, False, True), "ranged": g.variable_string(3, 12), "c": g.character(), "bits": g.bit_string(7)}, {}),
    "any_code_points": ({"t": g.any_text(6)}, {}),
    "between_bounds": ({"closed": g.between(0.0, 1.0), "open": g.between(0.0, 1.0, False, False), "narrow": g.between(2.5, 2.5)}, {}),
    "date_windows": ({"own": g.date("2024-02-25", 10), "usual": g.date()}, {}),
    "identifiers": ({"u": g.uuid(), "ip": g.inet(), "net": g.cidr(), "m6": g.mac(), "m8": g.mac(8), "span": g.interval()}, {}),
    "documents_and_arrays": ({"j": g.jsonb(5), "x": g.xml(), "ia": g.integer_array(), "sa": g.string_array(), "raw": g.binary(10), "lob": g.null()}, {"ia": ("array_join(transform(ia, x -> CAST(x AS STRING)), ',') AS ia", "array_to_string(ia, ',') AS ia"), "sa": ("array_join(sa, ',') AS sa", "array_to_string(sa, ',') AS sa"), "raw": ("hex(raw) AS raw", "hex(raw) AS raw")}),
    "temporal": ({"ts": g.timestamp(), "moment": g.instant(), "day": g.date(), "clock": g.time(), "fixed": g.fixed_timestamp("2020-01-01 00:00:00")}, {}),
    "skewed_timestamps": ({"ts": g.skewed_timestamp()}, {}),
    "constants_and_sequences": ({"zero": g.constant(0, "INT"), "word": g.constant("it's"), "seq": g.sequential(10, 16), "axis": g.key_component(1, 7, 5), "cnt": g.child_count(1, 7, 42), "prefix": g.grouped_prefix(10, 4, g.integer(1, 11))}, {}),
    "constrained": ({"status": constraints.generator(ColumnModel("s", "VARCHAR", 9), ColumnConstraint(values=("new", "it's, old"))), "rating": constraints.generator(ColumnModel("r", "INTEGER"), ColumnConstraint(least=0.5, most=5, most_inclusive=False)), "price": constraints.generator(ColumnModel("p", "DECIMAL", 8, 2), ColumnConstraint(least=1, least_inclusive=False, most=2.5))}, {"price": ("CAST(price AS DOUBLE) AS price",) * 2}),
    "weighted_pick": ({"status": g.weighted({"new": 5, "open": 3, "done": 1.5}), "level": g.weighted({1: 1, 2: 1, 30: 2}, "INT")}, {}),
    "normals": ({"d": g.normal(50.0, 12.0, 0.0, 100.0), "i": g.normal_integer(0, 3, -5, 5)}, {}),
    "zipf_pick": ({"k": g.zipf(1, 50, 1.1), "wide": g.zipf(0, 500, 0.8)}, {}),
    "tpcc_values": ({"credit": tpcc.credit(), "last": tpcc.customer_last(30, 20), "data": tpcc.data_column(), "zip": tpcc.zip_code(), "delivered": tpcc.delivery_date(20, 30), "nu": tpcc.nurand(1023, 1, 3000)}, {}),
}
for _name, (_gens, _shown) in _GENERATORS.items():
    _seeded = {c: (gen, 1000 * (k + 1)) for k, (c, gen) in enumerate(_gens.items())}

    def _run(spark: SparkSession, sf_dir: str, seeded=_seeded, shown=_shown) -> DataFrame:
        made = with_columns(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seeded)
        return made.selectExpr("o_orderkey", *(shown[c][0] if c in shown else c for c in seeded))

    QUERIES[_name] = _run
    ORACLES[_name] = f"SELECT o_orderkey, {', '.join(_shown[c][1] if c in _shown else c for c in _seeded)} FROM ({duck_columns('orders', 'o_orderkey', _seeded, 'o_orderkey')})"

# --- keys ---

_COUNTED = duck_columns("orders", "o_orderkey", {"cnt": (g.child_count(1, 7, 42), 42)}, "o_orderkey")


@_query(f"SELECT o_orderkey, cnt, CAST(line_no AS INT) AS line_no FROM (SELECT o_orderkey, cnt, unnest(range(1, cnt + 1)) AS line_no FROM ({_COUNTED}))")
def child_expand(spark, sf_dir):
    counted = keys.with_child_count(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1, 7, 42)
    return keys.expanded(counted, "cnt")


# as many parents as there are orders
_RANGE = "(SELECT range AS id FROM range((SELECT count(*) FROM orders)))"
_RANGE_COUNTED = duck_columns(_RANGE, "id", {"cnt": (g.child_count(0, 7, 42), 42)}, "id")


@_query(f"SELECT CAST(sum(cnt) AS BIGINT) AS total FROM ({_RANGE_COUNTED})")
def child_total(spark, sf_dir):
    return keys.total(spark, read(spark, sf_dir, "orders").count(), 0, 7, 42)


@_query(f"SELECT parent, CAST(p AS INT) AS position, CAST(before + p AS BIGINT) AS id FROM (SELECT id AS parent, before, unnest(range(cnt)) AS p FROM (SELECT id, cnt, sum(cnt) OVER (ORDER BY id) - cnt AS before FROM ({_RANGE_COUNTED})))")
def child_lines(spark, sf_dir):
    return keys.lines(spark, read(spark, sf_dir, "orders").count(), 0, 7, 42)


@_query(f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY z, o_orderkey) AS INT) AS place FROM (WITH {duck_mixed('orders', {'z': 'o_orderkey::HUGEINT + (77)'})} SELECT * FROM m)")
def permutation_ranked(spark, sf_dir):
    return keys.ranked_permutation(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10, 77, "place", 1)


_EVERY = 1 << 64
_ROUND = f"(SELECT *, ((r::UHUGEINT * {GAMMA}::UHUGEINT + key::UHUGEINT + step::UHUGEINT * {FIRST}::UHUGEINT) % {_EVERY}::UHUGEINT)::UBIGINT AS z FROM walk WHERE step <= 4)"
_ROUND = f"(SELECT *, (xor(z, z >> 30)::UHUGEINT * {FIRST}::UHUGEINT % {_EVERY}::UHUGEINT)::UBIGINT AS y FROM {_ROUND})"
_ROUND = f"(SELECT *, (xor(y, y >> 27)::UHUGEINT * {SECOND}::UHUGEINT % {_EVERY}::UHUGEINT)::UBIGINT AS x FROM {_ROUND})"
_ROUND = f"(SELECT o, key, step, r AS l, xor(l, xor(x, x >> 31) & 3) AS r FROM {_ROUND})"


# four rounds on two halves of two bits, keyed by the run of ten rows, and again until the value is below ten
@_query(
    f"WITH RECURSIVE {duck_mixed('orders', {'k': 'o_orderkey // 10 + 77'})}, walk(o, key, l, r, step) AS ("
    f"SELECT o_orderkey, CASE WHEN k < 0 THEN (k::HUGEINT + {_EVERY}::HUGEINT)::UBIGINT ELSE k::UBIGINT END, (o_orderkey % 10 // 4)::UBIGINT, (o_orderkey % 4)::UBIGINT * 0 + (o_orderkey % 10 % 4)::UBIGINT, 1 FROM m "
    f"UNION ALL SELECT o, key, l, r, CASE WHEN step < 4 THEN step + 1 WHEN l * 4 + r < 10 THEN 5 ELSE 1 END FROM {_ROUND}) "
    "SELECT o AS o_orderkey, CAST(l * 4 + r + 1 AS INT) AS place FROM walk WHERE step = 5"
)
def permutation_keyed(spark, sf_dir):
    return keys.keyed_permutation(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10, 77, "place", 1)


@_query("SELECT o_orderkey // 10 AS run, count(*) AS n_rows, count(*) AS n_places, CAST(1 AS INT) AS least, CAST(count(*) AS INT) AS most FROM orders GROUP BY 1 HAVING count(*) = 10")
def permutation_keyed_places(spark, sf_dir):
    placed = permutation_keyed(spark, sf_dir).withColumn("run", F.expr("o_orderkey DIV 10"))
    return placed.groupBy("run").agg(F.count("place").alias("n_rows"), F.countDistinct("place").alias("n_places"), F.min("place").alias("least"), F.max("place").alias("most")).filter("n_rows = 10")


@_query("SELECT o_orderkey, CAST(100 + o_orderkey % (SELECT count(*) FROM customer) AS BIGINT) AS fk FROM orders")
def fk_wraparound(spark, sf_dir):
    parents = read(spark, sf_dir, "customer").count()
    return keys.wrapped_key(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "fk", parents, 100)


_DRAWS = duck_draws("orders", "o_orderkey", {"u": (5, 0)}, "m")


# ranks 0, 1 ... with the share of all ranks up to each; the last share, one, is left out
@_query(
    f"WITH {_DRAWS}, w AS (SELECT range AS k, CASE WHEN range = 0 THEN 0.0::DOUBLE ELSE power(range::DOUBLE, -1.1::DOUBLE) END AS v FROM range(1000001)), t AS (SELECT sum(v) AS total FROM w), "
    "c AS (SELECT k, sum(v / total) OVER (ORDER BY k) AS share FROM w, t), d AS (SELECT o_orderkey, CAST(u // 1024 AS DOUBLE) * 1.1102230246251565e-16::DOUBLE AS x FROM m) "
    "SELECT o_orderkey, CAST(k + 1 AS INT) AS k FROM d ASOF JOIN (SELECT * FROM c WHERE k < 1000000) c ON d.x >= c.share"
)
def zipf_large(spark, sf_dir):
    return keys.zipf_column(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "k", 1_000_000, 1.1, 5)


# --- verification ---


@_query("SELECT count(*) AS n_rows, CAST(25 AS BIGINT) AS expected, count(*) = 25 AS matches FROM nation")
def row_counts(spark, sf_dir):
    return verify.row_count(read(spark, sf_dir, "nation"), 25)


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def domain_violations(spark, sf_dir):
    return verify.domain_violations(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_name NOT LIKE '%1_'")
def pattern_violations(spark, sf_dir):
    return verify.pattern_violations(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "%1_")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'O'")
def constant_violations(spark, sf_dir):
    return verify.constant_violations(read(spark, sf_dir, "lineitem"), "l_linestatus", "O").select("l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45 OR l_tax NOT BETWEEN 0 AND 0.06")
def range_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return verify.range_violations(rows, {"l_quantity": (5, 45), "l_tax": (0, 0.06)}).drop("l_tax")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_duplicates(spark, sf_dir):
    return verify.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINKS = {"lineitem_orders": ("lineitem", "orders", "l_orderkey", "o_orderkey"), "lineitem_part": ("lineitem", "part", "l_partkey", "p_partkey"), "lineitem_supplier": ("lineitem", "supplier", "l_suppkey", "s_suppkey"), "orders_customer": ("orders", "customer", "o_custkey", "c_custkey"), "customer_nation": ("customer", "nation", "c_nationkey", "n_nationkey"), "nation_region": ("nation", "region", "n_regionkey", "r_regionkey"), "customers_without_orders": ("customer", "orders", "c_custkey", "o_custkey")}
for _name, (_c, _p, _a, _b) in _LINKS.items():

    def _orphans(spark: SparkSession, sf_dir: str, c=_c, p=_p, a=_a, b=_b) -> DataFrame:
        return verify.orphans(read(spark, sf_dir, c).select(a), read(spark, sf_dir, p).select(b), {a: b})

    QUERIES[f"fk_orphans_{_name}"] = _orphans
    ORACLES[f"fk_orphans_{_name}"] = f"SELECT {_a} FROM {_c} c WHERE NOT EXISTS (SELECT 1 FROM {_p} p WHERE p.{_b} = c.{_a}) AND {_a} IS NOT NULL"


@_query(f"SELECT * FROM (SELECT o_orderkey, CAST(cnt AS BIGINT) AS stored, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS actual FROM ({_COUNTED})) WHERE stored <> actual")
def count_agreement(spark, sf_dir):
    counted = keys.with_child_count(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1, 7, 42)
    return verify.count_disagreements(counted, read(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"}, "cnt")


@_query(f"SELECT o_orderkey, cnt, l_linenumber FROM ({_COUNTED}) JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > cnt")
def line_overflow(spark, sf_dir):
    counted = keys.with_child_count(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1, 7, 42)
    return verify.joined_violations(counted, read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), {"o_orderkey": "l_orderkey"}, "l_linenumber > cnt").select("o_orderkey", "cnt", "l_linenumber")


_PREFIXED = {"carrier": (g.grouped_prefix(10, 7, g.integer(1, 11)), 9)}


@_query(f"SELECT o_orderkey, carrier FROM ({duck_columns('orders', 'o_orderkey', _PREFIXED, 'o_orderkey')}) WHERE o_orderkey % 10 < 8 AND carrier IS NULL")
def conditional_null(spark, sf_dir):
    made = with_columns(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", _PREFIXED)
    return verify.null_violations(made, "o_orderkey % 10 < 8", "carrier", False)


@_query("SELECT s_suppkey, s_nationkey FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey WHERE s_nationkey IS DISTINCT FROM n_nationkey")
def enumeration_mismatches(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.expr("s_suppkey % 25").alias("at"))
    return verify.enumeration_mismatches(rows, "at", "s_nationkey", read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("v"))).select("s_suppkey", "s_nationkey")


@_query("SELECT 'o_orderstatus' AS column_name, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS violations FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (NOT (o_totalprice > 1000 AND o_totalprice <= 90000)) FROM orders")
def check_conformance(spark, sf_dir):
    rules = {"o_orderstatus": constraints.parse_check("(status IN ('F', 'P'))"), "o_totalprice": constraints.parse_check("((price > 1000) AND (price <= 90000))")}
    return verify.conformance(read(spark, sf_dir, "orders"), rules)


@_query("SELECT count(DISTINCT event_type) AS n_event_type, count(DISTINCT user_id) AS n_user_id FROM events")
def distinct_variety(spark, sf_dir):
    return verify.variety(read(spark, sf_dir, "events"), ["event_type", "user_id"])


_A = "SELECT l_orderkey, l_linenumber FROM lineitem"
_B = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'"


@_query(f"SELECT l_orderkey, l_linenumber, CAST(greatest(sum(d), 0) AS BIGINT) AS only_left, CAST(greatest(-sum(d), 0) AS BIGINT) AS only_right FROM (SELECT *, 1 AS d FROM ({_A}) UNION ALL SELECT *, -1 FROM ({_B})) GROUP BY 1, 2 HAVING sum(d) <> 0")
def dataset_differences(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return verify.differences(rows.drop("l_returnflag"), rows.filter("l_returnflag <> 'R'").drop("l_returnflag"))


@_query("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), o_orderpriority)), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum FROM orders")
def table_checksum(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return verify.digest(verify.without_temporal(rows))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def subset_above(spark, sf_dir):
    return verify.beyond(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 150_000.0)


# two seeds give other numbers, but the same keys
_SEEDS = [duck_columns("(SELECT range AS id FROM range(2000))", "id", {"v": (g.integer(0, 50), s)}, "id") for s in (11, 12)]


@_query(f"SELECT id, v, CAST(greatest(sum(d), 0) AS BIGINT) AS only_left, CAST(greatest(-sum(d), 0) AS BIGINT) AS only_right FROM (SELECT id, v, 1 AS d FROM ({_SEEDS[0]}) UNION ALL SELECT id, v, -1 FROM ({_SEEDS[1]})) GROUP BY 1, 2 HAVING sum(d) <> 0")
def seed_differences(spark, sf_dir):
    one, other = (with_columns(spark.range(2000), "id", {"v": (g.integer(0, 50), s), "t": (g.string(8), s)}) for s in (11, 12))
    return verify.projection_differences(one, other, ["id", "v"])


@_query("SELECT CAST(0 AS BIGINT) AS changed_moments, CAST(2000 AS BIGINT) AS n_rows")
def temporal_reproducibility(spark, sf_dir):
    """Two runs of the same seed, differently parted, have the same instants."""
    made = [with_columns(spark.range(0, 2000, 1, n), "id", {"ts": (g.timestamp(), 3), "d": (g.date(), 4), "c": (g.time(), 5), "s": (g.skewed_timestamp(), 6)}) for n in (1, 5)]
    changed = verify.projection_differences(*made, ["id", "ts", "d", "c", "s"]).agg(F.count(F.lit(1)).alias("changed_moments"))
    return changed.join(F.broadcast(made[0].agg(F.count(F.lit(1)).alias("n_rows"))))  # one row each


@_query("SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def orphans_of_a_part(spark, sf_dir):
    """Lines whose order isn't among those that are left."""
    left = read(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    return verify.orphans(read(spark, sf_dir, "lineitem").select("l_orderkey"), left.select("o_orderkey"), {"l_orderkey": "o_orderkey"})


@_query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_quantity > 10)")
def orphans_by_two_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    some = rows.filter("l_quantity > 10").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return verify.orphans(rows.select("l_orderkey", "l_linenumber"), some, {"l_orderkey": "k", "l_linenumber": "n"})


def _expected_shares() -> dict[str, tuple[g.Gen, dict[str, float]]]:
    """What the definitions of distributions say about shares of values: written down apart from the generators."""
    harmonic = sum(1 / k for k in range(1, 201))
    return {
        "weighted": (g.weighted({"a": 1, "b": 3, "c": 6}), {"v = 'a'": 0.1, "v = 'b'": 0.3, "v = 'c'": 0.6}),
        "zipf": (g.zipf(1, 200, 1.0), {f"v = {k}": 1 / k / harmonic for k in (1, 2, 3, 10)} | {"v > 200 OR v < 1": 0.0}),
        "normal": (g.normal(10.0, 2.0), {"v < 10": 0.5, "abs(v - 10) < 2": 0.6827, "abs(v - 10) < 4": 0.9545}),
        "uniform": (g.integer(0, 8), {f"v = {k}": 0.125 for k in range(8)} | {"v NOT BETWEEN 0 AND 7": 0.0}),
        "boolean": (g.boolean(), {"v": 0.5}),
        "skewed": (g.skewed_timestamp(0, 8_000_000, 3.0), {"unix_millis(CAST(v AS TIMESTAMP)) < 1000000": 0.125 ** 3, "unix_millis(CAST(v AS TIMESTAMP)) >= 4000000": 0.875}),
        "credit": (tpcc.credit(), {"v = 'BC'": 0.1}),
        "letters": (g.string(1), {f"v = '{c}'": 1 / 52 for c in "AZaz"} | {"v NOT RLIKE '^[A-Za-z]$'": 0.0}),
    }


_SHARES = [(name, test, share) for name, (_, tests) in _expected_shares().items() for test, share in tests.items()]


@_query("SELECT kind, test, CAST(true AS BOOLEAN) AS near FROM (VALUES {}) t(kind, test)".format(", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t, _ in _SHARES)))
def shares_of_values(spark, sf_dir):
    """Whether the share of values that pass a test is within five standard errors of what the distribution's definition says."""
    n, rows = 100_000, None
    for name, (gen, tests) in _expected_shares().items():
        made = with_columns(spark.range(n), "id", {"v": (gen, 1_000_003)})
        seen = made.agg(*(F.avg(F.expr(t).cast("double")).alias(f"t{i}") for i, t in enumerate(tests)))
        checked = [F.struct(F.lit(name).alias("kind"), F.lit(t).alias("test"), (F.abs(F.col(f"t{i}") - share) <= 5 * (share * (1 - share) / n) ** 0.5 + 1e-4 * (name == "normal")).alias("near")) for i, (t, share) in enumerate(tests.items())]
        one = seen.select(F.inline(F.array(*checked)))
        rows = one if rows is None else rows.unionAll(one)
    return rows


# --- a recorded catalog ---

_CATALOG = {
    "pg_namespace": ("oid int, nspname string", [(1, "public"), (2, "other")]),
    "pg_class": ("oid int, relname string, relnamespace int", [(10, "orders", 1), (11, "items", 1), (12, "orders", 2)]),
    "pg_type": ("oid int, typname string", [(20, "state"), (21, "int4"), (22, "size")]),
    "pg_enum": ("enumtypid int, enumsortorder double, enumlabel string", [(20, 3.0, "done"), (20, 1.0, "new"), (20, 1.5, "it's"), (22, 1.0, "S"), (22, 2.0, "L")]),
    "pg_attribute": ("attrelid int, attname string, atttypid int, attnum int, attisdropped boolean", [(10, "state", 20, 1, False), (10, "n", 21, 2, False), (10, "gone", 20, 3, True), (10, "ctid", 20, -1, False), (11, "size", 22, 1, False), (12, "state", 20, 1, False), (11, "price", 21, 2, False)]),
    "pg_constraint": ("conrelid int, contype string, conkey array<int>, convalidated boolean, definition string", [(10, "c", [2], True, "CHECK ((n > 0))"), (10, "c", [1, 2], True, "CHECK ((n > 0) OR (state = 'new'))"), (11, "c", [2], True, "CHECK ((price BETWEEN 1 AND 9))"), (11, "f", [1], False, "FOREIGN KEY"), (12, "f", [1], True, "FOREIGN KEY"), (10, "p", [2], True, "PRIMARY KEY")]),
}


def _catalog(spark: SparkSession, *names: str) -> list[DataFrame]:
    return [spark.createDataFrame(_CATALOG[n][1], _CATALOG[n][0]) for n in names]


def _literal(v) -> str:
    if isinstance(v, list):
        return f"[{', '.join(map(_literal, v))}]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _with(*names: str) -> str:
    """The recorded tables as CTEs."""
    columns = {n: ", ".join(c.split(" ")[0] for c in _CATALOG[n][0].split(", ")) for n in names}
    return "WITH " + ", ".join(f"{n}({columns[n]}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in _CATALOG[n][1])})" for n in names)


_LIVE = "pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace s ON s.oid = c.relnamespace"


@_query(f"{_with('pg_attribute', 'pg_class', 'pg_namespace', 'pg_type', 'pg_enum')} SELECT nspname AS schema_name, relname AS table_name, attname AS column_name, CAST(row_number() OVER (PARTITION BY attrelid, attnum ORDER BY enumsortorder) AS INT) AS place, enumlabel AS label FROM {_LIVE} JOIN pg_type t ON t.oid = a.atttypid JOIN pg_enum e ON e.enumtypid = t.oid WHERE attnum > 0 AND NOT attisdropped")
def enum_catalog(spark, sf_dir):
    return catalog.enum_columns(*_catalog(spark, "pg_attribute", "pg_class", "pg_namespace", "pg_type", "pg_enum"))


@_query(f"{_with('pg_attribute', 'pg_class', 'pg_namespace', 'pg_constraint')} SELECT nspname AS schema_name, relname AS table_name, attname AS column_name, definition AS rule FROM {_LIVE} JOIN pg_constraint k ON k.conrelid = a.attrelid AND list_contains(k.conkey, a.attnum) WHERE contype = 'c' AND len(conkey) = 1 AND attnum > 0 AND NOT attisdropped")
def check_catalog(spark, sf_dir):
    return catalog.check_columns(*_catalog(spark, "pg_attribute", "pg_class", "pg_namespace", "pg_constraint"))


@_query(f"{_with('pg_constraint')} SELECT count(*) AS n FROM pg_constraint WHERE contype = 'f' AND NOT convalidated")
def unvalidated_keys(spark, sf_dir):
    return catalog.unvalidated_keys(*_catalog(spark, "pg_constraint"))


@_query("SELECT concat_ws('|', coalesce(CAST(n_nationkey AS VARCHAR), '\\N'), coalesce(n_name, '\\N'), coalesce(CAST(n_regionkey AS VARCHAR), '\\N')) AS line FROM nation ORDER BY n_nationkey")
def canonical_dump(spark, sf_dir):
    return verify.dump(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


# --- schema and graph ---

_EDGES = graph.edges(tpcc.schema())
_NAMES = [t.name for t in tpcc.schema().tables]
_VALUES = ", ".join(f"('{c}', '{p}')" for c, p in _EDGES)
_REFS = [(f"{t.name}.{c}", f"{f.parent}.{p}") for t in tpcc.schema().tables for f in t.foreign_keys[:1] for c, p in zip(f.columns, f.parent_columns)]


@_query(f"WITH RECURSIVE e(child, parent) AS (VALUES {_VALUES}), n(name) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in _NAMES)}), walk(name, level) AS (SELECT name, 0 FROM n WHERE name NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, level + 1 FROM walk JOIN e ON e.parent = walk.name) SELECT name AS table_name, CAST(max(level) AS INT) AS level FROM walk GROUP BY name")
def table_levels(spark, sf_dir):
    return graph.levels_frame(spark, _EDGES, _NAMES)


@_query(f"WITH RECURSIVE r(src, dst) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in _REFS)}), walk AS (SELECT * FROM r UNION ALL SELECT walk.src, r.dst FROM walk JOIN r ON r.src = walk.dst) SELECT src AS column_name, dst AS root_name FROM walk WHERE dst NOT IN (SELECT src FROM r)")
def root_keys(spark, sf_dir):
    return graph.root_frame(spark, _REFS)


_CHECKS = ["(rating >= 1 AND rating <= 5)", "((grade)::text = ANY ((ARRAY['A'::character varying, 'B'::character varying])::text[]))", "(priority IN (1, 2, 3))", "(score > 0 AND score < 100)", "(name <> 'x')", "(amount BETWEEN 0 AND 9999.99)"]


@_query("SELECT * FROM (VALUES (0, '', 1.0, 5.0, true, true), (1, 'A,B', NULL, NULL, true, true), (2, '1,2,3', NULL, NULL, true, true), (3, '', 0.0, 100.0, false, false), (4, NULL, NULL, NULL, NULL, NULL), (5, '', 0.0, 9999.99, true, true)) t(n, allowed, lo, hi, lo_in, hi_in)".replace("1.0, 5.0", "1.0::DOUBLE, 5.0::DOUBLE"))
def check_parsing(spark, sf_dir):
    rows = []
    for i, text in enumerate(_CHECKS):
        c: ColumnConstraint | None = constraints.parse_check(text)
        rows.append((i, ",".join(c.values), c.least, c.most, c.least_inclusive, c.most_inclusive) if c else (i, None, None, None, None, None))
    return spark.createDataFrame(rows, "n int, allowed string, lo double, hi double, lo_in boolean, hi_in boolean")


# --- declared schemas and how columns get their generators ---

_DDL = """
CREATE TYPE mood AS ENUM ('calm', 'it''s fine');
CREATE TABLE area (no int, code char(3), title varchar(40) NOT NULL, PRIMARY KEY (code, no));
CREATE TABLE person (id bigserial PRIMARY KEY, work_email varchar(60), feeling mood, score int CHECK (score > 0 AND score <= 9), price numeric(9,3) CHECK (price BETWEEN 1 AND 2.5), key uuid, tags text[], a_no int, a_code char(3),
  FOREIGN KEY (a_code, a_no) REFERENCES area (code, no));
"""
_SCHEMA = parse_ddl(_DDL)


@_query(
    "SELECT * FROM (VALUES ('area', 'no', 'INTEGER', NULL, 1, true, false, 2), ('area', 'code', 'CHAR', 3, 2, true, false, 1), ('area', 'title', 'VARCHAR', 40, 3, false, false, NULL), "
    "('person', 'id', 'BIGINT', NULL, 1, false, true, 1), ('person', 'work_email', 'VARCHAR', 60, 2, true, false, NULL), ('person', 'feeling', 'VARCHAR', NULL, 3, true, false, NULL), ('person', 'score', 'INTEGER', NULL, 4, true, false, NULL), "
    "('person', 'price', 'NUMERIC', 9, 5, true, false, NULL), ('person', 'key', 'OTHER', NULL, 6, true, false, NULL), ('person', 'tags', 'ARRAY', NULL, 7, true, false, NULL), ('person', 'a_no', 'INTEGER', NULL, 8, true, false, NULL), ('person', 'a_code', 'CHAR', 3, 9, true, false, NULL)) "
    "t(table_name, column_name, type_name, size, ordinal, nullable, identity, key_place)"
)
def declared_columns(spark, sf_dir):
    rows = [(t.name, c.name, c.type_name, c.size, c.ordinal, c.nullable, c.identity, t.primary_key.index(c.name) + 1 if c.name in t.primary_key else None) for t in _SCHEMA.tables for c in t.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, type_name string, size int, ordinal int, nullable boolean, identity boolean, key_place int")


@_query("SELECT * FROM (VALUES ('person', 1, 'a_code', 'area', 'code'), ('person', 2, 'a_no', 'area', 'no')) t(table_name, place, column_name, parent, parent_column)")
def declared_keys(spark, sf_dir):
    rows = [(t.name, i + 1, c, f.parent, p) for t in _SCHEMA.tables for f in t.foreign_keys for i, (c, p) in enumerate(zip(f.columns, f.parent_columns))]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, parent string, parent_column string")


@_query(
    "SELECT * FROM (VALUES ('id', 'column', 'sequential'), ('work_email', 'name rule', 'semantic'), ('feeling', 'constraint', 'weighted'), ('score', 'constraint', 'integer'), ('price', 'constraint', 'ranged_decimal'), ('key', 'type name rule', 'string'), "
    "('tags', 'default', 'string_array'), ('a_no', 'type rule', 'constant'), ('a_code', 'default', 'string')) t(column_name, source, kind)"
)
def resolved_generators(spark, sf_dir):
    """Configuration before rules by name, type name and type, before constraints, before the dialect's default."""
    registry = Registry().add(semantic.plugin).by_type_name("uuid", lambda c: g.string(36)).by_type("INTEGER", lambda c: g.constant(0, "INT"))
    t = _SCHEMA.table("person")
    rows = []
    for c in t.columns:
        own = Registry(registry.patterns, registry.type_names, {} if c.name == "score" else registry.types)
        found = resolve(c, {"ID": g.sequential()}, own, t.constraints.get(c.name), "postgres")
        rows.append((c.name, found.source, found.gen.kind))
    return spark.createDataFrame(rows, "column_name string, source string, kind string")


_PRODUCTS = {"PostgreSQL 18": "postgres", "CockroachDB (PostgreSQL wire)": "cockroach", "MariaDB, a MySQL": "mariadb", "MySQL 9": "mysql", "SQLite": "sqlite", "H2": "h2", "Other": "default"}


@_query("SELECT * FROM (VALUES {}) t(product, dialect)".format(", ".join(f"('{p}', '{d}')" for p, d in _PRODUCTS.items())))
def detected_dialects(spark, sf_dir):
    return spark.createDataFrame([(p, dialects.detect(p)) for p in _PRODUCTS], "product string, dialect string")


_COLUMNS = [(t.name, c.name, c.type_name, c.ordinal) for t in tpcc.schema().tables for c in t.columns]
_CHARS = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({}, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296)"
_SIGNED = "(CASE WHEN {0} % 4294967296 >= 2147483648 THEN {0} % 4294967296 - 4294967296 ELSE {0} % 4294967296 END)"


# 31-fold sums over name, table, no schema, no catalog, type and number, in 32 bits; then 1,000,003 times the base seed more
@_query(
    f"SELECT t, c, CAST(7 * 1000003 + {_SIGNED.format('h')} AS BIGINT) AS seed FROM (SELECT t, c, (((((((31 + n) * 31 + m) * 31) * 31) * 31 + k) * 31 + o) % 4294967296 + 4294967296) % 4294967296 AS h FROM ("
    f"SELECT t, c, {_SIGNED.format(_CHARS.format('c'))} AS n, {_SIGNED.format(_CHARS.format('t'))} AS m, {_SIGNED.format(_CHARS.format('kind'))} AS k, o::HUGEINT AS o FROM (VALUES {', '.join(map(str, _COLUMNS))}) v(t, c, kind, o)))"
)
def column_seeds(spark, sf_dir):
    return spark.createDataFrame([(t, c, column_seed(7, c, t, None, None, kind, o)) for t, c, kind, o in _COLUMNS], "t string, c string, seed long")


@_query("SELECT * FROM (VALUES {}) t(line)".format(", ".join([f"('  \"{n}\";')" for n in _NAMES] + [f"('  \"{c}\" -> \"{p}\";')" for c, p in _EDGES] + ["('digraph schema {')", "('}')"])))
def dot_lines(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in graph.dot(tpcc.schema()).splitlines()], "line string")


@_query(f"WITH e(child, parent) AS (VALUES {_VALUES}) SELECT child, parent, CAST(true AS BOOLEAN) AS parent_first FROM e")
def table_order(spark, sf_dir):
    """Whether the order has each parent before its child."""
    at = {n: i for i, n in enumerate(graph.order(tpcc.schema()))}
    return spark.createDataFrame([(c, p, at[p] < at[c]) for c, p in _EDGES], "child string, parent string, parent_first boolean")


_PRINTED = {"a": (g.integer_array(3), 5), "raw": (g.binary(4), 6), "n": (g.integer(-5, 5), 7)}


@_query(
    f"SELECT o_orderkey, '{{' || array_to_string(a, ',') || '}}' AS a, '[' || array_to_string(list_transform(range(4), lambda i: (('0x' || substr(hex(raw), 2 * i + 1, 2))::INT + 128) % 256 - 128), ', ') || ']' AS raw, n FROM ({duck_columns('orders', 'o_orderkey', _PRINTED, 'o_orderkey')})"
)
def rendered_rows(spark, sf_dir):
    return files.rendered(with_columns(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", _PRINTED))


@_query(f"SELECT CAST(child AS INT) AS child, area, num FROM (SELECT range AS child, 1 + range % 12 // 4 AS area, 1 + range % 12 % 4 AS num FROM range(100))".replace("area, num FROM", "CAST(area AS INT) AS area, CAST(num AS INT) AS num FROM"))
def aligned_composite_keys(spark, sf_dir):
    """A child's key of two columns is its parent's at the row index modulo the parent's rows."""
    ddl = "CREATE TABLE p (area int, num int, PRIMARY KEY (area, num)); CREATE TABLE c (child int, area int, num int, PRIMARY KEY (child), FOREIGN KEY (area, num) REFERENCES p (area, num));"
    config = FillConfig(1, 100, {"p": TableConfig(12, tpcc.dense(("area", "num"), {"area": 3, "num": 4})), "c": TableConfig(100, {"child": g.sequential(0, 1000)})})
    return fill(spark, parse_ddl(ddl), config)["c"]


# --- realistic values and the preset ---

_PEOPLE = duck_columns("customer", "c_custkey", semantic.person_gens(11), "c_custkey")


@_query(f'SELECT c_custkey, "first", "last", concat("first", \' \', "last") AS "full", concat(lower("first"), lower("last"), c_custkey) AS handle, concat(lower("first"), lower("last"), c_custkey, \'@example.com\') AS email FROM ({_PEOPLE.replace("AS first", "AS " + chr(34) + "first" + chr(34)).replace("AS last", "AS " + chr(34) + "last" + chr(34))})')
def people(spark, sf_dir):
    return semantic.with_person(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 11).select("c_custkey", "person.*")


_SPOTS = ", ".join("({}, {})".format(i, ", ".join(f"'{v}'" for v in (*p, semantic.COUNTRY))) for i, p in enumerate(semantic.PLACES))


@_query(f"SELECT c_custkey, p.city, p.state, p.state_name, p.zip, p.area, p.country FROM (WITH {duck_mixed('customer', {'z': 'c_custkey::HUGEINT + (12)'})} SELECT c_custkey, ((z % {len(semantic.PLACES)}) + {len(semantic.PLACES)}) % {len(semantic.PLACES)} AS spot FROM m) JOIN (VALUES {_SPOTS}) p(i, city, state, state_name, zip, area, country) ON p.i = spot")
def places(spark, sf_dir):
    return semantic.with_place(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 12).select("c_custkey", "place.*")


_SCALE = dict(items=200, districts=10, customers=30, new_orders=10)
_W = 2


_LINES = duck_columns("(SELECT range AS id FROM range(600))", "id", {"cnt": (g.child_count(5, 15, tpcc.COUNT_SALT), 1)}, "id")


@_query(f"SELECT table_name, CAST(n_rows AS BIGINT) AS n_rows FROM (VALUES ('warehouse', 2), ('item', 200), ('stock', 400), ('district', 20), ('customer', 600), ('history', 600), ('open_order', 600), ('new_order', 200)) t(table_name, n_rows) UNION ALL SELECT 'order_line', CAST(sum(cnt) AS BIGINT) FROM ({_LINES})")
def tpcc_rows(spark, sf_dir):
    made = tpcc.tables(spark, _W, **_SCALE)
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in made.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@_query(f"SELECT CAST(1 + id // 300 AS INT) AS ol_w_id, CAST(1 + id // 30 % 10 AS INT) AS ol_d_id, CAST(1 + id % 30 AS INT) AS ol_o_id, CAST(p + 1 AS INT) AS ol_number, CAST(1 + (before + p) % 200 AS INT) AS ol_i_id, 1 + id % 30 <= 20 AS delivered FROM (SELECT id, before, unnest(range(cnt)) AS p FROM (SELECT id, cnt, sum(cnt) OVER (ORDER BY id) - cnt AS before FROM ({_LINES})))")
def tpcc_order_line(spark, sf_dir):
    made = tpcc.tables(spark, _W, **_SCALE)["order_line"]
    return made.select("ol_w_id", "ol_d_id", "ol_o_id", "ol_number", "ol_i_id", F.col("ol_delivery_d").isNotNull().alias("delivered"))


@_query("SELECT 'stored counts' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'orphan lines', 0 UNION ALL SELECT 'orphan orders', 0 UNION ALL SELECT 'orphan new orders', 0 UNION ALL SELECT 'duplicate lines', 0 UNION ALL SELECT 'carriers', 0 UNION ALL SELECT 'credit', 0 UNION ALL SELECT 'zip', 0")
def tpcc_conformance(spark, sf_dir):
    t = tpcc.tables(spark, _W, **_SCALE)
    order, line = t["open_order"], t["order_line"]
    of = {"ol_w_id": "o_w_id", "ol_d_id": "o_d_id", "ol_o_id": "o_id"}
    broken = {
        "stored counts": verify.count_disagreements(order, line, {p: c for c, p in of.items()}, "o_ol_cnt"),
        "orphan lines": verify.orphans(line, order, of),
        "orphan orders": verify.orphans(order, t["customer"], {"o_w_id": "c_w_id", "o_d_id": "c_d_id", "o_c_id": "c_id"}),
        "orphan new orders": verify.orphans(t["new_order"], order, {"no_w_id": "o_w_id", "no_d_id": "o_d_id", "no_o_id": "o_id"}),
        "duplicate lines": verify.duplicate_keys(line, ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"]),
        "carriers": verify.null_violations(order, "o_id <= 20", "o_carrier_id", False),
        "credit": verify.domain_violations(t["customer"], "c_credit", ["GC", "BC"]),
        "zip": verify.pattern_violations(t["customer"], "c_zip", "____11111"),
    }
    out = None
    for rule, df in broken.items():
        one = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionAll(one)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
