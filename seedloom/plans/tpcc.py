"""The TPC-C preset: nine tables of a scale in warehouses."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import generators as g
from ..functions import keys
from . import graph
from .engine import FillConfig, TableConfig, fill
from .model import SchemaModel, parse_ddl

#: The salts of line counts and of customer permutations, the load constant of last names, the syllables.
COUNT_SALT, PERMUTE_SALT, LOAD = 0x7C3C45219ABCDEF, 0x0C1D5EED9ABCDEF, 157
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
AS_OF = "2020-01-01 00:00:00"

#: The benchmark's nine tables, as its specification names them.
_ADDRESS = "{0}_street_1 varchar(20), {0}_street_2 varchar(20), {0}_city varchar(20), {0}_state char(2), {0}_zip char(9)"
_DISTS = ", ".join(f"s_dist_{i:02d} char(24)" for i in range(1, 11))
DDL = f"""
CREATE TABLE warehouse (w_id int, w_name varchar(10), {_ADDRESS.format("w")}, w_tax decimal(4,4), w_ytd decimal(12,2), PRIMARY KEY (w_id));
CREATE TABLE item (i_id int, i_im_id int, i_name varchar(24), i_price decimal(5,2), i_data varchar(50), PRIMARY KEY (i_id));
CREATE TABLE stock (s_w_id int, s_i_id int, s_quantity int, {_DISTS}, s_ytd decimal(8,2), s_order_cnt int, s_remote_cnt int, s_data varchar(50),
  PRIMARY KEY (s_w_id, s_i_id), FOREIGN KEY (s_w_id) REFERENCES warehouse (w_id), FOREIGN KEY (s_i_id) REFERENCES item (i_id));
CREATE TABLE district (d_w_id int, d_id int, d_name varchar(10), {_ADDRESS.format("d")}, d_tax decimal(4,4), d_ytd decimal(12,2), d_next_o_id int,
  PRIMARY KEY (d_w_id, d_id), FOREIGN KEY (d_w_id) REFERENCES warehouse (w_id));
CREATE TABLE customer (c_w_id int, c_d_id int, c_id int, c_first varchar(16), c_middle char(2), c_last varchar(16), {_ADDRESS.format("c")}, c_phone char(16), c_since timestamp, c_credit char(2),
  c_credit_lim decimal(12,2), c_discount decimal(4,4), c_balance decimal(12,2), c_ytd_payment float, c_payment_cnt int, c_delivery_cnt int, c_data varchar(500),
  PRIMARY KEY (c_w_id, c_d_id, c_id), FOREIGN KEY (c_w_id, c_d_id) REFERENCES district (d_w_id, d_id));
CREATE TABLE history (h_c_id int, h_c_d_id int, h_c_w_id int, h_d_id int, h_w_id int, h_date timestamp, h_amount decimal(6,2), h_data varchar(24),
  FOREIGN KEY (h_c_w_id, h_c_d_id, h_c_id) REFERENCES customer (c_w_id, c_d_id, c_id), FOREIGN KEY (h_w_id, h_d_id) REFERENCES district (d_w_id, d_id));
CREATE TABLE open_order (o_w_id int, o_d_id int, o_id int, o_c_id int, o_entry_d timestamp, o_carrier_id int, o_ol_cnt int, o_all_local int,
  PRIMARY KEY (o_w_id, o_d_id, o_id), FOREIGN KEY (o_w_id, o_d_id, o_c_id) REFERENCES customer (c_w_id, c_d_id, c_id));
CREATE TABLE new_order (no_w_id int, no_d_id int, no_o_id int, PRIMARY KEY (no_w_id, no_d_id, no_o_id),
  FOREIGN KEY (no_w_id, no_d_id, no_o_id) REFERENCES open_order (o_w_id, o_d_id, o_id));
CREATE TABLE order_line (ol_w_id int, ol_d_id int, ol_o_id int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_delivery_d timestamp, ol_quantity int, ol_amount decimal(6,2), ol_dist_info char(24),
  PRIMARY KEY (ol_w_id, ol_d_id, ol_o_id, ol_number), FOREIGN KEY (ol_w_id, ol_d_id, ol_o_id) REFERENCES open_order (o_w_id, o_d_id, o_id), FOREIGN KEY (ol_supply_w_id, ol_i_id) REFERENCES stock (s_w_id, s_i_id));
"""


def schema() -> SchemaModel:
    return parse_ddl(DDL)


def credit() -> g.Gen:
    """BC for a tenth, else GC."""
    return g.weighted({"BC": 10, "GC": 90})


def nurand(a: int, x: int, y: int, c: int = LOAD) -> g.Gen:
    """((uniform(0, a) | uniform(x, y)) + c) % (y - x + 1) + x."""
    return g.Gen("nurand", 2, lambda d, u, n: f"CAST((({u[0]} % {a + 1} | ({x} + {u[1]} % {y - x + 1})) + {c}) % {y - x + 1} + {x} AS INT)", params={"a": a, "x": x, "y": y, "c": c})


def last_name(number: str, d: g.Dialect) -> str:
    part = lambda e: d.pick([d.quote(s) for s in SYLLABLES], e)
    return f"concat({part(d.div(number, 100))}, {part(d.div(number, 10) + ' % 10')}, {part(f'{number} % 10')})"


def customer_last(group: int, enumerated: int) -> g.Gen:
    """Names 0, 1 ... of the first customers of each district, NURand(255, 0, 999) for the others."""
    if not 0 <= enumerated <= 1000 or (enumerated and group < 1):
        raise ValueError("0 to 1000 names are enumerated, within groups")
    drawn = nurand(255, 0, 999)

    def formula(d: g.Dialect, u: list[str], n: str) -> str:
        number = drawn.sql(d, u, n)
        if enumerated:
            number = f"CASE WHEN {n} % {group} < {enumerated} THEN CAST({n} % {group} AS INT) ELSE {number} END"
        return last_name(f"({number})", d)

    return g.Gen("customer_last", 2, formula, params={"group": group, "enumerated": enumerated})


def data_column() -> g.Gen:
    """26 to 50 letters; a tenth hold ORIGINAL at a random place."""
    body = g.variable_string(26, 50)

    def value(whole: str, u: list[str]) -> str:
        """whole is the text before it is cut to its length of 26 to 50, drawn by u[2]."""
        n = f"CAST(26 + {u[2]} % 25 AS INT)"
        at = f"CAST({u[1]} % ({n} - 7) AS INT)"
        marked = f"concat(substr({whole}, 1, {at}), 'ORIGINAL', substr({whole}, {at} + 9, {n} - {at} - 8))"
        return f"CASE WHEN {u[0]} % 10 = 0 THEN {marked} ELSE substr({whole}, 1, {n}) END"

    def formula(d: g.Dialect, u: list[str], n: str) -> str:
        # the shortest way to write it: cut first, then mark
        cut = body.sql(d, u[2:], n)
        at = f"CAST({u[1]} % (length({cut}) - 7) AS INT)"
        return f"CASE WHEN {u[0]} % 10 = 0 THEN concat(substr({cut}, 1, {at}), 'ORIGINAL', substr({cut}, {at} + 9)) ELSE {cut} END"

    text = g.Text(body.text.pool, body.text.size, 3, lambda t, u, n: value(t, u))
    return g.Gen("data_column", body.draws + 2, formula, text=text)


def zip_code() -> g.Gen:
    return g.Gen("zip_code", 1, lambda d, u, n: f"concat(lpad({d.text(f'{u[0]} % 10000')}, 4, '0'), '11111')")


def delivery_date(threshold: int, orders: int, as_of: str = AS_OF) -> g.Gen:
    """The instant for lines of orders up to the threshold, null for those still open; the row index is the order's."""
    return g.Gen("delivery_date", 0, lambda d, u, n: f"CASE WHEN 1 + {n} % {orders} <= {threshold} THEN CAST('{as_of}' AS {'TIMESTAMP_NTZ' if d.name == 'spark' else 'TIMESTAMP'}) END")


def dense(columns: Sequence[str], sizes: Mapping[str, int], first: Mapping[str, int] = {}) -> dict[str, g.Gen]:
    """Generators of a key of several columns that takes every combination once, the last column fastest."""
    out, repeat = {}, 1
    for name in reversed(columns):
        size = max(1, sizes[name])
        out[name] = g.key_component(first.get(name, 1), repeat, size)
        repeat *= size
    return dict(reversed(out.items()))


def key_sizes(model: SchemaModel, sizes: Mapping[tuple[str, str], int]) -> dict[str, dict[str, int]]:
    """Table -> key column -> how many values it takes: those of the column that its references lead to."""
    out: dict[str, dict[str, int]] = {}
    for t in model.tables:
        names = t.primary_key or t.foreign_keys[0].columns
        out[t.name] = {n: sizes[root] for n in names if (root := graph.root_key(model, t.name, n)) in sizes}
    return out


def _fixed(**columns: tuple[object, str]) -> dict[str, g.Gen]:
    return {n: g.constant(value, kind) for n, (value, kind) in columns.items()}


def build(warehouses: int, items: int = 100_000, districts: int = 10, customers: int = 3000, least: int = 5, most: int = 15, new_orders: int = 900, seed: int = 0, as_of: str = AS_OF, partitions: int | None = None) -> FillConfig:
    """Configuration of all tables; orders of a district are as many as its customers."""
    if min(warehouses, items, districts, customers) < 1 or not 0 <= new_orders <= customers:
        raise ValueError("scales are positive, and new orders at most as many as customers")
    model = schema()
    own_axis = {("warehouse", "w_id"): warehouses, ("item", "i_id"): items, ("district", "d_id"): districts, ("customer", "c_id"): customers, ("open_order", "o_id"): customers}
    sizes = key_sizes(model, own_axis)
    sizes["new_order"]["no_o_id"] = new_orders  # the last ones of a district
    rows = {t: math.prod(s.values()) for t, s in sizes.items()}
    made = {t: dense(tuple(s), s, {"no_o_id": customers - new_orders + 1}) for t, s in sizes.items()}
    delivered, orders_ = customers - new_orders, rows["open_order"]

    def orders(spark: SparkSession) -> DataFrame:
        return keys.keyed_permutation(spark.range(0, orders_, 1, partitions), "id", customers, PERMUTE_SALT, "customer", 1)

    def lines(spark: SparkSession) -> DataFrame:
        return keys.lines(spark, orders_, least, most, COUNT_SALT)

    column = lambda name: g.Gen("source", 0, lambda dialect, u, n: name)
    tax = g.scaled_decimal(0, 0.2, 4, 4)
    money, cents = "DECIMAL(12,2)", "DECIMAL(6,2)"
    made["warehouse"] |= {"w_zip": zip_code(), "w_tax": tax, **_fixed(w_ytd=("300000.00", money))}
    made["item"] |= {"i_data": data_column(), "i_im_id": g.integer(1, 10_001), "i_price": g.scaled_decimal(1, 100, 2, 5)}
    made["stock"] |= {"s_data": data_column(), "s_quantity": g.integer(10, 101), **_fixed(s_ytd=("0.00", "DECIMAL(8,2)"), s_order_cnt=(0, "INT"), s_remote_cnt=(0, "INT"))}
    made["district"] |= {"d_zip": zip_code(), "d_tax": tax, **_fixed(d_ytd=("30000.00", money), d_next_o_id=(customers + 1, "INT"))}
    made["customer"] |= {
        "c_zip": zip_code(), "c_last": customer_last(customers, min(customers, 1000)), "c_credit": credit(), "c_discount": g.scaled_decimal(0, 0.5, 4, 4), "c_phone": g.string(16, False, True), "c_data": g.variable_string(300, 500, True, True),
        **_fixed(c_middle=("OE", "STRING"), c_credit_lim=("50000.00", money), c_balance=("-10.00", money), c_ytd_payment=("10.0", "FLOAT"), c_payment_cnt=(1, "INT"), c_delivery_cnt=(0, "INT")),
    }
    # a payment of each customer, in the customer's district
    made["history"] |= {f"h_{n}": made["history"][f"h_c_{n}"] for n in ("w_id", "d_id")} | {"h_data": g.variable_string(12, 24), **_fixed(h_amount=("10.00", cents))}
    made["open_order"] |= {"o_c_id": column("customer"), "o_carrier_id": g.grouped_prefix(customers, delivered, g.integer(1, 11)), "o_ol_cnt": g.child_count(least, most, COUNT_SALT), **_fixed(o_all_local=(1, "INT"))}
    order_key = dense(tuple(sizes["open_order"]), sizes["open_order"])
    of_order = dict(zip(model.table("order_line").foreign_keys[0].columns, order_key.values()))
    made["order_line"] = of_order | {"ol_supply_w_id": of_order["ol_w_id"], "ol_number": column("position + 1"), "ol_i_id": made["item"]["i_id"], "ol_amount": g.scaled_decimal(0.01, 9999.99, 2, 6), "ol_delivery_d": delivery_date(delivered, customers, as_of), **_fixed(ol_quantity=(5, "INT"))}
    by_order = dict.fromkeys([*of_order, "ol_supply_w_id", "ol_delivery_d"], "parent")

    special = {"open_order": TableConfig(orders_, made["open_order"], orders), "order_line": TableConfig(None, made["order_line"], lines, by_order)}
    return FillConfig(seed, 1000, {t.name: special.get(t.name) or TableConfig(rows[t.name], made[t.name]) for t in model.tables}, partitions=partitions)


def tables(spark: SparkSession, warehouses: int, **scales) -> dict[str, DataFrame]:
    """The nine tables by name."""
    return fill(spark, schema(), build(warehouses, **scales))
