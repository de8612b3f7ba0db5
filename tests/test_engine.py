"""Schemas, filling, files and streams."""

import duckdb
import numpy as np
import pytest

from seedloom.functions import generators as g
from seedloom.functions import keys
from seedloom.functions.mixing import GAMMA, FIRST, mix64
from seedloom.functions.semantic import plugin
from seedloom.operators import verify
from seedloom.plans import graph
from seedloom.plans.engine import FillConfig, TableConfig, fill
from seedloom.plans.model import parse_ddl
from seedloom.plans.registry import Registry
from seedloom.sources import files, jdbc
from seedloom.streaming.generated import stream

DDL = """
CREATE TYPE state AS ENUM ('NEW', 'PAID');
CREATE TABLE parent (id uuid PRIMARY KEY, email varchar(30), rating int CHECK (rating >= 1 AND rating <= 5), status state);
CREATE TABLE child (id int PRIMARY KEY, owner uuid REFERENCES parent (id), amount numeric(8,2));
"""


def test_fill_is_the_same_for_any_partitions_and_keeps_its_keys(spark):
    config = lambda n: FillConfig(42, 50, {"child": TableConfig(120, {"id": g.sequential(1, 1000)})}, Registry().add(plugin), "postgres", n)
    one, many = fill(spark, parse_ddl(DDL), config(1)), fill(spark, parse_ddl(DDL), config(7))
    for name in one:
        assert verify.differences(one[name], many[name]).count() == 0
    assert one["child"].count() == 120 and one["child"].agg({"id": "max"}).collect()[0][0] == 120
    assert verify.orphans(one["child"], one["parent"], {"owner": "id"}).count() == 0
    assert verify.duplicate_keys(one["parent"], ["id"]).count() == 0
    assert verify.range_violations(one["parent"], {"rating": (1, 5)}).count() == 0
    assert verify.domain_violations(one["parent"], "status", ["NEW", "PAID"]).count() == 0
    assert verify.pattern_violations(one["parent"], "email", "%@example.com").count() == 0


def test_circles_are_refused(spark):
    with pytest.raises(graph.CycleError):
        fill(spark, parse_ddl("CREATE TABLE a (x int REFERENCES b (y)); CREATE TABLE b (y int REFERENCES a (x));"))


def test_draws_match_big_integers(spark):
    found = g.with_columns(spark.range(50), "id", {"v": (g.long(), 7)}).collect()
    top = (1 << 63) - 1
    assert [r.v for r in found] == [((mix64(mix64(7) + r.id) & ((1 << 64) - 1)) >> 1) % top for r in found]


@pytest.mark.parametrize("size", [1, 2, 10, 37])
def test_permutation_against_plain_python(size):
    every = (1 << 64) - 1
    half = ((size - 1).bit_length() + 1) // 2

    def place(n):
        key, v = mix64(5 + n // size) & every, n % size
        while True:
            left, right = v >> half, v & ((1 << half) - 1)
            for step in range(1, 5):
                # mix64 adds GAMMA itself
                f = mix64(right * GAMMA + key + step * FIRST - GAMMA) & ((1 << half) - 1)
                left, right = right, left ^ f
            v = left << half | right
            if v < size:
                return v

    rows = np.arange(3 * size)
    assert keys.permuted(rows, size, 5).tolist() == [place(int(n)) for n in rows]


def test_text_round_trip(spark, tmp_path):
    made = files.generate(spark, {"id": (g.sequential(), 1), "t": (g.string(12), 2), "a": (g.integer_array(), 3), "raw": (g.binary(3), 4)}, 20)
    for kind in files.KINDS:
        files.write_text(made, str(tmp_path / kind), kind)
        back = files.read_text(spark, str(tmp_path / kind), "id int, t string, a string, raw string", kind)
        assert verify.differences(files.rendered(made), back).count() == 0
    row = files.rendered(spark.createDataFrame([([1, None], bytearray(b"\x01\xff"))], "a array<int>, b binary")).collect()[0]
    assert tuple(row) == ("{1,null}", "[1, -1]")


def test_urls():
    assert jdbc.with_parameter("jdbc:x://h/d", "a", "1") == "jdbc:x://h/d?a=1"
    assert jdbc.with_parameter("jdbc:x://h/d?b=2", "a", "1") == "jdbc:x://h/d?b=2&a=1"
    assert jdbc.batch_hint("jdbc:postgresql://h/d?rewritebatchedinserts=TRUE", "postgres") is None
    assert jdbc.batch_hint("jdbc:mysql://h/d", "mysql") == "rewriteBatchedStatements=true"


def test_stream_has_the_values_of_the_batch(spark, tmp_path):
    columns = {"k": (g.integer(0, 1000), 3)}
    query = stream(spark, columns, 200).writeStream.format("memory").queryName("generated").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(40):
            query.processAllAvailable()
            if spark.table("generated").count():
                break
    finally:
        query.stop()
    found = {r.value: r.k for r in spark.table("generated").collect()}
    want = {r.id: r.k for r in g.with_columns(spark.range(max(found) + 1), "id", columns).collect()}
    assert found and all(want[v] == k for v, k in found.items())


def test_descriptor_round_trip(spark):
    columns = {"id": (g.sequential(3, 9), 1), "t": (g.variable_string(2, 9, True, True), 2), "w": (g.weighted({"a": 1, "b": 2}), 3), "d": (g.scaled_decimal(0, 5, 2), 4), "n": (g.normal(5.0, 2.0), 5), "z": (g.zipf(1, 90, 1.2), 6), "x": (g.any_text(3), 7), "when": (g.instant(), 8), "c": (g.constant(7, "INT"), 9)}
    back, rows = files.from_descriptor(files.descriptor(columns, 70))
    assert rows == 70 and list(back) == list(columns)
    assert verify.differences(files.generate(spark, columns, rows), files.generate(spark, back, rows)).count() == 0
    with pytest.raises(ValueError):
        files.from_descriptor('{"rows": 1, "columns": [{"name": "a", "type": "other", "seed": 1}]}')


def test_any_text_has_assigned_code_points_only(spark):
    import unicodedata

    found = [r.t for r in g.with_columns(spark.range(3000), "id", {"t": (g.any_text(10), 4)}).collect()]
    assert all(len(t) == 10 and all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in t) for t in found)
    assert len({c for t in found for c in t}) > 20_000


def test_any_text_keeps_a_first_byte_order_mark(spark):
    columns = {"t": (g.any_text(6), 1000)}
    found = [r.t for r in g.with_columns(spark.range(137561, 137562), "id", columns).collect()]
    con = duckdb.connect()
    want = con.execute(f"SELECT t FROM ({g.duck_columns('(SELECT 137561 AS id)', 'id', columns, 'id')})").fetchall()
    assert found == [want[0][0]] and found[0][0] == "\ufeff" and len(found[0]) == 6


def test_names_choose_generators():
    made = Registry().add(plugin)
    from seedloom.plans.model import ColumnModel

    kind = lambda name: (found := made.find(ColumnModel(name, "VARCHAR", 30))) and found[1](ColumnModel(name, "VARCHAR", 30))
    assert all(kind(n) is not None for n in ("work_email", "EMAIL_ADDRESS", "billing_city", "w_zip", "postal_code", "home_phone_2", "customer_first_name", "name", "statement"))
    assert kind("names") is None and kind("rating") is None
    assert "@example.com" in kind("email_address").sql(g.SPARK, ["1", "2"], "0") and "555-01" not in kind("city").sql(g.SPARK, ["1"], "0")


def test_bounds_are_met(spark):
    made = g.with_columns(spark.range(2000), "id", {"a": (g.between(0.1, 0.3, False, True), 1), "b": (g.between(1.0, 1.0000000000000004, False, False), 2)}).agg({"a": "min", "b": "max"}).first()
    assert made[0] > 0.1 and made[1] == 1.0000000000000002
    from seedloom.plans import constraints
    from seedloom.plans.model import ColumnConstraint, ColumnModel

    for kind in ("DOUBLE", "REAL"):
        rule = ColumnConstraint(least=0.1, least_inclusive=False, most=0.10000001, most_inclusive=True)
        gen = constraints.generator(ColumnModel("c", kind), rule)
        if gen is not None:
            found = g.with_columns(spark.range(300), "id", {"c": (gen, 3)})
            assert found.filter(f"NOT ({constraints.predicate('CAST(c AS DOUBLE)', rule)})").count() == 0
    assert constraints.generator(ColumnModel("c", "DOUBLE"), ColumnConstraint(least=1.0, least_inclusive=False, most=1.0)) is None


def test_tables_are_written_at_once(spark, tmp_path):
    made = {f"t{i}": files.generate(spark, {"a": (g.integer(), i)}, 100) for i in range(6)}
    files.write_tables(made, str(tmp_path / "all"))
    assert all(verify.differences(df, spark.read.parquet(str(tmp_path / "all" / f"{n}.parquet"))).count() == 0 for n, df in made.items())
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_tables(made, str(tmp_path / "all"))
    files.write_text(made["t1"], str(tmp_path / "text"), "pipe")
    assert list((tmp_path / "text").glob("*.txt")) and not list((tmp_path / "text").glob("*.csv"))


def test_places_from_a_file(spark, tmp_path):
    from seedloom.functions.semantic import read_places

    (tmp_path / "p.csv").write_text("# a comment\ncity,st,state,zip,area\nAustin,TX,Texas,78701,512\n\nBoise,ID,Idaho,83702,208\n")
    assert read_places(spark, str(tmp_path / "p.csv")) == (("Austin", "TX", "Texas", "78701", "512"), ("Boise", "ID", "Idaho", "83702", "208"))
    with pytest.raises(ValueError):
        read_places(spark, str(tmp_path / "p.csv"), 1)


def test_distributions(spark):
    """Shares and moments, apart from the formulas by which they are made."""
    n = 40_000
    columns = {"z": (g.zipf(1, 500, 1.0), 1), "w": (g.weighted({"a": 1, "b": 3, "c": 6}), 2), "m": (g.normal(10.0, 2.0), 3), "s": (g.skewed_timestamp(0, 1_000_000_000, 3.0), 4), "u": (g.integer(0, 10), 5), "k": (g.string(1), 6), "long": (g.string(300, True, True), 7)}
    rows = g.with_columns(spark.range(n), "id", columns).selectExpr("*", "unix_millis(CAST(s AS TIMESTAMP)) AS ms").toPandas()
    harmonic = sum(1 / k for k in range(1, 501))
    for k in (1, 2, 10):
        assert abs((rows.z == k).mean() - 1 / k / harmonic) < 0.006
    assert rows.z.max() <= 500 and abs((rows.z <= 20).mean() - sum(1 / k for k in range(1, 21)) / harmonic) < 0.01
    assert [round((rows.w == v).mean(), 1) for v in "abc"] == [0.1, 0.3, 0.6]
    assert abs(rows.m.mean() - 10) < 0.05 and abs(rows.m.std() - 2) < 0.05 and abs((abs(rows.m - 10) < 2).mean() - 0.6827) < 0.01
    assert abs(rows.ms.mean() / 1e9 - 0.75) < 0.01  # the mean of u ** (1 / 3)
    assert all(abs((rows.u == v).mean() - 0.1) < 0.008 for v in range(10))
    share = rows.k.value_counts(normalize=True)
    assert len(share) == 52 and share.max() < 0.025 and share.min() > 0.014
    every = "".join(rows.long[:500])
    assert set(map(len, rows.long)) == {300} and len(set(every)) == 62 and max(every.count(c) for c in set(every)) < 1.15 * len(every) / 62


def test_the_clock_is_the_clock(spark):
    from datetime import datetime, timezone

    before = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    found = g.with_columns(spark.range(5), "id", {"now": (g.current_timestamp(), 1)}).selectExpr("CAST(to_utc_timestamp(now, current_timezone()) AS TIMESTAMP_NTZ) AS now").collect()
    assert len({r.now for r in found}) == 1 and before <= found[0].now <= datetime.now(timezone.utc).replace(tzinfo=None)
