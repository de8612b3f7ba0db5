"""A database within the process: its schema, loading, and what is read back; recorded answers where a server would be needed."""

import warnings

import pytest

from seedloom.functions import generators as g
from seedloom.operators import verify
from seedloom.plans import graph
from seedloom.plans.engine import Filled, FillConfig, TableConfig, fill
from seedloom.plans.model import parse_ddl
from seedloom.sources import database, jdbc

DDL = (
    "CREATE TABLE shop (area INT NOT NULL, num INT NOT NULL, title VARCHAR(12) DEFAULT 'x', PRIMARY KEY (num, area))",
    "CREATE TABLE buyer (id INT PRIMARY KEY, email VARCHAR(40), rating INT CHECK (rating >= 1 AND rating <= 5), status VARCHAR(12) CHECK (status IN ('new', 'it''s, old')))",
    "CREATE TABLE sale (id BIGINT GENERATED ALWAYS AS IDENTITY, s_num INT, s_area INT, b INT REFERENCES buyer (id), amount DECIMAL(8,3), sold TIMESTAMP, raw VARCHAR(20) FOR BIT DATA, CONSTRAINT of_shop FOREIGN KEY (s_num, s_area) REFERENCES shop (num, area))",
)


@pytest.fixture(scope="module")
def url(spark):
    at = "jdbc:derby:memory:fill"
    with database.connected(spark, at, {"create": "true"}) as c:
        for sql in DDL:
            s = c.createStatement()
            s.execute(sql)
            s.close()
    return at


def test_schema_of_a_database(spark, url):
    found = database.database_schema(spark, url)
    assert found.product == "Apache Derby" and [t.name for t in found.tables] == ["BUYER", "SALE", "SHOP"]
    shop, sale = found.table("shop"), found.table("sale")
    assert shop.primary_key == ("NUM", "AREA") and [c.ordinal for c in shop.columns] == [1, 2, 3]
    assert [(c.name, c.type_name, c.size, c.digits, c.identity, c.nullable) for c in sale.columns][:2] == [("ID", "BIGINT", 19, None, True, False), ("S_NUM", "INTEGER", 10, None, False, True)]
    assert sale.column("amount").digits == 3 and sale.column("raw").type_name == "VARBINARY" and shop.column("title").default == "'x'"
    keys = {f.columns: (f.parent, f.parent_columns) for f in sale.foreign_keys}
    assert keys == {("S_NUM", "S_AREA"): ("SHOP", ("NUM", "AREA")), ("B",): ("BUYER", ("ID",))}
    rules = found.table("buyer").constraints
    assert rules["STATUS"].values == ("new", "it's, old") and (rules["RATING"].least, rules["RATING"].most) == (1.0, 5.0)
    assert graph.root_key(found, "sale", "s_area") == ("SHOP", "AREA")


@pytest.mark.parametrize("partitions", [1, 3])
def test_fill_and_read_back(spark, url, partitions):
    """Level by level into enforced foreign keys; the rows are the frames' rows."""
    found = database.database_schema(spark, url)
    config = FillConfig(5, 40, {"shop": TableConfig(12, {"area": g.key_component(1, 4, 3), "num": g.key_component(1, 1, 4)}), "buyer": TableConfig(30, {"id": g.sequential(1, 1000)}), "sale": TableConfig(200)}, partitions=2)
    made = fill(spark, found, config)
    with database.connected(spark, url) as c:
        for table in ("sale", "buyer", "shop"):
            s = c.createStatement()
            s.execute(f"DELETE FROM {table}")
            s.close()
    levels = graph.levels([t.name for t in found.tables], graph.edges(found))
    assert levels == [["BUYER", "SHOP"], ["SALE"]]
    jdbc.write_tables(made, url, levels=levels, partitions=partitions, batch=50)
    read = lambda t: spark.read.jdbc(url, t)
    assert (read("SHOP").count(), read("BUYER").count(), read("SALE").count()) == (12, 30, 200)
    assert verify.differences(made["SHOP"], read("SHOP").selectExpr(*made["SHOP"].columns)).count() == 0
    back = read("SALE")
    assert back.select("ID").distinct().count() == 200
    assert verify.orphans(back, read("SHOP"), {"S_NUM": "NUM", "S_AREA": "AREA"}).count() == 0
    assert verify.domain_violations(read("BUYER"), "STATUS", ["new", "it's, old"]).count() == 0


def test_a_failing_table_raises(spark, url):
    bad = {"BUYER": spark.createDataFrame([(1,), (1,)], "ID int")}
    with pytest.raises(Exception, match="(?i)duplicate|batch|constraint|aborted"):
        jdbc.write_tables(bad, url, levels=[["BUYER"]])


def test_commit_strategies():
    assert jdbc.commit_partitions(10_500, 1000, "per_table") == 1
    assert jdbc.commit_partitions(10_500, 1000, "every_n_batches", 2) == 6
    assert jdbc.commit_partitions(10, strategy="per_partition", partitions=4) == 4
    for wrong in ({"strategy": "never"}, {"every": 0}):
        with pytest.raises(ValueError):
            jdbc.commit_partitions(10, **wrong)


def test_unordered_loading_is_probed(spark, url, monkeypatch):
    with pytest.warns(UserWarning, match="can't load without order"):
        assert database.unordered_properties(spark, url, "derby") is None
    # a database that takes the property but shows another value, then one that refuses, then one that agrees
    monkeypatch.setitem(database.UNORDERED, "derby", ({"x": "1"}, "VALUES 'origin'", "replica"))
    with pytest.warns(UserWarning, match="stay on"):
        assert database.unordered_properties(spark, url, "derby") is None
    monkeypatch.setitem(database.UNORDERED, "derby", ({"x": "1"}, "not a query", "replica"))
    with pytest.warns(UserWarning, match="can't be turned off"):
        assert database.unordered_properties(spark, url, "derby") is None
    monkeypatch.setitem(database.UNORDERED, "derby", ({"x": "1"}, "VALUES 'replica'", "replica"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert database.unordered_properties(spark, url, "derby", {"user": "a"}) == {"user": "a", "x": "1"}


def test_recorded_rules_of_a_server(monkeypatch):
    """What the catalog of a server answers, without one."""
    answers = {"checks": [("t", "score", "CHECK (((score >= 1) AND (score <= 9)))"), ("t", "name", "CHECK ((name ~ 'x'))"), ("t", "state", "CHECK ((state IN ('a')))"), ("other", "c", "CHECK (c IN (1))")], "labels": [("t", "state", "NEW"), ("t", "state", "it's")]}
    monkeypatch.setattr(database, "query", lambda c, sql, n: answers["labels" if "pg_enum" in sql else "checks"])
    with pytest.warns(UserWarning, match="not honored"):
        found = database.value_rules(None, "postgres", "public", {"t": ["score", "name", "state"]})
    assert found["t"]["state"].values == ("NEW", "it's") and found["t"]["score"].most == 9 and "name" not in found["t"]
    assert database.enum_labels("enum('a','it''s','c,d')") == ("a", "it's", "c,d")
    assert database.value_rules(None, "sqlite", None, {"t": []}) == {"t": {}}


front = Filled("CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (id int PRIMARY KEY, p int REFERENCES p (id));").rows(20).seed(3).table("p", TableConfig(5, {"id": g.sequential(1, 100)}))


@front
def test_front_end(spark, tables):
    assert spark.sql("SELECT count(*) FROM c JOIN p ON c.p = p.id").first()[0] == 20
    again = front.rows(20).frames(spark)
    assert verify.differences(tables["c"], again["c"]).count() == 0
    assert verify.differences(tables["c"], front.seed(4).frames(spark)["c"]).count() > 0


def test_own_dialect(spark):
    from seedloom.plans import dialects

    name = dialects.extended("tiny", "postgres", integer=lambda c: g.integer(0, 3))
    try:
        made = fill(spark, parse_ddl("CREATE TABLE t (a int, u uuid)"), FillConfig(1, 50, dialect=name))["t"]
        assert {r.a for r in made.collect()} == {0, 1, 2}
        with pytest.raises(ValueError):
            dialects.extended("tiny")
    finally:
        del dialects.DIALECTS[name]
