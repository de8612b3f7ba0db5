"""Questions to a recorded database catalog, as joins of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _owned(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Columns that are still there, with table and schema."""
    live = attributes.filter("attnum > 0 AND NOT attisdropped")
    tables = classes.select(F.col("oid").alias("attrelid"), F.col("relname").alias("table_name"), F.col("relnamespace"))
    schemas = namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    return live.join(tables, "attrelid").join(schemas, "relnamespace")


def enum_columns(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame, types: DataFrame, enums: DataFrame) -> DataFrame:
    """schema_name, table_name, column_name, place, label: the labels of each enum column in their order, from 1."""
    kinds = types.select(F.col("oid").alias("atttypid"))
    labels = enums.select(F.col("enumtypid").alias("atttypid"), "enumsortorder", "enumlabel")
    rows = _owned(attributes, classes, namespaces).join(kinds, "atttypid").join(labels, "atttypid")
    # an enum type's labels are few: one small group for each column
    grouped = rows.groupBy("schema_name", "table_name", F.col("attname").alias("column_name")).agg(F.sort_array(F.collect_list(F.struct("enumsortorder", "enumlabel"))).alias("labels"))
    return grouped.select("schema_name", "table_name", "column_name", F.posexplode("labels").alias("at", "l")).select("schema_name", "table_name", "column_name", (F.col("at") + 1).alias("place"), F.col("l.enumlabel").alias("label"))


def check_columns(attributes: DataFrame, classes: DataFrame, namespaces: DataFrame, rules: DataFrame) -> DataFrame:
    """schema_name, table_name, column_name, rule: CHECK rules on a single column. rules: conrelid, contype, conkey (array), definition."""
    single = rules.filter("contype = 'c' AND size(conkey) = 1").select(F.col("conrelid").alias("attrelid"), F.explode("conkey").alias("attnum"), F.col("definition").alias("rule"))
    return _owned(attributes, classes, namespaces).join(single, ["attrelid", "attnum"]).select("schema_name", "table_name", F.col("attname").alias("column_name"), "rule")


def unvalidated_keys(rules: DataFrame) -> DataFrame:
    """n: foreign keys that the database hasn't checked against all rows."""
    return rules.filter("contype = 'f' AND NOT convalidated").agg(F.count(F.lit(1)).alias("n"))
