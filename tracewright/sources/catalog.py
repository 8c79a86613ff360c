"""Catalog metadata of SQL Server, from JDBC or stored listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED_SCHEMAS = ("sys", "information_schema", "guest")
#: Kind groups of object types.
KINDS = {"P": "procedures", "V": "views", "FN": "functions", "IF": "functions", "TF": "functions", "U": "tables"}
MAX_DEFINITION = 4000


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def listing(kinds: dict[str, DataFrame]) -> DataFrame:
    """``(kind, schema, name)`` of each kind's ``(schema, name, is_shipped)``, without shipped objects and system schemas."""
    parts = [d.filter(~F.col("is_shipped")).select(F.lit(k).alias("kind"), "schema", "name") for k, d in kinds.items()]
    low = F.lower("schema")
    return reduce(DataFrame.unionByName, parts).filter(~low.isin(*EXCLUDED_SCHEMAS) & ~low.startswith("db_"))


def definitions(short: DataFrame, full: DataFrame) -> DataFrame:
    """``(key, definition)``: the full text where the short one is missing or may be cut."""
    f = full.select("key", F.col("definition").alias("whole"))
    text = F.when(F.length("definition").between(1, MAX_DEFINITION - 1), F.col("definition")).otherwise(F.coalesce("whole", "definition"))
    return short.join(f, "key", "left").select("key", text.alias("definition"))


def in_order(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """Parameters, columns or key columns of each object as one array in their order."""
    pairs = F.sort_array(F.collect_list(F.struct(ordinal, value)))
    return rows.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("items"))


def dependencies(rows: DataFrame) -> DataFrame:
    """``rows(module, entity, minor, is_selected, is_updated)`` -> tables read and written and columns written of a module."""
    whole = F.col("minor").isNull()
    picked = lambda c, v: F.sort_array(F.collect_set(F.when(c, F.col(v))))
    return rows.groupBy("module").agg(
        picked(whole & F.col("is_selected"), "entity").alias("reads"), picked(whole & F.col("is_updated"), "entity").alias("writes"), picked(~whole & F.col("is_updated"), "minor").alias("written_columns")
    )
