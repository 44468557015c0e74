"""A wide one-row-per-person table derived from orders, customer and nation.

It has the shape of a registration file (text columns, money text, yes/no
flags, coordinates) with nulls and odd values planted on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.sources.tables import table

# The columns of the three tables that are used here, as they are stored.
_SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def people(spark: SparkSession, directory: str) -> DataFrame:
    """Spark picks the join strategies from table sizes; nothing is forced.

    ``nation`` has 25 rows at any scale, so Spark broadcasts it. The join with
    ``customer`` becomes a shuffle when that table is large; adaptive
    execution then splits a customer who owns very many orders.
    """
    orders, customer, nation = (
        table(spark, directory, name, schema) for name, schema in _SCHEMAS.items()
    )
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return joined.select(
        key.alias("person_id"),
        F.col("n_name").alias("county"),
        _age(key, cust).alias("age"),
        _gender(key).alias("gender"),
        F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("ethnic_group"),
        F.col("o_orderpriority").alias("income_band"),
        _income(key, price).alias("income_amount"),
        F.concat(F.lit("$"), (40000 + 1000 * F.col("c_nationkey")).cast("string")).alias("area_income"),
        _coordinate(key, 30.25, 37, 400).alias("latitude"),
        _coordinate(key, -85.5, 53, 500).alias("longitude"),
        _voted(key, F.col("o_orderstatus")).alias("voted"),
        F.when((cust + key) % 8 < 2, "Yes").alias("interest_a"),
        F.when((cust * 3 + key) % 11 < 3, "Yes").alias("interest_b"),
        F.when((key * 5) % 17 == 0, "Yes").when(key % 17 == 1, "U").alias("interest_c"),
    )


def _age(key: Column, cust: Column) -> Column:
    """Null for every 97th key, the special value 100 for every 41st."""
    return (
        F.when(key % 97 == 0, F.lit(None))
        .when(key % 41 == 0, "100")
        .otherwise((18 + (key * 7 + cust) % 70).cast("string"))
    )


def _gender(key: Column) -> Column:
    return F.when(key % 9 == 0, F.lit(None)).when((key % 9).isin(1, 2, 3, 4), "F").otherwise("M")


def _income(key: Column, price: Column) -> Column:
    """Money text; every tenth amount has a thousands comma."""
    dollars = F.floor(price).cast("int").cast("string")
    thousands = F.floor(price / 1000).cast("int").cast("string")
    return (
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 10 == 0, F.concat(F.lit("$"), thousands, F.lit(",000")))
        .otherwise(F.concat(F.lit("$"), dollars))
    )


def _coordinate(key: Column, origin: float, factor: int, cells: int) -> Column:
    """A multiple of 1/128, so exact as a 32-bit float."""
    return F.when(key % 50 != 0, (origin + ((key * factor) % cells) / F.lit(128.0)).cast("string"))


def _voted(key: Column, status: Column) -> Column:
    """Y, N, null, and A where the two flag encodings differ."""
    return F.when(key % 101 == 0, "A").when(status == "F", "Y").when(status == "P", "N")
