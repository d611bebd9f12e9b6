"""Where queries get their rows: Parquet tables of a folder, and a relation derived from one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as cells: dimension i, keys a, b and c that hold NULL and NaN, and a value that holds NULL."""
    fifth, third, tenth = F.col("l_linenumber") % 5 == 0, F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 10 == 0
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("i"),
        F.col("l_returnflag").alias("a"),
        F.when(~fifth, F.col("l_returnflag")).alias("b"),
        F.when(fifth, None).when(third, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("c"),
        F.when(~tenth, F.col("l_quantity")).alias("val"),
    )


#: The same relation in SQL.
DERIVED_CELLS_SQL = """(select l_orderkey i, l_returnflag a,
 case when l_linenumber % 5 = 0 then null else l_returnflag end b,
 case when l_linenumber % 5 = 0 then null when l_linenumber % 3 = 0 then cast('NaN' as double) else l_tax end c,
 case when l_partkey % 10 = 0 then null else l_quantity end val from lineitem) foo"""
