"""Order tables seen as a household panel.

A customer is a person, the years they order in are their observed years (a missing year is a
dropout), and four consecutive customer keys form a household.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (pid, year) in which the person was born."""
    return born(person_years(spark, folder))


def born(df: DataFrame) -> DataFrame:
    return df.filter("age >= 0")  # orders before a person is born are left out


def person_years(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (pid, year), with ages below 0 before birth; each table is reduced before it is joined."""
    items = (table(spark, folder, "lineitem").groupBy("l_orderkey")
             .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"),
                  F.max(flag(F.col("l_returnflag") == "R")).alias("any_r")))
    orders = table(spark, folder, "orders")
    ordered = (
        orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left")
        .groupBy(F.col("o_custkey").alias("pid"), F.year("o_orderdate").cast("int").alias("year"))
        .agg(F.count(F.lit(1)).cast("int").alias("n_orders"),
             F.round(F.sum("o_totalprice"), 2).alias("earned"),
             F.least(F.coalesce(F.sum("q"), F.lit(0)) / F.greatest(F.coalesce(F.sum("c"), F.lit(0)), F.lit(1)),
                     F.lit(80.0)).alias("worked"),
             F.min("o_orderstatus").alias("min_status"), F.min("o_orderpriority").alias("prio"),
             F.coalesce(F.max("any_r"), F.lit(0)).alias("any_r")))
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pid"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 1000 + 1).alias("personweight"),
        F.col("c_mktsegment").alias("segment"))
    pid, year = F.col("pid"), F.col("year")
    status = (F.when(F.col("n_orders") >= 3, 3).when(F.col("n_orders") == 2, 2)
               .when(F.col("min_status") == "F", 1).otherwise(0))
    base = ordered.join(customer, "pid").withColumns({
        "hid": F.floor(pid / 4).cast("bigint"),
        "age": ((pid * 7) % 66 + (year - 1998)).cast("int"),
        "employment_status": status})
    adult, state = F.col("age") >= 18, F.col("employment_status")
    active = state >= 2
    return base.select(
        "pid", "year", "hid", "age", (pid % 2).cast("int").alias("female"),
        flag(F.col("hid") % 4 == 0).alias("east"), "personweight", "segment", "prio", "any_r",
        "n_orders", flag(~adult).alias("child"), "employment_status",
        flag(active).alias("working"), flag(state == 3).alias("fulltime"),
        flag(state == 1).alias("retired"),
        flag((state >= 1) & (F.col("min_status") != "P")).alias("lfs"),
        flag((pid % 5 < 2) & adult).alias("in_couple"), flag((pid % 5 == 0) & adult).alias("married"),
        (F.substring("prio", 1, 1).cast("int") - 1).alias("education"),
        F.when(active, F.col("earned")).otherwise(0.0).alias("gross_earnings"),
        F.when(active, F.col("worked").cast("double")).otherwise(0.0).alias("hours"))
