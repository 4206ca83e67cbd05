"""Row concatenation, distinct rows and output order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows, duplicates kept; a column that one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def sort_panel(df: DataFrame, *columns: str) -> DataFrame:
    """Order for output only; Spark range-partitions on the sort keys."""
    return df.orderBy(*(columns or ("pid", "year")))


def order_check(df: DataFrame, *columns: str) -> DataFrame:
    """One row: n, and `inversions`, the rows of `df` as it lies that come before the row ahead of them.

    Rows are compared inside their part, and the greatest keys of each part with the least of the next; only two keys
    per part are gathered.
    """
    key = F.struct(*[F.col(c) for c in (columns or ("pid", "year"))])
    placed = df.select(key.alias("_key"), F.monotonically_increasing_id().alias("_place")).withColumn("_part", F.shiftright("_place", 33))
    inside = placed.withColumn("_ahead", F.lag("_key").over(Window.partitionBy("_part").orderBy("_place")))
    parts = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_key") < F.col("_ahead")).alias("inside"),
                                        F.min("_key").alias("low"), F.max("_key").alias("high"))
    turn = F.col("low") < F.lag("high").over(Window.orderBy("_part"))
    return parts.select("n", (F.col("inside") + F.coalesce(turn.cast("bigint"), F.lit(0))).alias("inversions")).agg(
        F.sum("n").alias("n"), F.sum("inversions").alias("inversions"))
