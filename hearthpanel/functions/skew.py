"""Joins that stay balanced when one key holds a large part of all rows.

Adaptive execution splits a hot join partition only when both inputs of the join come
straight from a shuffle. Here one side is an aggregate, so the split is done in the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is cut into slices of about this size. There can be at most
# (all rows) / HOT_ROWS such keys.
HOT_ROWS = 1_000_000
# Rows without a key find no partner; they are only spread over this many parts.
SALTS = 4_096


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join_by_weight(df: DataFrame, table: DataFrame, keys: list[str], weight: str,
                   how: str = "left", hot_rows: int | None = None) -> DataFrame:
    """Join `table` (one row per key) to `df`; `weight` tells how many rows of `df` a key has.

    A key with more than `hot_rows` rows gets ceil(weight / hot_rows) slices: its row of `table` is repeated
    for each slice, and each row of `df` goes to one of them, so no task holds more of a key than others. The list
    of such keys with their slices, without any values, is broadcast; it has at most one entry per
    `hot_rows` rows of `df`. The slice is a hash of the whole row and not a random number, so a task that
    is run again routes its rows as before; panel rows differ in (pid, year) and so in their slice.
    Rows with a missing key are spread over all tasks.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    values = [c for c in table.columns if c not in keys and c != weight]
    df = df.drop(*values)  # a value that is already there is replaced
    slices = F.greatest(F.ceil(F.coalesce(F.col(weight), F.lit(0)) / hot_rows), F.lit(1)).cast("int")
    hot = table.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], slices.alias("_slices")).filter("_slices > 1")
    sliced = table.select(*[F.col(k).alias(f"_in_{k}") for k in keys], F.struct(F.lit(1).alias("_hit"), *values).alias("_pick"),
                          F.explode(F.sequence(F.lit(0), slices - 1)).alias("_in_slice"))
    spread = F.xxhash64(*df.columns)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    tagged = (df.join(F.broadcast(hot), _all([df[k] == hot[f"_hot_{k}"] for k in keys]), "left")
                .withColumn("_slice", F.when(no_key, F.pmod(spread, F.lit(SALTS)).cast("int") + 1)
                            .otherwise(F.pmod(spread, F.coalesce("_slices", F.lit(1))).cast("int"))))
    on = _all([tagged[k] == sliced[f"_in_{k}"] for k in keys] + [tagged["_slice"] == sliced["_in_slice"]])
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    return tagged.join(sliced, on, how).select(*[tagged[c] for c in df.columns], *[F.col("_pick")[v].alias(v) for v in values])


def join_hot(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
             hot_rows: int | None = None) -> DataFrame:
    """`join_by_weight` for a table that does not know the weights: they are counted first."""
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    weighted = table.join(heavy, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return join_by_weight(df, weighted, keys, "_n", how, hot_rows)


def attach_group(df: DataFrame, keys: list[str], aggregates: list[Column],
                 hot_rows: int | None = None) -> DataFrame:
    """Write group aggregates back to each member row.

    Same result as a window over `keys`, but the group is pre-aggregated before the shuffle
    and never has to fit one task. Rows without a key get nulls.
    """
    keyed = df.filter(_all([F.col(k).isNotNull() for k in keys]))
    totals = keyed.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("_n"))
    return join_by_weight(df, totals, keys, "_n", "left", hot_rows)
