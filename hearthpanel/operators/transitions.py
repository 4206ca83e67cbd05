"""Status transition tables in long form, and drawing a status from probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.functions.columns import seeded_uniform, when_any
from hearthpanel.operators.longitudinal import birth_cohort
from hearthpanel.session import cut_lineage

STATES = (0, 1, 2, 3)


def _cells(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of (previous, current) status per group, all 16 cells kept.

    After this group-by a group has one row, so everything that follows is small: the 16 counts are
    conditional sums with map-side partial results and are then turned into rows.
    """
    known = F.col("employment_status").isin(*STATES) & F.col("employment_status_t1").isin(*STATES)
    pair = lambda i, j: F.sum(((F.col("employment_status") == i) & (F.col("employment_status_t1") == j)).cast("int"))
    counts = df.filter(known).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.lit(i).alias("status_t"), F.lit(j).alias("status_t1"), pair(i, j).alias("k"))
                  for i in STATES for j in STATES]).alias("cells"))
    return (counts.select(*by, "n", F.inline("cells"))
                  .withColumn("joint", F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")),
                                                  F.lit(0.0))))


def transition_joint(df: DataFrame) -> DataFrame:
    """P(status = i, previous = j) over the whole sample, zero cells included."""
    return _cells(df, []).select("status_t", "status_t1", "joint")


def transition_marginals(df: DataFrame) -> DataFrame:
    """P(status = i) and P(previous = j), as (side, status, p)."""
    joint = transition_joint(df)
    sides = joint.select(F.inline(F.array(
        F.struct(F.lit("t").alias("side"), F.col("status_t").alias("status"), F.col("joint").alias("p")),
        F.struct(F.lit("t1").alias("side"), F.col("status_t1").alias("status"), F.col("joint").alias("p")))))
    return sides.groupBy("side", "status").agg(F.sum("p").alias("p"))


def transition_by_sex_age(df: DataFrame) -> DataFrame:
    """Joint probabilities and both marginals for every sex and one-year age, whatever the ages, all in one job."""
    by = ["female", "age"]
    keyed = df.filter(F.col("age").isNotNull() & F.col("female").isNotNull())
    cells = _cells(keyed, by)
    return cells.select(
        *by, "status_t1", "status_t", "n", "joint",
        F.sum("joint").over(Window.partitionBy(*by, "status_t")).alias("p_t"),
        F.sum("joint").over(Window.partitionBy(*by, "status_t1")).alias("p_t1"))


def transition_cohort(df: DataFrame, first: int = 1945, last: int = 1954, region: int = 0) -> DataFrame:
    return transition_by_sex_age(birth_cohort(df, first, last, region))


def transition_check(table: DataFrame, decimals: int = 2) -> DataFrame:
    """Sex and age cells whose marginals do not sum to one."""
    sums = table.groupBy("female", "age").agg(
        (F.sum("p_t") / 4).alias("sum_t"), (F.sum("p_t1") / 4).alias("sum_t1"))
    bad = (F.round("sum_t", decimals) != 1) | (F.round("sum_t1", decimals) != 1)
    return sums.filter(bad)


def transition_conditional(table: DataFrame) -> DataFrame:
    """P(status given previous status); 0 where the previous status never occurs."""
    cond = F.when(F.col("p_t1") == 0, 0.0).otherwise(F.try_divide("joint", "p_t1"))
    return table.withColumn("cond", cond)


def blend_probabilities(df: DataFrame, share: float = 0.25, model: str = "p", table: str = "t") -> DataFrame:
    """share * model + (1 - share) * transition table, as b0..b3."""
    return df.withColumns({f"b{k}": F.lit(share) * F.col(f"{model}{k}")
                           + F.lit(1 - share) * F.col(f"{table}{k}") for k in STATES})


def _cumulated(columns: list[str]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [F.col(c) for c in columns[:k + 1]]) for k in range(len(columns))]


def draw_status(df: DataFrame, seed: int = 2020, probabilities: str = "b", draw: Column | None = None,
                out: str = "drawn") -> DataFrame:
    """Status whose stretch of the cumulated probabilities holds the row's draw; 0 outside all."""
    u = seeded_uniform(["pid", "year"], "status", seed) if draw is None else draw
    totals = _cumulated([f"{probabilities}{k}" for k in STATES])
    return df.withColumn(out, when_any([(u < c, k) for k, c in zip(STATES, totals)], 0))


def argmax_status(df: DataFrame, probabilities: str = "b", out: str = "likely") -> DataFrame:
    """Most probable status; the lowest one of a tie."""
    best = F.greatest(*[F.col(f"{probabilities}{k}") for k in STATES])
    return df.withColumn(out, when_any([(F.col(f"{probabilities}{k}") == best, k) for k in STATES]))


def project_status_shares(start: DataFrame, conditional: DataFrame, periods: int) -> DataFrame:
    """Expected status shares by sex and age after each of `periods` years, without any draw.

    `start` has (female, age, status, share). Everybody ages by one each period, so each step is a
    join of two aggregated tables, and is cut there. Where the table knows no move from a status, its share
    goes on with status null (unknown), so the shares of an age stay the same in sum.
    """
    spark = start.sparkSession
    moves = cut_lineage(spark, conditional.filter("cond > 0").select(
        "female", "age", F.col("status_t1").alias("_from"), "status_t", "cond"))
    now = cut_lineage(spark, start.select("female", "age", "status", "share"))
    out = now.withColumn("period", F.lit(0))
    for step in range(1, periods + 1):
        aged = now.select("female", (F.col("age") + 1).cast("int").alias("age"), F.col("status").alias("_from"), "share")
        now = cut_lineage(spark, aged.join(moves, ["female", "age", "_from"], "left")
                          .groupBy("female", "age", F.col("status_t").alias("status"))
                          .agg(F.sum(F.col("share") * F.coalesce("cond", F.lit(1.0))).alias("share")))
        out = out.unionByName(now.withColumn("period", F.lit(step)))
    return out
