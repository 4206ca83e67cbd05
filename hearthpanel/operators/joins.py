"""Equi joins of survey tables, extracts, methods and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag
from hearthpanel.functions.skew import attach_group, join_hot


def join_person_left(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Person tables side by side on (pid, syear); a repeated `hid` is taken from the left one."""
    for other in others:
        repeated = [c for c in other.columns if c in left.columns and c not in ("pid", "syear")]
        left = left.join(other.drop(*repeated), ["pid", "syear"], "left")
    return left


def join_household_left(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Household tables side by side on (hid, syear); both sides have one row per household."""
    for other in others:
        left = left.join(other, ["hid", "syear"], "left")
    return left


def join_person_household(persons: DataFrame, households: DataFrame,
                          hot_rows: int | None = None) -> DataFrame:
    """Each person with the household's columns; persons without a household row are left out."""
    return join_hot(persons, households, ["hid", "syear"], "inner", hot_rows)


def merge_extracts_outer(new: DataFrame, old: DataFrame) -> DataFrame:
    """All (pid, year) of either extract; each column from the new one, else from the old one."""
    keys = ["pid", "year"]
    shared = [c for c in new.columns if c in old.columns and c not in keys]
    n, o = new.alias("n"), old.alias("o")
    joined = n.join(o, keys, "full")
    return joined.select(
        *keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in shared],
        *[F.col(f"n.{c}") for c in new.columns if c not in keys + shared],
        *[F.col(f"o.{c}") for c in old.columns if c not in keys + shared])


def _year_before(df: DataFrame) -> DataFrame:
    return df.select("pid", (F.col("year") - 1).cast("int").alias("year"))


def semi_observed_next(df: DataFrame) -> DataFrame:
    """Rows whose person is observed in the next year, for all years at once."""
    return df.join(_year_before(df), ["pid", "year"], "left_semi")


def anti_dropouts(df: DataFrame) -> DataFrame:
    """Rows whose person is absent in the next year; the last year has no next one."""
    last = df.agg(F.max("year")).scalar()
    return df.filter(F.col("year") < last).join(_year_before(df), ["pid", "year"], "left_anti")


def pair_methods(real: DataFrame, predictions: dict[str, DataFrame], variables: list[str]) -> DataFrame:
    """Observed rows next to each method's prediction; every variable carries its method's name.

    (pid, year) is unique in each input, so all joins share one partitioning and none can skew.
    """
    keys = ["pid", "year"]
    out = real.filter(F.col("predicted") == 0) if "predicted" in real.columns else real
    out = out.select(*keys, *[F.col(v).alias(f"{v}_real") for v in variables])
    for method, frame in predictions.items():
        out = out.join(frame.select(*keys, *[F.col(v).alias(f"{v}_{method}") for v in variables
                                             if v in frame.columns]), keys)
    return out


def link_mother_child(df: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Children with the `motherpid` of their household.

    A person's household is the one they live in most often (ties: lowest id); the mother of a
    household is its woman aged 18 to 49 with the lowest pid.
    """
    stays = df.groupBy("pid", "hid").agg(F.count(F.lit(1)).alias("n"))
    usual = stays.groupBy("pid").agg(F.max_by("hid", F.struct("n", -F.col("hid"))).alias("usual_hid"))
    placed = df.drop("motherpid").join(usual, "pid")
    woman = (F.col("female") == 1) & F.col("age").between(18, 49)
    linked = attach_group(placed, ["usual_hid"], [F.min(F.when(woman, F.col("pid"))).alias("motherpid")],
                          hot_rows)
    return linked.filter((F.col("child") == 1) & F.col("motherpid").isNotNull())


def flag_births_by_link(df: DataFrame, children: DataFrame) -> DataFrame:
    """birth = 1 for a mother in the year a linked child was born."""
    born = (children.select(F.col("motherpid").alias("pid"), (F.col("year") - F.col("age")).alias("year"))
                    .distinct().withColumn("_born", F.lit(1)))
    return (df.drop("birth").join(born, ["pid", "year"], "left")
              .withColumn("birth", flag(F.col("_born") == 1)).drop("_born"))


def rate_by_age(rates: DataFrame, name: str = "rate") -> DataFrame:
    """One row per age; an age with several different rates is an error."""
    one = F.when(F.min("rate") == F.max("rate"), F.max("rate")).when(F.max("rate").isNotNull(), F.raise_error(
        F.concat(F.lit("several rates for age "), F.col("age").cast("string"))))
    return rates.groupBy("age").agg(one.alias(name))


def possible_mother(ages: tuple[int, int] = (15, 49)) -> Column:
    """Women of the given ages who are no children."""
    return (F.col("female") == 1) & (F.col("child") == 0) & F.col("age").between(*ages)


def lookup_age_rate(df: DataFrame, rates: DataFrame, ages: tuple[int, int] = (15, 49)) -> DataFrame:
    """Women of the given ages who are no children, with their rate per 1000; null where `rates` lacks the age."""
    return df.filter(possible_mother(ages)).join(rate_by_age(rates), "age", "left")


def lookup_transition(df: DataFrame, conditional: DataFrame) -> DataFrame:
    """Status distribution given sex, age and last status, as t0..t3; zeros where none is known.

    `conditional` is the long table with one row per (female, age, status_t1, status_t).
    """
    keys = ["female", "age", "employment_status_t1"]
    wide = (conditional.withColumnRenamed("status_t1", "employment_status_t1").groupBy(*keys)
            .agg(*[F.sum(F.when(F.col("status_t") == k, F.col("cond"))).alias(f"t{k}") for k in range(4)]))
    joined = df.join(wide, keys, "left")
    return joined.withColumns({f"t{k}": F.coalesce(f"t{k}", F.lit(0.0)) for k in range(4)})


def join_external_ratio(series: DataFrame, numerators: dict[str, str], denominator: str,
                        own: DataFrame | None = None) -> DataFrame:
    """Yearly ratios of external series, next to the study's own yearly means where given."""
    names = [*numerators.values(), denominator]
    wide = series.filter(F.col("series").isin(names)).groupBy("year").pivot("series", names).agg(F.sum("value"))
    ratios = wide.select("year", *[F.try_divide(F.col(f"`{s}`"), F.col(f"`{denominator}`")).alias(n)
                                   for n, s in numerators.items()])
    joined = ratios if own is None else ratios.join(own, "year")
    return joined.na.drop("any")
