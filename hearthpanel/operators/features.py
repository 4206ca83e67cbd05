"""Feature frames of the estimation models, the train/test split and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag, seeded_uniform
from hearthpanel.operators.recode import age_squared, interact_with

# Explanatory variables of each model, in the study's order.
BIRTH = ["education", "age", "married", "n_children", "hh_youngest_age"]
RETIRED = ["age", "female", "retired_t1"]
RETIRED_WIDE = ["retired_t1", "working_t1", "n_children", "hh_youngest_age", "hh_income",
                "hh_frac_working", "female", "age"]
WORKING = ["fulltime_t1", "working_t1", "n_children", "hh_youngest_age", "hh_income",
           "hh_frac_working", "female", "age"]
FULLTIME = WORKING
HOURS = ["hours_t1", "hours_t2", "fulltime", "fulltime_t1", "gross_earnings_t1", "n_children",
         "hh_youngest_age", "hh_income", "hh_frac_working", "female", "age"]
EARNINGS = ["gross_earnings_t1", "gross_earnings_t2", "fulltime", "hours", "education", "n_children",
            "hh_youngest_age", "hh_income", "hh_frac_working", "female", "age"]

# Columns that tell the target or a person's identity, by target.
_IDS = ["pid", "hid", "orighid", "age_max", "predicted", "hhweight"]
GENERAL_DROPS = {
    "employment_status": _IDS + ["retired", "working", "fulltime", "hours", "gross_earnings"],
    "hours": _IDS + ["gross_earnings"],
}

WEIGHT = "personweight"
KEYS = ["pid", "year"]


def _frame(df: DataFrame, target: str, names: list[str], estimate: bool, keys: bool) -> DataFrame:
    head = [c for c in KEYS if keys and c not in names]
    if estimate:
        return df.select(*head, F.col(target).alias("dep_var"), *names, WEIGHT)
    return df.select(*head, *names)


def _with_terms(frame: DataFrame, interact: bool) -> DataFrame:
    if interact:
        frame = interact_with(frame, "female", ("dep_var", WEIGHT, *KEYS))
    return age_squared(frame)


def features_birth(df: DataFrame, estimate: bool = True, keys: bool = True, women_only: bool = False) -> DataFrame:
    """The stricter variant keeps adult women only."""
    if women_only:
        df = df.filter((F.col("female") == 1) & (F.col("child") == 0))
    return _frame(df, "birth", BIRTH, estimate, keys)


def features_retired(df: DataFrame, estimate: bool = True, keys: bool = True, wide: bool = False) -> DataFrame:
    return _with_terms(_frame(df, "retired", RETIRED_WIDE if wide else RETIRED, estimate, keys), True)


def features_working(df: DataFrame, estimate: bool = True, keys: bool = True) -> DataFrame:
    return _with_terms(_frame(df.filter("retired = 0"), "working", WORKING, estimate, keys), True)


def features_fulltime(df: DataFrame, estimate: bool = True, keys: bool = True) -> DataFrame:
    return _with_terms(_frame(df.filter("working = 1"), "fulltime", FULLTIME, estimate, keys), True)


def features_hours(df: DataFrame, estimate: bool = True, keys: bool = True) -> DataFrame:
    return _with_terms(_frame(df.filter("working = 1"), "hours", HOURS, estimate, keys), False)


def features_earnings(df: DataFrame, estimate: bool = True, keys: bool = True) -> DataFrame:
    return _with_terms(_frame(df.filter("working = 1"), "gross_earnings", EARNINGS, estimate, keys), False)


def features_general(df: DataFrame, target: str, estimate: bool = True) -> DataFrame:
    """Every column but identifiers and those that give the target away."""
    if estimate:
        df = df.withColumnRenamed(target, "dep_var")
    else:
        df = df.drop(target, WEIGHT)
    return df.drop(*GENERAL_DROPS.get(target, _IDS))


def split_train_test(df: DataFrame, test_share: float = 0.05, seed: int = 2020) -> DataFrame:
    """Adds `is_test` by a draw on (pid, year): the same rows in every run and on any cluster."""
    return df.withColumn("is_test", flag(seeded_uniform(KEYS, "split", seed) < test_share))


def scale_stats(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """One row with mean and population standard deviation of each column, as (c_mean, c_std)."""
    value = lambda c: F.col(c).cast("double") if fit_on is None else F.when(fit_on, F.col(c).cast("double"))
    return df.agg(*[F.avg(value(c)).alias(f"{c}_mean") for c in columns],
                  *[F.stddev_pop(value(c)).alias(f"{c}_std") for c in columns])


def _stats_row(stats: DataFrame) -> Column:
    """The one-row statistics as a struct; Spark runs it once as a scalar subquery."""
    return stats.select(F.struct(*stats.columns)).scalar()


def standardize(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std; a constant column becomes 0. Statistics default to the training rows."""
    if stats is None:
        train = (F.col("is_test") == 0) if "is_test" in df.columns else None
        stats = scale_stats(df, columns, train)
    s = F.col("_stats")
    scaled = {c: (F.col(c).cast("double") - s[f"{c}_mean"])
              / F.when(s[f"{c}_std"] == 0, 1.0).otherwise(s[f"{c}_std"]) for c in columns}
    return df.withColumn("_stats", _stats_row(stats)).withColumns(scaled).drop("_stats")


def unstandardize(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    s = F.col("_stats")
    raw = {c: F.col(c) * F.when(s[f"{c}_std"] == 0, 1.0).otherwise(s[f"{c}_std"]) + s[f"{c}_mean"] for c in columns}
    return df.withColumn("_stats", _stats_row(stats)).withColumns(raw).drop("_stats")
