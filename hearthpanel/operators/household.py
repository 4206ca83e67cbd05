"""Household aggregates written back to each member.

A household is keyed by (year, hid). All values of one call come from a single pre-aggregated
group-by that is joined back; see `functions/skew.py` for households of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag
from hearthpanel.functions.skew import attach_group

HOUSEHOLD = ["year", "hid"]


def _income(earnings: str = "gross_earnings") -> Column:
    return F.coalesce(F.sum(earnings), F.lit(0.0)).alias("hh_income")


def _size() -> Column:
    return F.count(F.lit(1)).cast("int").alias("n_people")


def _children() -> Column:
    return F.coalesce(F.sum("child"), F.lit(0)).cast("int").alias("n_children")


def _frac_working(working: str = "working") -> Column:
    """Working members per adult: 0 without adults, at most 1 as children may work too."""
    adults = F.count(F.lit(1)) - F.coalesce(F.sum("child"), F.lit(0))
    share = F.try_divide(F.sum(working).cast("double"), adults.cast("double"))
    return (F.when(adults == 0, 0.0).otherwise(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)))
             .alias("hh_frac_working"))


def _youngest() -> Column:
    return F.min("age").alias("hh_youngest_age")


def hh_income(df: DataFrame) -> DataFrame:
    return attach_group(df, HOUSEHOLD, [_income()])


def hh_size(df: DataFrame) -> DataFrame:
    return attach_group(df, HOUSEHOLD, [_size()])


def hh_children(df: DataFrame) -> DataFrame:
    return attach_group(df, HOUSEHOLD, [_children()])


def hh_frac_working(df: DataFrame) -> DataFrame:
    return attach_group(df, HOUSEHOLD, [_frac_working()])


def hh_youngest_age(df: DataFrame) -> DataFrame:
    return attach_group(df, HOUSEHOLD, [_youngest()])


def _mother_of_newborn(df: DataFrame, youngest: str = "hh_youngest_age") -> DataFrame:
    rule = (F.col(youngest) == 0) & (F.col("female") == 1) & (F.col("child") == 0)
    return df.withColumn("birth", flag(rule))


def hh_birth_flag(df: DataFrame) -> DataFrame:
    """Adult women of a household whose youngest member is of age 0."""
    youngest = attach_group(df, HOUSEHOLD, [F.min("age").alias("_youngest")])
    return _mother_of_newborn(youngest, "_youngest").drop("_youngest")


def hh_vars(df: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Income, youngest age, size, children, working share and the birth flag."""
    values = [_income(), _youngest(), _size(), _children(), _frac_working()]
    return _mother_of_newborn(attach_group(df, HOUSEHOLD, values, hot_rows))


def hh_vars_lagged(df: DataFrame, keys: tuple[str, ...] = ("year", "hid")) -> DataFrame:
    """As `hh_vars`, from last year's earnings and working flag; pass keys=("hid",) for one year."""
    values = [_income("gross_earnings_t1"), _youngest(), _size(), _children(),
              _frac_working("working_t1")]
    return attach_group(df, list(keys), values)
