"""Operators along a person's years.

(pid, year) is unique in a panel, so a person has at most as many rows as there are years and a
window over `pid` is small by definition. One shuffle on `pid` serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _person() -> WindowSpec:
    return Window.partitionBy("pid")


# Lag columns of the estimation panel.
LAGS = {
    "retired_t1": ("retired", 1), "working_t1": ("working", 1), "fulltime_t1": ("fulltime", 1),
    "hours_t1": ("hours", 1), "hours_t2": ("hours", 2),
    "gross_earnings_t1": ("gross_earnings", 1), "gross_earnings_t2": ("gross_earnings", 2),
    "employment_status_t1": ("employment_status", 1), "employment_status_t2": ("employment_status", 2),
}
ESTIMATED = ["birth", "retired", "working", "fulltime", "hours", "gross_earnings", "employment_status"]


def min_observations(df: DataFrame, more_than: int = 2) -> DataFrame:
    return (df.withColumn("_n", F.count(F.lit(1)).over(_person()))
              .filter(F.col("_n") > more_than).drop("_n"))


def _third_year(df: DataFrame):
    """Third distinct year of the data; distinct years are few, so this is a one-row subquery."""
    years = df.agg(F.array_sort(F.collect_set("year")).alias("years"))
    return years.select(F.try_element_at("years", F.lit(3))).scalar()


def lag_exact(df: DataFrame, lags: dict[str, tuple[str, int]] = LAGS,
              from_third_year: bool = True) -> DataFrame:
    """The value exactly k years before, null when that year was not observed."""
    frame = lambda k: _person().orderBy("year").rangeBetween(-k, -k)
    out = df.withColumns({name: F.first(source).over(frame(k)) for name, (source, k) in lags.items()})
    return out.filter(F.col("year") >= _third_year(df)) if from_third_year else out


def lagged_panel(df: DataFrame, lags: dict[str, tuple[str, int]] = LAGS) -> DataFrame:
    """Complete rows with their lags, of persons with more than two observations.

    Lags first and filters second: a person's rows are all kept or all removed by the count, so the
    order does not matter and both windows share one shuffle. A row whose year t-2 was observed is
    never older than the third year, so the year cut is implied by dropping incomplete rows.
    """
    return min_observations(lag_exact(df, lags, from_third_year=False)).na.drop("any")


def roll_state(df: DataFrame) -> DataFrame:
    """Move a row one year on: shift t to t-1 and t-1 to t-2, age by one, clear estimated columns."""
    moved = {
        "year": F.col("year") + 1, "age": F.col("age") + 1,
        "retired_t1": F.col("retired"), "working_t1": F.col("working"), "fulltime_t1": F.col("fulltime"),
        "hours_t2": F.col("hours_t1"), "gross_earnings_t2": F.col("gross_earnings_t1"),
        "employment_status_t2": F.col("employment_status_t1"), "hours_t1": F.col("hours"),
        "gross_earnings_t1": F.col("gross_earnings"), "employment_status_t1": F.col("employment_status"),
    }
    types = dict(df.dtypes)
    cleared = {c: F.lit(0).cast(types[c]) for c in ESTIMATED if c in types}
    return df.withColumns(moved | cleared)


def first_record(df: DataFrame) -> DataFrame:
    first = F.row_number().over(_person().orderBy("year"))
    return df.withColumn("_row", first).filter("_row = 1").drop("_row")


def period_ahead(df: DataFrame) -> DataFrame:
    """Years left until the person's last observation, and years since the first."""
    return df.withColumns({
        "period_ahead": (F.max("year").over(_person()) - F.col("year")).cast("int"),
        "years_since_entry": (F.col("year") - F.min("year").over(_person())).cast("int")})


def entry_year(df: DataFrame) -> DataFrame:
    """First observed year per person."""
    return df.groupBy("pid").agg(F.min("year").alias("entry_year"))


def entrants_by_year(df: DataFrame) -> DataFrame:
    return entry_year(df).groupBy("entry_year").agg(F.count(F.lit(1)).alias("n_entrants"))


def first_year_cohort(df: DataFrame) -> DataFrame:
    """All rows of persons who are present in the very first year."""
    start = df.agg(F.min("year")).scalar()
    founders = df.filter(F.col("year") == start).select("pid").distinct()
    return df.join(founders, "pid", "left_semi")


def birth_cohort(df: DataFrame, first: int, last: int, region: int | None = None,
                 age: str = "age") -> DataFrame:
    """Birth years `first` to `last`, both included; optionally one region."""
    out = df.filter((F.col("year") - F.col(age)).between(first, last))
    return out if region is None else out.filter(F.col("east") == region)


def observation_length(df: DataFrame) -> DataFrame:
    return df.groupBy("pid").agg(F.max("period_ahead").alias("observation_length"))


def retention_curve(df: DataFrame) -> DataFrame:
    """Persons seen in at least `year` years, and their share of all persons."""
    sizes = df.groupBy("pid").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    histogram = sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("persons"))
    # at most one row per possible number of years from here on
    grid = (histogram.agg(F.max("rows").alias("most"), F.sum("persons").alias("everyone"),
                          F.map_from_entries(F.collect_list(F.struct("rows", "persons"))).alias("by_rows"))
            .select("everyone", "by_rows", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("year")))
    later = Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0)
    still = F.sum(F.coalesce(F.col("by_rows")[F.col("year")], F.lit(0))).over(later)
    return grid.select("year", still.cast("bigint").alias("count"),
                       (still / F.col("everyone")).alias("relative"))


def panel_size_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("size"))
