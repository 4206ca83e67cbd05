"""Validation and inequality reports.

Reports read the analysis frame: one row per (pid, year) with each variable once per method
(`hours_real`, `hours_standard`, ...) and `period_ahead`. Most of them turn it into rows per method
in the same task and aggregate once for all methods and subsets; sums are always reduced on the map
side, and quantiles go through `exact_quantiles`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.functions.columns import flag
from hearthpanel.functions.ordered import exact_quantiles, gini, subset_quantiles
from hearthpanel.functions.skew import join_by_weight
from hearthpanel.operators.recode import status_from_flags
from hearthpanel.session import cut_lineage

METHODS = ["real", "standard", "ext"]
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}

# Population subsets of the income reports, as (working, female, fulltime).
SUBSETS = {
    "all": (None, None, None), "male": (None, 0, None), "female": (None, 1, None),
    "working": (1, None, None), "working_male": (1, 0, None), "working_female": (1, 1, None),
    "fulltime": (None, None, 1), "fulltime_male": (None, 0, 1), "fulltime_female": (None, 1, 1),
}
WORKING_SUBSETS = ["working", "working_male", "working_female"]


def long_by_method(df: DataFrame, variables: list[str], methods: list[str] = METHODS,
                   keep: tuple[str, ...] = ("pid", "year")) -> DataFrame:
    """One row per method; made inside the task, without a join."""
    rows = [F.struct(F.lit(m).alias("method"), *[F.col(f"{v}_{m}").alias(v) for v in variables]) for m in methods]
    return df.select(*keep, F.inline(F.array(*rows)))


def _wide_by_method(df: DataFrame, by: list[str], value: str, methods: list[str], fill: float | None = None) -> DataFrame:
    """Report rows (few) back to one column per method."""
    cols = [F.max(F.when(F.col("method") == m, F.col(value))) for m in methods]
    if fill is not None:
        cols = [F.coalesce(c, F.lit(fill)) for c in cols]
    return df.groupBy(*by).agg(*[c.alias(m) for c, m in zip(cols, methods)])


def _belongs(working: int | None, female: int | None, fulltime: int | None, suffix: str = "") -> Column:
    tests = [F.lit(True)]
    if working:
        tests.append(F.col(f"working{suffix}") == 1)
    if female is not None:
        tests.append(F.col(f"female{suffix}") == female)
    if fulltime == 1:
        tests.append(F.col(f"fulltime{suffix}") == 1)
    elif fulltime == 0:
        tests.append((F.col(f"working{suffix}") == 1) & (F.col(f"fulltime{suffix}") == 0))
    return reduce(lambda a, b: a & b, tests)


def subset_by_flags(df: DataFrame, method: str = "real", working: int | None = None, female: int | None = None,
                    fulltime: int | None = None, max_age: int | None = None) -> DataFrame:
    """Rows of a subset, judged by the method's own flags; fulltime=0 asks for part-time."""
    out = df.filter(_belongs(working, female, fulltime, f"_{method}"))
    return out if max_age is None else out.filter(F.col(f"age_{method}") <= max_age)


def _conditions(names: list[str]) -> dict[str, Column]:
    return {name: _belongs(*SUBSETS[name]) for name in names}


def _into_subsets(df: DataFrame, names: list[str]) -> DataFrame:
    """Copy a row into each named subset it belongs to."""
    labels = F.filter(F.array(*[F.when(_belongs(*SUBSETS[s]), F.lit(s)) for s in names]), lambda s: s.isNotNull())
    return df.withColumn("subset", F.explode(labels))


def select_by_method(df: DataFrame, variable: str, methods: list[str] = METHODS) -> DataFrame:
    return df.select("pid", "year", F.col("hid_real").alias("hid"), F.col("age_real").alias("age"),
                     *[F.col(f"{variable}_{m}").alias(m) for m in methods])


def mean_by_age_method(df: DataFrame, variables: list[str], methods: list[str] = METHODS) -> DataFrame:
    return df.groupBy(F.col("age_real").alias("age")).agg(
        *[F.avg(f"{v}_{m}").alias(f"{v}_{m}") for v in variables for m in methods])


def _status_shares(df: DataFrame, by: list[str]) -> DataFrame:
    share = lambda k: F.avg(flag(F.col("employment_status") == k).cast("double")).alias(f"status{k}")
    return df.groupBy(*by).agg(*[share(k) for k in range(4)])


def status_share_by_age(df: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """Share of each status among all rows of an age, per method; ages are the observed ones."""
    long = long_by_method(df.withColumnRenamed("age_real", "age"), ["employment_status"], methods, ("age",))
    return _status_shares(long, ["age", "method"])


def status_share_from_flags(df: DataFrame) -> DataFrame:
    """As `status_share_by_age`, for rows that carry only working, retired and fulltime."""
    return _status_shares(status_from_flags(df.drop("employment_status")), ["age"])


def status_by_subgroup(df: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """Share of each status by age for all nine sex x region groups; -1 stands for all.

    Counts are taken once for the finest groups; the coarser ones are grouping sets over those few rows.
    """
    fine = df.groupBy(F.col("female_real").alias("female"), F.col("east_real").alias("east"),
                      F.col("age_real").alias("age")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(flag(F.col(f"employment_status_{m}") == k)).alias(f"{m}_{k}") for m in methods for k in range(4)])
    fine = fine.na.drop("any", subset=["female", "east", "age"])
    keys = [F.col("female"), F.col("east"), F.col("age")]
    sets = [[keys[0], keys[1], keys[2]], [keys[0], keys[2]], [keys[1], keys[2]], [keys[2]]]
    every = fine.groupingSets(sets, *keys).agg(
        F.sum("n").alias("n"), *[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for m in methods for k in range(4)])
    share = lambda m, k: (F.col(f"{m}_{k}") / F.col("n")).alias(m)
    rows = F.array(*[F.struct(F.lit(k).alias("status"), *[share(m, k) for m in methods]) for k in range(4)])
    return every.select(F.coalesce("female", F.lit(-1)).alias("female"), F.coalesce("east", F.lit(-1)).alias("east"),
                        "age", F.inline(rows))


def _income_by(df: DataFrame, group: str, variable: str, methods: list[str], subsets: list[str]) -> DataFrame:
    """Mean and median per group, method and subset; 0 where a method has no row."""
    long = long_by_method(df, [variable, "female", "working", "fulltime"], methods, (group,))
    by = [group, "method", "subset"]
    # means: reduce to the flag combinations first, then copy these few rows into the subsets
    fine = long.groupBy(group, "method", "female", "working", "fulltime").agg(
        F.sum(variable).alias("s"), F.count(variable).alias("n"))
    means = _into_subsets(fine, subsets).groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))
    medians = subset_quantiles(long, [group, "method"], _conditions(subsets), variable, {"value": 0.5})
    both = (means.withColumn("measure", F.lit("mean"))
                 .unionByName(medians.withColumn("measure", F.lit("median"))))
    return _wide_by_method(both, [group, "subset", "measure"], "value", methods, 0.0)


def income_by_age(df: DataFrame, variable: str = "gross_earnings", methods: list[str] = METHODS) -> DataFrame:
    return _income_by(df.withColumn("age", F.col("age_real")), "age", variable, methods, list(SUBSETS))


def income_by_year(df: DataFrame, variable: str = "gross_earnings", methods: list[str] = METHODS) -> DataFrame:
    return _income_by(df, "year", variable, methods, list(SUBSETS))


def _values(df: DataFrame, variables: list[str], methods: list[str]) -> DataFrame:
    long = long_by_method(df, [*variables, "female", "working", "fulltime"], methods, ("year",))
    values = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
                                for v in variables]))
    return long.select("year", "method", "female", "working", "fulltime", values)


def percentile_ratios(df: DataFrame, variables: tuple[str, ...] = ("gross_earnings", "hours"),
                      methods: list[str] = METHODS, subsets: list[str] = WORKING_SUBSETS) -> DataFrame:
    """p90/p50, p90/p10 and p50/p10 by year, method, subset and variable."""
    by = ["year", "method", "subset", "variable"]
    q = subset_quantiles(_values(df, list(variables), methods), ["year", "method", "variable"], _conditions(subsets), "value", QUANTILES)
    return q.select(*by, F.try_divide("p90", "p50").alias("p90p50"), F.try_divide("p90", "p10").alias("p90p10"),
                    F.try_divide("p50", "p10").alias("p50p10"))


def gini_by_year(df: DataFrame, variables: tuple[str, ...] = ("gross_earnings", "hours"),
                 methods: list[str] = METHODS, subsets: list[str] = WORKING_SUBSETS) -> DataFrame:
    return gini(_into_subsets(_values(df, list(variables), methods), subsets), ["year", "method", "subset", "variable"], "value")


def ar1_by_age(df: DataFrame, variable: str, methods: list[str] = METHODS) -> DataFrame:
    """Slope of a variable on its lag by age and method, and the overall observed slope as `coef`."""
    long = long_by_method(df, ["age", variable, f"{variable}_t1"], methods, ())
    slopes = long.groupBy("age", "method").agg(F.regr_slope(variable, f"{variable}_t1").alias("slope"))
    overall = df.agg(F.regr_slope(f"{variable}_real", f"{variable}_t1_real")).scalar()
    return _wide_by_method(slopes, ["age"], "slope", methods).withColumn("coef", overall)


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str], name: str = "weighted_mean") -> DataFrame:
    """Weighted mean; rows without a value count in neither sum."""
    weights = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), weights).alias(name))


def yearly_means_by_method(df: DataFrame, variable: str, methods: list[str], weight: str = "personweight",
                           observed: str | None = None) -> DataFrame:
    """Per year: weighted mean of observed rows, mean per method, and mean of its imputed rows.

    `df` has the completed panels of all methods below each other, told apart by `method`. Observed
    rows are the same in each; they are read from the method `observed`.
    """
    observed = observed or methods[0]
    real = (F.col("method") == observed) & (F.col("predicted") == 0)
    start = df.filter(F.col("predicted") == 0).agg(F.min("year")).scalar()
    weights = F.sum(F.when(real & F.col(variable).isNotNull(), F.col(weight)))
    cols = [F.try_divide(F.sum(F.when(real, F.col(variable) * F.col(weight))), weights).alias("no_impute")]
    for m in methods:
        mine = F.col("method") == m
        cols += [F.avg(F.when(mine, F.col(variable))).alias(m),
                 F.avg(F.when(mine & (F.col("predicted") == 1), F.col(variable))).alias(f"{m}_cond")]
    return df.filter(F.col("year") > start + 2).groupBy("year").agg(*cols)


def _work_states(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "parttime": flag((F.col("fulltime") == 0) & (F.col("working") == 1)),
        "unemployed": flag((F.col("working") == 0) & (F.col("lfs") == 1))}).filter(F.col("age").between(20, 59))


def employment_by_age_group(df: DataFrame) -> DataFrame:
    """Shares in full-time, part-time, unemployment and inactivity, ages 20 to 59, by sex and region."""
    return _work_states(df).groupBy("female", "east", "age").agg(
        *[F.avg(c).alias(c) for c in ("fulltime", "parttime", "unemployed")], (1 - F.avg("lfs")).alias("inactive"))


def cohort_years_in_state(df: DataFrame) -> DataFrame:
    """Mean number of years in each state at ages 20 to 59 by birth year, sex and region."""
    states = ["fulltime", "parttime", "working", "unemployed"]
    persons = _work_states(df).groupBy("female", "east", "pid").agg(
        F.collect_set(F.col("year") - F.col("age")).alias("born"), *[F.sum(c).alias(c) for c in states])
    return (persons.withColumn("birthyear", F.explode("born")).groupBy("female", "east", "birthyear")
                   .agg(*[F.avg(c).alias(c) for c in states]))


def sample_by_horizon(df: DataFrame) -> DataFrame:
    working = F.sum(flag(F.col("working_real") == 1))
    return df.groupBy("period_ahead").agg(
        F.count("pid").alias("n"), working.alias("n_working"), (working / F.count("pid")).alias("share_working"))


def sample_by_age(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("age_real").alias("age")).agg(
        F.count("pid").alias("n"), F.sum(flag(F.col("working_real") == 1)).alias("n_working"))


def employment_rate_by_sex(df: DataFrame) -> DataFrame:
    value = lambda sex: F.when(F.col("female_real") == sex, F.col("working_real"))
    return df.groupBy(F.col("age_real").alias("age")).agg(
        F.avg(value(1)).alias("emp_female"), F.count(value(1)).alias("n_female"),
        F.avg(value(0)).alias("emp_male"), F.count(value(0)).alias("n_male"))


def median_by_age(df: DataFrame, age: str = "age_real") -> DataFrame:
    """Median of every number column by age, in long form, with the number of persons of that age."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != age]
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                                for c in numbers]))
    long = df.select(F.col(age).alias("age"), values)
    medians = exact_quantiles(long, ["age", "variable"], "value", {"median": 0.5})
    sizes = df.groupBy(F.col(age).alias("age")).agg(F.count("pid").alias("n"))
    return medians.join(sizes, "age")


def working_share_by_length(df: DataFrame) -> DataFrame:
    """Persons' share of working years: mean and median by length of observation, and overall mean."""
    persons = df.groupBy("pid").agg(F.avg("working_real").alias("share"), F.max("period_ahead").alias("period_ahead"))
    means = persons.groupBy("period_ahead").agg(F.avg("share").alias("mean"))
    medians = exact_quantiles(persons, ["period_ahead"], "share", {"median": 0.5})
    return means.join(medians, "period_ahead").withColumn("overall_mean", df.agg(F.avg("working_real")).scalar())


def at_horizons(df: DataFrame, step: int) -> DataFrame:
    """Rows at horizons 1, 1 + step, ... below the number of distinct horizons."""
    distinct = df.agg(F.size(F.collect_set("period_ahead"))).scalar()
    ahead = F.col("period_ahead")
    return df.filter((ahead >= 1) & (ahead < distinct) & ((ahead - 1) % step == 0))


def accuracy_by_horizon(df: DataFrame, variable: str, methods: list[str], step: int = 4) -> DataFrame:
    """Share of exact hits per method, as (type, years, value)."""
    hit = lambda m: F.avg(flag(F.col(f"{variable}_real") == F.col(f"{variable}_{m}")).cast("double"))
    wide = at_horizons(df, step).groupBy(F.col("period_ahead").alias("years")).agg(
        *[hit(m).alias(f"frac_{m}") for m in methods])
    return unpivot_metrics(wide, ["years"], [f"frac_{m}" for m in methods], "type")


def mean_by_horizon(df: DataFrame, variable: str, methods: list[str] = METHODS) -> DataFrame:
    return df.groupBy("period_ahead").agg(*[F.avg(f"{variable}_{m}").alias(m) for m in methods])


def dispersion_by_horizon(df: DataFrame, variable: str, methods: list[str] = METHODS,
                          positive: str | None = None, absolute: bool = False) -> DataFrame:
    """Mean, median, variance, p90/p50 and p50/p10 by horizon and method, rows with a positive real value."""
    kept = df.filter(F.col(positive or f"{variable}_real") > 0)
    long = long_by_method(kept, [variable], methods, ("period_ahead",))
    by = ["period_ahead", "method"]
    moments = long.groupBy(*by).agg(F.avg(variable).alias("mean"), F.var_samp(variable).alias("variance"))
    q = exact_quantiles(long, by, variable, QUANTILES)
    sign = F.abs if absolute else (lambda c: c)
    return moments.join(q, by).select(
        *by, sign(F.col("mean")).alias("mean"), sign(F.col("p50")).alias("median"), "variance",
        sign(F.try_divide("p90", "p50")).alias("p90p50"), sign(F.try_divide("p50", "p10")).alias("p50p10"))


def abs_dispersion_by_horizon(df: DataFrame, variable: str, methods: list[str] = METHODS) -> DataFrame:
    """As `dispersion_by_horizon` in absolute values, always for persons with real earnings."""
    return dispersion_by_horizon(df, variable, methods, "gross_earnings_real", True)


def prediction_error(df: DataFrame, variable: str, methods: list[str]) -> DataFrame:
    errors = {}
    for m in methods:
        diff = F.col(f"{variable}_real") - F.col(f"{variable}_{m}")
        errors |= {f"error_{m}": diff, f"abs_error_{m}": F.abs(diff)}
    return df.withColumns(errors)


def drop_largest(df: DataFrame, value: str, by: str) -> DataFrame:
    """Remove rows whose value equals the positive maximum of any group.

    Rows without a value stay.
    """
    largest = df.groupBy(by).agg(F.max(value).alias("_m")).filter(F.col("_m") > 0).select("_m").distinct()
    return df.join(largest, F.col(value) == F.col("_m"), "left_anti")


def abs_error_describe(df: DataFrame, variable: str, method: str) -> DataFrame:
    """Absolute difference of person sums, largest ones removed, described by horizon."""
    persons = df.groupBy("pid", "period_ahead").agg(
        F.abs(F.sum(f"{variable}_real") - F.sum(f"{variable}_{method}")).alias("diff"))
    kept = drop_largest(persons, "diff", "period_ahead")
    moments = kept.groupBy("period_ahead").agg(
        F.count("diff").alias("count"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("std"),
        F.min("diff").alias("min"), F.max("diff").alias("max"))
    q = exact_quantiles(kept, ["period_ahead"], "diff", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(q, "period_ahead")


def _with_group_values(df: DataFrame, values: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Bring per-group report values to the rows; without a group they are a one-row subquery."""
    if by:
        return join_by_weight(df, values, by, weight, "inner")
    names = [c for c in values.columns if c != weight]
    row = values.select(F.struct(*names)).scalar()
    return df.withColumn("_values", row).select(*df.columns, *[F.col("_values")[c].alias(c) for c in names])


def trim_quantiles(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95,
                   by: list[str] | None = None) -> DataFrame:
    """Rows strictly between two exact quantiles of their group."""
    by = by or []
    values = exact_quantiles(df, by, column, {"_low": low, "_high": high}, count="_n")
    kept = _with_group_values(df, values, by, "_n")
    return kept.filter((F.col(column) > F.col("_low")) & (F.col(column) < F.col("_high"))).select(*df.columns)


def histogram_equal_width(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins from minimum to maximum; the last bin is closed and empty bins are kept."""
    by = by or []
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    low, high = F.min("_v"), F.max("_v")
    same = low == high
    edges = rows.groupBy(*by).agg(F.when(same, low - 0.5).otherwise(low).alias("_lo"),
                                  F.when(same, high + 0.5).otherwise(high).alias("_hi"),
                                  F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (_with_group_values(rows, edges, by, "_n").select(*by, place.alias("bin"))
              .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("obs")))
    grid = edges.filter(F.col("_lo").isNotNull()).select(
        *by, "_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin", F.coalesce("obs", F.lit(0)).alias("obs"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"))


def error_histograms(df: DataFrame, methods: list[str], variable: str = "gross_earnings", bins: int = 40) -> DataFrame:
    """Trimmed error histograms per method at horizons 1, 6, 11, 16 and 21, for persons with real earnings."""
    rows = df.filter((F.col(f"{variable}_real") > 0) & F.col("period_ahead").isin(1, 6, 11, 16, 21))
    error = [F.struct(F.lit(m).alias("method"), (F.col(f"{variable}_real") - F.col(f"{variable}_{m}")).alias("error"))
             for m in methods]
    long = rows.select("period_ahead", F.inline(F.array(*error)))
    by = ["method", "period_ahead"]
    # three short columns, read several times by the histogram
    trimmed = cut_lineage(df.sparkSession, trim_quantiles(long, "error", by=by))
    return histogram_equal_width(trimmed, "error", bins, by)


def person_histograms(df: DataFrame, bins: int = 32) -> DataFrame:
    """Histograms of observation length, first year, education and sex of persons, and children of households."""
    persons = df.groupBy("pid").agg(
        F.max("period_ahead").cast("double").alias("observed_years"), F.min("year").cast("double").alias("first_year"),
        F.max("education_real").cast("double").alias("education"), F.avg("female_real").alias("female"))
    households = df.groupBy("hid_real").agg(F.max("n_children_real").cast("double").alias("value"))
    long = (persons.unpivot("pid", ["observed_years", "first_year", "education", "female"], "measure", "value")
            .select("measure", "value")
            .unionByName(households.select(F.lit("children").alias("measure"), "value")))
    return histogram_equal_width(long, "value", bins, ["measure"])


def hours_bucket(column: str | Column) -> Column:
    """0: below 10, 1: [10, 20), 2: [20, 30), 3: [30, 40), 4: 40 and more."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c < 10, 0).when(c < 20, 1).when(c < 30, 2).when(c < 40, 3).when(c >= 40, 4)


def bucket_shares(df: DataFrame, methods: list[str] = METHODS, step: int = 5) -> DataFrame:
    """Share of rows per hours bucket, horizon and method."""
    share = lambda m, b: F.avg(flag(hours_bucket(f"hours_{m}") == b).cast("double"))
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), *[F.col(f"{m}_{b}").alias(m) for m in methods]) for b in range(5)])
    return (at_horizons(df, step).groupBy("period_ahead")
            .agg(*[share(m, b).alias(f"{m}_{b}") for m in methods for b in range(5)])
            .select("period_ahead", F.inline(rows)))


def crosstab_real_vs_method(df: DataFrame, method: str) -> DataFrame:
    """Rows by real hours bucket, columns by predicted bucket."""
    pairs = df.select(hours_bucket("hours_real").alias("real_bucket"), hours_bucket(f"hours_{method}").alias("b"))
    table = pairs.groupBy("real_bucket").pivot("b", list(range(5))).count().na.fill(0)
    return table.select("real_bucket", *[F.col(str(b)).alias(f"bucket{b}") for b in range(5)])


def unpivot_metrics(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable",
                    value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)
