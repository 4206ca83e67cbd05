"""Queries of the validation and inequality reports."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from hearthpanel.operators import reports as op
from hearthpanel.operators.events import complete_panel
from hearthpanel.operators.joins import anti_dropouts
from hearthpanel.plans.frames import FIXED, METHODS, MONEY, VARIABLES, ana, analysis_frame, full, panel
from hearthpanel.plans.registry import fragment, query

METHODS = op.METHODS
PREDICTED = ["standard", "ext"]


def _each(template: str, methods=METHODS, glue: str = ", ") -> str:
    return glue.join(template.format(m=m) for m in methods)


fragment("ana_long", _each(
    "select pid, year, period_ahead, age_real as age, '{m}' as method, "
    + ", ".join(f"{v}_{{m}} as {v}" for v in ("female", "daily_gross_earnings", *VARIABLES)) + " from panel_ana", glue=" union all "))

SUBSET_SQL = {"all": "true", "male": "female = 0", "female": "female = 1", "working": "working = 1",
              "working_male": "working = 1 and female = 0", "working_female": "working = 1 and female = 1",
              "fulltime": "fulltime = 1", "fulltime_male": "fulltime = 1 and female = 0",
              "fulltime_female": "fulltime = 1 and female = 1"}


def _subset_rows(names) -> str:
    return " union all ".join(f"select *, '{s}' as subset from ana_long where {SUBSET_SQL[s]}" for s in names)


@query("select_by_method", f"""
select pid, year, hid_real as hid, age_real as age, {_each('hours_{m} as {m}')} from panel_ana""", "real standard ext")
def _(spark, folder):
    return op.select_by_method(ana(spark, folder), "hours")


MEAN_VARS = ["married", "in_couple", "n_people", "n_children", "birth", "daily_hh_income", "hh_youngest_age", "hh_frac_working"]


@query("mean_by_age_method", "select age_real as age, " + ", ".join(
    _each(f"avg({v}_{{m}}) as {v}_{{m}}") for v in MEAN_VARS) + " from panel_ana group by age_real",
    " ".join(_each(f"{v}_{{m}}", glue=" ") for v in MEAN_VARS))
def _(spark, folder):
    # derived for the columns it needs; the stored frame holds all columns of all methods
    return op.mean_by_age_method(analysis_frame(full(spark, folder)), MEAN_VARS)


SHARES = ", ".join(f"avg(cast(employment_status = {k} as int)) as status{k}" for k in range(4))
SHARE_DIGITS = "status0 status1 status2 status3"


@query("status_share_by_age", f"select age, method, {SHARES} from ana_long group by age, method", SHARE_DIGITS)
def _(spark, folder):
    return op.status_share_by_age(ana(spark, folder))


@query("status_share_from_flags", f"select age, {SHARES} from panel group by age", SHARE_DIGITS)
def _(spark, folder):
    return op.status_share_from_flags(panel(spark, folder))


@query("status_by_subgroup", f"""
states as (select unnest([0, 1, 2, 3]) as status),
rows as (select female_real as female, east_real as east, age_real as age, {_each('employment_status_{m} as {m}')}
         from panel_ana)
select coalesce(female, -1) as female, coalesce(east, -1) as east, age, status,
       {_each('avg(cast({m} = status as int)) as {m}')}
from rows, states group by grouping sets ((female, east, age, status), (female, age, status), (east, age, status), (age, status))
""", "real standard ext")
def _(spark, folder):
    return op.status_by_subgroup(ana(spark, folder))


@query("subset_by_flags", """
select pid, year, hours_ext from panel_ana
where working_ext = 1 and fulltime_ext = 0 and female_ext = 1 and age_ext <= 50""", "hours_ext")
def _(spark, folder):
    return op.subset_by_flags(ana(spark, folder), "ext", None, 1, 0, 50).select("pid", "year", "hours_ext")


def _income_sql(group: str) -> str:
    return f"""
subsets as ({_subset_rows(SUBSET_SQL)}),
long as (select {group}, subset, method, avg(daily_gross_earnings) as mean, quantile_cont(daily_gross_earnings, 0.5) as median
         from subsets group by all),
measures as (select {group}, subset, method, 'mean' as measure, mean as v from long
             union all select {group}, subset, method, 'median', median from long)
select {group}, subset, measure, {_each("coalesce(max(v) filter (method = '{m}'), 0.0::double) as {m}")}
from measures group by {group}, subset, measure"""


@query("income_by_age", _income_sql("age"), "real standard ext")
def _(spark, folder):
    return op.income_by_age(ana(spark, folder), "daily_gross_earnings")


@query("income_by_year", _income_sql("year"), "real standard ext")
def _(spark, folder):
    return op.income_by_year(ana(spark, folder), "daily_gross_earnings")


BOTH = f"""
subsets as ({_subset_rows(op.WORKING_SUBSETS)}),
vals as (select year, method, subset, 'gross_earnings' as variable, gross_earnings as value from subsets
         union all select year, method, subset, 'hours', hours from subsets)"""


@query("percentile_ratios", BOTH + """,
q as (select year, method, subset, variable, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.5) as p50,
             quantile_cont(value, 0.1) as p10 from vals group by all)
select year, method, subset, variable, p90 / p50 as p90p50, p90 / p10 as p90p10, p50 / p10 as p50p10 from q""",
       "p90p50 p90p10 p50p10")
def _(spark, folder):
    return op.percentile_ratios(ana(spark, folder))


@query("gini", BOTH + """,
ranked as (select *, row_number() over (partition by year, method, subset, variable order by value) as i from vals)
select year, method, subset, variable,
       2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / cast(count(*) as double) as gini
from ranked group by year, method, subset, variable""", "gini")
def _(spark, folder):
    return op.gini_by_year(ana(spark, folder))


def _lag_of_method(df, variable):
    """The method's value of the person's previous row, as the lag of the autocorrelation report."""
    before = Window.partitionBy("pid").orderBy("year")
    return df.withColumns({f"{variable}_t1_{m}": F.lag(f"{variable}_{m}").over(before) for m in METHODS})


@query("ar1_by_age", f"""
lagged as (select *, {_each('lag(hours_{m}) over (partition by pid order by year) as hours_t1_{m}')} from panel_ana)
select age_real as age, {_each('case when not isnan(regr_slope(hours_{m}, hours_t1_{m})) then regr_slope(hours_{m}, hours_t1_{m}) end as {m}')},
       (select regr_slope(hours_real, hours_t1_real) from lagged) as coef
from lagged group by age_real""", "real standard ext coef")
def _(spark, folder):
    return op.ar1_by_age(_lag_of_method(ana(spark, folder), "hours"), "hours")


@query("weighted_mean", """
select year, sum(v * personweight) / sum(case when v is not null then personweight end) as weighted_mean
from (select year, personweight, case when prio <> '5-LOW' then hours end as v from panel) group by year""",
       "weighted_mean")
def _(spark, folder):
    df = panel(spark, folder).withColumn("v", F.when(F.col("prio") != "5-LOW", F.col("hours")))
    return op.weighted_mean(df, "v", "personweight", ["year"])


fragment("completed", """
with gone as (select * from panel_full p where year < (select max(year) from panel_full)
              and not exists (select 1 from panel_full n where n.pid = p.pid and n.year = p.year + 1)),
means as (select female, age, cast(sum(cast(round(hours * 10000) as bigint)) as double) / count(*) / 10000.0::double as hours
          from panel_full group by female, age)
select 'standard' as method, year, hours, personweight, 0 as predicted from panel_full
union all select 'ext', year, hours, personweight, 0 from panel_full
union all select 'standard', cast(year + 1 as int), hours, personweight, 1 from gone
union all select 'ext', cast(g.year + 1 as int), m.hours, personweight, 1 from gone g
          left join means m on m.female = g.female and m.age = g.age + 1""")


def completed_panels(spark, folder):
    """Panels completed by both predictors for the year after a dropout, below each other."""
    df = full(spark, folder).select("pid", "year", "female", "age", "hours", "personweight")
    gone = anti_dropouts(df).withColumns({"year": (F.col("year") + 1).cast("int"), "age": F.col("age") + 1})
    carried = complete_panel(df, gone)
    mean = F.sum(F.round(F.col("hours") * 10_000).cast("bigint")) / F.count("hours") / F.lit(10_000.0)
    means = df.groupBy("female", "age").agg(mean.alias("mean_hours"))
    by_group = gone.join(means, ["female", "age"], "left").withColumn("hours", F.col("mean_hours")).drop("mean_hours")
    return (carried.withColumn("method", F.lit("standard"))
                   .unionByName(complete_panel(df, by_group).withColumn("method", F.lit("ext"))))


@query("yearly_means_by_method", """
select year, sum(case when method = 'standard' and predicted = 0 then hours * personweight end)
             / sum(case when method = 'standard' and predicted = 0 then personweight end) as no_impute,
       avg(case when method = 'standard' then hours end) as standard,
       avg(case when method = 'standard' and predicted = 1 then hours end) as standard_cond,
       avg(case when method = 'ext' then hours end) as ext,
       avg(case when method = 'ext' and predicted = 1 then hours end) as ext_cond
from completed where year > (select min(year) from panel_full) + 2 group by year""",
       "no_impute standard standard_cond ext ext_cond")
def _(spark, folder):
    return op.yearly_means_by_method(completed_panels(spark, folder), "hours", ["standard", "ext"])


STATES = """
states as (select *, case when fulltime = 0 and working = 1 then 1 else 0 end as parttime,
                  case when working = 0 and lfs = 1 then 1 else 0 end as unemployed
           from panel where age between 20 and 59)"""


@query("employment_by_age_group", STATES + """
select female, east, age, avg(fulltime) as fulltime, avg(parttime) as parttime, avg(unemployed) as unemployed,
       1 - avg(lfs) as inactive from states group by female, east, age""", "fulltime parttime unemployed inactive")
def _(spark, folder):
    return op.employment_by_age_group(panel(spark, folder))


@query("cohort_years_in_state", STATES + """,
sums as (select female, east, pid, sum(fulltime) as fulltime, sum(parttime) as parttime, sum(working) as working,
                sum(unemployed) as unemployed from states group by female, east, pid),
born as (select distinct pid, year - age as birthyear from states)
select female, east, cast(birthyear as int) as birthyear, avg(fulltime) as fulltime, avg(parttime) as parttime,
       avg(working) as working, avg(unemployed) as unemployed
from sums join born using (pid) group by female, east, birthyear""", "fulltime parttime working unemployed")
def _(spark, folder):
    return op.cohort_years_in_state(panel(spark, folder))


@query("sample_by_horizon", """
select period_ahead, count(*) as n, cast(sum(working_real) as bigint) as n_working,
       sum(working_real) / cast(count(*) as double) as share_working from panel_ana group by period_ahead""",
       "share_working")
def _(spark, folder):
    return op.sample_by_horizon(ana(spark, folder))


@query("sample_by_age", """
select age_real as age, count(*) as n, cast(sum(working_real) as bigint) as n_working from panel_ana group by age_real""")
def _(spark, folder):
    return op.sample_by_age(ana(spark, folder))


@query("employment_rate_by_sex", """
select age_real as age, avg(working_real) filter (female_real = 1) as emp_female,
       count(*) filter (female_real = 1) as n_female, avg(working_real) filter (female_real = 0) as emp_male,
       count(*) filter (female_real = 0) as n_male from panel_ana group by age_real""", "emp_female emp_male")
def _(spark, folder):
    return op.employment_rate_by_sex(ana(spark, folder))


MEDIAN_COLUMNS = ["pid", "year", *(f"{v}_{m}" for m in METHODS for v in (*(f"daily_{x}" for x in MONEY), *FIXED, *VARIABLES) if (v, m) != ("age", "real")),
                  "period_ahead"]


@query("median_by_age", "sizes as (select age_real as age, count(*) as n from panel_ana group by age_real)\n" + " union all ".join(
    f"""select age_real as age, '{c}' as variable, cast(quantile_cont({c}, 0.5) as double) as median,
        (select n from sizes where sizes.age = age_real) as n from panel_ana group by age_real""" for c in MEDIAN_COLUMNS), "median:7")
def _(spark, folder):
    return op.median_by_age(ana(spark, folder).select("age_real", *MEDIAN_COLUMNS))


@query("working_share_by_length", """
persons as (select pid, avg(working_real) as share, max(period_ahead) as period_ahead from panel_ana group by pid)
select period_ahead, avg(share) as mean, quantile_cont(share, 0.5) as median,
       (select avg(working_real) from panel_ana) as overall_mean from persons group by period_ahead""",
       "mean median overall_mean")
def _(spark, folder):
    return op.working_share_by_length(ana(spark, folder))


def _horizons(step: int) -> str:
    return (f"horizons as (select *, (select count(distinct period_ahead) from panel_ana) as k from panel_ana), "
            f"picked as (select * from horizons where period_ahead >= 1 and period_ahead < k and (period_ahead - 1) % {step} = 0)")


@query("accuracy_by_horizon", _horizons(4) + " " + " union all ".join(f"""
select 'frac_{m}' as type, period_ahead as years, avg(cast(employment_status_real = employment_status_{m} as int)) as value
from picked group by period_ahead""" for m in PREDICTED), "value")
def _(spark, folder):
    return op.accuracy_by_horizon(ana(spark, folder), "employment_status", PREDICTED)


@query("mean_by_horizon", f"select period_ahead, {_each('avg(hours_{m}) as {m}')} from panel_ana group by period_ahead",
       "real standard ext")
def _(spark, folder):
    return op.mean_by_horizon(ana(spark, folder), "hours")


def _dispersion_sql(variable: str, positive: str, absolute: str) -> str:
    q = lambda p: f"quantile_cont(v, {p})"
    rows = _each(f"select period_ahead, '{{m}}' as method, {variable}_{{m}} as v from panel_ana where {positive} > 0",
                 glue=" union all ")
    return f"""
rows as ({rows})
select period_ahead, method, {absolute}(avg(v)) as mean, {absolute}({q(0.5)}) as median, var_samp(v) as variance,
       {absolute}({q(0.9)} / case when {q(0.5)} <> 0 then {q(0.5)} end) as p90p50,
       {absolute}({q(0.5)} / case when {q(0.1)} <> 0 then {q(0.1)} end) as p50p10
from rows group by period_ahead, method"""


@query("dispersion_by_horizon", _dispersion_sql("daily_gross_earnings", "daily_gross_earnings_real", ""),
       "mean median variance:3 p90p50 p50p10")
def _(spark, folder):
    return op.dispersion_by_horizon(ana(spark, folder), "daily_gross_earnings")


@query("abs_dispersion_by_horizon", _dispersion_sql("hours", "gross_earnings_real", "abs"),
       "mean median variance:5 p90p50 p50p10")
def _(spark, folder):
    return op.abs_dispersion_by_horizon(ana(spark, folder), "hours")


@query("prediction_error", """
select pid, year, hours_real - hours_standard as error_standard, abs(hours_real - hours_standard) as abs_error_standard,
       hours_real - hours_ext as error_ext, abs(hours_real - hours_ext) as abs_error_ext from panel_ana""",
       "error_standard:8 abs_error_standard:8 error_ext:8 abs_error_ext:8")
def _(spark, folder):
    return op.prediction_error(ana(spark, folder), "hours", PREDICTED).select(
        "pid", "year", *[f"{p}error_{m}" for m in PREDICTED for p in ("", "abs_")])


PERSON_DIFF = """
persons as (select pid, period_ahead, abs(sum(daily_gross_earnings_real) - sum(daily_gross_earnings_ext)) as diff
            from panel_ana group by pid, period_ahead),
largest as (select max(diff) as m from persons group by period_ahead having max(diff) > 0),
kept as (select * from persons where diff not in (select m from largest))"""


@query("abs_error_describe", PERSON_DIFF + """
select period_ahead, count(diff) as count, avg(diff) as mean, stddev_samp(diff) as std, min(diff) as min, max(diff) as max,
       quantile_cont(diff, 0.25) as p25, quantile_cont(diff, 0.5) as p50, quantile_cont(diff, 0.75) as p75
from kept group by period_ahead""", "mean std:5 min max p25 p50 p75")
def _(spark, folder):
    return op.abs_error_describe(ana(spark, folder), "daily_gross_earnings", "ext")


@query("drop_largest", """
errors as (select pid, year, period_ahead, abs(hours_real - hours_standard) as diff from panel_ana)
select * from errors where diff not in (select m from (select max(diff) as m from errors group by period_ahead) where m > 0)
""", "diff")
def _(spark, folder):
    errors = op.prediction_error(ana(spark, folder), "hours", ["standard"]).select(
        "pid", "year", "period_ahead", F.col("abs_error_standard").alias("diff"))
    return op.drop_largest(errors, "diff", "period_ahead")


@query("trim_quantiles", """
q as (select quantile_cont(gross_earnings, 0.05) as low, quantile_cont(gross_earnings, 0.95) as high from panel)
select pid, year, gross_earnings from panel, q where gross_earnings > low and gross_earnings < high""",
       "gross_earnings:2")
def _(spark, folder):
    return op.trim_quantiles(panel(spark, folder).select("pid", "year", "gross_earnings"), "gross_earnings")


def _histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    using = f"join edges using ({by})" if by else ", edges"
    return f"""
edges as (select {keys} case when min({value}) = max({value}) then min({value}) - 0.5 else min({value}) end as lo,
                 case when min({value}) = max({value}) then max({value}) + 0.5 else max({value}) end as hi
          from {source} {group}),
counts as (select {keys} least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1}) as bin, count(*) as obs
           from {source} {using} group by all),
grid as (select *, unnest(generate_series(0, {bins - 1})) as bin from edges)
select {keys} cast(bin as int) as bin, coalesce(obs, 0) as obs, lo + bin * ((hi - lo) / {bins}) as "left",
       lo + (bin + 1) * ((hi - lo) / {bins}) as "right"
from grid left join counts using ({keys} bin)"""


@query("histogram_equal_width", _histogram_sql("panel", "hours", 20),
       "left right")
def _(spark, folder):
    return op.histogram_equal_width(panel(spark, folder), "hours", 20)


ERROR_ROWS = " union all ".join(
    f"""select '{m}' as method, period_ahead, gross_earnings_real - gross_earnings_{m} as error from panel_ana
        where gross_earnings_real > 0 and period_ahead in (1, 6, 11, 16, 21)""" for m in PREDICTED)


@query("error_histograms", f"""
errors as ({ERROR_ROWS}),
q as (select method, period_ahead, quantile_cont(error, 0.05) as low, quantile_cont(error, 0.95) as high
      from errors group by all),
trimmed as (select e.* from errors e join q using (method, period_ahead) where error > low and error < high),
""" + _histogram_sql("trimmed", "error", 40, "method, period_ahead").strip(),
       "left:4 right:4")
def _(spark, folder):
    return op.error_histograms(ana(spark, folder), PREDICTED)


@query("person_histograms", """
persons as (select pid, cast(max(period_ahead) as double) as observed_years, cast(min(year) as double) as first_year,
                   cast(max(education_real) as double) as education, avg(female_real) as female from panel_ana group by pid),
people_values as (
  select 'observed_years' as measure, observed_years as value from persons
  union all select 'first_year', first_year from persons union all select 'education', education from persons
  union all select 'female', female from persons
  union all select 'children', cast(max(n_children_real) as double) from panel_ana group by hid_real),
""" + _histogram_sql("people_values", "value", 32, "measure").strip(),
       "left right")
def _(spark, folder):
    return op.person_histograms(ana(spark, folder))


def _bucket_sql(column: str) -> str:
    return (f"case when {column} < 10 then 0 when {column} < 20 then 1 when {column} < 30 then 2 "
            f"when {column} < 40 then 3 when {column} >= 40 then 4 end")


@query("bucket_shares", _horizons(5) + f""",
buckets as (select unnest([0, 1, 2, 3, 4]) as bucket)
select period_ahead, bucket, {', '.join(f"avg(cast({_bucket_sql(f'hours_{m}')} = bucket as int)) as {m}" for m in METHODS)}
from picked, buckets group by period_ahead, bucket""", "real standard ext")
def _(spark, folder):
    return op.bucket_shares(ana(spark, folder))


@query("crosstab_real_vs_method", "pairs as (select " + _bucket_sql("hours_real") + " as real_bucket, "
       + _bucket_sql("hours_standard") + " as b from panel_ana) select real_bucket, "
       + ", ".join(f"count(*) filter (b = {k}) as bucket{k}" for k in range(5)) + " from pairs group by real_bucket")
def _(spark, folder):
    return op.crosstab_real_vs_method(ana(spark, folder), "standard")


@query("unpivot_metrics", f"""
means as (select period_ahead as ahead, {_each('avg(hours_{m}) as {m}')} from panel_ana group by period_ahead)
""" + " ".join(_each("select ahead, '{m}' as variable, {m} as value from means", glue=" union all ").split("\n")), "value")
def _(spark, folder):
    means = op.mean_by_horizon(ana(spark, folder), "hours").withColumnRenamed("period_ahead", "ahead")
    return op.unpivot_metrics(means, ["ahead"], METHODS)
