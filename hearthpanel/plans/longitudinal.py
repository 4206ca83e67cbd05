"""Queries along a person's years."""

from pyspark.sql import functions as F

from hearthpanel.operators import longitudinal as op
from hearthpanel.plans.frames import full, lags, panel
from hearthpanel.plans.registry import query

PERIODS = """select pid, year, cast(max(year) over (partition by pid) - year as int) as period_ahead from panel"""


@query("min_observations", """
select pid, year, age from panel qualify count(*) over (partition by pid) > 2""")
def _(spark, folder):
    return op.min_observations(panel(spark, folder).select("pid", "year", "age"))


@query("lag_exact", """
select pid, year,
       first_value(hours) over (partition by pid order by year range between 1 preceding and 1 preceding) as hours_t1,
       first_value(hours) over (partition by pid order by year range between 2 preceding and 2 preceding) as hours_t2,
       first_value(employment_status) over (partition by pid order by year range between 1 preceding and 1 preceding)
         as employment_status_t1
from panel qualify year >= (select distinct year from panel order by year limit 1 offset 2)""", "hours_t1 hours_t2")
def _(spark, folder):
    df = panel(spark, folder).select("pid", "year", "hours", "employment_status")
    out = op.lag_exact(df, {"hours_t1": ("hours", 1), "hours_t2": ("hours", 2),
                            "employment_status_t1": ("employment_status", 1)})
    return out.drop("hours", "employment_status")


LAGGED = ["pid", "year", "employment_status", *op.LAGS]
LAG_DIGITS = "hours_t1 hours_t2 gross_earnings_t1:2 gross_earnings_t2:2"


@query("lagged_panel", f"select {', '.join(LAGGED)} from panel_lags", LAG_DIGITS)
def _(spark, folder):
    return op.lagged_panel(full(spark, folder)).select(*LAGGED)


@query("roll_state", """
select pid, year + 1 as year, age + 1 as age, retired as retired_t1, working as working_t1, fulltime as fulltime_t1,
       hours as hours_t1, hours_t1 as hours_t2, gross_earnings as gross_earnings_t1,
       gross_earnings_t1 as gross_earnings_t2, employment_status as employment_status_t1,
       employment_status_t1 as employment_status_t2, 0 as birth, 0 as retired, 0 as working, 0 as fulltime,
       0.0::double as hours, 0.0::double as gross_earnings, 0 as employment_status
from panel_lags""", LAG_DIGITS)
def _(spark, folder):
    names = ["pid", "year", "age", *op.LAGS, *op.ESTIMATED]
    return op.roll_state(lags(spark, folder).select(*names))


@query("first_record", "select pid, year, age from panel qualify row_number() over (partition by pid order by year) = 1")
def _(spark, folder):
    return op.first_record(panel(spark, folder).select("pid", "year", "age"))


@query("period_ahead", """
select pid, year, cast(max(year) over (partition by pid) - year as int) as period_ahead,
       cast(year - min(year) over (partition by pid) as int) as years_since_entry from panel""")
def _(spark, folder):
    return op.period_ahead(panel(spark, folder).select("pid", "year"))


@query("entry_year", """
select entry_year, count(*) as n_entrants from (select pid, min(year) as entry_year from panel group by pid)
group by entry_year""")
def _(spark, folder):
    return op.entrants_by_year(panel(spark, folder))


@query("first_year_cohort", """
select pid, year, age from panel
where pid in (select pid from panel where year = (select min(year) from panel))""")
def _(spark, folder):
    return op.first_year_cohort(panel(spark, folder).select("pid", "year", "age"))


@query("birth_cohort", "select pid, year, age, east from panel where year - age between 1945 and 1954 and east = 0")
def _(spark, folder):
    return op.birth_cohort(panel(spark, folder).select("pid", "year", "age", "east"), 1945, 1954, 0)


@query("observation_length", f"""
select pid, max(period_ahead) as observation_length from ({PERIODS}) group by pid""")
def _(spark, folder):
    return op.observation_length(op.period_ahead(panel(spark, folder).select("pid", "year")))


@query("retention_curve", """
sizes as (select pid, count(*) as k from panel group by pid),
grid as (select unnest(generate_series(1, (select max(k) from sizes))) as i)
select cast(i as int) as year, (select count(*) from sizes where k >= i) as count,
       (select count(*) from sizes where k >= i) / cast((select count(*) from sizes) as double) as relative
from grid""", "relative")
def _(spark, folder):
    return op.retention_curve(panel(spark, folder))


@query("panel_size_by_year", "select year, count(*) as size from panel group by year")
def _(spark, folder):
    return op.panel_size_by_year(panel(spark, folder))
