"""The frames the queries start from, in Spark and in SQL.

panel       one row per (pid, year), from the order tables
panel_whole the same with orders before a person is born, for queries that do not use ages
panel_full  the panel with household variables and the placeholder columns
panel_lags  complete rows with values of one and two years before
panel_ana   observed values next to two predictors: `standard` carries a person's last observed
            value forward, `ext` is the mean of the same sex and age
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag
from hearthpanel.operators.household import hh_vars
from hearthpanel.operators.joins import pair_methods
from hearthpanel.operators.longitudinal import lagged_panel, period_ahead
from hearthpanel.plans.registry import fragment
from hearthpanel.session import stored
from hearthpanel.sources.tables import born, person_years, table

BORN = " where (pid * 7) % 66 + (year - 1998) >= 0"
PANEL_SQL = """
with li as (
  select l_orderkey, sum(l_quantity) as q, count(*) as c,
         max(case when l_returnflag = 'R' then 1 else 0 end) as any_r
  from lineitem group by l_orderkey),
py as (
  select o.o_custkey as pid, cast(year(o.o_orderdate) as int) as year,
         cast(count(*) as int) as n_orders, round(sum(o.o_totalprice), 2) as gross_earnings,
         least(coalesce(sum(li.q), 0) / greatest(coalesce(sum(li.c), 0), 1), 80.0) as hours,
         min(o.o_orderstatus) as min_status, min(o.o_orderpriority) as prio,
         coalesce(max(li.any_r), 0) as any_r
  from orders o left join li on li.l_orderkey = o.o_orderkey
  group by o.o_custkey, cast(year(o.o_orderdate) as int)),
p as (
  select py.*, cast(floor(pid / 4) as bigint) as hid,
         cast((pid * 7) % 66 + (year - 1998) as int) as age,
         cast(pid % 2 as int) as female,
         case when n_orders >= 3 then 3 when n_orders = 2 then 2
              when min_status = 'F' then 1 else 0 end as employment_status,
         greatest(c.c_acctbal, 0.0) / 1000 + 1 as personweight, c.c_mktsegment as segment
  from py join customer c on c.c_custkey = py.pid{born})
select pid, year, hid, age, female, cast(case when hid % 4 = 0 then 1 else 0 end as int) as east,
       cast(personweight as double) as personweight, segment, prio, cast(any_r as int) as any_r, n_orders,
       case when age < 18 then 1 else 0 end as child,
       cast(employment_status as int) as employment_status,
       case when employment_status >= 2 then 1 else 0 end as working,
       case when employment_status = 3 then 1 else 0 end as fulltime,
       case when employment_status = 1 then 1 else 0 end as retired,
       case when employment_status >= 1 and min_status <> 'P' then 1 else 0 end as lfs,
       case when pid % 5 < 2 and age >= 18 then 1 else 0 end as in_couple,
       case when pid % 5 = 0 and age >= 18 then 1 else 0 end as married,
       cast(substr(prio, 1, 1) as int) - 1 as education,
       cast(case when employment_status >= 2 then gross_earnings else 0.0 end as double) as gross_earnings,
       cast(case when employment_status >= 2 then hours else 0.0 end as double) as hours
from p"""
fragment("panel", PANEL_SQL.format(born=BORN))
fragment("panel_whole", PANEL_SQL.format(born=""))

fragment("panel_full", """
select pid, year, hid, age, female, east, personweight, child, employment_status, working, fulltime,
       retired, lfs, in_couple, married, education, gross_earnings, hours, any_r as migback,
       personweight as hhweight, hid as orighid, cast(0 as bigint) as motherpid, 60 as age_max, 0 as predicted,
       round(sum(gross_earnings) over h, 2) as hh_income,
       cast(count(*) over h as int) as n_people, cast(sum(child) over h as int) as n_children,
       case when count(*) over h = sum(child) over h then 0.0::double
            else least(cast(sum(working) over h as double) / cast(count(*) over h - sum(child) over h as double), 1.0)
       end as hh_frac_working,
       min(age) over h as hh_youngest_age,
       case when min(age) over h = 0 and female = 1 and child = 0 then 1 else 0 end as birth
from panel window h as (partition by year, hid)""")

fragment("panel_lags", """
select f.*,
       r1.retired as retired_t1, r1.working as working_t1, r1.fulltime as fulltime_t1,
       r1.hours as hours_t1, r2.hours as hours_t2, r1.gross_earnings as gross_earnings_t1,
       r2.gross_earnings as gross_earnings_t2, r1.employment_status as employment_status_t1,
       r2.employment_status as employment_status_t2
from panel_full f
join panel_full r1 on r1.pid = f.pid and r1.year = f.year - 1
join panel_full r2 on r2.pid = f.pid and r2.year = f.year - 2""")

VARIABLES = ["employment_status", "working", "fulltime", "married", "in_couple", "birth", "education",
             "n_people", "n_children", "hh_youngest_age", "hh_frac_working", "hh_income", "hours",
             "gross_earnings"]
MONEY = ["gross_earnings", "hh_income"]  # also given per day
METHODS = ["real", "standard", "ext"]
FIXED = ["hid", "age", "female", "east"]  # facts no predictor changes
_WHOLE = {"married", "in_couple", "birth", "education", "n_people", "n_children", "hh_youngest_age"}
_SCALE = {"hh_frac_working": 10_000, "hh_income": 100, "hours": 10_000, "gross_earnings": 100}


def _mean(variable: str) -> Column:
    """Group mean from whole-number sums, so that it does not depend on the order of addition."""
    if variable in _SCALE:
        s = _SCALE[variable]
        return (F.sum(F.round(F.col(variable) * s).cast("bigint")) / F.count(variable) / F.lit(float(s)))
    return F.round(F.avg(variable)).cast("int")


def _mean_sql(variable: str) -> str:
    if variable in _SCALE:
        s = _SCALE[variable]
        return (f"cast(sum(cast(round({variable} * {s}) as bigint)) as double) / count({variable}) / {s}.0::double")
    return f"cast(round(avg({variable})) as int)"


_CARRIED = [v for v in VARIABLES if v not in ("working", "fulltime")]
fragment("pred_mean", "select female, age, " + ", ".join(f"{_mean_sql(v)} as {v}" for v in _CARRIED)
         + " from panel_full group by female, age")
fragment("pred_last", "select pid, year, "
         + ", ".join(f"lag({v}) over (partition by pid order by year) as {v}" for v in _CARRIED)
         + " from panel_full")
_ana = []
for _m, _t in zip(METHODS, "fse"):
    _ana += [f"{_t}.{v} / 365 as daily_{v}_{_m}" for v in MONEY]
    _ana += [f"f.{v} as {v}_{_m}" for v in FIXED]
    _ana += [f"{_t}.{v} as {v}_{_m}" for v in _CARRIED]
    _ana += [f"case when {_t}.employment_status >= 2 then 1 else 0 end as working_{_m}",
             f"case when {_t}.employment_status = 3 then 1 else 0 end as fulltime_{_m}"]
fragment("panel_ana", f"""
select f.pid, f.year, {', '.join(_ana)},
       cast(max(f.year) over (partition by f.pid) - f.year as int) as period_ahead,
       cast(f.year - min(f.year) over (partition by f.pid) as int) as years_since_entry
from panel_full f
join pred_last s on s.pid = f.pid and s.year = f.year and s.employment_status is not null
join pred_mean e on e.female = f.female and e.age = f.age""")


def panel_whole(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "panel", lambda: person_years(spark, folder))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return born(panel_whole(spark, folder))


def full_panel(people: DataFrame) -> DataFrame:
    base = people.drop("segment", "prio", "n_orders").withColumnRenamed("any_r", "migback")
    base = base.withColumns({"hhweight": F.col("personweight"), "orighid": F.col("hid"),
                             "motherpid": F.lit(0).cast("bigint"), "age_max": F.lit(60), "predicted": F.lit(0)})
    return hh_vars(base).withColumn("hh_income", F.round("hh_income", 2))


def full(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "panel_full", lambda: full_panel(panel(spark, folder)))


def lags(spark: SparkSession, folder: str) -> DataFrame:
    # read once, so the frame before it need not be written
    return stored(spark, folder, "panel_lags", lambda: lagged_panel(full_panel(panel(spark, folder))))


def _with_states(df: DataFrame) -> DataFrame:
    return df.withColumns({"working": flag(F.col("employment_status") >= 2),
                           "fulltime": flag(F.col("employment_status") == 3)})


def last_value(df: DataFrame) -> DataFrame:
    """Predictor `standard`: the values of a person's previous observed year."""
    before = Window.partitionBy("pid").orderBy("year")
    moved = df.select("pid", "year", *FIXED, *[F.lag(v).over(before).alias(v) for v in _CARRIED])
    return _with_states(moved.filter(F.col("employment_status").isNotNull()))


def group_mean(df: DataFrame) -> DataFrame:
    """Predictor `ext`: the means of all persons of the same sex and age."""
    keys = ["female", "age"]
    means = df.groupBy(*keys).agg(*[_mean(v).alias(f"_mean_{v}") for v in _CARRIED])
    return _with_states(df.join(means, keys, "left").select("pid", "year", *FIXED, *[F.col(f"_mean_{v}").alias(v) for v in _CARRIED]))


def analysis_frame(people: DataFrame) -> DataFrame:
    df = people.select("pid", "year", "predicted", *FIXED, *VARIABLES)
    paired = pair_methods(df, {"standard": last_value(df), "ext": group_mean(df)}, FIXED + VARIABLES)
    return period_ahead(paired.withColumns({f"daily_{v}_{m}": F.col(f"{v}_{m}") / 365 for v in MONEY for m in METHODS}))


def ana(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "panel_ana", lambda: analysis_frame(full(spark, folder)))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate per 1000 by age, from the part table: size is the age."""
    return (table(spark, folder, "part").groupBy(F.col("p_size").alias("age"))
            .agg(F.round(F.avg("p_retailprice") / 10, 3).alias("rate")))


fragment("rates", """
select p_size as age, round(avg(p_retailprice) / 10, 3) as rate from part group by p_size""")
