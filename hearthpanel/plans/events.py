"""Queries of the one-period population events."""

from pyspark.sql import functions as F

from hearthpanel.functions.columns import seeded_uniform
from hearthpanel.operators import events as op
from hearthpanel.operators.joins import anti_dropouts
from hearthpanel.operators.longitudinal import roll_state
from hearthpanel.plans.frames import full, lags, panel, rates
from hearthpanel.plans.registry import fragment, query


def draw(event: str, seed: int = op.SEED, key: str = "pid") -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', {key}, year, '{event}', '{seed}')), 1, 8))::ubigint"
            " / 4294967296.0::double)")


@query("seeded_uniform", f"select pid, year, {draw('demo')} as u from panel", "u:9")
def _(spark, folder):
    return panel(spark, folder).select("pid", "year", seeded_uniform(["pid", "year"], "demo", op.SEED).alias("u"))


@query("remove_age_out", "select pid, year, age from panel_full where not age >= age_max")
def _(spark, folder):
    return op.remove_age_out(full(spark, folder)).select("pid", "year", "age")


fragment("separated", f"""
with d as (select *, {draw('separation')} as u from panel_full),
s as (select *, (married = 1 and u < 0.05) or (in_couple = 1 and married = 0 and u < 0.10) as parts from d)
select * exclude (married, in_couple, orighid, hid, u, parts), cast(parts as int) as separated,
       case when parts then 0 else married end as married, case when parts then 0 else in_couple end as in_couple,
       case when parts and female = 0 then hid else orighid end as orighid,
       case when parts and female = 0 then 1000000000000 + pid * 10000 + year else hid end as hid from s""")
COUPLE = ["pid", "year", "hid", "orighid", "married", "in_couple"]


@query("mark_separations", f"select {', '.join(COUPLE)}, separated from separated")
def _(spark, folder):
    # the default rates of 1% and 2% leave too few rows at small scale
    return op.mark_separations(full(spark, folder), married_rate=0.05, couple_rate=0.10).select(*COUPLE, "separated")


@query("mark_marriages", f"""
select pid, year, in_couple, case when married = 0 and in_couple = 1 and {draw('marriage')} < 0.1 then 1 else married end
       as married, case when married = 0 and in_couple = 1 and {draw('marriage')} < 0.1 then 1 else 0 end as wed
from panel_full""")
def _(spark, folder):
    return op.mark_marriages(full(spark, folder)).select("pid", "year", "in_couple", "married", "wed")


@query("leave_home", """
select pid, year, age, case when age = 18 then n_children - 1 else n_children end as n_children,
       case when age = 18 then 1000000000000 + pid * 10000 + year else hid end as hid,
       case when age = 18 then 0 else child end as child from panel_full""")
def _(spark, folder):
    return op.leave_home(full(spark, folder)).select("pid", "year", "age", "n_children", "hid", "child")


fragment("mothers", f"""
select p.* exclude (birth), case when p.female = 1 and p.child = 0 and p.age between 15 and 49
     and {draw('birth').replace('pid,', 'p.pid,').replace('year,', 'p.year,')} < r.rate / 1000 then 1 else 0 end as birth
from panel_full p left join rates r on r.age = p.age""")


@query("flag_births", "select pid, year, age, birth from mothers")
def _(spark, folder):
    return op.flag_births(full(spark, folder), rates(spark, folder)).select("pid", "year", "age", "birth")


CHILD = ["pid", "year", "hid", "age", "female", "child", "motherpid", "employment_status", "predicted", "birth"]


@query("add_newborn_rows", f"""
select {', '.join(CHILD)}, hours from mothers
union all
select 3000000000000 + pid * 10000 + year, year, hid, 0, case when {draw('sex')} >= 0.5 then 1 else 0 end, 1, pid, 0, 1, 0,
       0.0::double from mothers where birth = 1""", "hours")
def _(spark, folder):
    return op.add_newborn_rows(op.flag_births(full(spark, folder), rates(spark, folder))).select(*CHILD, "hours")


@query("form_couples", """
homes as (select c.year, c.man as pid, w.hid, w.east, w.hhweight from couples c
          join panel_full w on w.year = c.year and w.pid = c.woman),
paired as (select year, man as pid from couples union all select year, woman from couples)
select p.pid, p.year, coalesce(h.hid, p.hid) as hid, coalesce(h.east, p.east) as east,
       coalesce(h.hhweight, p.hhweight) as hhweight, case when q.pid is not null then 1 else p.in_couple end as in_couple
from panel_full p left join homes h on h.year = p.year and h.pid = p.pid
                  left join paired q on q.year = p.year and q.pid = p.pid""", "hhweight")
def _(spark, folder):
    return op.form_couples(spark, full(spark, folder)).select("pid", "year", "hid", "east", "hhweight", "in_couple")


@query("complete_panel", """
gone as (select * from panel_lags p where year < (select max(year) from panel_lags)
         and not exists (select 1 from panel_lags n where n.pid = p.pid and n.year = p.year + 1))
select pid, year, age, employment_status, employment_status_t1, predicted from panel_lags
union all
select pid, cast(year + 1 as int), cast(age + 1 as int), 0, employment_status, 1 from gone""")
def _(spark, folder):
    df = lags(spark, folder)
    projected = roll_state(anti_dropouts(df)).withColumn("year", F.col("year").cast("int"))
    return op.complete_panel(df, projected).select(
        "pid", "year", "age", "employment_status", "employment_status_t1", "predicted")


@query("event_counts", f"""
events as (select year, case when age >= age_max then 1 else 0 end as deaths, separated as separations,
                  case when married = 0 and in_couple = 1 and {draw('marriage')} < 0.1 then 1 else 0 end as marriages,
                  birth as births from separated)
select year, cast(sum(deaths) as bigint) as deaths, cast(sum(separations) as bigint) as separations,
       cast(sum(marriages) as bigint) as marriages, cast(sum(births) as bigint) as births from events group by year""")
def _(spark, folder):
    df = op.mark_marriages(op.mark_separations(full(spark, folder), married_rate=0.05, couple_rate=0.10))
    flags = df.select("year", (F.col("age") >= F.col("age_max")).cast("int").alias("deaths"),
                      F.col("separated").alias("separations"), F.col("wed").alias("marriages"),
                      F.col("birth").alias("births"))
    return op.event_counts(flags, ["deaths", "separations", "marriages", "births"])
