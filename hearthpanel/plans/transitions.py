"""Queries of the transition tables and status draws."""

from pyspark.sql import functions as F

from hearthpanel.operators import transitions as op
from hearthpanel.plans.frames import lags, panel
from hearthpanel.plans.registry import fragment, query

CELL = "female, age, status_t1, status_t, n, joint, p_t, p_t1"
CELL_DIGITS = "joint p_t p_t1"


def _states(spark, folder):
    """The lagged panel is what the tables are estimated on."""
    return lags(spark, folder).select("pid", "year", "female", "age", "east", "employment_status", "employment_status_t1")


@query("transition_joint", """
states as (select unnest([0, 1, 2, 3]) as s)
select a.s as status_t, b.s as status_t1,
       (select count(*) from panel_lags where employment_status = a.s and employment_status_t1 = b.s)
       / cast((select count(*) from panel_lags) as double) as joint from states a, states b""", "joint")
def _(spark, folder):
    return op.transition_joint(_states(spark, folder))


@query("transition_marginals", """
select 't' as side, employment_status as status, count(*) / cast((select count(*) from panel_lags) as double) as p
from panel_lags group by employment_status
union all
select 't1', employment_status_t1, count(*) / cast((select count(*) from panel_lags) as double)
from panel_lags group by employment_status_t1""", "p")
def _(spark, folder):
    return op.transition_marginals(_states(spark, folder))


@query("transition_by_sex_age", f"select {CELL} from conditional", CELL_DIGITS)
def _(spark, folder):
    return op.transition_by_sex_age(_states(spark, folder))


@query("transition_cohort", """
base as (select * from panel_lags where year - age between 1945 and 1954 and east = 0),
n as (select female, age, count(*) as n from base group by female, age),
states as (select unnest([0, 1, 2, 3]) as s),
joint as (select n.female, n.age, b.s as status_t1, a.s as status_t, n.n,
                 (select count(*) from base x where x.female = n.female and x.age = n.age and x.employment_status = a.s
                                               and x.employment_status_t1 = b.s) / cast(n.n as double) as joint
          from n, states a, states b)
select *, sum(joint) over (partition by female, age, status_t) as p_t,
       sum(joint) over (partition by female, age, status_t1) as p_t1 from joint""", CELL_DIGITS)
def _(spark, folder):
    return op.transition_cohort(_states(spark, folder))


@query("transition_check", """
spoilt as (select female, age, p_t1, case when age % 10 = 0 then p_t * 1.5 else p_t end as p_t from conditional)
select female, age, sum(p_t) / 4 as sum_t, sum(p_t1) / 4 as sum_t1 from spoilt group by female, age
having round(sum(p_t) / 4, 2) <> 1 or round(sum(p_t1) / 4, 2) <> 1""", "sum_t sum_t1")
def _(spark, folder):
    """Also over a table in which the marginals of every tenth age are spoilt, so that there is something to find."""
    cells = op.transition_by_sex_age(_states(spark, folder))
    return op.transition_check(cells.withColumn("p_t", F.when(F.col("age") % 10 == 0, F.col("p_t") * 1.5).otherwise(F.col("p_t"))))


@query("transition_conditional", f"select {CELL}, cond from conditional", CELL_DIGITS + " cond")
def _(spark, folder):
    return op.transition_conditional(op.transition_by_sex_age(_states(spark, folder)))


fragment("shares", """
select p.pid, p.year, p.female, p.age, p.employment_status, s.*exclude (female)
from panel p join (select female, avg(case when employment_status = 0 then 1.0::double else 0.0 end) as p0,
                          avg(case when employment_status = 1 then 1.0::double else 0.0 end) as p1,
                          avg(case when employment_status = 2 then 1.0::double else 0.0 end) as p2,
                          avg(case when employment_status = 3 then 1.0::double else 0.0 end) as p3
                   from panel group by female) s on s.female = p.female""")
fragment("blended", """
with wide as (select female, age, status_t1, sum(cond) filter (status_t = 0) as t0, sum(cond) filter (status_t = 1) as t1,
                     sum(cond) filter (status_t = 2) as t2, sum(cond) filter (status_t = 3) as t3
              from conditional group by all)
select s.pid, s.year, 0.25 * p0 + 0.75 * coalesce(t0, 0) as b0, 0.25 * p1 + 0.75 * coalesce(t1, 0) as b1,
       0.25 * p2 + 0.75 * coalesce(t2, 0) as b2, 0.25 * p3 + 0.75 * coalesce(t3, 0) as b3
from shares s left join wide w on w.female = s.female and w.age = s.age and w.status_t1 = s.employment_status""")
DRAW = "('0x' || substr(md5(concat_ws('|', pid, year, 'status', '2020')), 1, 8))::ubigint / 4294967296.0::double"


def with_shares(df):
    """Model probabilities of the fixture: status shares of the person's sex."""
    share = lambda k: F.avg((F.col("employment_status") == k).cast("double")).alias(f"p{k}")
    return df.join(df.groupBy("female").agg(*[share(k) for k in range(4)]), "female", "left")


def blended(spark, folder):
    from hearthpanel.operators.joins import lookup_transition
    people = with_shares(panel(spark, folder).select("pid", "year", "female", "age", "employment_status"))
    people = people.withColumn("employment_status_t1", F.col("employment_status"))
    return op.blend_probabilities(lookup_transition(people, op.transition_conditional(
        op.transition_by_sex_age(_states(spark, folder)))))


@query("blend_probabilities", "select * from blended", "b0 b1 b2 b3")
def _(spark, folder):
    return blended(spark, folder).select("pid", "year", "b0", "b1", "b2", "b3")


@query("draw_status", f"""
select pid, year, case when u < b0 then 0 when u < b0 + b1 then 1 when u < b0 + b1 + b2 then 2
                       when u < b0 + b1 + b2 + b3 then 3 else 0 end as drawn
from (select *, {DRAW} as u from blended)""")
def _(spark, folder):
    return op.draw_status(blended(spark, folder)).select("pid", "year", "drawn")


@query("argmax_status", """
select pid, year, case greatest(b0, b1, b2, b3) when b0 then 0 when b1 then 1 when b2 then 2 else 3 end as likely
from (select pid, year, round(b0, 9) as b0, round(b1, 9) as b1, round(b2, 9) as b2, round(b3, 9) as b3 from blended)""")
def _(spark, folder):
    rounded = blended(spark, folder).withColumns({f"b{k}": F.round(f"b{k}", 9) for k in range(4)})
    return op.argmax_status(rounded).select("pid", "year", "likely")


PROJECTION_START = """select female, age, employment_status as status,
  count(*) / cast(sum(count(*)) over (partition by female, age) as double) as share
  from panel_full group by female, age, employment_status"""


@query("project_status_shares", f"""
s0 as ({PROJECTION_START}),
s1 as (select s.female, cast(s.age + 1 as int) as age, c.status_t as status, sum(share * coalesce(cond, 1)) as share
       from s0 s left join conditional c on c.female = s.female and c.age = s.age + 1 and c.status_t1 = s.status and cond > 0 group by all),
s2 as (select s.female, cast(s.age + 1 as int) as age, c.status_t as status, sum(share * coalesce(cond, 1)) as share
       from s1 s left join conditional c on c.female = s.female and c.age = s.age + 1 and c.status_t1 = s.status and cond > 0 group by all)
select *, 0 as period from s0 union all select *, 1 from s1 union all select *, 2 from s2""", "share")
def _(spark, folder):
    now = panel(spark, folder).groupBy("female", "age", F.col("employment_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    sizes = now.groupBy("female", "age").agg(F.sum("n").alias("size"))
    start = now.join(sizes, ["female", "age"]).withColumn("share", F.col("n") / F.col("size"))
    table = op.transition_conditional(op.transition_by_sex_age(_states(spark, folder)))
    return op.project_status_shares(start, table, 2)
