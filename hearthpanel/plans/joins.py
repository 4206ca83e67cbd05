"""Queries of the join operators."""

from pyspark.sql import functions as F

from hearthpanel.operators import joins as op
from hearthpanel.operators import transitions as tr
from hearthpanel.operators.matching import FEATURES, eligible_singles, knn_candidates, match_pairs
from hearthpanel.plans.frames import analysis_frame, full, lags, panel, panel_whole, rates
from hearthpanel.plans.registry import fragment, query
from hearthpanel.sources.tables import table

for _people, _of in (("panel", ""), ("panel_whole", "_whole")):
    fragment(f"pgen{_of}", f"""
select pid, hid, year as syear, employment_status as pgemplst, gross_earnings as pglabgro from {_people}""")
    fragment(f"ppathl{_of}", f"""
select p.pid, p.hid + 1000 as hid, p.year as syear, p.female as sex, c.c_nationkey as migback, p.personweight as phrf
from {_people} p join customer c on c.c_custkey = p.pid""")
    fragment(f"pkal{_of}", f"select pid, year as syear, any_r as kal1e01 from {_people} where any_r = 1")
fragment("hgen", "select distinct hid, year as syear, cast(hid % 10 as int) as hgrent from panel")
fragment("hpathl", "select hid, year as syear, sum(personweight) as hhrf from panel group by hid, year")
fragment("hbrutto", "select distinct hid, year as syear, cast(hid % 16 as int) as bula from panel where prio <> '5-LOW'")


def person_tables(spark, folder, people=panel):
    df = people(spark, folder)
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("migback"))
    pgen = df.select("pid", "hid", F.col("year").alias("syear"), F.col("employment_status").alias("pgemplst"),
                     F.col("gross_earnings").alias("pglabgro"))
    ppathl = df.join(customer, "pid").select(
        "pid", (F.col("hid") + 1000).alias("hid"), F.col("year").alias("syear"), F.col("female").alias("sex"),
        "migback", F.col("personweight").alias("phrf"))
    pkal = df.filter("any_r = 1").select("pid", F.col("year").alias("syear"), F.col("any_r").alias("kal1e01"))
    return pgen, ppathl, pkal


def household_tables(spark, folder):
    df = panel(spark, folder).select("hid", F.col("year").alias("syear"), "personweight", "prio")
    homes = df.select("hid", "syear").distinct()
    hgen = homes.withColumn("hgrent", (F.col("hid") % 10).cast("int"))
    hpathl = df.groupBy("hid", "syear").agg(F.sum("personweight").alias("hhrf"))
    # households that left no answer have no region row
    hbrutto = df.filter("prio <> '5-LOW'").select("hid", "syear").distinct().withColumn("bula", (F.col("hid") % 16).cast("int"))
    return hgen, hpathl, hbrutto


@query("join_person_left", """
select g.*, p.sex, p.migback, p.phrf, k.kal1e01
from pgen_whole g left join ppathl_whole p on p.pid = g.pid and p.syear = g.syear
            left join pkal_whole k on k.pid = g.pid and k.syear = g.syear""", "pglabgro:2 phrf")
def _(spark, folder):
    return op.join_person_left(*person_tables(spark, folder, panel_whole))


@query("join_household_left", """
select g.*, p.hhrf, b.bula from hgen g left join hpathl p on p.hid = g.hid and p.syear = g.syear
                                       left join hbrutto b on b.hid = g.hid and b.syear = g.syear""", "hhrf")
def _(spark, folder):
    return op.join_household_left(*household_tables(spark, folder))


@query("join_person_household", """
select g.*, b.bula from pgen g join hbrutto b on b.hid = g.hid and b.syear = g.syear""", "pglabgro:2")
def _(spark, folder):
    pgen, _, _ = person_tables(spark, folder)
    _, _, hbrutto = household_tables(spark, folder)
    return op.join_person_household(pgen, hbrutto)


@query("merge_extracts_outer", """
new as (select pid, year, case when prio = '5-LOW' then null else gross_earnings end as gross_earnings, hours, lfs
        from panel where year >= 1997),
old as (select pid, year, gross_earnings, hours + 100 as hours, education from panel where year <= 1998)
select coalesce(n.pid, o.pid) as pid, coalesce(n.year, o.year) as year,
       coalesce(n.gross_earnings, o.gross_earnings) as gross_earnings, coalesce(n.hours, o.hours) as hours,
       n.lfs, o.education
from new n full join old o on o.pid = n.pid and o.year = n.year""", "gross_earnings:2 hours")
def _(spark, folder):
    df = panel(spark, folder)
    new = df.filter("year >= 1997").select(
        "pid", "year", F.when(F.col("prio") != "5-LOW", F.col("gross_earnings")).alias("gross_earnings"), "hours", "lfs")
    old = df.filter("year <= 1998").select("pid", "year", "gross_earnings", (F.col("hours") + 100).alias("hours"),
                                           "education")
    return op.merge_extracts_outer(new, old)


@query("semi_observed_next", """
select pid, year, age from panel p where exists (select 1 from panel n where n.pid = p.pid and n.year = p.year + 1)""")
def _(spark, folder):
    return op.semi_observed_next(panel(spark, folder).select("pid", "year", "age"))


@query("anti_dropouts", """
select pid, year, age from panel p where year < (select max(year) from panel)
  and not exists (select 1 from panel n where n.pid = p.pid and n.year = p.year + 1)""")
def _(spark, folder):
    return op.anti_dropouts(panel(spark, folder).select("pid", "year", "age"))


PAIRED = ["pid", "year", "period_ahead"] + [f"{v}_{m}" for v in ("employment_status", "hours", "gross_earnings", "n_children")
                                            for m in ("real", "standard", "ext")]


# No rounding: the values are quotients of whole-number sums, equal to the last bit, while the engines round ties differently.
@query("pair_methods", f"select {', '.join(PAIRED)} from panel_ana")
def _(spark, folder):
    return analysis_frame(full(spark, folder)).select(*PAIRED)


fragment("linked", """
stays as (select pid, hid, count(*) as n from panel group by pid, hid),
usual as (select pid, hid as usual_hid from stays qualify row_number() over (partition by pid order by n desc, hid) = 1),
placed as (select p.*, u.usual_hid from panel p join usual u on u.pid = p.pid),
mothers as (select usual_hid, min(pid) as motherpid from placed where female = 1 and age between 18 and 49 group by usual_hid)
select p.pid, p.year, p.age, p.usual_hid, m.motherpid from placed p join mothers m on m.usual_hid = p.usual_hid
where p.child = 1""".replace("stays as", "with stays as", 1))


@query("link_mother_child", "select * from linked")
def _(spark, folder):
    return op.link_mother_child(panel(spark, folder)).select("pid", "year", "age", "usual_hid", "motherpid")


@query("flag_births_by_link", """
select p.pid, p.year, case when exists (select 1 from linked l where l.motherpid = p.pid and l.year - l.age = p.year)
                           then 1 else 0 end as birth from panel_up p""".replace("panel_up", """(
  select pid, cast(year - 10 as int) as year from panel)"""))
def _(spark, folder):
    # children of the fixture are born before the panel starts, so mothers are looked at ten years earlier
    df = panel(spark, folder)
    mothers = df.select("pid", (F.col("year") - 10).cast("int").alias("year"))
    return op.flag_births_by_link(mothers, op.link_mother_child(df))


@query("lookup_age_rate", """
select p.pid, p.year, p.age, r.rate from panel p left join rates r on r.age = p.age
where p.female = 1 and p.child = 0 and p.age between 15 and 49""", "rate:3")
def _(spark, folder):
    return op.lookup_age_rate(panel(spark, folder), rates(spark, folder)).select("pid", "year", "age", "rate")


fragment("conditional", """
with n as (select female, age, count(*) as n from panel_lags group by female, age),
k as (select female, age, employment_status as status_t, employment_status_t1 as status_t1, count(*) as k
      from panel_lags group by all),
states as (select unnest([0, 1, 2, 3]) as s),
grid as (select n.female, n.age, n.n, a.s as status_t, b.s as status_t1 from n, states a, states b),
joint as (select g.female, g.age, g.status_t1, g.status_t, g.n, coalesce(k.k, 0) / cast(g.n as double) as joint
          from grid g left join k on k.female = g.female and k.age = g.age and k.status_t = g.status_t
                                 and k.status_t1 = g.status_t1),
both_sides as (select *, sum(joint) over (partition by female, age, status_t) as p_t,
                    sum(joint) over (partition by female, age, status_t1) as p_t1 from joint)
select *, case when p_t1 = 0 then 0.0::double else joint / p_t1 end as cond from both_sides""")


@query("lookup_transition", """
wide as (select female, age, status_t1, sum(cond) filter (status_t = 0) as t0, sum(cond) filter (status_t = 1) as t1,
                sum(cond) filter (status_t = 2) as t2, sum(cond) filter (status_t = 3) as t3
         from conditional group by all)
select p.pid, p.year, coalesce(t0, 0.0::double) as t0, coalesce(t1, 0.0::double) as t1, coalesce(t2, 0.0::double) as t2,
       coalesce(t3, 0.0::double) as t3
from (select pid, year, female, age, employment_status from panel) p
left join wide w on w.female = p.female and w.age = p.age and w.status_t1 = p.employment_status""", "t0 t1 t2 t3")
def _(spark, folder):
    table_ = tr.transition_conditional(tr.transition_by_sex_age(lags(spark, folder)))
    df = panel(spark, folder).select("pid", "year", "female", "age", F.col("employment_status").alias("employment_status_t1"))
    return op.lookup_transition(df, table_).select("pid", "year", "t0", "t1", "t2", "t3")


fragment("singles", """
select pid, year, age, education, migback, east, n_children, female from panel_full
where in_couple = 0 and child = 0 and n_people - n_children = 1""")


@query("knn_candidates", """
men as (select * from singles where female = 0), women as (select * from singles where female = 1),
pairs as (select m.pid, m.year, w.pid as candidate,
                 (m.age - w.age) * (m.age - w.age) + (m.education - w.education) * (m.education - w.education)
                 + (m.migback - w.migback) * (m.migback - w.migback) + (m.east - w.east) * (m.east - w.east)
                 + (m.n_children - w.n_children) * (m.n_children - w.n_children) as d2
          from men m join women w on w.year = m.year)
select m.pid, m.year, cast(case when candidate is not null then row_number() over (partition by m.pid, m.year order by d2, candidate) end as int) as rank,
       candidate, sqrt(cast(d2 as double)) as distance
from men m left join pairs p on p.pid = m.pid and p.year = m.year
qualify row_number() over (partition by m.pid, m.year order by d2, candidate) <= 5""", "distance")
def _(spark, folder):
    singles = eligible_singles(full(spark, folder))
    return knn_candidates(spark, singles.filter("female = 0"), singles.filter("female = 1"))


FEATURE_LIST = ", ".join(FEATURES)


def _draw(event: str, seed: int = 2020, keys: str = "pid, year") -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', {keys}, '{event}', '{seed}')), 1, 8))::ubigint"
            " / 4294967296.0::double)")


def _round_sql(n: int, k: int = 5) -> str:
    """Round n of asks between the waiting m{n-1} and the free w{n-1}, person by person; p{n} are its pairs."""
    m, w, r = f"m{n - 1}", f"w{n - 1}", f"round{n}"
    d2 = " + ".join(f"(m.{f} - w.{f}) * (m.{f} - w.{f})" for f in FEATURES)
    rcell = ", ".join(f"r_{f}" for f in FEATURES)
    cell = f"year, {FEATURE_LIST}"
    same = " and ".join(f"l.{f} = a.{f}" for f in FEATURES)
    mine = " and ".join(f"o.{f} = a.r_{f}" for f in FEATURES)
    return f"""
mc{n} as (select {cell}, count(*) as n from {m} group by all), wc{n} as (select {cell}, count(*) as n from {w} group by all),
dist{n} as (select m.*, {", ".join(f"w.{f} as r_{f}" for f in FEATURES)}, w.n as r_n, {d2} as d2 from mc{n} m join wc{n} w on w.year = m.year),
list{n} as (select *, sum(r_n) over (partition by {cell} order by d2, {rcell} rows unbounded preceding) as upto from dist{n}),
place{n} as (select *, least(max(upto) over (partition by {cell}), n + {k}) as places from list{n}),
rank{n} as (select *, row_number() over (partition by {cell} order by {_draw("man")}, pid) - 1 as rank from {m}),
block{n} as (select r.*, rank // {k} as block, least({k}, places - {k} * (rank // {k})) as width
             from rank{n} r join (select distinct {cell}, places from place{n}) a using ({cell})),
spot{n} as (select *, block * {k} + (row_number() over (partition by {cell}, block order by {_draw(r + "-pick")}, pid) - 1
              + cast(floor({_draw(r + "-turn", keys=f"{cell}, block")} * width) as bigint)) % width as spot from block{n}),
asked{n} as (select a.year, a.pid as man, {rcell}, row_number() over (partition by a.year, {rcell} order by {_draw("man", keys="a.pid, a.year")}, a.pid) as place
             from spot{n} a join place{n} l on l.year = a.year and {same} and spot < upto and spot >= upto - r_n),
offered{n} as (select year, pid as woman, {FEATURE_LIST}, row_number() over (partition by {cell} order by {_draw("woman")}, pid) as place from {w}),
p{n} as materialized (select a.year, a.man, o.woman from asked{n} a join offered{n} o on o.year = a.year and o.place = a.place and {mine}),
m{n} as materialized (select * from {m} m where not exists (select 1 from p{n} p where p.year = m.year and p.man = m.pid)),
w{n} as materialized (select * from {w} w where not exists (select 1 from p{n} p where p.year = w.year and p.woman = w.pid))"""


# Rounds that find nobody waiting change nothing; the last column fails where somebody still waits.
ROUNDS = 10
fragment("couples", f"""
with men as (select * from singles where female = 0), w0 as materialized (select * from singles where female = 1),
sizes as (select year, cast(round_even(0.1::double * least(count(*) filter (female = 0), count(*) filter (female = 1)), 0) as bigint)
          as wanted from singles group by year),
m0 as materialized (select m.* from men m join sizes s on s.year = m.year
       qualify row_number() over (partition by m.year order by {_draw('chosen', keys='m.pid, m.year')}, m.pid) <= s.wanted),
{",".join(_round_sql(n) for n in range(1, ROUNDS + 1))}
{" union all ".join(f"select * from p{n}" for n in range(1, ROUNDS + 1))}
union all select year, pid, error('somebody waits') from m{ROUNDS}""")


@query("match_pairs", "select year, man, woman from couples")
def _(spark, folder):
    singles = eligible_singles(full(spark, folder))
    return match_pairs(spark, singles.filter("female = 0"), singles.filter("female = 1"))


@query("join_external_ratio", """
wide as (select cast(year(o_orderdate) as int) as year, count(*) filter (o_orderstatus = 'O') as o,
                count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'P') as p
         from orders group by 1),
own as (select year, avg(working) as mean_working, avg(lfs) as mean_lfs from panel group by year)
select w.year, o / cast(p as double) as lfs, f / cast(p as double) as working, mean_working, mean_lfs
from wide w join own on own.year = w.year""", "lfs working mean_working mean_lfs")
def _(spark, folder):
    series = (table(spark, folder, "orders")
              .groupBy(F.col("o_orderstatus").alias("series"), F.year("o_orderdate").cast("int").alias("year"))
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    own = panel(spark, folder).groupBy("year").agg(F.avg("working").alias("mean_working"), F.avg("lfs").alias("mean_lfs"))
    return op.join_external_ratio(series, {"lfs": "O", "working": "F"}, "P", own)
