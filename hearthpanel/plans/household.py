"""Queries of the household aggregates."""

from hearthpanel.operators import household as op
from hearthpanel.plans.frames import lags, panel
from hearthpanel.plans.registry import query

COLUMNS = ["pid", "year", "hid", "age", "female", "child", "working", "gross_earnings"]


def _people(spark, folder):
    return panel(spark, folder).select(*COLUMNS)


def _own(sql: str) -> str:
    return f"select {', '.join(COLUMNS)}, {sql} from panel_full"


@query("hh_income", _own("hh_income"), "hh_income:2")
def _(spark, folder):
    return op.hh_income(_people(spark, folder))


@query("hh_size", _own("n_people"))
def _(spark, folder):
    return op.hh_size(_people(spark, folder))


@query("hh_children", _own("n_children"))
def _(spark, folder):
    return op.hh_children(_people(spark, folder))


@query("hh_frac_working", _own("hh_frac_working"), "hh_frac_working")
def _(spark, folder):
    return op.hh_frac_working(_people(spark, folder))


@query("hh_youngest_age", _own("hh_youngest_age"))
def _(spark, folder):
    return op.hh_youngest_age(_people(spark, folder))


@query("hh_birth_flag", _own("birth"))
def _(spark, folder):
    return op.hh_birth_flag(_people(spark, folder))


@query("hh_vars", _own("hh_income, hh_youngest_age, n_people, n_children, hh_frac_working, birth"),
       "hh_income:2 hh_frac_working")
def _(spark, folder):
    return op.hh_vars(_people(spark, folder))


@query("hh_vars_lagged", """
select pid, year, hid, sum(gross_earnings_t1) over h as hh_income, min(age) over h as hh_youngest_age,
       cast(count(*) over h as int) as n_people, cast(sum(child) over h as int) as n_children,
       case when count(*) over h = sum(child) over h then 0.0::double
            else least(cast(sum(working_t1) over h as double) / cast(count(*) over h - sum(child) over h as double), 1.0)
       end as hh_frac_working
from panel_lags window h as (partition by year, hid)""", "hh_income:2 hh_frac_working")
def _(spark, folder):
    df = lags(spark, folder).select("pid", "year", "hid", "age", "child", "gross_earnings_t1", "working_t1")
    return op.hh_vars_lagged(df).drop("age", "child", "gross_earnings_t1", "working_t1")
