"""Queries of row concatenation, distinct rows and output order."""

from pyspark.sql import functions as F

from hearthpanel.operators import sets as op
from hearthpanel.plans.frames import panel
from hearthpanel.plans.registry import query


@query("union_rows", """
select pid, year, age, cast(null as double) as hours from panel where year <= 1998
union all select pid, year, null, hours from panel where year >= 1997""", "hours")
def _(spark, folder):
    df = panel(spark, folder)
    return op.union_rows(df.filter("year <= 1998").select("pid", "year", "age"),
                         df.filter("year >= 1997").select("pid", "year", "hours"))


@query("distinct_rows", "select distinct pid, cast(year - age as int) as birthyear from panel")
def _(spark, folder):
    df = panel(spark, folder).withColumn("birthyear", (F.col("year") - F.col("age")).cast("int"))
    return op.distinct_rows(df, "pid", "birthyear")


@query("sort_panel", "select pid, year, age from panel order by pid, year")
def _(spark, folder):
    return op.sort_panel(panel(spark, folder).select("pid", "year", "age"))


@query("sort_panel_order", "select count(*) as n, cast(0 as bigint) as inversions from panel")
def _(spark, folder):
    return op.order_check(op.sort_panel(panel(spark, folder).select("pid", "year", "age")))
