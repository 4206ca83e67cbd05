"""Queries of the projection, recoding, cleaning and filter operators."""

from pyspark.sql import functions as F

from hearthpanel.operators import recode as op
from hearthpanel.plans.frames import full, panel, panel_whole
from hearthpanel.plans.registry import fragment, query

# The panel carries English order labels where the survey has its own; the operators take the labels
# as arguments.
PRIORITY_CODES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 6}
NULLABLE_SEGMENT = "case when prio = '5-LOW' then null else segment end"

MIXED_SQL = f"""
select pid, year, employment_status, lfs, hours, {NULLABLE_SEGMENT} as segment,
       case when n_orders = 1 then prio else cast(gross_earnings as varchar) end as earned,
       case when n_orders = 1 then null else gross_earnings end as number
from """
fragment("mixed", MIXED_SQL + "panel")
fragment("mixed_whole", MIXED_SQL + "panel_whole")


def mixed(spark, folder, people=panel):
    """Panel with a mixed text and number column, and with a label that is missing at times."""
    text = F.when(F.col("n_orders") == 1, F.col("prio")).otherwise(F.col("gross_earnings").cast("string"))
    return people(spark, folder).select(
        "pid", "year", "employment_status", "lfs", "hours",
        F.when(F.col("prio") != "5-LOW", F.col("segment")).alias("segment"), text.alias("earned"),
        F.when(F.col("n_orders") != 1, F.col("gross_earnings")).alias("number"))


@query("rename_columns", "select pid, year as syear, gross_earnings as pglabgro, hours as pgtatzeit from panel")
def _(spark, folder):
    names = {"year": "syear", "gross_earnings": "pglabgro", "hours": "pgtatzeit"}
    return op.rename_columns(panel(spark, folder).select("pid", *names), names)


@query("keep_columns", "select pid, year, hid, age, female, employment_status from panel")
def _(spark, folder):
    return op.keep_columns(panel(spark, folder), ["pid", "year", "hid", "age", "female", "employment_status"])


@query("drop_if_present", """
select pid, year, age, female, east, child, working, fulltime, retired, lfs, education from panel""")
def _(spark, folder):
    return op.drop_if_present(panel(spark, folder), [
        "hid", "personweight", "segment", "prio", "any_r", "n_orders", "employment_status", "in_couple",
        "married", "gross_earnings", "hours", "emplstatus", "married_h"])


@query("placeholder_columns", """
select pid, year, hid, hid as orighid, cast(0 as bigint) as motherpid, 99 as age_max from panel""")
def _(spark, folder):
    return op.placeholder_columns(panel(spark, folder).select("pid", "year", "hid"))


@query("derive_age_child", """
select pid, year, gebjahr, year - gebjahr as age, case when year - gebjahr < 18 then 1 else 0 end as child
from (select pid, year, cast(year - age as int) as gebjahr from panel)""")
def _(spark, folder):
    base = panel(spark, folder).select("pid", "year", (F.col("year") - F.col("age")).cast("int").alias("gebjahr"))
    return op.derive_age_child(base)


@query("recode_codes", """
select pid, year, prio, case prio when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2
                                  when '5-LOW' then 6 else 0 end as code from panel_whole""")
def _(spark, folder):
    return op.recode_codes(panel_whole(spark, folder).select("pid", "year", "prio"), "prio", PRIORITY_CODES, 0, "code")


@query("recode_sex", """
select pid, year, segment, case segment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 end as female from panel""")
def _(spark, folder):
    return op.recode_sex(panel(spark, folder).select("pid", "year", "segment"), "segment",
                         {"AUTOMOBILE": 0, "BUILDING": 1})


@query("recode_last_write_wins", """
select pid, year, case when prio = '1-URGENT' then 3 when prio in ('2-HIGH', '3-MEDIUM') then 2
                       when any_r = 1 then 1 when segment = 'MACHINERY' then 1
                       when prio = '5-LOW' then 0 when age < 19 then 0 end as status from panel""")
def _(spark, folder):
    df = panel(spark, folder)
    rules = [(F.col("age") < 19, 0), (F.col("prio") == "5-LOW", 0), (F.col("segment") == "MACHINERY", 1),
             (F.col("any_r") == 1, 1), (F.col("prio").isin("2-HIGH", "3-MEDIUM"), 2),
             (F.col("prio") == "1-URGENT", 3)]
    return op.recode_last_write_wins(df, rules, "status").select("pid", "year", "status")


@query("recode_status_legacy", """
select pid, year, employment_status, case when employment_status = 3 then 1 else 0 end as fulltime
from (select pid, year, case segment when 'AUTOMOBILE' then 2 when 'BUILDING' then 3 when 'MACHINERY' then 1
                                     else 0 end as employment_status from panel)""")
def _(spark, folder):
    df = panel(spark, folder).select("pid", "year", F.col("segment").alias("employment_status"))
    return op.recode_status_legacy(df, codes={"AUTOMOBILE": 2, "BUILDING": 3, "MACHINERY": 1, "FURNITURE": 0})


@query("recode_in_set", """
select pid, year, case when segment in ('BUILDING', 'FURNITURE') then 1 else 0 end as married from mixed""")
def _(spark, folder):
    return op.recode_in_set(mixed(spark, folder), "segment", ["BUILDING", "FURNITURE"], "married").select(
        "pid", "year", "married")


@query("recode_in_set_nullable", """
select pid, year, case when segment = 'BUILDING' then 1 when segment = 'HOUSEHOLD' then null else 0 end as east
from mixed""")
def _(spark, folder):
    return op.recode_in_set_nullable(mixed(spark, folder), "segment", ["BUILDING"], ["HOUSEHOLD"], "east").select(
        "pid", "year", "east")


@query("recode_migration", """
select pid, year, case when segment <> 'BUILDING' then 1 else 0 end as migback from mixed""")
def _(spark, folder):
    return op.recode_migration(mixed(spark, folder), "segment", "BUILDING").select("pid", "year", "migback")


@query("flag_labour_force", """
select pid, year, case when prio in ('1-URGENT', '2-HIGH') then 1 else 0 end as lfs from panel""")
def _(spark, folder):
    return op.flag_labour_force(panel(spark, folder), "prio", ["1-URGENT", "2-HIGH"]).select("pid", "year", "lfs")


@query("flag_working", """
select pid, year, case when employment_status in (0, 1) then 0 when lfs = 1 and hours > 0 then 1 else 0 end as working,
       case when employment_status = 2 then 1 else 0 end as parttime,
       case when employment_status = 3 then 1 else 0 end as fulltime from panel""")
def _(spark, folder):
    return op.flag_working(panel(spark, folder)).select("pid", "year", "working", "parttime", "fulltime")


@query("flag_working_legacy", """
select pid, year, case when employment_status in (2, 3) then 1 else 0 end as working from panel""")
def _(spark, folder):
    return op.flag_working_legacy(panel(spark, folder)).select("pid", "year", "working")


@query("numeric_or_null", "select pid, year, try_cast(earned as double) as earned from mixed")
def _(spark, folder):
    return op.numeric_or_null(mixed(spark, folder), "earned").select("pid", "year", "earned")


@query("fill_zero_when_inactive", """
select pid, year, case when number is null and employment_status in (0, 1) and lfs = 0 then 0.0 else number end::double
       as number from mixed_whole""")
def _(spark, folder):
    return op.fill_zero_when_inactive(mixed(spark, folder, panel_whole), "number").select("pid", "year", "number")


@query("fill_default_label", """
select pid, year, case coalesce(segment, 'BUILDING') when 'BUILDING' then 0 when 'MACHINERY' then 1 end as label
from mixed""")
def _(spark, folder):
    return op.fill_default_label(mixed(spark, folder), "segment", "BUILDING", {"BUILDING": 0, "MACHINERY": 1},
                                 "label").select("pid", "year", "label")


@query("status_from_flags", "select pid, year, employment_status from panel")
def _(spark, folder):
    return op.status_from_flags(panel(spark, folder).drop("employment_status")).select("pid", "year", "employment_status")


@query("flags_from_status", """
select pid, year, case when employment_status >= 2 then 1 else 0 end as working,
       case when employment_status = 1 then 1 else 0 end as retired,
       case when employment_status = 3 then 1 else 0 end as fulltime from panel_whole""")
def _(spark, folder):
    return op.flags_from_status(panel_whole(spark, folder).drop("working", "retired", "fulltime")).select(
        "pid", "year", "working", "retired", "fulltime")


@query("filter_age_range", "select pid, year, age from panel where age between 16 and 65")
def _(spark, folder):
    return op.filter_age_range(panel(spark, folder).select("pid", "year", "age"), 16, 65)


@query("drop_incomplete", "select * from mixed where segment is not null and number is not null")
def _(spark, folder):
    return op.drop_incomplete(mixed(spark, folder))


MIXED = {"pid": "bigint", "year": "int", "employment_status": "int", "lfs": "int", "hours": "double", "segment": "string", "earned": "string", "number": "double"}


@query("null_profile", " union all ".join(f"""
select '{c}' as "column", '{t}' as type, avg(cast({c} is null as int)) as null_share, count(*) as n_rows, {len(MIXED)} as n_columns from mixed"""
                                          for c, t in MIXED.items()), "null_share")
def _(spark, folder):
    return op.null_profile(mixed(spark, folder))


@query("clip_values", """
select pid, year, case when x < 0 then 0.0 else x end as x, case when hours > 30 then 30.0 else hours end as hours
from (select pid, year, personweight - 3 as x, hours from panel)""", "x hours")
def _(spark, folder):
    df = panel(spark, folder).select("pid", "year", (F.col("personweight") - 3).alias("x"), "hours")
    return op.clip_values(df, {"x": (0.0, None), "hours": (0.0, 30.0)})


@query("domain_guard", """
select pid, year, case when n_orders in (0, 1, 2, 3) then n_orders else 0 end as n_orders from panel""")
def _(spark, folder):
    return op.domain_guard(panel(spark, folder).select("pid", "year", "n_orders"), "n_orders")


@query("age_squared", "select pid, year, age, cast(age as bigint) * age as age_squared from panel")
def _(spark, folder):
    return op.age_squared(panel(spark, folder).select("pid", "year", "age"))


@query("interact_with", """
select pid, year, female, age, n_children, hh_income, age * female as age_interacted,
       n_children * female as n_children_interacted, hh_income * female as hh_income_interacted from panel_full""",
       "hh_income:2 hh_income_interacted:2")
def _(spark, folder):
    df = full(spark, folder).select("pid", "year", "female", "age", "n_children", "hh_income")
    return op.interact_with(df, "female", ("pid", "year"))
