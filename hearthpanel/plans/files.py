"""Queries of the readers and writers: files are written from the tables and read back."""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.plans.frames import panel, rates
from hearthpanel.plans.joins import household_tables, person_tables
from hearthpanel.plans.recode import mixed
from hearthpanel.plans.registry import query
from hearthpanel.session import shared_folder
from hearthpanel.sources import files as op
from hearthpanel.sources.tables import table


def _place(spark) -> str:
    return f"{shared_folder(spark)}/files/{uuid4().hex}"


# The columns that the order tables can give of each survey table, and the key that is summed up.
SURVEY = {"pgen": ["pid", "hid", "syear", "pglabgro", "pgemplst"], "ppathl": ["pid", "hid", "syear", "sex", "migback", "phrf"],
          "pkal": ["pid", "syear", "kal1e01"], "hgen": ["hid", "syear", "hgrent"], "hpathl": ["hid", "syear", "hhrf"],
          "hbrutto": ["hid", "syear", "bula"]}


@query("read_survey_tables", " union all ".join(
    f"select '{name}' as name, count(*) as n, cast(sum({kept[0]}) as bigint) as checksum, cast(sum(syear) as bigint) as years, {len(kept)} as n_columns from {name}"
    for name, kept in SURVEY.items()))
def _(spark, folder):
    place = _place(spark)
    for name, df in zip(SURVEY, (*person_tables(spark, folder), *household_tables(spark, folder))):
        df.withColumn("unused", F.lit(1)).write.parquet(f"{place}/{name}")
    tables = op.read_survey_tables(spark, place, SURVEY)
    return reduce(DataFrame.unionByName, [tables[name].agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(kept[0]).alias("checksum"), F.sum("syear").cast("bigint").alias("years"),
        F.lit(len(tables[name].columns)).alias("n_columns")) for name, kept in SURVEY.items()])


@query("read_panel", "select * from mixed where segment is not null and number is not null")
def _(spark, folder):
    path = f"{_place(spark)}/panel"
    df = mixed(spark, folder)
    df.write.parquet(path)
    return op.read_panel(spark, path, df.schema)


@query("read_rate_csv", "select age, rate from rates", "rate:3")
def _(spark, folder):
    """An export with seven lines before the header, one column per cohort, decimal commas and note rows."""
    path = f"{_place(spark)}/fertility"
    data = rates(spark, folder).select(F.concat_ws(
        ";", F.concat(F.col("age"), F.lit(" Jahre")), F.lit("1,5"), F.regexp_replace(F.col("rate").cast("string"), r"\.", ",")).alias("value"))
    frame = spark.createDataFrame([(line,) for line in (
        "Table;;", "Rates by cohort", "", "All regions", "Age of the mother", "Cohort", "", ";1967;1968", "____", "Notes: none")], "value string")
    frame.unionByName(data).write.text(path)
    return op.read_rate_csv(spark, path, "1968")


@query("build_mortality_table", """
select p_size as age, round(avg(p_retailprice) / 1000, 5) as men, round(max(p_retailprice) / 1000, 5) as women
from part where p_size between 1 and 40 group by p_size""", "men:5 women:5")
def _(spark, folder):
    place = _place(spark)
    by_age = table(spark, folder, "part").groupBy("p_size")
    for name, value in (("men", F.avg("p_retailprice")), ("women", F.max("p_retailprice"))):
        text = F.regexp_replace(F.round(value / 1000, 5).cast("string"), r"\.", ",")
        by_age.agg(text.alias("v")).select(F.col("p_size").cast("string").alias("age"), "v").unionByName(
            spark.createDataFrame([("Alter", "qx")], "age string, v string")).write.option("sep", ";").csv(f"{place}/{name}")
    return op.build_mortality_table(spark, f"{place}/men", f"{place}/women", (1, 40))


@query("read_external_series", """
select o_orderstatus as series, cast(year(o_orderdate) as int) as year, cast(count(*) as double) as value
from orders where year(o_orderdate) < (select min(year(o_orderdate)) from orders) + 4 group by 1, 2""")
def _(spark, folder):
    path = f"{_place(spark)}/series"
    (table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("Series"), F.year("o_orderdate").alias("Time"))
     .agg(F.count(F.lit(1)).alias("Value")).write.option("header", True).csv(path))
    return op.read_external_series(spark, path, 4)


@query("write_panel", """
select 'merged' as name, year, count(*) as n from mixed where segment is not null and number is not null group by year
union all select 'workingage', m.year, count(*) from mixed m join panel p using (pid, year)
where m.segment is not null and number is not null and age between 16 and 65 group by m.year""")
def _(spark, folder):
    df = mixed(spark, folder).join(panel(spark, folder).select("pid", "year", "age"), ["pid", "year"])
    everyone, working = op.write_panel(df, _place(spark))
    size = lambda path, name: spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
    return size(everyone, "merged").unionByName(size(working, "workingage"))


@query("write_rates_csv", "select age, rate from rates", "rate:3")
def _(spark, folder):
    path = op.write_rates_csv(rates(spark, folder), f"{_place(spark)}/rates")
    return spark.read.schema("age int, rate double").option("header", True).csv(path)


@query("write_run_output", "select year, count(*) as size from panel group by year")
def _(spark, folder):
    sizes = panel(spark, folder).groupBy("year").agg(F.count(F.lit(1)).alias("size"))
    return spark.read.parquet(op.write_run_output({"sizes": sizes}, _place(spark), "week1")["sizes"])
