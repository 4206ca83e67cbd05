"""Readers and writers: survey tables, the panel, rate tables, yearly series and run outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The survey tables and the columns that are kept of each.
SURVEY_COLUMNS = {
    "pgen": ["hid", "pid", "syear", "pglabgro", "pgemplst", "pglfs", "pgtatzeit", "pgerwzeit",
             "pgpsbil", "pgfamstd"],
    "ppathl": ["hid", "pid", "syear", "sex", "gebjahr", "migback", "phrf"],
    "pkal": ["pid", "syear", "kal1e01"],
    "hgen": ["hid", "syear", "hgheat", "hgrent", "hgtyp1hh"],
    "hpathl": ["hid", "syear", "hhrf"],
    "hbrutto": ["hid", "syear", "bula"],
}


def read_survey_tables(spark: SparkSession, folder: str,
                       columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The yearly survey tables, each cut to its needed columns at the scan."""
    columns = SURVEY_COLUMNS if columns is None else columns
    return {name: spark.read.parquet(f"{folder}/{name}").select(*kept) for name, kept in columns.items()}


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored panel without incomplete rows."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).na.drop("any")


def write_panel(panel: DataFrame, folder: str, ages: tuple[int, int] = (16, 65)) -> tuple[str, str]:
    """Store the complete rows, and a second copy for the working ages, partitioned by year.

    Files have about the session's advisory partition size: small years are one file each, a large one is split into
    as many as it fills.
    """
    complete = panel.na.drop("any")
    everyone, working_age = f"{folder}/merged", f"{folder}/workingage"
    by_size = lambda df: df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year")
    by_size(complete).parquet(everyone)
    by_size(panel.sparkSession.read.parquet(everyone).filter(F.col("age").between(*ages))).parquet(working_age)
    return everyone, working_age


def read_rate_csv(spark: SparkSession, path: str, cohort: str, sep: str = ";",
                  decimal: str = ",") -> DataFrame:
    """Age-specific rates from a statistical export, as (age, rate).

    The export has seven preamble lines, then a header with one column per cohort, ages such as
    "23 Jahre" and note rows at the end. Lines carry no order once a file is split, so the header
    is told by its `cohort` column and data rows by their leading age, not by position.
    """
    lines = spark.read.text(path).select(F.split("value", sep).alias("cells"))
    header = lines.filter(F.array_contains("cells", cohort)).select(
        F.min(F.array_position("cells", cohort)).alias("place")).scalar()
    age = F.regexp_extract(F.col("cells")[0], r"^\s*(\d+) Jahre\s*$", 1).try_cast("int")
    rate = F.replace(F.try_element_at("cells", header.cast("int")), F.lit(decimal), F.lit(".")).try_cast("double")
    return lines.select(age.alias("age"), rate.alias("rate")).filter(F.col("age").isNotNull())


def build_mortality_table(spark: SparkSession, men: str, women: str,
                          ages: tuple[int, int] = (0, 100)) -> DataFrame:
    """Death probabilities by age for men and women, from two exports `age;value`."""
    def one(path: str, name: str) -> DataFrame:
        raw = spark.read.schema("age string, value string").option("sep", ";").csv(path)
        return (raw.select(F.col("age").try_cast("int").alias("age"),
                           F.regexp_replace("value", ",", ".").try_cast("double").alias(name))
                   .filter(F.col("age").between(*ages)))
    return one(men, "men").join(one(women, "women"), "age", "left")


def read_external_series(spark: SparkSession, path: str, years: int = 33) -> DataFrame:
    """Long yearly series as (series, year, value), kept for the first `years` years."""
    raw = spark.read.schema("Series string, Time int, Value double").option("header", True).csv(path)
    series = raw.select(F.col("Series").alias("series"), F.col("Time").alias("year"),
                        F.col("Value").alias("value"))
    first = series.select(F.min("year")).scalar()
    return series.filter(F.col("year") < first + years)


def write_rates_csv(rates: DataFrame, path: str) -> str:
    rates.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_run_output(results: dict[str, DataFrame], folder: str, label: str) -> dict[str, str]:
    """Store each result of a run under the run's label."""
    paths = {name: f"{folder}/{label}/{name}" for name in results}
    for name, frame in results.items():
        frame.write.mode("overwrite").parquet(paths[name])
    return paths
