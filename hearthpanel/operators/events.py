"""One-period population events as table transforms.

Each works on all person-years at once. Draws depend on (pid, year, event, seed), so a row's fate
does not depend on order, partitioning or a repeated task, and no event but pairing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.columns import (derived_household_id, derived_person_id, flag,
                                           seeded_uniform)
from hearthpanel.operators.joins import possible_mother, rate_by_age
from hearthpanel.operators.matching import FEATURES, eligible_singles, match_pairs

SEED = 2020

# Columns of a newborn that start at zero.
NEWBORN_ZERO = ["age", "gross_earnings", "in_couple", "married", "hours", "education",
                "employment_status", "fulltime", "retired", "working", "birth"]


def remove_age_out(df: DataFrame) -> DataFrame:
    """Drop persons at or above their maximum age; an unknown age stays."""
    return df.filter(~F.coalesce(F.col("age") >= F.col("age_max"), F.lit(False)))


def count_age_out(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.sum(flag(F.col("age") >= F.col("age_max"))).alias("deaths"))


def mark_separations(df: DataFrame, seed: int = SEED, married_rate: float = 0.01,
                     couple_rate: float = 0.02, by: str = "pid") -> DataFrame:
    """Couples that part: both flags cleared, and the man moves to a household of his own.

    Draws are per person; by="hid" draws once per household so that partners part together.
    """
    u = seeded_uniform([by, "year"], "separation", seed)
    parts = (((F.col("married") == 1) & (u < married_rate))
             | ((F.col("in_couple") == 1) & (F.col("married") == 0) & (u < couple_rate)))
    leaves = parts & (F.col("female") == 0)
    return df.withColumns({
        "separated": flag(parts),
        "married": F.when(parts, 0).otherwise(F.col("married")),
        "in_couple": F.when(parts, 0).otherwise(F.col("in_couple")),
        "orighid": F.when(leaves, F.col("hid")).otherwise(F.col("orighid")),
        "hid": F.when(leaves, derived_household_id(F.col("pid"), F.col("year"))).otherwise(F.col("hid"))})


def mark_marriages(df: DataFrame, seed: int = SEED, rate: float = 0.10) -> DataFrame:
    u = seeded_uniform(["pid", "year"], "marriage", seed)
    weds = (F.col("married") == 0) & (F.col("in_couple") == 1) & (u < rate)
    return df.withColumns({"wed": flag(weds), "married": F.when(weds, 1).otherwise(F.col("married"))})


def leave_home(df: DataFrame) -> DataFrame:
    """At exactly 18 a person moves out, is no child any more, and has one child less to count."""
    grown = F.col("age") == 18
    return df.withColumns({
        "n_children": F.when(grown, F.col("n_children") - 1).otherwise(F.col("n_children")),
        "hid": F.when(grown, derived_household_id(F.col("pid"), F.col("year"))).otherwise(F.col("hid")),
        "child": F.when(grown, 0).otherwise(F.col("child"))})


def flag_births(df: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """All rows, with birth = 1 for women of 15 to 49 who are no children and whose draw is below their rate."""
    u = seeded_uniform(["pid", "year"], "birth", seed)
    with_rate = df.drop("birth").join(rate_by_age(rates, "_rate"), "age", "left")
    born = with_rate.withColumn("birth", flag(possible_mother() & (u < F.col("_rate") / 1000)))
    return born.select(*[c for c in df.columns if c != "birth"], "birth")


def flag_births_scored(df: DataFrame, probability: Column) -> DataFrame:
    """The model version: birth = 1 for possible mothers whose score exceeds one half."""
    return df.withColumn("birth", flag(possible_mother() & (probability > 0.5)))


def newborn_rows(df: DataFrame, seed: int = SEED) -> DataFrame:
    """One child per birth, in the mother's household, with an id derived from hers."""
    types = dict(df.dtypes)
    girl = flag(seeded_uniform(["pid", "year"], "sex", seed) >= 0.5)
    changes = {c: F.lit(0).cast(types[c]) for c in NEWBORN_ZERO if c in types}
    changes |= {"child": F.lit(1), "female": girl, "predicted": F.lit(1),
                "pid": derived_person_id(F.col("pid"), F.col("year"))}
    if "motherpid" in types:
        changes["motherpid"] = F.col("pid")
    return df.filter(F.col("birth") == 1).withColumns(changes).select(*df.columns)


def add_newborn_rows(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.unionByName(newborn_rows(df, seed))


def form_couples(spark: SparkSession, df: DataFrame, share: float = 0.10, k: int = 5, seed: int = SEED,
                 features: list[str] = FEATURES) -> DataFrame:
    """Single men and women find each other; the man takes over the woman's household and region."""
    singles = eligible_singles(df)
    pairs = match_pairs(spark, singles.filter("female = 0"), singles.filter("female = 1"), share, k,
                        seed, features)
    homes = pairs.join(df.select("year", F.col("pid").alias("woman"), "hid", "east", "hhweight"),
                       ["year", "woman"])
    news = (homes.select("year", F.col("man").alias("pid"), F.struct("hid", "east", "hhweight").alias("_home"))
            .unionByName(pairs.select("year", F.col("woman").alias("pid"),
                                      F.lit(None).cast("struct<hid:bigint,east:int,hhweight:double>").alias("_home"))))
    joined = df.join(news.withColumn("_paired", F.lit(1)), ["year", "pid"], "left")
    moved = {c: F.coalesce(F.col("_home")[c], F.col(c)) for c in ("hid", "east", "hhweight")}
    moved["in_couple"] = F.when(F.col("_paired") == 1, 1).otherwise(F.col("in_couple"))
    return joined.withColumns(moved).select(*df.columns)


def complete_panel(real: DataFrame, projected: DataFrame) -> DataFrame:
    """Real rows plus projected rows of persons who are not observed in that year."""
    missing = projected.join(real.select("pid", "year"), ["pid", "year"], "left_anti")
    flagged = real if "predicted" in real.columns else real.withColumn("predicted", F.lit(0))
    return flagged.unionByName(missing.withColumn("predicted", F.lit(1)), allowMissingColumns=True)


def event_counts(df: DataFrame, events: list[str]) -> DataFrame:
    """Yearly number of rows with each event flag set."""
    return df.groupBy("year").agg(*[F.sum(e).cast("bigint").alias(e) for e in events])
