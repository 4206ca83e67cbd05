"""The three stages of the study as compositions of the operators.

survey tables -> panel, panel -> lagged panel (see `longitudinal.lagged_panel`), and one year of
imputation for persons who drop out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators import events, household, joins, longitudinal, models, recode, scoring

DROPPED = ["tenure", "heizkosten", "bruttokaltmiete"]


def join_survey(tables: dict[str, DataFrame]) -> DataFrame:
    """Person tables and household tables side by side; persons without a household row are left out."""
    persons = joins.join_person_left(tables["pgen"], tables["ppathl"], tables["pkal"])
    homes = joins.join_household_left(tables["hgen"], tables["hpathl"], tables["hbrutto"])
    return joins.join_person_household(persons, homes)


def harmonise_survey(raw: DataFrame) -> DataFrame:
    """Joined survey rows with code names and labels to panel columns."""
    df = recode.rename_columns(raw)
    df = recode.derive_age_child(recode.placeholder_columns(df))
    df = recode.recode_codes(df, "education", recode.EDUCATION_CODES)
    df = recode.recode_last_write_wins(df, recode.survey_status_rules(), "_status")
    df = df.drop("employment_status").withColumnRenamed("_status", "employment_status")
    df = recode.recode_sex(recode.recode_migration(df))
    df = recode.recode_in_set(df, "married2", recode.MARRIED, "married")
    df = recode.recode_in_set_nullable(df, "bula", recode.EAST, recode.NOT_APPLICABLE, "east")
    df = recode.recode_in_set(df, "hgtyp1hh", recode.COUPLE, "in_couple")
    df = recode.flag_labour_force(df)
    df = recode.numeric_or_null(df, "gross_earnings", "hours", "bruttokaltmiete", "heizkosten")
    df = recode.fill_zero_when_inactive(df, "gross_earnings", "hours")
    df = household.hh_vars(recode.flag_working(df))
    return recode.keep_columns(df)


def harmonise_legacy(raw: DataFrame) -> DataFrame:
    """The older extract, which already has ages, flags and some study names."""
    names = {k: v for k, v in recode.STUDY_NAMES.items() if k in ("syear", "phrf", "pglabgro", "hhrf", "hgheat", "pgpsbil")}
    df = recode.drop_if_present(raw, ["emplstatus", "married_h"])
    df = recode.rename_columns(df, names | {"kaltmiete": "bruttokaltmiete", "kind": "child", "whours_actual": "hours",
                                            "pglfs": "lfs"})
    df = recode.placeholder_columns(df)
    df = recode.recode_codes(df, "education", recode.EDUCATION_CODES)
    df = recode.recode_status_legacy(df)
    df = recode.flag_working_legacy(recode.flag_labour_force(df))
    df = recode.fill_zero_when_inactive(recode.numeric_or_null(df, "hours"), "hours")
    return household.hh_vars(recode.recode_migration(df))


def finish_panel(new: DataFrame, old: DataFrame) -> DataFrame:
    """Both extracts in one panel: the new one first, births and flags derived again, ages below 99."""
    newer = recode.drop_if_present(new, DROPPED)
    kept = [c for c in newer.columns if c != "birth"]
    merged = joins.merge_extracts_outer(newer, old).select(*kept)
    pension = recode.fill_default_label(merged, "retired")
    flagged = recode.filter_age_range(household.hh_birth_flag(pension), high=98)
    return recode.drop_incomplete(recode.flags_from_status(flagged))


def _one_year(spark: SparkSession, df: DataFrame, births: Callable[[DataFrame], DataFrame], work: Callable[[DataFrame], DataFrame],
              seed: int) -> DataFrame:
    df = events.leave_home(longitudinal.roll_state(df))
    df = events.mark_separations(events.remove_age_out(df), seed).drop("separated")
    df = events.mark_marriages(df, seed).drop("wed")
    df = events.form_couples(spark, df, seed=seed)
    return work(events.add_newborn_rows(births(df), seed))


def project_year(spark: SparkSession, df: DataFrame, coefficients: dict[str, dict[str, float]], birth: Column,
                 seed: int = events.SEED) -> DataFrame:
    """One year on for the given persons: age, move out, family events, then the work cascade of a coefficient table."""
    return _one_year(spark, df, lambda d: events.flag_births_scored(d, birth), lambda d: scoring.score_cascade(d, coefficients), seed)


def project_year_fitted(spark: SparkSession, df: DataFrame, bundle: models.Bundle, seed: int = events.SEED) -> DataFrame:
    """The same with the fitted models: births by theirs, then the fitted cascade."""
    births = lambda d: events.flag_births_scored(models.fitted(bundle, "birth", d, "_birth"), F.col("_birth")).drop("_birth")
    return _one_year(spark, df, births, lambda d: models.cascade(bundle, d), seed)


def impute_dropouts(spark: SparkSession, panel: DataFrame, coefficients: dict[str, dict[str, float]], birth: Column,
                    seed: int = events.SEED) -> DataFrame:
    """The panel plus, for everyone absent in the next year, a projected row of that year.

    All years are handled at once; observed rows win where a person is back.
    """
    return events.complete_panel(panel, project_year(spark, joins.anti_dropouts(panel), coefficients, birth, seed))


def impute_dropouts_fitted(spark: SparkSession, panel: DataFrame, bundle: models.Bundle, seed: int = events.SEED) -> DataFrame:
    """`impute_dropouts` with the fitted models."""
    return events.complete_panel(panel, project_year_fitted(spark, joins.anti_dropouts(panel), bundle, seed))
