"""Scoring person-years with coefficient tables; one projection, no split and no union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag
from hearthpanel.operators.joins import lookup_transition
from hearthpanel.operators.recode import clip_values, domain_guard, flags_from_status, status_from_flags
from hearthpanel.operators.transitions import blend_probabilities, draw_status

HOURS_CAP = 80.0


def linear_score(terms: dict[str, float]) -> Column:
    """Intercept plus the sum of coefficient times column; products such as "age*age" are allowed."""
    def term(name: str) -> Column:
        return reduce(lambda a, b: a * b, [F.col(part).cast("double") for part in name.split("*")])
    parts = [F.lit(float(b)) * term(n) for n, b in terms.items() if n != "intercept"]
    return reduce(lambda a, b: a + b, parts, F.lit(float(terms.get("intercept", 0.0))))


def logit_probability(terms: dict[str, float]) -> Column:
    return 1 / (1 + F.exp(-linear_score(terms)))


def score_binary(df: DataFrame, terms: dict[str, float], out: str) -> DataFrame:
    """1 when the probability exceeds one half."""
    p = logit_probability(terms)
    return df.withColumns({f"{out}_probability": p, out: flag(p > 0.5)})


def score_regression(df: DataFrame, terms: dict[str, float], out: str, mean: float = 0.0, std: float = 1.0,
                     cap: float | None = None) -> DataFrame:
    """Prediction back on the target's scale, at least 0 and at most `cap`."""
    return clip_values(df.withColumn(out, linear_score(terms) * std + mean), {out: (0.0, cap)})


def score_cascade(df: DataFrame, models: dict[str, dict[str, float]]) -> DataFrame:
    """Retired, then working if not retired, then full-time if working, then hours and earnings.

    A person the step does not apply to gets 0. The status follows from the flags.
    """
    def given(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.lit(0))

    out = df.withColumn("retired", flag(logit_probability(models["retired"]) > 0.5))
    out = out.withColumn("working", given(F.col("retired") == 0, flag(logit_probability(models["working"]) > 0.5)))
    out = out.withColumn("fulltime", given(F.col("working") == 1, flag(logit_probability(models["fulltime"]) > 0.5)))
    out = status_from_flags(out)
    works = F.col("working") == 1
    hours = F.least(F.greatest(linear_score(models["hours"]), F.lit(0.0)), F.lit(HOURS_CAP))
    out = out.withColumn("hours", F.when(works, hours).otherwise(0.0))
    earnings = F.greatest(linear_score(models["gross_earnings"]), F.lit(0.0))
    return out.withColumn("gross_earnings", F.when(works, earnings).otherwise(0.0))


def score_status_blend(df: DataFrame, conditional: DataFrame, share: float = 0.25, seed: int = 2020) -> DataFrame:
    """Status drawn from model probabilities p0..p3 blended with the transition table."""
    blended = blend_probabilities(lookup_transition(df, conditional), share)
    drawn = draw_status(blended, seed, out="employment_status")
    return flags_from_status(domain_guard(drawn))
