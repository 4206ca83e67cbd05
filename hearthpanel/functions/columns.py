"""Column helpers shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """0/1 integer flag; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def when_any(rules: Iterable[tuple[Column, object]], default=None) -> Column:
    """First matching rule wins; `default` when none does."""
    expr = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def seeded_uniform(keys: Iterable[str | Column], event: str, seed: int) -> Column:
    """Reproducible draw in [0, 1) from a row's own key.

    The draw depends on the key, the event and the seed only, so a lost task that is run
    again gives the same value and no shuffle or ordering is needed.
    """
    text = F.concat_ws("|", *[F.col(k) if isinstance(k, str) else k for k in keys],
                       F.lit(event), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def derived_household_id(pid: Column, year: Column) -> Column:
    """New household id that two persons or two years can never share."""
    return F.lit(1_000_000_000_000) + pid * 10_000 + year


def derived_person_id(mother: Column, year: Column) -> Column:
    """Id of the child born to `mother` in `year`."""
    return F.lit(3_000_000_000_000) + mother * 10_000 + year


def order_bucket(value: Column, per_unit: int = 4096) -> Column:
    """Integer that never falls as `value` grows.

    The grid is logarithmic (a relative width of about 1/`per_unit`), needs no statistics
    of the data and has at most 6 million cells over all doubles, so it can split a hot
    group into ordered parts without a first pass and always splits it the same way. The
    infinities have end cells of their own.
    """
    x = value.cast("double")
    top = 800 * per_unit  # log1p of the largest double is below 710
    finite = F.least(F.greatest(F.floor(F.signum(x) * F.log1p(F.abs(x)) * per_unit), F.lit(-top)), F.lit(top))
    return (F.when(x == float("inf"), top + 1).when(x == float("-inf"), -top - 1).otherwise(finite)).cast("int")
