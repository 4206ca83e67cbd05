"""Projection, recoding, cleaning and filters of the survey columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.functions.columns import flag, when_any

# Survey code names and the study's names for them.
STUDY_NAMES = {
    "syear": "year", "phrf": "personweight", "pglabgro": "gross_earnings", "hhrf": "hhweight",
    "hgheat": "heizkosten", "hgrent": "bruttokaltmiete", "pgpsbil": "education",
    "pld0131": "married1", "pgtatzeit": "hours", "loc1989": "east1",
    "pgemplst": "employment_status", "pgfamstd": "married2", "pglfs": "lfs",
    "pgerwzeit": "tenure", "kal1e01": "retired",
}

# The columns of a finished panel.
PANEL_COLUMNS = [
    "year", "pid", "hid", "personweight", "age", "gross_earnings", "hhweight", "heizkosten",
    "bruttokaltmiete", "female", "east", "married", "child", "in_couple", "hours", "orighid",
    "motherpid", "age_max", "education", "employment_status", "fulltime", "lfs", "working",
    "tenure", "migback", "hh_income", "hh_youngest_age", "n_people", "n_children",
    "hh_frac_working", "birth", "retired",
]

# Survey labels.
EDUCATION_CODES = {
    "[1] Hauptschulabschluss": 0, "[2] Realschulabschluss": 1, "[3] Fachhochschulreife": 2,
    "[4] Abitur": 3, "[5] Anderer Abschluss": 4, "[6] Ohne Abschluss verlassen": 5,
    "[7] Noch kein Abschluss": 6,
}
SEX_CODES = {"[1] maennlich": 0, "[2] weiblich": 1}
NOT_EMPLOYED = "[5] Nicht erwerbstaetig"
OLDER_THAN_65 = "[2] NW-age 65 and older"
YES, NO = "[1] Ja", "[2] Nein"
PART_TIME = ["[2] Teilzeitbeschaeftigung", "[3] Ausbildung, Lehre",
             "[4] Unregelmaessig,geringfuegig erwerbstaet."]
FULL_TIME = "[1] Voll erwerbstaetig"
LEGACY_STATUS_CODES = {"Teilzeit": 2, "Vollzeit": 3, "Bildung": 0, "Nicht erwerbstaetig": 0, "Rente": 1}
MARRIED = [
    "[1] Verheiratet, zusammenlebend", "[2] Verheiratet, getrenntlebend",
    "[6] Eing. gleichg. Partn., zusammenlebend", "[7] Eing. gleichg. Partn., getrenntlebend",
    "[1] Verheiratet, mit Ehepartner zusammenlebend", "[2] Verheiratet, dauernd getrennt lebend",
    "[6] Ehepartner im Ausland",
    "[7] Eingetragene gleichgeschlechtliche Partnerschaft zusammenlebend",
    "[8] Eingetragene gleichgeschlechtliche Partnerschaft getrennt lebend",
]
EAST = ["[13] Mecklenburg-Vorpommern", "[12] Brandenburg", "[14] Sachsen", "[15] Sachsen-Anhalt",
        "[16] Thueringen"]
NOT_APPLICABLE = ["[-1] keine Angabe", "[-3] nicht valide"]
COUPLE = ["[5] 5 Paar + K. GT 16", "[4] 4 Paar + K. LE 16", "[2] 2 (Ehe-)Paar ohne K.",
          "[6] 6 Paar + K. LE und GT 16"]
LABOUR_FORCE = ["[11] Working", "[12] Working but NW past 7 days"]
NO_MIGRATION = "[1] kein Migrationshintergrund"


def rename_columns(df: DataFrame, mapping: dict[str, str] = STUDY_NAMES) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def keep_columns(df: DataFrame, names: list[str] = PANEL_COLUMNS) -> DataFrame:
    return df.select(*names)


def drop_if_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def placeholder_columns(df: DataFrame, age_max: int = 99) -> DataFrame:
    return df.withColumns({"orighid": F.col("hid"), "motherpid": F.lit(0).cast("bigint"),
                           "age_max": F.lit(age_max)})


def derive_age_child(df: DataFrame, birth_year: str = "gebjahr") -> DataFrame:
    age = (F.col("year") - F.col(birth_year)).cast("int")
    return df.withColumns({"age": age, "child": flag(age < 18)})


def recode_codes(df: DataFrame, column: str, codes: dict[str, int], default: int | None = 0,
                 out: str | None = None) -> DataFrame:
    """Label to code; a label that is not listed gets `default`."""
    rules = [(F.col(column) == label, code) for label, code in codes.items()]
    return df.withColumn(out or column, when_any(rules, default).cast("int"))


def recode_sex(df: DataFrame, column: str = "sex", codes: dict[str, int] = SEX_CODES,
               out: str = "female") -> DataFrame:
    return recode_codes(df, column, codes, None, out)


def recode_last_write_wins(df: DataFrame, rules: list[tuple[Column, int]], out: str) -> DataFrame:
    """Rules are listed in writing order; a later rule overrides an earlier one, else null."""
    return df.withColumn(out, when_any(reversed(rules)).cast("int"))


def survey_status_rules(status: str = "employment_status", lfs: str = "lfs",
                        pension: str = "retired") -> list[tuple[Column, int]]:
    """Writing order of the employment status: 0 not employed, 1 retired, 2 part-time, 3 full-time."""
    return [(F.col("age") < 19, 0), (F.col(status) == NOT_EMPLOYED, 0),
            (F.col(lfs) == OLDER_THAN_65, 1), (F.col(pension) == YES, 1),
            (F.col(status).isin(PART_TIME), 2), (F.col(status) == FULL_TIME, 3)]


def recode_status_legacy(df: DataFrame, column: str = "employment_status",
                         codes: dict[str, int] = LEGACY_STATUS_CODES) -> DataFrame:
    coded = recode_codes(df, column, codes, 0)
    return coded.withColumn("fulltime", flag(F.col(column) == 3))


def recode_in_set(df: DataFrame, column: str, values: list[str], out: str) -> DataFrame:
    return df.withColumn(out, flag(F.col(column).isin(values)))


def recode_in_set_nullable(df: DataFrame, column: str, values: list[str], unknown: list[str],
                           out: str) -> DataFrame:
    c = F.col(column)
    return df.withColumn(out, F.when(c.isin(values), 1).when(c.isin(unknown), F.lit(None)).otherwise(0))


def recode_migration(df: DataFrame, column: str = "migback", none_label: str = NO_MIGRATION,
                     out: str = "migback") -> DataFrame:
    """1 when the label is known and names a migration background."""
    return df.withColumn(out, flag(F.col(column) != none_label))


def flag_labour_force(df: DataFrame, column: str = "lfs", labels: list[str] = LABOUR_FORCE,
                      out: str = "lfs") -> DataFrame:
    return recode_in_set(df, column, labels, out)


def flag_working(df: DataFrame) -> DataFrame:
    """Working when in the labour force with hours, never when not employed or retired."""
    status = F.col("employment_status")
    at_work = (F.col("lfs") == 1) & (F.col("hours") > 0)
    return df.withColumns({
        "working": F.when(status.isin(0, 1), 0).otherwise(flag(at_work)),
        "parttime": flag(status == 2), "fulltime": flag(status == 3)})


def flag_working_legacy(df: DataFrame) -> DataFrame:
    return df.withColumn("working", flag(F.col("employment_status").isin(2, 3)))


def numeric_or_null(df: DataFrame, *columns: str) -> DataFrame:
    """Text codes inside a number column become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def fill_zero_when_inactive(df: DataFrame, *columns: str) -> DataFrame:
    inactive = F.col("employment_status").isin(0, 1) & (F.col("lfs") == 0)
    return df.withColumns({c: F.when(F.col(c).isNull() & inactive, 0.0).otherwise(F.col(c))
                           for c in columns})


def fill_default_label(df: DataFrame, column: str, default: str = NO, codes: dict[str, int] | None = None,
                       out: str | None = None) -> DataFrame:
    """Missing label becomes `default`, then labels become codes."""
    codes = {NO: 0, YES: 1} if codes is None else codes
    label = F.coalesce(F.col(column), F.lit(default))
    rules = [(label == text, code) for text, code in codes.items()]
    return df.withColumn(out or column, when_any(rules).cast("int"))


def status_from_flags(df: DataFrame, out: str = "employment_status") -> DataFrame:
    """Later rules override: not employed, retired, part-time, full-time."""
    works, retired, full = F.col("working"), F.col("retired"), F.col("fulltime")
    keep = F.col(out) if out in df.columns else F.lit(None).cast("int")
    return df.withColumn(out, when_any([
        ((works == 1) & (full == 1), 3), ((works == 1) & (full == 0), 2), (retired == 1, 1),
        ((works == 0) & (retired == 0), 0)], keep).cast("int"))


def flags_from_status(df: DataFrame, status: str = "employment_status") -> DataFrame:
    """Three flags from the status; a missing or unknown status leaves them as they are."""
    known = F.col(status).isin(0, 1, 2, 3)
    values = {"working": F.col(status) >= 2, "retired": F.col(status) == 1, "fulltime": F.col(status) == 3}
    return df.withColumns({
        name: F.when(known, rule.cast("int")).otherwise(
            F.col(name) if name in df.columns else F.lit(None).cast("int"))
        for name, rule in values.items()})


def filter_age_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Ages `low` to `high`, both included; a missing bound is open."""
    if low is not None:
        df = df.filter(F.col("age") >= low)
    return df if high is None else df.filter(F.col("age") <= high)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, share of nulls, row count and column count, in one pass over the data."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = stats.unpivot("n_rows", df.columns, "column", "null_share")
    kind = when_any([(F.col("column") == c, t) for c, t in types.items()])
    return long.select("column", kind.alias("type"), "null_share", "n_rows",
                       F.lit(len(df.columns)).alias("n_columns"))


def clip_values(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clamp columns to (low, high); nulls stay null."""
    clipped = {}
    for name, (low, high) in bounds.items():
        c = F.col(name)
        if low is not None:
            c = F.when(c < low, F.lit(low)).otherwise(c)
        if high is not None:
            c = F.when(c > high, F.lit(high)).otherwise(c)
        clipped[name] = c
    return df.withColumns(clipped)


def domain_guard(df: DataFrame, column: str = "employment_status", allowed=(0, 1, 2, 3)) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(0))


def age_squared(df: DataFrame) -> DataFrame:
    return df.withColumn("age_squared", F.col("age").cast("bigint") * F.col("age").cast("bigint"))


def interact_with(df: DataFrame, by: str = "female", exclude: tuple[str, ...] = ("dep_var",)) -> DataFrame:
    """Each column times the flag, with suffix `_interacted`."""
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name != by and f.name not in exclude]
    return df.withColumns({f"{c}_interacted": F.col(c) * F.col(by) for c in numeric})
