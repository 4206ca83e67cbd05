"""The stages of the study end to end."""

from pyspark.sql import functions as F

from conftest import rows
from hearthpanel.operators import harmonise
from hearthpanel.operators.longitudinal import lagged_panel
from hearthpanel.plans.features import COEFFICIENTS
from hearthpanel.plans.frames import full_panel
from hearthpanel.sources.tables import order_panel


def survey(spark):
    make = spark.createDataFrame
    return {
        "pgen": make([
            (10, 1, 2000, "1500", "[1] Voll erwerbstaetig", "[11] Working", "40.5", 3, "[4] Abitur", "[1] Verheiratet, zusammenlebend"),
            (10, 2, 2000, "[-2] trifft nicht zu", "[5] Nicht erwerbstaetig", "[1] Not working", "[-2]", 0, "unknown", "[3] Ledig"),
            (10, 3, 2000, "[-2]", "[5] Nicht erwerbstaetig", "[1] Not working", None, 0, None, None),
            (11, 4, 2000, "900", "[2] Teilzeitbeschaeftigung", "[12] Working but NW past 7 days", "20", 3, "[7] Noch kein Abschluss", None)],
            "hid long, pid long, syear int, pglabgro string, pgemplst string, pglfs string, pgtatzeit string, "
            "pgerwzeit int, pgpsbil string, pgfamstd string"),
        "ppathl": make([(99, 1, 2000, "[1] maennlich", 1960, "[1] kein Migrationshintergrund", 1.5),
                        (99, 2, 2000, "[2] weiblich", 1965, "[2] direkter", 1.0), (99, 3, 2000, "[2] weiblich", 2000, None, 1.0),
                        (99, 4, 2000, "[2] weiblich", 1970, None, 2.0)],
                       "hid long, pid long, syear int, sex string, gebjahr int, migback string, phrf double"),
        "pkal": make([(1, 2000, "[2] Nein"), (2, 2000, "[1] Ja")], "pid long, syear int, kal1e01 string"),
        "hgen": make([(10, 2000, "50", "500", "[4] 4 Paar + K. LE 16")], "hid long, syear int, hgheat string, hgrent string, hgtyp1hh string"),
        "hpathl": make([(10, 2000, 2.0)], "hid long, syear int, hhrf double"),
        "hbrutto": make([(10, 2000, "[14] Sachsen")], "hid long, syear int, bula string"),
    }


def test_survey_to_panel(spark):
    out = {r.pid: r for r in harmonise.harmonise_survey(harmonise.join_survey(survey(spark))).collect()}
    assert set(out) == {1, 2, 3}  # household 11 has no row
    one, two, baby = out[1], out[2], out[3]
    assert (one.hid, one.age, one.female, one.east, one.married, one.in_couple) == (10, 40, 0, 1, 1, 1)
    assert (one.employment_status, one.fulltime, one.working, one.hours, one.gross_earnings, one.education) == (3, 1, 1, 40.5, 1500.0, 3)
    assert (two.employment_status, two.working, two.gross_earnings, two.hours, two.migback, two.birth) == (1, 0, 0.0, 0.0, 1, 1)
    assert (baby.age, baby.child, baby.employment_status, baby.birth, baby.gross_earnings) == (0, 1, 0, 0, 0.0)
    assert (two.hh_income, two.n_people, two.n_children, two.hh_frac_working, two.hh_youngest_age) == (1500.0, 3, 1, 0.5, 0)


def test_both_extracts_become_one_panel(spark):
    new = harmonise.harmonise_survey(harmonise.join_survey(survey(spark)))
    old = (new.withColumn("year", F.lit(1999)).withColumn("retired", F.lit("[1] Ja")).unionByName(new.withColumn("hours", F.lit(1.0))))
    out = harmonise.finish_panel(new, old)
    got = rows(out.filter("pid = 1"), "year", "hours", "retired", "employment_status")
    assert got == [(1999, 40.5, 0, 3), (2000, 40.5, 0, 3)]


def test_dropouts_are_imputed_once(spark, small):
    panel = lagged_panel(full_panel(order_panel(spark, small))).cache()
    birth = F.when(F.col("n_children") == 0, 0.6).otherwise(0.0)
    out = harmonise.impute_dropouts(spark, panel, COEFFICIENTS, birth).cache()
    keys = out.groupBy("pid", "year").count()
    assert keys.filter("count > 1").count() == 0
    assert out.filter("predicted = 0").count() == panel.count()
    added = out.filter("predicted = 1")
    born = added.filter("pid >= 3000000000000")
    last = panel.agg(F.max("year")).first()[0]
    next_year = panel.select("pid", (F.col("year") - 1).alias("year"))
    gone = panel.filter(F.col("year") < last).join(next_year, ["pid", "year"], "left_anti").filter("age + 1 < age_max")
    assert added.count() - born.count() == gone.count() > 0
    assert born.count() > 0 and born.filter("age <> 0 or child <> 1").count() == 0
