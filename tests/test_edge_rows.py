"""Hand-written edge rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hearthpanel.operators import events, household, joins, longitudinal, recode, reports, transitions
from hearthpanel.operators import features

PERSON = "pid long, year int, hid long, age int, female int, child int, working int, gross_earnings double"


def test_gap_year_gives_no_lag(spark):
    df = spark.createDataFrame([(1, 2000, 10.0), (1, 2001, 11.0), (1, 2003, 13.0)], "pid long, year int, hours double")
    out = longitudinal.lag_exact(df, {"t1": ("hours", 1), "t2": ("hours", 2)}, from_third_year=False)
    assert rows(out, "year", "t1", "t2") == [(2000, None, None), (2001, 10.0, None), (2003, None, 11.0)]


def test_rows_start_with_the_third_year(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2001, 2.0), (2, 2004, 3.0)], "pid long, year int, hours double")
    out = longitudinal.lag_exact(df, {"t1": ("hours", 1)})
    assert rows(out, "pid", "year") == [(2, 2004)]


def test_two_observations_are_too_few(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 2)], "pid long, year int")
    assert {r.pid for r in longitudinal.min_observations(df).collect()} == {1}


def test_household_without_adults_working_children_and_nulls(spark):
    df = spark.createDataFrame([
        (1, 2000, 1, 5, 1, 1, 0, None), (2, 2000, 1, 7, 0, 1, 0, None),
        (3, 2000, 2, 40, 1, 0, 0, 5.0), (4, 2000, 2, 17, 0, 1, 1, 1.0), (5, 2000, 2, 16, 0, 1, 1, None),
        (6, 2000, None, 30, 1, 0, 1, 9.0), (7, 2000, None, 31, 1, 0, 1, 9.0),
        (8, 2000, 3, 0, 0, 1, 0, 0.0), (9, 2000, 3, 30, 1, 0, 1, 4.0)], PERSON)
    for hot in (None, 1):
        out = {r.pid: r for r in household.hh_vars(df, hot).collect()}
        assert (out[1].hh_frac_working, out[1].hh_income, out[1].n_people) == (0.0, 0.0, 2)
        assert (out[3].hh_frac_working, out[3].hh_income, out[3].n_children) == (1.0, 6.0, 2)
        assert out[6].n_people is None and out[7].hh_income is None
        assert (out[9].birth, out[8].birth, out[3].birth) == (1, 0, 0)
        assert len(out) == 9


def test_recodes(spark):
    df = spark.createDataFrame([
        (1, 18, "[1] Voll erwerbstaetig", None, "[2] Nein", "[9] anything"),
        (2, 40, "[3] Ausbildung, Lehre", None, None, "[1] kein Migrationshintergrund"),
        (3, 70, "[5] Nicht erwerbstaetig", "[2] NW-age 65 and older", None, None),
        (4, 70, "unknown", None, "[1] Ja", "[2] direkter Migrationshintergrund"),
        (5, 40, "unknown", None, None, None)],
        "pid long, age int, employment_status string, lfs string, retired string, migback string")
    status = recode.recode_last_write_wins(df, recode.survey_status_rules(), "status")
    assert rows(status, "pid", "status") == [(1, 3), (2, 2), (3, 1), (4, 1), (5, None)]
    assert rows(recode.recode_migration(df), "pid", "migback") == [(1, 1), (2, 0), (3, 0), (4, 1), (5, 0)]
    label = recode.fill_default_label(df, "retired")
    assert rows(label, "pid", "retired") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 0)]
    codes = spark.createDataFrame([("[4] Abitur",), ("no such label",), (None,)], "education string")
    assert rows(recode.recode_codes(codes, "education", recode.EDUCATION_CODES)) == [(0,), (0,), (3,)]


def test_flags_and_status(spark):
    df = spark.createDataFrame([(0, 9, 9, 9), (1, 9, 9, 9), (2, 9, 9, 9), (3, 9, 9, 9), (None, 1, 0, 1)],
                               "employment_status int, working int, retired int, fulltime int")
    out = recode.flags_from_status(df)
    assert rows(out) == [(0, 0, 0, 0), (1, 0, 1, 0), (2, 1, 0, 0), (3, 1, 0, 1), (None, 1, 0, 1)]
    back = recode.status_from_flags(out.filter("employment_status is not null").withColumnRenamed("employment_status", "old"))
    assert all(r.old == r.employment_status for r in back.collect())


def test_numbers_with_text_codes(spark):
    df = spark.createDataFrame([("12.5", 2, 1), ("[-2] trifft nicht zu", 0, 0), ("x", 3, 1), (None, 1, 0)],
                               "hours string, employment_status int, lfs int")
    out = recode.fill_zero_when_inactive(recode.numeric_or_null(df, "hours"), "hours")
    assert rows(out, "employment_status", "hours") == [(0, 0.0), (1, 0.0), (2, 12.5), (3, None)]


def test_conditional_with_zero_marginal(spark):
    df = spark.createDataFrame([(1, 30, 2, 2), (1, 30, 2, 2), (1, 30, 3, 2), (1, 30, 2, 3)],
                               "female int, age int, employment_status int, employment_status_t1 int")
    table = transitions.transition_conditional(transitions.transition_by_sex_age(df))
    got = {(r.status_t1, r.status_t): r.cond for r in table.collect()}
    assert len(got) == 16 and got[2, 2] == 2 / 3 and got[3, 2] == 1.0 and got[0, 1] == 0.0
    assert transitions.transition_check(table).count() == 0


def test_draws_on_and_outside_the_mass(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.0, 0.0, 0.5), (2, 0.25, 0.0, 0.0, 0.0, 0.9), (3, 0.1, 0.2, 0.3, 0.4, 0.65)],
                               "pid long, b0 double, b1 double, b2 double, b3 double, u double")
    drawn = transitions.draw_status(df, draw=F.col("u"))
    assert rows(drawn, "pid", "drawn") == [(1, 1), (2, 0), (3, 3)]
    assert rows(transitions.argmax_status(df), "pid", "likely") == [(1, 0), (2, 0), (3, 3)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "pid long, a double, b double")
    assert rows(features.standardize(df, ["a", "b"]), "a", "b") == [(0.0, -1.0), (0.0, 1.0)]


def test_histogram_edges(spark):
    same = spark.createDataFrame([(3.0,)] * 4, "x double")
    out = reports.histogram_equal_width(same, "x", 4).orderBy("bin").collect()
    assert [r.obs for r in out] == [0, 0, 4, 0] and out[0].left == 2.5
    spread = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 4)], "x double")
    out = reports.histogram_equal_width(spread, "x", 4).orderBy("bin").collect()
    assert [r.obs for r in out] == [1, 1, 1, 1] and out[-1].right == 4.0


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(h),) for h in (9, 10, 20, 30, 40, 60)], "hours double")
    got = [r.b for r in df.select(reports.hours_bucket("hours").alias("b")).collect()]
    assert got == [0, 1, 2, 3, 4, 4]


def test_real_row_wins_on_return(spark):
    real = spark.createDataFrame([(1, 2002, 7.0)], "pid long, year int, hours double")
    projected = spark.createDataFrame([(1, 2001, 5.0), (1, 2002, 5.0)], "pid long, year int, hours double")
    out = events.complete_panel(real, projected)
    assert rows(out, "year", "hours", "predicted") == [(2001, 5.0, 1), (2002, 7.0, 0)]


def test_separation_moves_the_man_only(spark):
    df = spark.createDataFrame([(p, 2000, 9, 9, f, 1, 1) for p in range(1, 400) for f in [p % 2]],
                               "pid long, year int, hid long, orighid long, female int, married int, in_couple int")
    out = events.mark_separations(df, married_rate=0.2).collect()
    parted = [r for r in out if r.separated]
    assert 40 < len(parted) < 120
    for r in out:
        assert (r.married, r.in_couple) == ((0, 0) if r.separated else (1, 1))
        assert (r.hid != 9) == bool(r.separated and r.female == 0) and r.orighid == 9
    moved = [r.hid for r in out if r.hid != 9]
    assert len(set(moved)) == len(moved)


def test_newborn(spark):
    df = spark.createDataFrame([(4, 2000, 8, 30, 1, 0, 1, 0, 0, 25.0, 3), (5, 2000, 8, 31, 1, 0, 0, 0, 0, 20.0, 3)],
                               "pid long, year int, hid long, age int, female int, child int, birth int, predicted int, "
                               "motherpid long, hours double, education int")
    out = {r.pid: r for r in events.add_newborn_rows(df).collect()}
    assert len(out) == 3
    child = out[max(out)]
    assert (child.age, child.child, child.hours, child.education, child.motherpid, child.hid, child.predicted) == (0, 1, 0.0, 0, 4, 8, 1)


def test_mother_link_uses_the_usual_household(spark):
    df = spark.createDataFrame([
        (1, 2000, 7, 30, 1, 0), (1, 2001, 7, 31, 1, 0), (1, 2002, 9, 32, 1, 0), (2, 2001, 7, 0, 0, 1),
        (3, 2001, 9, 3, 0, 1), (5, 2001, 9, 60, 1, 0)], "pid long, year int, hid long, age int, female int, child int")
    for hot in (None, 1):
        assert rows(joins.link_mother_child(df, hot), "pid", "motherpid") == [(2, 1)]
    births = joins.flag_births_by_link(df, joins.link_mother_child(df))
    assert rows(births.filter("birth = 1"), "pid", "year") == [(1, 2001)]


def test_extracts_prefer_the_new_one(spark):
    new = spark.createDataFrame([(1, 2000, None, 4), (2, 2000, 5.0, 4)], "pid long, year int, hours double, a int")
    old = spark.createDataFrame([(1, 2000, 3.0, 1), (3, 1999, 6.0, 1)], "pid long, year int, hours double, b int")
    out = joins.merge_extracts_outer(new, old)
    assert rows(out, "pid", "year", "hours", "a", "b") == [(1, 2000, 3.0, 4, 1), (2, 2000, 5.0, 4, None), (3, 1999, 6.0, None, 1)]


def test_external_ratio_by_year(spark):
    series = spark.createDataFrame([("Labour Force", 2000, 6.0), ("Employment", 2000, 5.0), ("Population", 2000, 10.0),
                                    ("Labour Force", 2001, 6.0)], "series string, year int, value double")
    out = joins.join_external_ratio(series, {"lfs": "Labour Force", "working": "Employment"}, "Population")
    assert rows(out, "year", "lfs", "working") == [(2000, 0.6, 0.5)]


def test_lookups_take_any_age(spark):
    people = spark.createDataFrame([(1, 1990, 1, 0, 140), (2, 1990, 1, 0, 150)], "pid long, year int, female int, child int, age int")
    rates = spark.createDataFrame([(140, 20.0), (140, 20.0)], "age int, rate double")
    got = {r.pid: r.rate for r in joins.lookup_age_rate(people, rates, (15, 200)).collect()}
    assert got == {1: 20.0, 2: None}


def test_several_rates_of_an_age_are_an_error(spark):
    people = spark.createDataFrame([(1, 1990, 1, 0, 30)], "pid long, year int, female int, child int, age int")
    rates = spark.createDataFrame([(30, 10.0), (30, 20.0)], "age int, rate double")
    with pytest.raises(Exception, match="several rates"):
        joins.lookup_age_rate(people, rates).collect()


def test_births_keep_the_population(spark):
    people = spark.createDataFrame([(1, 1990, 1, 0, 30), (2, 1990, 0, 0, 30), (3, 1990, 1, 0, 70)],
                                   "pid long, year int, female int, child int, age int")
    rates = spark.createDataFrame([(30, 1000.0)], "age int, rate double")
    assert {r.pid: r.birth for r in events.flag_births(people, rates).collect()} == {1: 1, 2: 0, 3: 0}


def test_transitions_of_any_age_and_unknown_moves(spark):
    lags = spark.createDataFrame([(1, 2000, 0, 120, 0, 1, 2)], "pid long, year int, female int, age int, east int, employment_status int, employment_status_t1 int")
    table = transitions.transition_conditional(transitions.transition_by_sex_age(lags))
    assert {r.age for r in table.collect()} == {120}
    start = spark.createDataFrame([(0, 119, 2, 1.0), (0, 50, 1, 1.0)], "female int, age int, status int, share double")
    last = {(r.age, r.status): r.share for r in transitions.project_status_shares(start, table, 1).filter("period = 1").collect()}
    assert last == {(120, 1): 1.0, (51, None): 1.0}
