"""The model bundle, staged boosting, folds by person, calibration and the order check."""

import random

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import estimation, features, harmonise, models
from hearthpanel.operators.longitudinal import lagged_panel
from hearthpanel.operators.sets import order_check, sort_panel
from hearthpanel.plans.frames import full_panel
from hearthpanel.session import shared_folder
from hearthpanel.sources import files
from hearthpanel.sources.tables import order_panel


@pytest.fixture(scope="module")
def lagged(spark, small):
    return lagged_panel(full_panel(order_panel(spark, small))).cache()


@pytest.fixture(scope="module")
def bundle(lagged):
    return models.fit_bundle(lagged)


def test_design_columns_are_those_of_the_frames(lagged):
    for target, build in models.FRAMES.items():
        frame = [c for c in build(lagged).columns if c not in {"pid", "year", "dep_var", "personweight"}]
        assert sorted(frame) == sorted(models.design(target))


def test_reloaded_bundle_gives_equal_scores(spark, lagged, bundle):
    again = models.load_bundle(spark, models.save_bundle(spark, bundle, f"{shared_folder(spark)}/test-bundle"))
    assert again.scalers == bundle.scalers and set(again.models) == set(models.FRAMES)
    for target in models.FRAMES:
        one = {(r.pid, r.year): r.v for r in models.fitted(bundle, target, lagged, "v").collect()}
        two = {(r.pid, r.year): r.v for r in models.fitted(again, target, lagged, "v").collect()}
        assert one == two


def test_rows_that_lack_a_regressor_get_no_score(lagged, bundle):
    scored = models.fitted(bundle, "hours", lagged.withColumn("hours_t2", F.lit(None).cast("double")), "v")
    assert scored.filter("v is not null").isEmpty() and scored.columns == [*lagged.columns, "v"]


def test_fits_meet_their_score_equations(lagged, bundle):
    for target in ("hours", "gross_earnings", "working"):
        frame = features.split_train_test(models.FRAMES[target](lagged)).filter("is_test = 0").drop("is_test")
        names = estimation.feature_names(frame)
        for row in models.score_equations(models.fitted(bundle, target, frame, "v"), names, "v").collect():
            assert row.fitted == pytest.approx(row.observed, rel=1e-3, abs=1e-4), (target, row.term)


def test_logits_on_whole_numbers_pass_over_different_rows_only(lagged, bundle, monkeypatch):
    seen, fit = {}, models.Pipeline.fit

    def noted(self, rows):
        seen[len(seen)] = rows
        return fit(self, rows)
    monkeypatch.setattr(models.Pipeline, "fit", noted)
    monkeypatch.setattr(models, "FRAMES", {"birth": models.FRAMES["birth"], "retired": models.FRAMES["retired"]})
    again = models.fit_bundle(lagged)
    assert list(again.models) == ["birth", "retired"] and again.scalers == {t: bundle.scalers[t] for t in again.scalers}
    for rows in seen.values():
        frame = [c for c in rows.columns if c != "personweight"]
        assert rows.count() > 0 and rows.groupBy(*frame).count().filter("count > 1").isEmpty()


def test_cascade_is_consistent(lagged, bundle):
    out = models.cascade(bundle, lagged)
    assert out.columns[:len(lagged.columns)] == lagged.columns and out.count() == lagged.count()
    bad = ((F.col("working") == 0) & ((F.col("hours") != 0) | (F.col("gross_earnings") != 0) | (F.col("fulltime") != 0))) | (F.col("hours") > 80) | (
        (F.col("retired") == 1) & (F.col("working") == 1)) | (F.col("gross_earnings") < 0)
    assert out.filter(bad).isEmpty()


def test_dropouts_are_imputed_with_the_fitted_models(spark, lagged, bundle):
    out = harmonise.impute_dropouts_fitted(spark, lagged, bundle).cache()
    assert out.filter("predicted = 0").count() == lagged.count() and not out.filter("predicted = 1").isEmpty()
    assert out.groupBy("pid", "year").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("losses, want", [([3, 2, 1, 1, 1, 1], (3, True)), ([3, 2, 1, 1, 1], (3, False)), ([1.0], (1, False)),
                                          ([2, 3, 1, 4, 4, 4], (3, True)), ([5, 4, 3], (3, False))])
def test_best_stage(losses, want):
    assert estimation.best_stage(losses, 3) == want


def test_a_shorter_boosted_model_is_the_beginning_of_a_longer_one(spark):
    rng = random.Random(1)
    rows = [(i, 2000, float(rng.random() < 0.2 + 0.6 * (i % 2)), float(i % 2), rng.random(), 1.0, int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, year int, dep_var double, a double, b double, personweight double, is_test int")
    model = estimation.fit_boosted_binary(df, trees=40, depth=2).stages[-1]
    assert 1 <= model.getNumTrees <= 40
    whole = estimation.fit_boosted_binary(df.withColumn("is_test", F.lit(0)), trees=12, depth=2)
    part = estimation.fit_boosted_binary(df.withColumn("is_test", F.lit(0)), trees=5, depth=2)
    assert len(whole.stages[-1].trees) == 12
    assert [t.toDebugString.split("\n", 1)[1] for t in whole.stages[-1].trees[:5]] == [t.toDebugString.split("\n", 1)[1] for t in part.stages[-1].trees]


def test_merged_rows_give_the_trees_of_single_rows_and_the_first_trees_are_a_shorter_fit(spark):
    rng = random.Random(4)
    rows = [(i, 2000, float(rng.random() < 0.2 + 0.15 * (i % 5)), i % 5, float(i % 3), 1.0 + i % 2, 0) for i in range(900)]
    df = spark.createDataFrame(rows, "pid long, year int, dep_var double, a int, b double, personweight double, is_test int")
    scored = lambda m: sorted((r.pid, round(r.p1, 9)) for r in estimation.predict(m, df).collect())
    whole, part = (estimation.fit_boosted_binary(df, trees=n, depth=3) for n in (9, 4))
    single = estimation._fit_staged(estimation.GBTClassifier(maxDepth=3, stepSize=0.05, seed=2020, **estimation.COMMON), df, 4, 5)
    assert scored(part) == scored(single)
    cut = estimation.first_trees(whole.stages[-1], 4)
    assert cut.getNumTrees == 4 and list(cut.treeWeights) == list(part.stages[-1].treeWeights)
    assert scored(type(whole)(stages=[*whole.stages[:-1], cut])) == scored(part)
    numbers = estimation.fit_boosted_regression(df, trees=3, depth=2)
    assert estimation.first_trees(numbers.stages[-1], 2).getNumTrees == 2


def test_the_model_of_one_fold_needs_no_others(spark, lagged, monkeypatch):
    fits = []
    fit = estimation.RandomForestClassifier.fit
    monkeypatch.setattr(estimation.RandomForestClassifier, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    df = features.split_train_test(features.features_retired(lagged))
    one = estimation.cv_multiclass(df, folds=3, trees=2, depth=2, only=[0])
    assert list(one) == [0] and len(fits) == 1
    every = estimation.cv_multiclass(df, folds=3, trees=2, depth=2)
    assert len(every) == 3 and len(fits) == 4  # none on all rows together, which no fold's row may use
    assert every[0].stages[-1].toDebugString.split("\n", 1)[1] == one[0].stages[-1].toDebugString.split("\n", 1)[1]


def test_no_person_is_in_two_folds(lagged):
    folds = estimation.person_folds(lagged, 10)
    assert folds.groupBy("pid").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert folds.select("fold").distinct().count() > 5 and folds.filter("fold < 0 or fold > 9").isEmpty()


def test_calibrated_shares_are_those_observed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        p = [rng.random() for _ in range(4)]
        rows.append((*[x / sum(p) for x in p], float(rng.choices(range(4), [x ** 2 for x in p])[0]), 1.0 + rng.random(), i % 2))
    df = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, p3 double, dep_var double, personweight double, is_test int")
    out = estimation.calibrate_status(df)
    assert out.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3") - 1) > 1e-9).isEmpty()
    raw = estimation.calibrate_status(df, normalise=False).filter("is_test = 1")
    w = F.col("personweight")
    one = raw.agg(F.sum(w * F.col("p2")).alias("said"), F.sum(w * (F.col("dep_var") == 2).cast("int")).alias("seen")).first()
    assert one.said == pytest.approx(one.seen)
    assert estimation.calibrate_status(df.filter("is_test = 0")).columns == df.columns


def test_order_check_tells_sorted_from_shuffled(spark):
    df = spark.range(1000).select(F.col("id").alias("pid"), F.lit(2000).alias("year")).repartition(7)
    good, bad = order_check(sort_panel(df)).first(), order_check(df).first()
    assert (good.n, good.inversions) == (1000, 0) and bad.n == 1000 and bad.inversions > 0


def test_large_years_are_split_into_files_and_small_ones_are_not(spark):
    df = spark.range(60_000).select(F.col("id").alias("pid"), F.when(F.col("id") < 50_000, 2000).otherwise(2001 + F.col("id") % 5).cast("int").alias("year"),
                                    F.lit(30).alias("age"), F.md5(F.col("id").cast("string")).alias("x")).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        everyone, _ = files.write_panel(df, f"{shared_folder(spark)}/sized")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    per = {}
    for name in spark.read.parquet(everyone).inputFiles():
        year = name.split("year=")[1][:4]
        per[year] = per.get(year, 0) + 1
    assert per.pop("2000") >= 4 and set(per.values()) == {1}
