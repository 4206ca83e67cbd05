"""Fits against closed forms and files in the form of the real exports."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hearthpanel.operators import estimation, features, scoring
from hearthpanel.session import shared_folder
from hearthpanel.sources import files


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(3)
    data = [(i, 2000, 2.0 + 3.0 * (i % 17) - (i % 5), float(i % 17), float(i % 5), 1.0 + rng.random()) for i in range(400)]
    return spark.createDataFrame(data, "pid long, year int, dep_var double, a double, b double, personweight double").cache()


def test_ols_finds_the_plane(spark, line):
    model = estimation.fit_ols(line)
    got = {r.term: r.beta for r in estimation.coefficients(spark, model, ["a", "b"]).collect()}
    assert got == pytest.approx({"intercept": 2.0, "a": 3.0, "b": -1.0}, abs=1e-6)


def test_saved_model_predicts_the_same(spark, line):
    model = estimation.fit_ols(line)
    path = estimation.save_model(model, f"{shared_folder(spark)}/test-model")
    again = estimation.predict(estimation.load_model(path), line)
    assert rows(again, "pid", "prediction") == rows(estimation.predict(model, line), "pid", "prediction")


def test_logit_recovers_probabilities(spark):
    # 3 of 4 at x = 1 and 1 of 4 at x = 0: log odds are +-log 3
    data = [(i, 2000, float(x == (i % 4 > 0)), float(x), 1.0) for i in range(400) for x in (0, 1)]
    df = spark.createDataFrame(data, "pid long, year int, dep_var double, x double, personweight double")
    got = {r.term: r.beta for r in estimation.coefficients(spark, estimation.fit_logit(df), ["x"]).collect()}
    assert got["intercept"] == pytest.approx(-1.0986, abs=1e-3) and got["x"] == pytest.approx(2.1972, abs=1e-3)


def test_coefficient_scores_equal_the_model(spark, line):
    model = estimation.fit_ols(line)
    terms = {r.term: r.beta for r in estimation.coefficients(spark, model, ["a", "b"]).collect()}
    scored = scoring.score_regression(line, terms, "s")
    both = estimation.predict(model, scored).filter(F.abs(F.greatest(F.col("prediction"), F.lit(0.0)) - F.col("s")) > 1e-9)
    assert both.count() == 0


def test_boosting_beats_the_mean(line):
    df = features.split_train_test(line, 0.2)
    scored = estimation.predict(estimation.fit_boosted_regression(df, trees=20), df.withColumn("dep_var", F.col("dep_var")))
    error = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("dep_var")))).first()[0]
    assert error < 3.0


def test_split_is_stable(line):
    a = rows(features.split_train_test(line), "pid", "is_test")
    assert a == rows(features.split_train_test(line.repartition(7)), "pid", "is_test")


def test_rate_export(spark, tmp_path):
    text = ["Geburtenziffern", "", "Deutschland", "", "Alter der Mutter", "Kohorte", "", ";1967;1968", "15 Jahre;1,0;2,5",
            "16 Jahre;3,0;4,25", "__________", "Anmerkung: ohne Gewaehr"]
    path = tmp_path / "rates.csv"
    path.write_text("\n".join(text))
    assert rows(files.read_rate_csv(spark, str(path), "1968")) == [(15, 2.5), (16, 4.25)]
    assert rows(files.read_rate_csv(spark, str(path), "1967")) == [(15, 1.0), (16, 3.0)]


def test_mortality_tables(spark, tmp_path):
    for name, scale in (("men", 2), ("women", 1)):
        (tmp_path / name).write_text("Alter;qx\n0;0,00%d\n1;0,0%d\n101;1\nQuelle\n" % (3 * scale, 2 * scale))
    out = files.build_mortality_table(spark, str(tmp_path / "men"), str(tmp_path / "women"))
    assert rows(out, "age", "men", "women") == [(0, 0.006, 0.003), (1, 0.04, 0.02)]
