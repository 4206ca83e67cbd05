"""The study's six fitted models as one bundle: fit, save, load, score.

Every model has the frame of its target, scaled with the mean and standard deviation of its training rows; the targets
of regressions are scaled as well and scored back on their own scale. The bundle keeps fits and scalers together in one
folder, so that scoring a person-year needs nothing else.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.columns import flag
from hearthpanel.operators import features as ft
from hearthpanel.operators.recode import status_from_flags
from hearthpanel.operators.scoring import HOURS_CAP

BINARY = {"birth": ft.features_birth, "retired": ft.features_retired, "working": ft.features_working, "fulltime": ft.features_fulltime}
CONTINUOUS = {"hours": ft.features_hours, "gross_earnings": ft.features_earnings}
FRAMES = BINARY | CONTINUOUS
NAMES = {"birth": ft.BIRTH, "retired": ft.RETIRED, "working": ft.WORKING, "fulltime": ft.FULLTIME, "hours": ft.HOURS, "gross_earnings": ft.EARNINGS}
INTERACTED = {"retired", "working", "fulltime"}


def design(target: str) -> dict[str, Column]:
    """The regressors of a target as expressions over a panel row, named as in its frame."""
    out = {name: F.col(name).cast("double") for name in NAMES[target]}
    if target in INTERACTED:
        out |= {f"{name}_interacted": out[name] * out["female"] for name in NAMES[target] if name != "female"}
    if target != "birth":
        out["age_squared"] = out["age"] * out["age"]
    return out


@dataclass
class Bundle:
    """Fitted pipelines and, per target, mean and standard deviation of each column of its frame."""

    models: dict[str, PipelineModel] = field(default_factory=dict)
    scalers: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    def scaled(self, target: str, name: str, value: Column) -> Column:
        mean, std = self.scalers[target][name]
        return (value - F.lit(mean)) / F.lit(std)


def _input(name: str) -> str:
    return f"_z_{name}"


def _fit_target(lagged: DataFrame, target: str, test_share: float, seed: int) -> tuple[dict[str, tuple[float, float]], PipelineModel]:
    """Scalers and fit of one target. Rows of a logit with whole-number regressors that are equal become one with the sum
    of their weights, which leaves its likelihood as it is, so that its many passes grow with the different rows only."""
    frame = ft.split_train_test(FRAMES[target](lagged), test_share, seed).filter("is_test = 0").drop("is_test").na.drop("any")
    names = [c for c in frame.columns if c not in {*ft.KEYS, "dep_var", ft.WEIGHT}]
    scaled = names + (["dep_var"] if target in CONTINUOUS else [])
    stats = ft.scale_stats(frame, scaled).first()  # two numbers per column
    bundle = Bundle(scalers={target: {c: (stats[f"{c}_mean"], stats[f"{c}_std"] or 1.0) for c in scaled}})
    if target in BINARY and not {t for c, t in frame.dtypes if c in names} & {"double", "float"}:
        frame = frame.groupBy(*names, "dep_var").agg(F.sum(ft.WEIGHT).alias(ft.WEIGHT))
    rows = frame.select(*[bundle.scaled(target, c, F.col(c).cast("double")).alias(_input(c)) for c in names], ft.WEIGHT,
                        (bundle.scaled(target, "dep_var", F.col("dep_var")) if target in CONTINUOUS else F.col("dep_var").cast("double")).alias("_y"))
    common = dict(featuresCol="_features", labelCol="_y", weightCol=ft.WEIGHT, predictionCol="_prediction", regParam=0.0)
    fit = (LinearRegression(solver="normal", **common) if target in CONTINUOUS else
           LogisticRegression(maxIter=300, tol=1e-12, rawPredictionCol="_raw", probabilityCol="_probability", **common))
    assembler = VectorAssembler(inputCols=[_input(c) for c in names], outputCol="_features")
    return bundle.scalers[target], Pipeline(stages=[assembler, fit]).fit(rows)


def fit_bundle(lagged: DataFrame, test_share: float = 0.05, seed: int = 2020) -> Bundle:
    """All six models on the training rows of their frames, with the weights of the survey.

    The fits, each a chain of small jobs, run side by side.
    """
    with ThreadPoolExecutor(len(FRAMES)) as pool:
        fits = list(pool.map(lambda target: _fit_target(lagged, target, test_share, seed), FRAMES))
    return Bundle({t: model for t, (_, model) in zip(FRAMES, fits)}, {t: scalers for t, (scalers, _) in zip(FRAMES, fits)})


def save_bundle(spark: SparkSession, bundle: Bundle, folder: str) -> str:
    with ThreadPoolExecutor(len(bundle.models) or 1) as pool:
        list(pool.map(lambda target: bundle.models[target].write().overwrite().save(f"{folder}/{target}"), bundle.models))
    rows = [(t, c, float(m), float(s)) for t, columns in bundle.scalers.items() for c, (m, s) in columns.items()]
    spark.createDataFrame(rows, "target string, name string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/scalers")
    return folder


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    """The bundle that was saved in `folder`; its targets are those of the scalers."""
    bundle = Bundle()
    for row in spark.read.parquet(f"{folder}/scalers").collect():  # a row per column of six frames
        bundle.scalers.setdefault(row.target, {})[row.name] = (row.mean, row.std)
    with ThreadPoolExecutor(len(bundle.scalers) or 1) as pool:
        bundle.models = dict(zip(bundle.scalers, pool.map(lambda target: PipelineModel.load(f"{folder}/{target}"), bundle.scalers)))
    return bundle


def fitted(bundle: Bundle, target: str, df: DataFrame, out: str) -> DataFrame:
    """`df` with the probability of a binary target, or the value of a continuous one on its own scale, in column `out`.

    One projection around the model's own; rows stay where they are. A row that lacks a regressor gets null.
    """
    columns = {_input(c): bundle.scaled(target, c, x) for c, x in design(target).items()}
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    filled = df.withColumns(columns).withColumn("_known", known).withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(0.0) for c in columns})
    scored = bundle.models[target].transform(filled)
    if target in CONTINUOUS:
        mean, std = bundle.scalers[target]["dep_var"]
        value = F.col("_prediction") * F.lit(std) + F.lit(mean)
    else:
        value = vector_to_array("_probability")[1]
    return scored.withColumn(out, F.when(F.col("_known"), value)).drop(*columns, "_known", "_features", "_prediction", "_raw", "_probability")


def cascade(bundle: Bundle, df: DataFrame) -> DataFrame:
    """Retired, working if not retired, full-time if working, then hours and earnings, each by its fitted model.

    A step sees what the steps before it decided. Who a step does not apply to gets 0; the status follows from the
    flags. Hours lie between 0 and their cap, earnings are not negative.
    """
    columns = df.columns
    out = fitted(bundle, "retired", df, "_p").withColumn("retired", flag(F.col("_p") > 0.5))
    out = fitted(bundle, "working", out, "_p").withColumn("working", flag((F.col("retired") == 0) & (F.col("_p") > 0.5)))
    out = fitted(bundle, "fulltime", out, "_p").withColumn("fulltime", flag((F.col("working") == 1) & (F.col("_p") > 0.5)))
    out, works = status_from_flags(out), F.col("working") == 1
    value = F.greatest(F.col("_p"), F.lit(0.0))
    out = fitted(bundle, "hours", out, "_p").withColumn("hours", F.when(works, F.least(value, F.lit(HOURS_CAP))).otherwise(0.0))
    out = fitted(bundle, "gross_earnings", out, "_p").withColumn("gross_earnings", F.when(works, value).otherwise(0.0))
    return out.select(*columns, *[c for c in out.columns if c not in columns and c != "_p"])


def score_equations(df: DataFrame, names: list[str], value: str) -> DataFrame:
    """A row per term (the intercept among them): n, observed and fitted.

    These are the weighted sums of term times dep_var and of term times `value`, over the weighted sum of the term's
    size. A linear model by least squares, and a logistic one by maximum likelihood, have both equal at the optimum.
    One aggregate with partial sums per task gives all of them.
    """
    w, y, v = (F.col(c).cast("double") for c in (ft.WEIGHT, "dep_var", value))
    terms = {"intercept": F.lit(1.0)} | {c: F.col(c).cast("double") for c in names}
    sums = [F.struct(F.lit(name).alias("term"), F.count(F.lit(1)).alias("n"), F.sum(w * x * y).alias("observed"), F.sum(w * x * v).alias("fitted"),
                     F.sum(w * F.abs(x)).alias("size")) for name, x in terms.items()]
    one = df.agg(*[s.alias(f"t{k}") for k, s in enumerate(sums)])
    rows = one.select(F.inline(F.array(*[F.col(f"t{k}") for k in range(len(sums))])))
    return rows.select("term", "n", *[F.when(F.col("size") > 0, F.col(c) / F.col("size")).alias(c) for c in ("observed", "fitted")])
