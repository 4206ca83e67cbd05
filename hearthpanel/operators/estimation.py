"""Estimation jobs on Spark ML. Each fit is a distributed job over the feature frame."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.columns import seeded_uniform
from hearthpanel.operators.features import KEYS, WEIGHT
from hearthpanel.operators.forest import FoldForest, packed_rows
from hearthpanel.session import cut_lineage, keep_checkpoints

COMMON = dict(featuresCol="features", labelCol="dep_var", weightCol=WEIGHT)
NOT_FEATURES = {*KEYS, "dep_var", WEIGHT, "is_test", "fold"}


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def _train(df: DataFrame) -> DataFrame:
    return df.filter("is_test = 0") if "is_test" in df.columns else df


def _fit(estimator: Estimator, df: DataFrame) -> PipelineModel:
    rows = df.withColumn("dep_var", F.col("dep_var").cast("double")).na.drop("any")
    assembler = VectorAssembler(inputCols=feature_names(df), outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(rows)


def fit_logit(df: DataFrame, max_iter: int = 100, tol: float = 1e-10) -> PipelineModel:
    """Weighted logistic regression without a penalty."""
    return _fit(LogisticRegression(regParam=0.0, maxIter=max_iter, tol=tol, **COMMON), _train(df))


def fit_ols(df: DataFrame) -> PipelineModel:
    """Weighted least squares by the normal equations."""
    return _fit(LinearRegression(regParam=0.0, solver="normal", **COMMON), _train(df))


def best_stage(losses: list[float], patience: int) -> tuple[int, bool]:
    """Trees up to the first lowest loss, and whether `patience` further trees brought no gain."""
    best = 0
    for stage, loss in enumerate(losses):
        if loss < losses[best]:
            best = stage
        elif stage - best >= patience:
            return best + 1, True
    return best + 1, False


FIRST_TREES = 40
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 500_000
BINS = 32  # a Spark tree looks at so many bins of a column


def _tasks(spark: SparkSession, n: int) -> int:
    """Tasks for `n` rows: of a fixed size until every core has three, then larger ones up to a limit."""
    few, many = -(-n // MOST_ROWS_PER_TASK), -(-n // ROWS_PER_TASK)
    return max(1, few, min(many, 3 * spark.sparkContext.defaultParallelism))


def _binned(rows: DataFrame, columns: list[str]) -> Bucketizer | None:
    """Bins of the given columns, as `<name>_bin`: a bin per value where these are few, else by quantiles of all rows."""
    if not columns:
        return None
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= BINS]
    values = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    many = [c for c in columns if c not in few]
    cuts = dict(zip(many, rows.approxQuantile(many, [k / BINS for k in range(1, BINS)], 0.001))) if many else {}
    cuts |= {c: sorted(values[c])[1:] for c in few}
    edges = [[-float("inf"), *sorted(set(cuts[c])), float("inf")] for c in columns]
    edges = [e if len(e) > 2 else [e[0], 0.0, e[-1]] for e in edges]
    return Bucketizer(splitsArray=edges, inputCols=columns, outputCols=[f"{c}_bin" for c in columns])


def first_trees(model, n: int):
    """The boosted model of the first `n` trees of `model`: what a fit of `n` trees would give, without another fit."""
    java, jvm = model._java_obj, SparkSession.active().sparkContext._jvm.org.apache.spark.ml
    own = jvm.regression if isinstance(model, GBTRegressionModel) else jvm.classification
    gateway = SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(jvm.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k, (tree, weight) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
        trees[k], weights[k] = tree, weight
    if isinstance(model, GBTRegressionModel):
        short = own.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    else:
        short = own.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    return model._copyValues(type(model)(short))


def _fit_staged(gbt: Estimator, df: DataFrame, trees: int, patience: int, merge: bool = False, growth: int = 3) -> PipelineModel:
    """Boosting that ends where `patience` further trees do not lower the loss on the test part, after `trees` at most.

    The loss is taken after every tree. As a boosted model begins with the trees of any shorter one, it is fitted with
    a limit that grows by `growth` until the loss has turned, and then cut to its best length. Without test rows all
    `trees` are kept.

    With `merge` the columns of type double are binned, as a tree would bin them itself, and rows with the same bins
    and label become one that carries the sum of their weights. Without row sampling a tree sees only weighted sums
    over its bins, so it is the same tree, at the price of the distinct rows.
    """
    spark = df.sparkSession
    keep_checkpoints(spark)  # boosting cuts its own lineage every few trees where it can
    rows = df.withColumn("dep_var", F.col("dep_var").cast("double")).na.drop("any")
    names = feature_names(rows)
    stages = []
    if merge:
        bins = _binned(rows.filter("is_test = 0"), [c for c, t in rows.dtypes if c in names and t == "double"])
        if bins is not None:
            rows, stages = bins.transform(rows).drop(*bins.getInputCols()), [bins]
            for c in bins.getOutputCols():
                rows = rows.withMetadata(c, {})  # numbers in order, not categories
            names = [f"{c}_bin" if c in bins.getInputCols() else c for c in names]
        rows = rows.groupBy(*names, "dep_var", "is_test").agg(F.sum(WEIGHT).alias(WEIGHT))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    written = assembler.transform(rows).select("features", "dep_var", WEIGHT, "is_test").persist()
    rows = written.coalesce(_tasks(spark, written.count())).persist()  # a tree is several small jobs
    try:
        train, test = rows.filter("is_test = 0"), rows.filter("is_test = 1")
        regression = isinstance(gbt, GBTRegressor)
        limit = trees if test.isEmpty() else min(FIRST_TREES, trees)
        while True:
            model = gbt.copy({gbt.maxIter: limit}).fit(train)
            if test.isEmpty():
                break
            losses = model.evaluateEachIteration(test, "squared") if regression else model.evaluateEachIteration(test)
            best, turned = best_stage(losses, patience)
            if turned or limit == trees:
                model = model if best == limit else first_trees(model, best)
                break
            limit = min(growth * limit, trees)
        return PipelineModel(stages=[*stages, assembler, model])
    finally:
        rows.unpersist()
        written.unpersist()


def fit_boosted_binary(df: DataFrame, trees: int = 350, depth: int = 5, rate: float = 0.05, patience: int = 5,
                       seed: int = 2020) -> PipelineModel:
    """Boosted trees; the test part stops the boosting early."""
    return _fit_staged(GBTClassifier(maxDepth=depth, stepSize=rate, seed=seed, **COMMON), df, trees, patience, merge=True, growth=9)


def fit_boosted_regression(df: DataFrame, trees: int = 350, depth: int = 5, rate: float = 0.15, bagging: float = 0.8,
                           feature_share: float = 0.9, patience: int = 5, seed: int = 2020) -> PipelineModel:
    """Boosted trees on the unscaled target, with row and feature sampling; stopped like the binary ones."""
    gbt = GBTRegressor(maxDepth=depth, stepSize=rate, subsamplingRate=bagging, seed=seed,
                       featureSubsetStrategy=str(feature_share), **COMMON)
    return _fit_staged(gbt, df, trees, patience)


def fit_multiclass_status(df: DataFrame, trees: int = 50, depth: int = 8, seed: int = 2020) -> PipelineModel:
    """Probabilities of the four statuses; Spark's boosted trees know two classes only."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **COMMON)
    return _fit(forest, _train(df))


STATUSES = 4


def calibrate_status(scored: DataFrame, normalise: bool = True) -> DataFrame:
    """`scored` (p0 to p3, dep_var, is_test) with probabilities set right on the test part, which no tree has seen.

    Per status a rising function from the model's to the observed share is fitted, and the four are normalised to the
    sum 1 if asked; a row that all of them give 0 keeps the model's. Without test rows nothing changes.
    """
    test = scored.filter("is_test = 1")
    if test.isEmpty():
        return scored
    out = scored
    for k in range(STATUSES):
        rows = test.select(F.col(f"p{k}").alias("x"), (F.col("dep_var") == k).cast("double").alias("y"), F.col(WEIGHT).cast("double").alias("w"))
        rising = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol=f"_c{k}").fit(rows)
        out = rising.transform(out.withColumn("x", F.col(f"p{k}"))).drop("x")
    total = reduce(lambda a, b: a + b, [F.col(f"_c{k}") for k in range(STATUSES)]) if normalise else F.lit(1.0)
    new = {f"p{k}": F.when(total > 0, F.col(f"_c{k}") / total).otherwise(F.col(f"p{k}")) for k in range(STATUSES)}
    return out.withColumns(new).drop(*[f"_c{k}" for k in range(STATUSES)])


# The tuning grid.
RATES = [0.01, 0.175, 0.34, 0.505, 0.67, 0.835, 1.0]
TREES = [150, 200, 250]


def tune_grid(df: DataFrame, rates: list[float] = RATES, trees: list[int] = TREES, binary: bool = True,
              folds: int = 3, parallelism: int = 4, seed: int = 2020) -> DataFrame:
    """Cross-validated score of every setting, one row each.

    Two kinds of ensembles are compared: boosted trees over rates and numbers of trees, and random
    forests, which have no rate, over numbers of trees.
    """
    keep_checkpoints(df.sparkSession)
    boosted = (GBTClassifier if binary else GBTRegressor)(maxDepth=5, seed=seed, **COMMON)
    forest = (RandomForestClassifier if binary else RandomForestRegressor)(maxDepth=5, seed=seed, **COMMON)
    score = (BinaryClassificationEvaluator(labelCol="dep_var", weightCol=WEIGHT) if binary
             else RegressionEvaluator(labelCol="dep_var", weightCol=WEIGHT))
    rows = []
    for kind, model, count, rate in (("boosted", boosted, boosted.maxIter, boosted.stepSize),
                                     ("forest", forest, forest.numTrees, None)):
        grid = ParamGridBuilder().addGrid(count, trees)
        grid = (grid if rate is None else grid.addGrid(rate, rates)).build()
        fitted = _cross_validate(df, model, grid, score, folds, parallelism, seed)
        rows += [(kind, None if rate is None else float(p[rate]), int(p[count]), float(m), score.getMetricName())
                 for p, m in zip(grid, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "kind string, rate double, trees int, score double, metric string")


def person_folds(df: DataFrame, folds: int, seed: int = 2020) -> DataFrame:
    """Adds `fold`, 0 to `folds` - 1, by a draw on the person: all years of a person are in one fold."""
    return df.withColumn("fold", F.floor(seeded_uniform(["pid"], "fold", seed) * folds).cast("int"))


def _cross_validate(df: DataFrame, estimator: Estimator, grid: list, score, folds: int, parallelism: int,
                    seed: int) -> CrossValidatorModel:
    train = _train(df).withColumn("dep_var", F.col("dep_var").cast("double")).na.drop("any")
    rows = VectorAssembler(inputCols=feature_names(df), outputCol="features").transform(person_folds(train, folds, seed))
    rows = rows.select("features", "dep_var", WEIGHT, "fold").persist()
    try:
        return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=score, numFolds=folds, foldCol="fold",
                              parallelism=parallelism, seed=seed).fit(rows)
    finally:
        rows.unpersist()


ROWS_AT_ONCE = 4_000_000


def cv_multiclass(df: DataFrame, folds: int = 10, trees: int = 50, depth: int = 8, parallelism: int = 4,
                  seed: int = 2020, only: list[int] | None = None, shared: bool = True) -> dict[int, PipelineModel]:
    """The status model of every fold, or of those in `only`, fitted on the rows of the other folds; folds are by person.

    The forests grow side by side in passes they share (`operators/forest.py`). If not `shared`, each is a fit of Spark's
    own, which keeps its own copy of the rows while it grows, so fewer grow side by side where there are many rows.
    """
    names = feature_names(df)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    train = person_folds(_train(df).withColumn("dep_var", F.col("dep_var").cast("double")).na.drop("any"), folds, seed)
    wanted = list(range(folds)) if only is None else only
    settings = dict(numTrees=trees, maxDepth=depth, seed=seed, **COMMON)
    if shared:
        with packed_rows(train, names, WEIGHT, wanted, folds, trees) as common:
            with ThreadPoolExecutor(parallelism) as pool:
                fits = pool.map(lambda k: FoldForest(common, k, **settings).fit(common.units), wanted)
                return {k: PipelineModel(stages=[assembler, m]) for k, m in zip(wanted, fits)}
    rows = assembler.transform(train).select("features", "dep_var", WEIGHT, "fold").persist()
    try:
        side = max(1, min(parallelism, ROWS_AT_ONCE // max(1, rows.count())))
        with ThreadPoolExecutor(side) as pool:
            fits = pool.map(lambda k: RandomForestClassifier(**settings).fit(rows.filter(F.col("fold") != k)), wanted)
            return {k: PipelineModel(stages=[assembler, m]) for k, m in zip(wanted, fits)}
    finally:
        rows.unpersist()


def out_of_fold(models: dict[int, PipelineModel], df: DataFrame, folds: int = 10, seed: int = 2020) -> DataFrame:
    """Every training row with its fold and the probabilities p0, p1, ... of the model that has not seen the person."""
    rows = person_folds(_train(df).withColumn("dep_var", F.col("dep_var").cast("double")).na.drop("any"), folds, seed)
    rows = cut_lineage(df.sparkSession, rows, "fold")  # drawn and filtered once, not once per fold
    return reduce(DataFrame.unionByName, [predict(m, rows.filter(F.col("fold") == k)) for k, m in models.items()])


def feature_importance(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """Importance per feature of a tree model, or of the last stage of a pipeline."""
    tree = model.stages[-1] if isinstance(model, PipelineModel) else model
    weights = tree.featureImportances.toArray()
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double")


def coefficients(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """Coefficient table (term, beta) of a linear or logistic model."""
    linear = model.stages[-1]
    rows = [("intercept", float(linear.intercept))] + [(n, float(b)) for n, b in zip(names, linear.coefficients)]
    return spark.createDataFrame(rows, "term string, beta double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds `prediction`, and `p0`, `p1`, ... for a classifier."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        classes = model.stages[-1].numClasses
        scored = scored.withColumn("_p", vector_to_array("probability"))
        scored = scored.withColumns({f"p{k}": F.col("_p")[k] for k in range(classes)}).drop("_p")
    return scored.drop("features", "rawPrediction", "probability")
