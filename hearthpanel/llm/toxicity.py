"""Toxicity by a classifier chain.

Categories are predicted one after the other; the model of a category sees the words of the text and the
probabilities of the categories before it. While training, these probabilities come from models that have
not seen the row (out-of-fold), so that a later model learns how far earlier ones can be trusted.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.store import saved

# Words that make a toxic text an insult, or contempt. The labels name no kinds of toxicity,
# so these two categories are weak labels: the given label and a word of the list.
INSULTS = ["idiot", "moron", "loser", "clown", "scum", "trash"]
CONTEMPT = ["stupid", "pathetic", "worthless", "disgusting"]
CATEGORIES = ["insult", "contempt", "toxic"]
FOLDS = 3
VOCABULARY = 1_000
"""Terms that the models see: those whose share of documents differs most between the classes."""
STEMS = (4, 5)
TRAINING_ROWS = 20_000
"""Bound of the sample of labelled documents that the chain is fitted on."""


def terms(text: Column) -> Column:
    """Distinct lower-case words and their stems (their first letters, by STEMS) of a whole text; null counts as empty."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    stems = [F.array_distinct(F.transform(words, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))) for n in STEMS]
    return F.concat(words, *stems)


def choose_terms(rows: DataFrame, count: int = VOCABULARY) -> list[str]:
    """The `count` terms of `rows` (terms, toxic) whose document share differs most between the classes.

    Each document counts once per term. Ties go to the term that sorts first.
    """
    sizes = rows.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    seen = rows.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    gap = F.abs(F.col("toxic") / sizes.toxic - F.col("clean") / sizes.clean)
    return [r.term for r in seen.filter("term <> ''").orderBy(gap.desc(), "term").limit(count).collect()]


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """`rows` with `words`, a 0/1 vector of the chosen terms, in place of `terms`."""
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="words").setBinary(True)
    return counts.transform(rows).drop("terms")


def _score(rows: DataFrame, model: LogisticRegressionModel, earlier: list[str], name: str) -> DataFrame:
    """`rows` with the probability `name` that `model` gives."""
    given = VectorAssembler(inputCols=["words", *earlier], outputCol="given").transform(rows)
    return model.transform(given).withColumn(name, vector_to_array("probability")[1]).drop(
        "given", "rawPrediction", "probability", "prediction")


def fit_chain(training: DataFrame, categories: list[str] = CATEGORIES, folds: int = FOLDS,
              penalty: float = 1e-4) -> list[LogisticRegressionModel]:
    """One linear model per category. `training` has `words`, `fold` and a 0/1 double column per category.

    It must be a saved table, as it is read many times.
    """
    def learn(rows: DataFrame, name: str, earlier: list[str]) -> LogisticRegressionModel:
        given = VectorAssembler(inputCols=["words", *earlier], outputCol="given").transform(rows)
        return LogisticRegression(featuresCol="given", labelCol=name, regParam=penalty, standardization=False,
                                  maxIter=40).fit(given)

    models, earlier = [], []
    for name in categories:
        probability = f"p_{name}"
        models.append(learn(training, name, earlier))
        if name != categories[-1]:
            parts = [_score(training.filter(F.col("fold") == k), learn(training.filter(F.col("fold") != k), name, earlier),
                            earlier, probability) for k in range(folds)]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            training = saved(whole, f"chain_{name}")
        earlier = [*earlier, probability]
    return models


def apply_chain(rows: DataFrame, models: list[LogisticRegressionModel], categories: list[str] = CATEGORIES) -> DataFrame:
    """Adds the probability p_<category> of each category to rows with `words`, in one pass."""
    earlier: list[str] = []
    for name, model in zip(categories, models):
        rows = _score(rows, model, earlier, f"p_{name}")
        earlier.append(f"p_{name}")
    return rows.drop("words")


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", limit: int = TRAINING_ROWS) -> DataFrame:
    """A hashed sample of about `limit` labelled documents with `terms`, `fold` and the categories, saved.

    Labels with a null key or a null `toxic` are left out; of several labels of a key the highest counts,
    of documents with one key the text that sorts first.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col(key).alias("key")).agg(F.max("toxic").cast("double").alias("toxic"))
    known = saved(known, "toxic_labels")
    share = min(1.0, limit / max(1, known.count()))
    # At most about `limit` rows of two numbers: small enough to send to every task.
    chosen = F.broadcast(known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000))
    found = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("body")).join(chosen, "key")
    one = found.groupBy("key", "toxic").agg(F.min("body").alias("body"))
    says = lambda words: F.lower("body").rlike(r"(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])").cast("double")
    weak = one.withColumns({"insult": F.col("toxic") * says(INSULTS), "contempt": F.col("toxic") * says(CONTEMPT),
                            "fold": F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS))})
    return saved(weak.withColumn("terms", terms(F.col("body"))).drop("body"), "toxic_terms")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.3,
          limit: int = TRAINING_ROWS) -> DataFrame:
    """`key`, p_insult, p_contempt, p_toxic (doubles from 0 to 1) and toxic (boolean) of every document.

    The chain and its terms are fitted on a sample of about `limit` labelled documents and applied to all
    whole texts without a shuffle. Where labels are missing or of one class only, p_toxic is the share of toxic labels
    (0.0 without labels), and so are the others. Null and empty texts are judged like texts without words; null
    and repeated keys each keep their rows. Other columns are ignored. No rows give no rows.
    """
    training = training_rows(docs, labels, key, limit)
    rows = docs.select(F.col(key), terms(F.col("text")).alias("terms"))
    share = training.agg(F.avg("toxic")).first()[0] or 0.0
    if 0 < share < 1:
        vocabulary = choose_terms(training)
        models = fit_chain(saved(_vectors(training, vocabulary), "toxic_training"))
        scored = apply_chain(_vectors(rows, vocabulary), models)
    else:
        scored = rows.withColumns({f"p_{c}": F.lit(float(share)) for c in CATEGORIES})
    return scored.select(key, *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= threshold).alias("toxic"))
