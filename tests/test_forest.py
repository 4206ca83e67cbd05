"""The forests of all folds: splits against brute force, shared passes, no row of a fold in its own model."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hearthpanel.operators import estimation, forest

FOLDS = 4
SCHEMA = "pid long, year int, dep_var double, a int, b double, c double, d int, personweight double"


def _rows(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c, d = rng.randrange(5), rng.random(), rng.gauss(0, 1), rng.randrange(2)
        label = 2.0 if b > 0.6 and rng.random() < 0.9 else float(a > 2) if rng.random() < 0.85 else float(d)
        rows.append((i // 2, 2000 + i % 2, label, a, b, c, d, 1.0 + rng.random()))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(3000), SCHEMA).cache()


def _packed(df, parts=1):
    rows = estimation.person_folds(df, FOLDS)
    names = estimation.feature_names(df)
    cuts = forest.cut_points(rows, names)
    return forest.pack(rows, names, cuts, "personweight", 700, parts).persist(), cuts


def _unpacked(units):
    for u in units.collect():
        n = u.n
        yield u.unit, np.frombuffer(u.bins, np.uint8).reshape(-1, n), np.frombuffer(u.label, np.uint8), np.frombuffer(u.fold, np.uint16), np.frombuffer(u.weight, float)


def test_bins_hold_every_row_and_cuts_lie_between_values(frame):
    units, cuts = _packed(frame)
    assert cuts[0] == [0.5, 1.5, 2.5, 3.5] and cuts[3] == [0.5] and 25 < len(cuts[1]) < 32
    assert sum(u.n for u in units.collect()) == 3000 and max(u.n for u in units.collect()) <= 700
    got = sorted(x for _, bins, *_ in _unpacked(units) for x in bins[1].tolist())
    assert got == sorted(sum(r.b > c for c in cuts[1]) for r in frame.collect())


def test_splits_are_the_best_ones_over_the_drawn_rows_of_the_other_folds(frame):
    units, cuts = _packed(frame)
    sizes = [len(c) + 1 for c in cuts]
    grown = forest.grow(units, 1, [0, 1, 2, 3], FOLDS, 3, 3, sizes, 3, 7)
    for model in range(FOLDS):
        for tree in range(3):
            parts = []
            for unit, bins, label, fold, weight in _unpacked(units):
                drawn = weight * np.random.default_rng([7, 0, tree, unit]).poisson(1.0, len(label))
                keep = fold != model
                parts.append((bins[:, keep], label[keep], drawn[keep]))
            bins, label, w = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
            inside = {1: w > 0}
            gini = lambda at: 1 - sum((w[at & (label == k)].sum() / w[at].sum()) ** 2 for k in range(3)) if w[at].sum() > 0 else 0.0
            for place, (weights, gain, feature, cut) in sorted(grown[model][tree].items()):
                at = inside[place]
                assert weights == pytest.approx([w[at & (label == k)].sum() for k in range(3)])
                if place >= 8:
                    continue
                gains = {}
                for f in forest.node_features(7, tree, place, 4):
                    for c in range(sizes[f] - 1):
                        low, high = at & (bins[f] <= c), at & (bins[f] > c)
                        if low.any() and high.any():
                            gains[f, c] = gini(at) - (w[low].sum() * gini(low) + w[high].sum() * gini(high)) / w[at].sum()
                if feature < 0:
                    assert max(gains.values(), default=0) < 1e-9 or gini(at) < 1e-9
                else:
                    assert gain == pytest.approx(gains[feature, cut]) and gain == pytest.approx(max(gains.values()))
                    inside[2 * place], inside[2 * place + 1] = at & (bins[feature] <= cut), at & (bins[feature] > cut)


def test_folds_that_split_alike_are_summed_once(spark, monkeypatch):
    # clear splits, the same in every fold: a node is one node for all of them
    rows = [(i, 2000, float(i % 8 // 2), i % 8 // 4, float(i % 4 // 2), float(i % 2), i % 2, 1.0) for i in range(1600)]
    units, cuts = _packed(spark.createDataFrame(rows, SCHEMA))
    seen, best = [], forest._best
    monkeypatch.setattr(forest, "_best", lambda nodes, *a: seen.append(len(nodes)) or best(nodes, *a))
    grown = forest.grow(units, 1, list(range(FOLDS)), FOLDS, 5, 3, [len(c) + 1 for c in cuts], 4, 1)
    one = sum(p < 8 and t[p][2] >= 0 for t in grown[0] for p in t)
    assert seen[0] == 5 and sum(seen) < 2.5 * one
    assert len(grown) == FOLDS


def test_no_row_of_a_fold_is_in_its_model_and_parts_of_the_trees_change_nothing(spark, frame):
    text = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    before = estimation.cv_multiclass(frame, folds=FOLDS, trees=4, depth=4)
    mine = estimation.person_folds(frame, FOLDS).withColumn("dep_var", F.when(F.col("fold") == 2, (F.col("dep_var") + 1) % 3).otherwise(F.col("dep_var"))).drop("fold")
    after = estimation.cv_multiclass(mine, folds=FOLDS, trees=4, depth=4)
    assert text(before[2]) == text(after[2])
    assert all(text(before[k]) != text(after[k]) for k in (0, 1, 3))
    sizes = lambda cuts: [len(c) + 1 for c in cuts]
    whole, shared = (forest.grow(u, p, [1, 3], FOLDS, 4, 3, sizes(c), 3, 1) for p in (1, 3) for u, c in [_packed(frame, p)])
    plain = lambda g: {m: [{p: v[1:] for p, v in t.items()} for t in ts] for m, ts in g.items()}
    assert plain(whole).keys() == plain(shared).keys()
    assert all({p: v[1:] for p, v in t.items()} == {p: v[1:] for p, v in u.items()} for m in whole for t, u in zip(whole[m], shared[m]))


def test_the_model_is_as_good_as_that_of_a_single_forest(spark, frame):
    fold = estimation.person_folds(frame, FOLDS)
    model = estimation.cv_multiclass(frame, folds=FOLDS, trees=20, depth=5, only=[1])[1]
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(fold)
    single = RandomForestClassifier(numTrees=20, maxDepth=5, seed=2020, **estimation.COMMON).fit(rows.filter("fold != 1"))
    right = lambda df: df.filter("fold = 1").agg(F.avg((F.col("prediction") == F.col("dep_var")).cast("int"))).first()[0]
    assert model.stages[-1].getNumTrees == 20 and model.stages[-1].numClasses == 3
    assert right(estimation.predict(model, fold)) > right(single.transform(rows)) - 0.03
    shares = model.stages[-1].featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == single.featureImportances.toArray().argmax()


def test_each_fold_is_scored_from_its_own_rows(frame):
    models = estimation.cv_multiclass(frame, folds=FOLDS, trees=2, depth=2)
    scored = estimation.out_of_fold(models, frame, FOLDS)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(fold") == FOLDS and "md5" not in plan
    assert scored.count() == 3000 and scored.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).isEmpty()
    want = {(r.pid, r.year): r.fold for r in estimation.person_folds(frame, FOLDS).collect()}
    assert {(r.pid, r.year): r.fold for r in scored.collect()} == want


@pytest.mark.parametrize("odd", ["dep_var = 0.5", "dep_var = -1", "personweight = -1"])
def test_labels_and_weights_that_no_forest_knows_are_refused(frame, odd):
    name, value = odd.split(" = ")
    with pytest.raises(ValueError, match="1 have no class"):
        estimation.cv_multiclass(frame.withColumn(name, F.when((F.col("pid") == 3) & (F.col("year") == 2000), float(value)).otherwise(F.col(name))), folds=2, trees=1, depth=1)
