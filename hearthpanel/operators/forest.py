"""Random forests of all folds of a cross-validation, grown side by side.

The forests of two folds differ by the rows of two folds in ten, and in many rows by few splits. So the trees are
grown over one set of rows, packed once, level by level: a pass sums the weights of every node by feature, bin and
class for each of the forests that still share the node's path, and only where their best splits differ do they part.
As long as they agree, ten forests cost the passes of one. A draw of a row or of a node's features depends on the seed,
the tree and the place only, so a fold's trees are the same whether or not others grow beside them.

The rules are those of Spark's own forest: Poisson draws of rows, the rounded-up root of the features at a node, at
most `BINS` bins of a feature, the gain in Gini impurity, leaves of equal prediction merged. The bins are those of all
rows (their features, not their labels).
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.session import shared_folder

BINS = 32
UNIT_ROWS = 500_000  # rows that a task has in memory, each with a byte per feature
TIE = 1e-10  # gains this near are equal: sums of weights depend on the order of addition
UNIT = "unit long, part int, n int, bins binary, label binary, fold binary, weight binary"
SPLIT = "node long, model int, feature int, bin int, gain double, lower array<double>, upper array<double>"


def cut_points(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Per column the values up to which a bin goes: between the values where these are few, else quantiles of all rows."""
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= BINS]
    many = [c for c in columns if c not in few]
    values = rows.agg(*[F.collect_set(F.col(c).cast("double")).alias(c) for c in few]).first() if few else {}
    cuts = dict(zip(many, rows.approxQuantile(many, [k / BINS for k in range(1, BINS)], 0.001))) if many else {}
    for c in few:
        seen = sorted(values[c])
        cuts[c] = [(a + b) / 2 if math.isfinite(a + b) else a for a, b in zip(seen, seen[1:])]
    return [sorted(set(cuts[c])) for c in columns]


def pack(rows: DataFrame, columns: list[str], cuts: list[list[float]], weight: str, unit_rows: int, parts: int) -> DataFrame:
    """The rows (columns, dep_var, fold, weight) as units of up to `unit_rows`, each `parts` times: a part is a share of the trees."""
    edges = [np.array(c, dtype=float) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def unit(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            column = lambda c, kind: table[c].to_numpy().astype(kind)
            bins = b"".join(np.searchsorted(e, column(c, float), side="left").astype(np.uint8).tobytes() for c, e in zip(columns, edges))
            values = [place * 1_000_000 + made, table.num_rows, bins, *[column(c, k).tobytes() for c, k in (("dep_var", np.uint8), ("fold", np.uint16), (weight, float))]]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            one = dict(zip(("unit", "n", "bins", "label", "fold", "weight"), ([v] for v in values)))
            arrays = {k: pa.array(v, kind) for (k, v), kind in zip(one.items(), kinds)} | {"part": pa.array([0], pa.int32())}
            return pa.RecordBatch.from_pydict({k: arrays[k] for k in ("unit", "part", "n", "bins", "label", "fold", "weight")})

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= unit_rows:
                table = pa.Table.from_batches(held)
                yield unit(table.slice(0, unit_rows))
                held, size = table.slice(unit_rows).to_batches(), size - unit_rows
        if size:
            yield unit(pa.Table.from_batches(held))

    packed = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], "dep_var", "fold", F.col(weight).cast("double").alias(weight)).mapInArrow(run, UNIT)
    return packed if parts == 1 else packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


class Node:
    """A place in the trees of `models`, the folds whose forests have the same splits above it; `place` is 1 at the root, 2 and 3 below."""

    __slots__ = ("id", "tree", "place", "models", "branches")

    def __init__(self, id: int, tree: int, place: int, models: tuple[int, ...]):
        self.id, self.tree, self.place, self.models = id, tree, place, models
        self.branches: list[tuple[int, int, Node | None, Node | None]] = []  # feature, bin, lower and upper child; none where all are leaves


def node_features(seed: int, tree: int, place: int, features: int) -> list[int]:
    """The features a node may be split by."""
    return sorted(np.random.default_rng([seed, 1, tree, place]).choice(features, math.ceil(math.sqrt(features)), replace=False).tolist())


def _tally(roots: list[Node], level: int, sizes: list[int], classes: int, folds: int, parts: int, seed: int):
    """Per unit and node of a level the weights by feature, bin and class, for each model that has the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            n = row["n"]
            bins = np.frombuffer(row["bins"], np.uint8).reshape(len(sizes), n)
            label, fold, weight = (np.frombuffer(row[c], k) for c, k in (("label", np.uint8), ("fold", np.uint16), ("weight", float)))
            label = label.astype(np.int64)
            both = label + classes * fold.astype(np.int64)
            for root in roots[row["part"]::parts]:
                drawn = np.random.default_rng([seed, 0, root.tree, row["unit"]]).poisson(1.0, n)
                weights = weight * drawn
                start = np.flatnonzero(drawn)
                found, waiting = [], [(root, start if len(root.models) > 1 else start[fold[start] != root.models[0]])]
                while waiting:
                    node, at = waiting.pop()
                    if node.place >> level == 1:
                        found.append((node.id, _weights(node, at, bins, label, both, weights).tobytes()))
                        continue
                    for feature, cut, lower, upper in node.branches:
                        if lower is None and upper is None:
                            continue
                        low = bins[feature][at] <= cut
                        for child, side in ((lower, low), (upper, ~low)):
                            if child is not None:
                                here = at[side]
                                waiting.append((child, here[fold[here] != child.models[0]] if len(child.models) == 1 < len(node.models) else here))
                if found:
                    yield pa.RecordBatch.from_pydict({"node": pa.array([i for i, _ in found], pa.int64()), "sums": pa.array([s for _, s in found], pa.binary())})

    def _weights(node: Node, at: np.ndarray, bins, label, both, weights) -> np.ndarray:
        w, alone, out = weights[at], len(node.models) == 1, []
        keys = (label if alone else both)[at]
        width = classes if alone else classes * folds
        others = None if alone else np.array([[float(k != f) for f in range(folds)] for k in node.models])
        for f in node_features(seed, node.tree, node.place, len(sizes)):
            sums = np.bincount(np.multiply(bins[f][at], width, dtype=np.int64) + keys, w, sizes[f] * width)
            if not alone:  # a model has the rows of the other folds
                sums = others @ sums.reshape(sizes[f], folds, classes).transpose(1, 0, 2).reshape(folds, -1)
            out.append(sums.reshape(len(node.models), -1))
        return np.concatenate(out, axis=1)

    return run


def _best(nodes: dict[int, tuple[int, int, tuple[int, ...]]], sizes: list[int], classes: int, seed: int):
    """The best split of every node for each of its models, from the sums of all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, part in zip(batch["node"].to_pylist(), batch["sums"]):
                part = np.frombuffer(part.as_buffer(), float)
                sums[node] = sums[node] + part if node in sums else part.copy()
        rows: list[tuple] = []
        for node, flat in sums.items():
            tree, place, models = nodes[node]
            flat, start = flat.reshape(len(models), -1), 0
            best: list[tuple] = [(None,)] * len(models)
            for f in node_features(seed, tree, place, len(sizes)):
                below = flat[:, start:start + sizes[f] * classes].reshape(len(models), sizes[f], classes).cumsum(axis=1)
                start += sizes[f] * classes
                total, low = below[:, -1], below[:, :-1]
                high = total[:, None, :] - low
                w, wl, wh = total.sum(axis=1), low.sum(axis=2), high.sum(axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = ((low ** 2).sum(axis=2) / wl + (high ** 2).sum(axis=2) / wh) / w[:, None] - ((total ** 2).sum(axis=1) / w ** 2)[:, None]
                gain = np.where((wl > 0) & (wh > 0), gain, -1.0)
                for m in range(len(models)):
                    top = gain[m].max() if sizes[f] > 1 else -1.0
                    if best[m][0] is None:
                        best[m] = (-1.0, -1, -1, total[m], np.zeros(classes))
                    if top > best[m][0] + TIE:
                        cut = int(np.argmax(gain[m] >= top - TIE))
                        best[m] = (float(top), f, cut, low[m, cut], high[m, cut])
            for model, (gain, f, cut, low, high) in zip(models, best):
                rows.append((node, model, f, cut, gain, low.tolist(), high.tolist()))
        names = ("node", "model", "feature", "bin", "gain", "lower", "upper")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        if rows:
            yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, k, v in zip(names, kinds, zip(*rows))})

    return run


def grow(units: DataFrame, parts: int, models: list[int], folds: int, trees: int, depth: int, sizes: list[int], classes: int,
         seed: int) -> dict[int, list[dict[int, tuple]]]:
    """Per model its trees: {place: (class weights, gain, feature, bin)}, with the feature -1 in a leaf."""
    roots = [Node(t, t, 1, tuple(models)) for t in range(trees)]
    grown: dict[int, list[dict[int, tuple]]] = {m: [{} for _ in range(trees)] for m in models}
    front, made = list(roots), trees
    for level in range(depth):
        if not front:
            break
        nodes = {n.id: (n.tree, n.place, n.models) for n in front}
        tallied = units.mapInArrow(_tally(roots, level, sizes, classes, folds, parts, seed), "node long, sums binary").repartition("node")
        splits: dict[int, list] = {}
        for r in tallied.mapInArrow(_best(nodes, sizes, classes, seed), SPLIT).collect():
            splits.setdefault(r.node, []).append(r)
        below = []
        for node in front:
            apart: dict[tuple[int, int], list] = {}
            for r in sorted(splits.get(node.id, []), key=lambda r: r.model):
                tree, low, high = grown[r.model][node.tree], np.array(r.lower), np.array(r.upper)
                if level == 0:
                    tree[1] = (low + high, 0.0, -1, -1)
                if r.gain <= TIE:
                    continue
                tree[node.place] = (tree[node.place][0], r.gain, r.feature, r.bin)
                tree[2 * node.place], tree[2 * node.place + 1] = (low, 0.0, -1, -1), (high, 0.0, -1, -1)
                apart.setdefault((r.feature, r.bin), []).append((r.model, low, high))
            for (feature, cut), members in sorted(apart.items()):
                children: list[Node | None] = []
                for side in (1, 2):
                    mixed = tuple(m[0] for m in members if m[side].max() < m[side].sum() * (1 - TIE))
                    child = Node(made, node.tree, 2 * node.place + side - 1, mixed) if mixed else None
                    made += 1
                    children.append(child)
                    if child is not None:
                        below.append(child)
                node.branches.append((feature, cut, *children))
        front = below
    return grown


def _numbered(tree: dict[int, tuple], cuts: list[list[float]]) -> list[dict]:
    """The nodes of a tree as Spark writes them, in pre-order; two leaves of equal prediction become one."""
    leaf = {p: v[2] < 0 for p, v in tree.items()}
    says = {p: float(np.argmax(v[0])) for p, v in tree.items()}
    for p in sorted(tree, reverse=True):
        if not leaf[p] and leaf[2 * p] and leaf[2 * p + 1] and says[2 * p] == says[2 * p + 1]:
            leaf[p], says[p] = True, says[2 * p]
    rows: list[dict] = []

    def visit(p: int) -> int:
        weights, gain, feature, cut = tree[p]
        total, mine = weights.sum(), len(rows)
        row = {"id": mine, "prediction": says[p], "impurity": float(1 - ((weights / total) ** 2).sum()) if total > 0 else 0.0, "impurityStats": weights.tolist(),
               "rawCount": -1, "gain": -1.0, "leftChild": -1, "rightChild": -1,  # -1: not counted
               "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        rows.append(row)
        if not leaf[p]:
            row |= {"gain": gain, "split": {"featureIndex": feature, "leftCategoriesOrThreshold": [cuts[feature][cut]], "numCategories": -1}}
            row["leftChild"], row["rightChild"] = visit(2 * p), visit(2 * p + 1)
        return mine

    visit(1)
    return rows


_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
                   ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                   ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


class Shared:
    """What the fits of several folds have in common: the packed rows, and the trees once the first fit has grown them."""

    def __init__(self, units: DataFrame, parts: int, models: list[int], folds: int, cuts: list[list[float]], classes: int):
        self.units, self.parts, self.models, self.folds, self.cuts, self.classes = units, parts, models, folds, cuts, classes
        self.grown, self.lock = None, Lock()

    def trees(self, model: int, trees: int, depth: int, seed: int) -> list[dict[int, tuple]]:
        with self.lock:
            if self.grown is None:
                self.grown = grow(self.units, self.parts, self.models, self.folds, trees, depth, [len(c) + 1 for c in self.cuts], self.classes, seed)
        return self.grown[model]


@contextmanager
def packed_rows(train: DataFrame, columns: list[str], weight: str, models: list[int], folds: int, trees: int) -> Iterator[Shared]:
    """The rows (columns, dep_var, fold, weight) ready for the fits of `models`, in as many tasks as keep every core busy."""
    rows, units = train.select(*columns, "dep_var", weight, "fold").persist(), None
    try:
        y, w = F.col("dep_var"), F.col(weight)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(y).alias("top"), F.count_if((y < 0) | (y != F.floor(y)) | (y >= 100) | ~(w >= 0)).alias("odd")).first()
        if not size.n or size.odd:
            raise ValueError(f"of {size.n} rows {size.odd} have no class 0 to 99 or a negative weight")
        tasks = -(-size.n // UNIT_ROWS)
        parts = max(1, min(trees, -(-2 * train.sparkSession.sparkContext.defaultParallelism // tasks)))
        cuts = cut_points(rows, columns)
        units = pack(rows, columns, cuts, weight, UNIT_ROWS, parts).repartition(tasks * parts).persist()
        yield Shared(units, parts, models, folds, cuts, int(size.top) + 1)
    finally:
        rows.unpersist()
        if units is not None:
            units.unpersist()


class FoldForest(RandomForestClassifier):
    """The forest of one fold, on the rows of the others; its model is Spark's."""

    def __init__(self, shared: Shared, fold: int, **params):
        super().__init__(**params)
        self.shared, self.fold = shared, fold

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark, s = dataset.sparkSession, self.shared
        trees = s.trees(self.fold, self.getNumTrees(), self.getMaxDepth(), self.getSeed())
        if any(1 not in t for t in trees):
            raise ValueError(f"a tree of fold {self.fold} has no rows")
        named = lambda values, drop=(): {p.name: v for p, v in values.items() if p.name not in drop}
        said, default = named(self._paramMap), named(self._defaultParamMap)
        about = lambda kind, uid, said, default, **more: json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000),
                                                                     "sparkVersion": spark.version, "uid": uid, "paramMap": said, "defaultParamMap": default, **more})
        path = f"{shared_folder(spark)}/forests/{uuid4().hex}"
        whole = about("RandomForestClassificationModel", self.uid, said, default, numFeatures=len(s.cuts), numClasses=s.classes, numTrees=len(trees))
        of_forest = {"numTrees", "subsamplingRate", "featureSubsetStrategy", "bootstrap"}
        single = lambda: about("DecisionTreeClassificationModel", f"dtc_{uuid4().hex[:12]}", {k: v for k, v in said.items() if k not in of_forest},
                               {k: v for k, v in default.items() if k not in of_forest})
        numbered = [(k, row) for k, t in enumerate(trees) for row in _numbered(t, s.cuts)]
        table = pa.table({"treeID": pa.array([k for k, _ in numbered], pa.int32()), "nodeData": pa.array([r for _, r in numbered], _NODE)})
        order = range(len(trees))
        written = {"treesMetadata": pa.table({"_1": pa.array(order, pa.int32()), "_2": [single() for _ in order], "_3": [1.0 for _ in order]}), "data": table}
        spark.createDataFrame(pa.table({"value": [whole]})).coalesce(1).write.text(f"{path}/metadata")
        for name, rows in written.items():
            spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/{name}")
        return RandomForestClassificationModel.load(path)
