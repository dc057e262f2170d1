"""G4m: trees of a forest, each grown whole by one task over groups of rows.

A tree sees a column as one of few bins, so rows of the same bins and label are
one group with their number.  Every task has all groups (the caller bounds their
number), draws for its tree the Poisson counts that a bootstrap gives them, and
grows it level by level from counts of bins.  Rules of growth (Gini gain, a random
share of the columns a node, least rows of a leaf, leaves of one parent that
predict the same put together) and the written form are those of the library's forest, which
reads the trees back as its own model.
"""

from __future__ import annotations

import json
import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import SparkSession

from mailspark.session import scratch_dir

#: nodes whose counts a tree takes at a time, and the least gain that is no rounding
NODES, LEAST_GAIN = 2048, 1e-12
#: of a written tree
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE_SQL = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
             "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def _inside(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity of counts a class (last axis); 0 without rows."""
    n = counts.sum(axis=-1)
    return n - (counts * counts).sum(axis=-1) / np.maximum(n, 1.0)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, least: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree of groups with bins ``x``, classes ``y`` and counts ``w``: per node ``counts`` a class,
    ``feature`` (-1: a leaf), ``bin`` (up to it goes left), ``gain`` and ``left`` (the right child is the next
    number).  Children have larger numbers than their parent."""
    cols = x.shape[1]
    some, bins = math.ceil(math.sqrt(cols)), x.max(axis=0).astype(np.int64) + 1 if len(x) else np.ones(cols, dtype=np.int64)
    rows = np.flatnonzero(w > 0)
    counts = [np.bincount(y[rows], weights=w[rows], minlength=classes)[None, :]]
    splits: list[tuple] = []
    made = 1
    # groups, their node (from 0), numbers and counts of these nodes, level
    todo = [(rows, np.zeros(len(rows), dtype=np.int64), np.zeros(1, dtype=np.int64), counts[0], 0)] if depth > 0 and _inside(counts[0])[0] > 0 else []
    while todo:
        rows, of, ids, total, level = todo.pop()
        k = len(ids)
        n, inside = total.sum(axis=1), _inside(total)
        seen = np.zeros((k, cols), dtype=bool)
        np.put_along_axis(seen, rng.random((k, cols)).argsort(axis=1)[:, :some], True, axis=1)
        gain, feature, border = np.full(k, LEAST_GAIN), np.full(k, -1), np.zeros(k, dtype=np.int64)
        for f in range(cols):
            own = np.flatnonzero(seen[:, f])
            if bins[f] < 2 or not len(own):
                continue
            place = np.full(k, -1)
            place[own] = np.arange(len(own))
            p = place[of]
            here = np.flatnonzero(p >= 0)
            r = rows[here]
            size = len(own) * bins[f] * classes
            left = np.bincount((p[here] * bins[f] + x[r, f]) * classes + y[r], weights=w[r], minlength=size) \
                .reshape(len(own), bins[f], classes).cumsum(axis=1)[:, :-1]
            right = total[own][:, None, :] - left
            gains = (inside[own][:, None] - _inside(left) - _inside(right)) / n[own][:, None]
            gains[(left.sum(axis=2) < least) | (right.sum(axis=2) < least)] = -1.0
            at = gains.argmax(axis=1)
            best = gains[np.arange(len(own)), at]
            better = best > gain[own]
            gain[own[better]], feature[own[better]], border[own[better]] = best[better], f, at[better]
        cut = np.flatnonzero(feature >= 0)
        if not len(cut):
            continue
        first = made + 2 * np.arange(len(cut))
        splits.append((ids[cut], feature[cut], border[cut], gain[cut], first))
        made += 2 * len(cut)
        place = np.full(k, -1)
        place[cut] = np.arange(len(cut))
        p = place[of]
        here = np.flatnonzero(p >= 0)
        rows, of, p = rows[here], of[here], p[here]
        child = 2 * p + (x[rows, feature[of]] > border[of])
        held = np.bincount(child * classes + y[rows], weights=w[rows], minlength=2 * len(cut) * classes).reshape(-1, classes)
        counts.append(held)
        if level + 1 == depth:
            continue
        on = np.flatnonzero(_inside(held) > 0)
        place = np.full(len(held), -1)
        place[on] = np.arange(len(on))
        p = place[child]
        for a in range(0, len(on), NODES):
            part = np.flatnonzero((p >= a) & (p < a + NODES))
            own = on[a:a + NODES]
            todo.append((rows[part], p[part] - a, made - len(held) + own, held[own], level + 1))
    tree = {"counts": np.concatenate(counts), "feature": np.full(made, -1), "bin": np.zeros(made, dtype=np.int64),
            "gain": np.full(made, -1.0), "left": np.full(made, -1)}
    for ids, feature, border, gain, first in splits:
        tree["feature"][ids], tree["bin"][ids], tree["gain"][ids], tree["left"][ids] = feature, border, gain, first
    return _pruned(tree)


def _pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Leaves of one parent that predict the same are put together, and the nodes numbered anew."""
    says, left, leaf = tree["counts"].argmax(axis=1), tree["left"], tree["feature"] < 0
    for i in np.flatnonzero(~leaf)[::-1]:
        a = left[i]
        leaf[i] = leaf[a] and leaf[a + 1] and says[a] == says[a + 1]
    kept = np.zeros(len(leaf), dtype=bool)
    kept[0] = True
    for i in np.flatnonzero(~leaf):
        kept[left[i]] = kept[left[i] + 1] = kept[i]
    number = np.cumsum(kept) - 1
    out = {c: v[kept] for c, v in tree.items()}
    end = leaf[kept]
    out["feature"], out["gain"] = np.where(end, -1, out["feature"]), np.where(end, -1.0, out["gain"])
    out["left"] = np.where(end, -1, number[np.maximum(out["left"], 0)])
    return out


def _written(t: int, tree: dict[str, np.ndarray], borders: list[list[float]]) -> pa.RecordBatch:
    counts, feature, end = tree["counts"], tree["feature"], tree["feature"] < 0
    n = counts.sum(axis=1)
    edges = [[] if f < 0 else [borders[f][b]] for f, b in zip(feature.tolist(), tree["bin"].tolist())]
    split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), pa.array(edges, pa.list_(pa.float64())),
                                        pa.array(np.full(len(n), -1), pa.int32())], fields=list(_SPLIT))
    node = {"id": pa.array(np.arange(len(n)), pa.int32()), "prediction": pa.array(counts.argmax(axis=1).astype(np.float64)),
            "impurity": pa.array(_inside(counts) / np.maximum(n, 1.0)), "impurityStats": pa.array(counts.tolist(), pa.list_(pa.float64())),
            "rawCount": pa.array(n.astype(np.int64)), "gain": pa.array(tree["gain"]), "leftChild": pa.array(tree["left"], pa.int32()),
            "rightChild": pa.array(np.where(end, -1, tree["left"] + 1), pa.int32()), "split": split}
    return pa.RecordBatch.from_pydict({"treeID": pa.array(np.full(len(n), t), pa.int32()),
                                       "nodeData": pa.StructArray.from_arrays(list(node.values()), list(node))})


def fit(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: np.ndarray, borders: list[list[float]], classes: int,
        settings: RandomForestClassifier) -> RandomForestClassificationModel:
    """The library's model, its trees grown over groups of ``n`` rows with bins ``x`` and class ``y``."""
    trees, depth, least, seed = settings.getNumTrees(), settings.getMaxDepth(), settings.getMinInstancesPerNode(), settings.getSeed()
    held = spark.sparkContext.broadcast((x, y, n))

    def run(batches):
        groups = held.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                # by the number of the tree: the same in a task that runs again
                rng = np.random.Generator(np.random.Philox(key=[seed & ((1 << 64) - 1), t]))
                yield _written(t, grow(groups[0], groups[1], rng.poisson(groups[2]).astype(np.float64), classes, depth, least, rng), borders)
    path, parts = scratch_dir(spark, "forest"), min(trees, 2 * spark.sparkContext.defaultParallelism)
    spark.range(0, trees, 1, parts).mapInArrow(run, _NODE_SQL).write.parquet(f"{path}/data")
    held.destroy()

    def about(kind: str, own: set | None = None, **more) -> str:
        def of(values: dict) -> dict:
            return {p.name: v for p, v in values.items() if own is None or p.name in own}
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}ClassificationModel", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": of(settings._paramMap),
                           "defaultParamMap": of(settings._defaultParamMap), "numFeatures": x.shape[1], "numClasses": classes, **more})
    of_tree = {"labelCol", "featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol", "maxDepth", "seed"}
    spark.createDataFrame([(t, about("DecisionTree", of_tree), 1.0) for t in range(trees)], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(about("RandomForest", numTrees=trees),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
