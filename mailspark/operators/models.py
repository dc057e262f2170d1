"""2.G: model families, cross-validated training and the predictions table.

Every fit is a ``pyspark.ml`` job, or a solver's passes (``network``,
``one_class``), over the fold's training rows; every evaluation is a ``transform`` of the held-out rows.  The per-fold outputs
are unioned into one long ``predictions`` table that the metric queries
(2.H) score in a single job.  Kernel models are re-aimed at linear ones over
mapped features, so training stays a distributed linear fit: a Nystroem map
of landmark rows for the RBF classifier, random Fourier features (Rahimi &
Recht, 2007) for the one-class model.
"""

from __future__ import annotations

import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from mailspark.functions.headers import sigmoid
from mailspark.operators import forest, margin, network, one_class
from mailspark.operators.folds import ham_only, holdout_split, stratified_folds
from mailspark.operators.knn import complete, knn_predict, scaled, scaler
from mailspark.session import checkpoint_dir

MODEL_NAMES = ["RF", "SVM", "MLP", "KNN", "Stacking", "OC_SVM"]
DEFAULTS = {
    "RF": {"numTrees": 100, "maxDepth": None},  # no limit of its own: the library's 30 levels
    "SVM": {"C": 1.0, "n_components": 256, "gamma": None, "calibration": "sigmoid", "calibration_cv": 5},
    "MLP": {"hidden": [100, 50], "maxIter": 300, "validation": 0.1, "round_iter": 20, "patience": 3, "tol": 1e-4},
    "OC_SVM": {"nu": 0.1, "n_components": 256, "gamma": None, "rounds": one_class.ROUNDS},
    "KNN": {"k": 5},
    "Stacking": {"base": ["RF", "MLP", "KNN"], "inner_folds": 5, "passthrough": False, "base_params": {}},
}


# deep trees: keep node ids with the cached training rows (checkpointed every
# 10 levels in the shared checkpoint folder) and split more nodes per pass
RF_TRAINING = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}


#: fits submitted side by side, and bytes of mapped rows that they hold together
PARALLEL_FITS, HELD_BYTES = 8, 1 << 30


def in_parallel(fits: list, most: int = PARALLEL_FITS) -> list:
    """Results of independent fits.  A fit is a chain of small jobs, so several
    (at most ``most``) are submitted at once, as the library's own cross-validator does."""
    submit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=min(most, len(fits))) as pool:
        return list(pool.map(lambda fit: fit(), [submit(f) for f in fits]))


def side_by_side(n_rows: int, width: int) -> int:
    """Fits on ``n_rows`` vectors of ``width`` values that hold ``HELD_BYTES`` at most, but one at least."""
    return max(1, min(PARALLEL_FITS, HELD_BYTES // max(1, 8 * width * n_rows)))


#: bytes of a forest's training rows (two numbers a row and tree) that one task reads at most
FOREST_BYTES = 512 << 20


def _forest_rows(df: DataFrame, num_trees: int) -> DataFrame:
    """``df`` dealt to as many tasks as keep each within ``FOREST_BYTES``, where those of the
    planner, which counts the bytes of the plain columns, may not."""
    parts = -(-df.count() * (8 * num_trees + 200) // FOREST_BYTES)
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df


#: borders of a column and rows that they are taken from: the library's own bins and sample
BINS, BORDER_ROWS = 32, 10_000
#: classes that the library's forest takes at most
MOST_CLASSES = 100
#: rows, and rows of a group on average, from which a forest is grown on groups (a tree then costs its own
#: jobs, as much as its share of a forest's passes over some 300 000 rows), and groups of a task
FOREST_ROWS, LEAST_ROWS, GROUP_ROWS = 1 << 18, 32, 50_000


def _borders(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Midpoints between all values, or where these are more than ``bins`` the midpoints that cut them into equal shares."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) < 2:
        return []
    mid = (v[1:] + v[:-1]) / 2
    if len(v) > bins:
        share = np.cumsum(n)[:-1] / n.sum()
        mid = mid[np.unique([np.abs(share - i / bins).argmin() for i in range(1, bins)])]
    return mid.tolist()


def _binned(cols: list[str], borders: dict[str, list[float]]) -> SQLTransformer:
    """Rows with ``_bin_<column>``, the number of borders below the value; nulls and NaN
    are above all of them, as in the library's bins."""
    def of(c: str, low: int, high: int) -> str:
        """The number, known to be from ``low`` to ``high``, halved at a border."""
        if low == high:
            return f"{low}D"
        mid = (low + high) // 2
        return f"if(cast(`{c}` as double) <= {borders[c][mid]!r}D, {of(c, low, mid)}, {of(c, mid + 1, high)})"
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{of(c, 0, len(borders[c]))} AS `_bin_{c}`" for c in cols) + " FROM __THIS__")


#: rows from which trees are grown in tasks, and groups that a task holds at most (some 100 bytes each)
TREE_ROWS, TREE_GROUPS = 1 << 16, 1 << 20


def fit_forest(train: DataFrame, cols: list[str], num_trees: int, depth: int, seed: int, least: int = 1, grouped: bool = True) -> PipelineModel:
    """G4m: the library's forest, with leaves of ``least`` rows at least.

    Its trees see a column only as one of ``BINS`` bins.  Rows of the same bins and
    label are therefore one row with their number, from which each tree draws its own
    Poisson count (what the bootstrap gives their rows together).  As far as a task holds all
    groups, each tree is grown whole by one task (``forest``).  Beyond, a pass of a tree costs
    groups, not rows.  Few rows, and rows that hardly share their bins, go to the forest themselves."""
    def settings(trees: int) -> RandomForestClassifier:
        return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=least,
                                      featureSubsetStrategy="sqrt", seed=seed, **RF_TRAINING)

    def on_rows() -> PipelineModel:
        model = settings(num_trees).fit(_forest_rows(_vec(train, cols).select("label", "features"), num_trees))
        return PipelineModel([VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), model])
    # values and labels that the library refuses are left to it
    fine = F.coalesce((F.col("label") >= 0) & (F.col("label") < MOST_CLASSES) & (F.floor("label") == F.col("label")), F.lit(False))
    for c in cols:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < math.inf, F.lit(False))
    n_rows, n_fine = train.agg(F.count(F.lit(1)), F.count_if(fine)).first()
    if n_rows < min(TREE_ROWS, FOREST_ROWS) or n_fine < n_rows:
        return on_rows()
    sample = train.select(*cols).sample(min(1.0, BORDER_ROWS / n_rows), seed).toArrow()
    borders = {c: _borders(np.array(sample.column(c).to_numpy(), dtype=np.float64)) for c in cols}
    bins, names = _binned(cols, borders), [f"_bin_{c}" for c in cols]
    groups = bins.transform(train.select("label", *cols)).groupBy("label", *names).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n_groups, top = groups.agg(F.count(F.lit(1)), F.max("label")).first()
    n_classes = max(2, int(top) + 1)
    if n_rows >= TREE_ROWS and n_groups <= TREE_GROUPS:
        # in one order: the draws are by place
        held = groups.orderBy("label", *names).select(F.col("label").cast("tinyint"), *[F.col(c).cast("tinyint") for c in names], "_n").toArrow()
        x = np.column_stack([held.column(c).to_numpy() for c in names]).astype(np.uint8)
        model = forest.fit(train.sparkSession, x, held.column("label").to_numpy().astype(np.int64), held.column("_n").to_numpy(),
                           [borders[c] for c in cols], n_classes, settings(num_trees))
        return PipelineModel([VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), model])
    if n_groups * LEAST_ROWS > n_rows or not grouped:
        return on_rows()

    def draw(key: pa.Array, n: pa.Array) -> pa.Array:
        # by the group's own key: the same in a task that runs again
        return pa.array([np.random.Generator(np.random.Philox(key=k & ((1 << 64) - 1))).poisson(m, num_trees)
                         for k, m in zip(key.to_pylist(), n.to_pylist())], type=pa.list_(pa.int64()))
    together = VectorAssembler(inputCols=names, outputCol="features")
    drawn = together.transform(groups).select("label", "features", F.arrow_udf(draw, "array<bigint>")(
        F.xxhash64("label", *names, F.lit(seed)), "_n").alias("_draws")).coalesce(-(-n_groups // GROUP_ROWS)).checkpoint()
    classes = [str(i) for i in range(n_classes)]

    def tree(t: int):
        rows = drawn.select("label", "features", F.col("_draws")[t].cast("double").alias("_w")).where("_w > 0") \
            .withMetadata("label", {"ml_attr": {"type": "nominal", "vals": classes}})
        one = settings(1).setBootstrap(False).setWeightCol("_w").setSeed(seed + t).setCacheNodeIds(False)
        return one.fit(rows)._java_obj.trees()[0]
    trees = in_parallel([lambda t=t: tree(t) for t in range(num_trees)])
    # the trees put together as the library's model
    sc = train.sparkSession.sparkContext
    library = sc._jvm.org.apache.spark.ml.classification
    held = sc._gateway.new_array(library.DecisionTreeClassificationModel, num_trees)
    for i, t in enumerate(trees):
        held[i] = t
    model = library.RandomForestClassificationModel(f"forest_{uuid.uuid4().hex[:12]}", held, len(cols), len(classes))
    return PipelineModel([bins, together, RandomForestClassificationModel(model)])


def _vec(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(
        df.withColumns({c: F.col(c).cast("double") for c in cols}))


def _fourier(n_columns: int, n_components: int, gamma: float, seed: int = 42):
    """x -> z(x) = sqrt(2/D) cos(x W + b), W ~ N(0, 2 gamma), on matrices of rows."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, n_columns)).T
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return lambda x: math.sqrt(2.0 / n_components) * _cosine(x @ w + b)


#: values whose cosines are taken at a time: as many as stay near the processor
NEAR_VALUES = 1 << 16
#: sin(u) = u (1 - u^2 / 3! + u^4 / 5! - ...), to 1e-16 for u within a quarter turn
_SINE = [(-1.0) ** i / math.factorial(2 * i + 1) for i in range(12)]


def _cosine(z: np.ndarray) -> np.ndarray:
    """cos(z) of a matrix, in place, to about 1e-15 (angles of moderate size): 1 - 2 sin(u)^2
    with u half the angle within a turn.  Numpy's own takes each value by itself, many times as slow."""
    step = max(1, NEAR_VALUES // max(1, z.shape[1]))
    for a in range(0, len(z), step):
        u = z[a:a + step]
        turns = np.round(u * (1.0 / (2.0 * math.pi)))
        turns *= 2.0 * math.pi
        u -= turns
        u *= 0.5
        square = np.multiply(u, u, out=turns)
        sine = np.full_like(u, _SINE[-1])
        for c in _SINE[-2::-1]:
            sine *= square
            sine += c
        sine *= u
        sine *= sine
        sine *= -2.0
        np.add(sine, 1.0, out=u)
    return z


def _matrix_udf(fn, cols: list[str], returns: str):
    """Column from ``fn`` over the matrix of a batch's ``cols``: one matrix product per Arrow batch."""
    def run(*parts: pa.Array) -> pa.Array:
        x = np.column_stack([p.cast(pa.float64()).to_numpy(zero_copy_only=False) for p in parts])
        z = fn(x)
        if z.ndim == 1:
            return pa.array(z)
        return pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], z.ravel())
    return F.arrow_udf(run, returns)(*[F.col(c) for c in cols])


#: rows of the sample that landmarks are chosen from, for each landmark
CANDIDATES = 8


def _kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(far, 0.0))


def choose_landmarks(rows: np.ndarray, n: int, gamma: float) -> np.ndarray:
    """Numbers of at most ``n`` rows by pivoted Cholesky: the next landmark is
    the row that the ones before it explain least."""
    left = np.ones(len(rows))
    factor, chosen = np.zeros((len(rows), 0)), []
    while len(chosen) < min(n, len(rows)) and left.max() > 1e-8:
        at = int(left.argmax())
        column = (_kernel(rows, rows[at:at + 1], gamma)[:, 0] - factor @ factor[at]) / math.sqrt(left[at])
        factor = np.column_stack([factor, column])
        left = np.maximum(left - column * column, 0.0)
        left[at] = 0.0
        chosen.append(at)
    return np.array(chosen, dtype=np.int64)


def _nystroem(train: DataFrame, cols: list[str], n_components: int, gamma: float):
    """x -> z(x) with z(x) . z(y) near the kernel of x and y; exact where the
    distinct rows are no more than the landmarks.  The sample is the distinct
    rows with the least hashes, ``CANDIDATES`` for each landmark; ``train`` has no nulls."""
    distinct = train.select(*cols).distinct()
    sample = distinct.orderBy(F.xxhash64(*cols), *cols).limit(CANDIDATES * n_components).collect()
    if not sample:
        raise ValueError("the kernel model needs rows without nulls")
    rows = np.array([list(r) for r in sample], dtype=np.float64)
    landmarks = rows[choose_landmarks(rows, n_components, gamma)]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks, gamma))
    used = values > 1e-10 * values.max()
    to = vectors[:, used] / np.sqrt(values[used])
    return lambda x: _kernel(x, landmarks, gamma) @ to


def _mapped(df: DataFrame, cols: list[str], fn) -> DataFrame:
    """``fn`` of the matrix of ``cols`` as the vector column ``features``."""
    return df.withColumn("features", array_to_vector(_matrix_udf(fn, cols, "array<double>")))


#: rows of a task in solvers that read their rows again and again
ROUND_ROWS = 20_000
#: rows from which a network is trained by small steps
PASS_ROWS = 1 << 16


def fit_mlp(rows: DataFrame, layers: list[int], p: dict, seed: int):
    """G9m: a network with early stopping, and its history.

    ``rows(mail_id, label, features)``.  A stratified share ``validation`` of
    the rows is held out.  Training runs in rounds of ``round_iter`` steps that
    start from the weights of the round before; it stops after ``patience``
    rounds without a gain of ``tol`` in held-out accuracy, or when a round
    converged, and the best round's model is kept.  From ``PASS_ROWS`` rows on a round is one
    step: a pass over all rows in small steps.  The history has (round, steps, held-out accuracy, kept)."""
    split = holdout_split(rows.select("mail_id", "label"), p["validation"], seed)
    held = rows.join(split.select("mail_id", "is_test"), "mail_id").select("label", "features", "is_test")
    # dealt by their number: the planner would put a few bytes a row into few tasks
    n_rows = rows.count()
    held = held.repartition(max(1, -(-n_rows // ROUND_ROWS))).cache()
    fit, check = network.blocks(held.where("is_test = 0")), network.blocks(held.where("is_test = 1"))

    def model(start: np.ndarray | None = None):
        """The library's model of these weights; without any, of those that it starts from."""
        mlp = MultilayerPerceptronClassifier(labelCol="label", featuresCol="features", layers=layers, maxIter=0, seed=seed)
        if start is not None:
            mlp.setInitialWeights(Vectors.dense(start))
        return mlp.fit(rows.sparkSession.createDataFrame([(0.0, Vectors.dense([0.0] * layers[0]))], ["label", "features"]))
    loss, weights = network.mean_loss(fit, layers), model().weights.toArray()
    # as many states as tasks run at a time
    state, dealt = network.start(weights), fit.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    history, best, steps, stale = [], None, 0, 0
    while steps < p["maxIter"] and stale < p["patience"]:
        if n_rows >= PASS_ROWS:
            n = taken = 1
            state = network.small_steps(dealt, state, layers, seed)
            weights = state[0]
        else:
            n = min(p["round_iter"], p["maxIter"] - steps)
            weights, taken = network.descend(loss, weights, n)
        steps += n
        score = network.accuracy(check, weights, layers)
        stale = 0 if best is None or score > history[best[0]][2] + p["tol"] else stale + 1
        if best is None or score > history[best[0]][2]:
            best = len(history), weights
        history.append((len(history), steps, score))
        if taken < n - 1:
            break
    for kept in (fit, check, held):
        kept.unpersist()
    return model(best[1]), [(*h, h[0] == best[0]) for h in history]


def _prob1(df: DataFrame) -> DataFrame:
    return df.withColumn("y_prob", vector_to_array("probability")[1])


def fit_predict(model: str, train: DataFrame, test: DataFrame, cols: list[str],
                params: dict | None = None, seed: int = 42) -> DataFrame:
    """G4m-G11m, G19m: fit one model on ``train``, score ``test``.

    Returns test rows with ``y_pred`` (int) and ``y_prob`` (probability of
    class 1 or a sigmoid confidence)."""
    p = {**DEFAULTS.get(model, {}), **(params or {})}
    if model == "RF":
        depth = 30 if p["maxDepth"] is None else p["maxDepth"]
        if depth > 30:
            raise ValueError("the library's trees have at most 30 levels")
        m = fit_forest(train, cols, p["numTrees"], depth, seed)
        out = _prob1(m.transform(test)).drop(*[f"_bin_{c}" for c in cols])
    elif model == "MLP":
        tr, te = scaled(train, test, cols)
        m, _ = fit_mlp(_vec(tr, cols).select("mail_id", "label", "features"), [len(cols), *p["hidden"], 2], p, seed)
        out = _prob1(m.transform(_vec(te, cols)))
    elif model == "SVM":
        apply = scaler(train, cols)
        tr, te = apply(train), apply(test)
        gamma = p["gamma"] or 1.0 / max(len(cols), 1)
        to = _nystroem(apply(train.where(complete(cols))), cols, p["n_components"], gamma)
        tef, k = _mapped(te, cols, to), p["calibration_cv"] or 0
        # the columns only are kept: mapped values are many times as large, and each fit holds its own
        trf = tr.select(*(["mail_id"] if k > 1 else []), "label", *cols).cache()

        if k > 1 and p["calibration"] == "sigmoid" and _plain(train, cols):
            dealt = stratified_folds(trf, k=k, seed=seed, salt="calibration").select("label", "fold", *cols)
            probability = margin.fit(dealt.repartition(max(1, -(-trf.count() // ROUND_ROWS))), cols, to, k, p["C"])
            trf.unpersist()
            out = te.withColumn("y_prob", _matrix_udf(probability, cols, "double"))
            return out.withColumn("prediction", (F.col("y_prob") > 0.5).cast("double")).withColumn("y_pred", F.col("prediction").cast("int"))

        def mapped_fit(fit_rows, cal_rows):
            return _svm_fit(_mapped(fit_rows, cols, to).select("label", "features"),
                            _mapped(cal_rows, cols, to).select("label", "features"), p)
        if k > 1:
            # k fits, each calibrated on its held-out part, probabilities averaged
            inner = stratified_folds(trf, k=k, seed=seed, salt="calibration").cache()
            fitted = in_parallel([lambda f=f: mapped_fit(inner.where(F.col("fold") != f), inner.where(F.col("fold") == f))
                                  for f in range(k)], side_by_side(trf.count(), p["n_components"]))
            inner.unpersist()
        else:
            fitted = [mapped_fit(trf, trf)]
        trf.unpersist()
        names = [f"_p{i}" for i in range(len(fitted))]
        out = tef
        for name, probability in zip(names, fitted):
            out = probability(out, name)
        mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
        out = out.withColumn("y_prob", mean).drop("features", *names) \
            .withColumn("prediction", (F.col("y_prob") > 0.5).cast("double"))
    elif model == "OC_SVM":
        # the model of class 0; score = w . z - rho, rho = nu-quantile of the training scores; outlier (score < 0) -> 1
        tr, te = scaled(ham_only(train), test, cols)
        # read once a round, by few tasks where there are few rows
        tr = tr.select(*cols).checkpoint()
        tr = tr.coalesce(max(1, -(-tr.count() // ROUND_ROWS))).checkpoint()
        gamma = p["gamma"] or 1.0 / max(len(cols), 1)
        fourier = _fourier(len(cols), p["n_components"], gamma, seed)
        w, _ = one_class.solve(tr, cols, p["nu"], fourier, rounds=p["rounds"])

        def score(df):
            return df.withColumn("_s", _matrix_udf(lambda x: fourier(x) @ w, cols, "double"))
        rho = one_class.offset(score(tr), p["nu"])
        out = score(te).withColumn("_s", F.col("_s") - F.lit(rho)) \
            .withColumn("prediction", (F.col("_s") < 0).cast("double")) \
            .withColumn("y_prob", sigmoid(-F.col("_s")))
    elif model == "KNN":
        out = knn_predict(train, test, cols, k=p["k"])
    elif model == "Stacking":
        out = _stacking(train, test, cols, p, seed)
    else:
        raise KeyError(f"unknown model {model!r}")
    return out.withColumn("y_pred", F.col("prediction").cast("int"))


def _plain(train: DataFrame, cols: list[str]) -> bool:
    """Whether ``train`` has ``PASS_ROWS`` rows, both classes and no nulls, so that ``margin`` takes it."""
    fine = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    for c in cols:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < math.inf, F.lit(False))
    n, n_fine, n_classes = train.agg(F.count(F.lit(1)), F.count_if(fine), F.countDistinct("label")).first()
    return n >= PASS_ROWS and n_fine == n and n_classes == 2


def _svm_fit(fit_rows: DataFrame, cal_rows: DataFrame, p: dict):
    """LinearSVC on mapped features fitted on ``fit_rows``, its decision values
    calibrated on ``cal_rows`` with Platt (one-feature logistic fit) or isotonic
    regression.  Returns ``(rows, name) -> rows`` with the probability as ``name``."""
    n = fit_rows.count()
    svc = LinearSVC(labelCol="label", featuresCol="features", rawPredictionCol="_raw", predictionCol="_class",
                    regParam=1.0 / (p["C"] * max(n, 1)), maxIter=100, standardization=False).fit(fit_rows)

    def decided(df):
        return svc.transform(df).withColumn("_d", vector_to_array("_raw")[1]).drop("_raw", "_class")
    if p["calibration"] == "isotonic":
        iso = IsotonicRegression(labelCol="label", featuresCol="_d", predictionCol="_iso").fit(
            decided(cal_rows).withColumn("label", F.col("label").cast("double")))
        return lambda df, name: iso.transform(decided(df)).withColumnRenamed("_iso", name).drop("_d")
    va = VectorAssembler(inputCols=["_d"], outputCol="_dv")
    platt = LogisticRegression(labelCol="label", featuresCol="_dv", rawPredictionCol="_raw", probabilityCol="_prob",
                               predictionCol="_class", regParam=0.0).fit(va.transform(decided(cal_rows)))
    return lambda df, name: platt.transform(va.transform(decided(df))).withColumn(
        name, vector_to_array("_prob")[1]).drop("_d", "_dv", "_raw", "_prob", "_class")


def _stacking(train: DataFrame, test: DataFrame, cols: list[str], p: dict, seed: int) -> DataFrame:
    """G13m: out-of-fold base probabilities -> logistic meta model; base
    models refitted on all training rows for the test predictions.  All of them
    are one long table (mail_id, base, y_prob), turned into a row per mail and
    joined once.  ``base_params`` holds settings of base models by name."""
    k = p["inner_folds"]
    tr = stratified_folds(train, k=k, seed=seed, salt="inner").cache()
    folds = [(tr.where(F.col("fold") != f), tr.where(F.col("fold") == f)) for f in range(k)]
    # the inner folds of every base model, then the base models on all training rows
    jobs = [(b, fit, held) for b in p["base"] for fit, held in [*folds, (train, test)]]
    scored = in_parallel([lambda j=j: fit_predict(*j, cols, p["base_params"].get(j[0]), seed).select(
        "mail_id", F.lit(j[0]).alias("base"), "y_prob").checkpoint() for j in jobs])
    long = scored[0]
    for part in scored[1:]:
        long = long.unionByName(part)
    wide = long.groupBy("mail_id").agg(*[F.max(F.when(F.col("base") == b, F.col("y_prob"))).alias("p_" + b) for b in p["base"]])
    tr_all, te = tr.join(wide, "mail_id"), test.join(wide, "mail_id")
    # passthrough: the meta model also sees the original features
    extra = cols if p.get("passthrough") else []
    base_cols = ["p_" + b for b in p["base"]] + extra
    meta = LogisticRegression(labelCol="label", featuresCol="features").fit(_vec(tr_all, base_cols))
    tr.unpersist()
    return _prob1(meta.transform(_vec(te, base_cols)))


def cv_predictions(df: DataFrame, cols: list[str], model: str, dataset: str, feature_group: str,
                   k: int = 5, params: dict | None = None, seed: int = 42,
                   timings: list | None = None) -> DataFrame:
    """G14m/G15m: k-fold loop; ``df`` carries ``fold``.  Returns the long
    predictions rows of every fold; per-fold train / inference seconds are
    appended to ``timings`` when given (H14)."""
    def fold(f: int) -> DataFrame:
        train, test = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        t0 = time.perf_counter()
        pred = fit_predict(model, train, test, cols, params, seed) \
            .select("mail_id", F.col("label").alias("y_true"), "y_pred", "y_prob")
        t1 = time.perf_counter()  # fits run when the plan is made, scoring when it is written
        pred = pred.checkpoint()
        t2 = time.perf_counter()
        if timings is not None:
            timings.append((dataset, feature_group, model, f, t1 - t0, t2 - t1, pred.count()))
        return pred.withColumn("fold", F.lit(f))

    checkpoint_dir(df.sparkSession)
    # folds that are timed run one after another
    most = PARALLEL_FITS
    if model == "SVM" and side_by_side(df.count(), {**DEFAULTS["SVM"], **(params or {})}["n_components"]) < PARALLEL_FITS:
        most = 1  # a fold's own fits already hold what may be held
    parts = [fold(f) for f in range(k)] if timings is not None else in_parallel([lambda f=f: fold(f) for f in range(k)], most)
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    return u.select(F.lit(dataset).alias("dataset"), F.lit(feature_group).alias("feature_group"),
                    F.lit(model).alias("model_name"), F.col("fold").cast("int"), "mail_id",
                    F.col("y_true").cast("int"), "y_pred", F.col("y_prob").cast("double"))


def fit_pipeline(df: DataFrame, cols: list[str], num_trees: int = 100, max_depth: int = 12,
                 min_instances: int = 3, seed: int = 42, grouped: bool = False) -> PipelineModel:
    """G6m / M6: the served RF as a PipelineModel (the assembler stage
    carries the feature list), by :func:`fit_forest`.  ``grouped``: many rows also by trees that
    the library fits on groups, which end at single rows."""
    if grouped and min_instances > 1:
        raise ValueError("groups of rows have no least number of rows in a leaf")
    return fit_forest(df, cols, num_trees, max_depth, seed, min_instances, grouped)


def split_predictions(df: DataFrame, cols: list[str], model: str, dataset: str, feature_group: str,
                      test_size: float = 0.2, params: dict | None = None, seed: int = 42) -> DataFrame:
    """G16m: single stratified hold-out split (train 80 %, evaluate 20 %);
    the predictions carry ``fold = 0``."""
    s = holdout_split(df.select("mail_id", "label", *cols), test_size, seed).checkpoint()  # read by every pass of the fit
    pred = fit_predict(model, s.where("is_test = 0"), s.where("is_test = 1"), cols, params, seed)
    return pred.select(F.lit(dataset).alias("dataset"), F.lit(feature_group).alias("feature_group"),
                       F.lit(model).alias("model_name"), F.lit(0).alias("fold"), "mail_id",
                       F.col("label").cast("int").alias("y_true"), "y_pred", F.col("y_prob").cast("double"))
