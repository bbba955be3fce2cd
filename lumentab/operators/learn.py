"""Splits, scaling, metrics and Spark ML models over tables of features.

Splits are hashes of a key, so they do not depend on the partitioning; seeds
are fixed.  Models come from Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.operators.ranking import exact_quantiles, with_row_number
from lumentab.operators.sampling import key_normal
from lumentab.session import ensure_checkpoint_dir, scratch_path

c = F.col


# --- splits ----------------------------------------------------------------

def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """Fold number 0..folds-1 of a row, from its key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def split_rows(df: DataFrame, key: str, test_share: float, seed: int = 101) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by key hash."""
    test = F.pmod(F.xxhash64(F.lit(seed), c(key)), F.lit(10_000)) < int(test_share * 10_000)
    return df.where(~test), df.where(test)


def ordered_split(df: DataFrame, order_by: str, share: float, out: str = "is_train") -> DataFrame:
    """Mark the first ``share`` of the rows in ``order_by`` order (a unique key)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    numbered = with_row_number(df, order_by, out="__rn")
    return numbered.withColumn(out, c("__rn") <= F.floor(n * F.lit(share))).drop("__rn")


def out_of_fold(df: DataFrame, key: str, folds: int, fit: Callable[[DataFrame], object], seed: int = 0) -> DataFrame:
    """Every row predicted once, by a model that was fitted without its fold; four models are fitted at a time.

    A fit is many short jobs, one for each level of a tree, which leave most cores idle.
    """
    marked = df.withColumn("fold", fold_of(c(key), folds, seed))
    parts = [marked.where(c("fold") != k) for k in range(folds)]
    with ThreadPool(4) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), parts, chunksize=1)
    out = None
    for k, model in enumerate(models):
        part = model.transform(marked.where(c("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


# --- scaling and metrics ---------------------------------------------------

def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; constants become 0."""
    stats = (fitted_on or df).agg(F.struct(
        *[F.avg(x).alias(f"m_{x}") for x in columns], *[F.stddev_pop(x).alias(f"s_{x}") for x in columns])).scalar()
    marked = df.withColumn("__st", stats)
    return marked.withColumns({
        x: F.coalesce(F.try_divide(c(x) - c("__st")[f"m_{x}"], c("__st")[f"s_{x}"]), F.when(c(x).isNotNull(), 0.0))
        for x in columns}).drop("__st")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    err = c(predicted) - c(actual)
    return df.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"))


def median_difference(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median of |predicted - actual|."""
    diff = df.select(*by, F.abs(c(predicted) - c(actual)).alias("d"))
    return exact_quantiles(diff, "d", [0.5], by, ["median_diff"])


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support per class; the truth comes first.

    The table of (actual, predicted) counts has classes squared rows; all else
    is derived from it.
    """
    cells = df.groupBy(c(actual).alias("a"), c(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(c("a").alias("label"), c("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"),
                 F.when(c("a") == c("p"), c("n")).otherwise(0).alias("right")),
        F.struct(c("p").alias("label"), F.lit(0).cast("bigint").alias("support"), c("n").alias("chosen"),
                 F.lit(0).cast("bigint").alias("right")))).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("right").alias("right"))
    return t.select(
        "label", F.coalesce(F.try_divide("right", "chosen"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("right", "support"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * c("right"), c("chosen") + c("support")), F.lit(0.0)).alias("f1"), "support")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence, normalise: bool = False) -> DataFrame:
    """Rows: truth, columns: prediction; absent cells are 0."""
    wide = df.groupBy(c(actual).alias("actual")).pivot(predicted, list(labels)).count().na.fill(0)
    names = [str(x) for x in labels]
    if not normalise:
        return wide.select("actual", *[c(f"`{x}`").alias(f"p{x}") for x in names])
    total = sum((c(f"`{x}`") for x in names[1:]), c(f"`{names[0]}`"))
    return wide.select("actual", *[F.try_divide(c(f"`{x}`"), total).alias(f"p{x}") for x in names])


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((c(actual) == c(predicted)).cast("int")).alias("accuracy"))


# --- models ----------------------------------------------------------------

def features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def linear_regression(df: DataFrame, columns: Sequence[str], target: str):
    """Least squares by normal equations."""
    return LinearRegression(labelCol=target, solver="normal").fit(features(df, columns))


def logistic_regression(penalty: float = 1e-3, label: str = "label") -> LogisticRegression:
    return LogisticRegression(labelCol=label, regParam=penalty, elasticNetParam=0.0)


def softmax_regression(label: str = "label") -> LogisticRegression:
    return LogisticRegression(labelCol=label, family="multinomial", maxIter=100)


def tree_regressor(depth: int, label: str = "label") -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=label, maxDepth=depth, seed=42)


def tree_classifier(label: str = "label", depth: int = 10) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=42)


def forest_classifier(trees: int, label: str = "label", depth: int = 10) -> RandomForestClassifier:
    """The node that each row has come to is kept: else every pass sends all trees out and takes each row down from the root."""
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True)


def network_classifier(inputs: int, classes: int, hidden: Sequence[int] = (10, 20, 10), label: str = "label"):
    return MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, *hidden, classes], maxIter=100, seed=42)


def depth_sweep(train: DataFrame, test: DataFrame, depths: Sequence[int], label: str = "label") -> DataFrame:
    """Median absolute difference on both sets for each tree depth; 30 is Spark's limit, more is an error.

    A split depends on the rows of its node only, so a tree of a smaller depth is the
    top of the deepest one: that is grown once, and each row's way down gives
    its prediction at every depth.
    """
    if max(depths, default=0) > 30:
        raise ValueError("Spark grows trees to a depth of 30 at most")
    if not depths:
        return None
    spark = train.sparkSession
    path = scratch_path(spark, "tree")
    tree_regressor(max(depths), label).fit(train).write().save(path)
    # as large as the fitted model, which is with the driver and in each task as well
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")
    ).toPandas().sort_values("id")
    table = spark.sparkContext.broadcast({x: nodes[x].to_numpy() for x in nodes.columns[1:]})
    wanted = sorted(set(depths))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for b in batches:
            if not len(b):
                continue
            x, at = np.vstack(b["x"].to_numpy()).astype(float), np.zeros(len(b), dtype=int)
            for depth in range(wanted[-1] + 1):
                if depth in wanted:
                    yield pd.DataFrame({"depth": depth, "part": b["part"], "label": b["label"], "prediction": t["prediction"][at]})
                inner = np.flatnonzero(t["leftChild"][at] >= 0)
                node = at[inner]
                left = x[inner, t["featureIndex"][node]] <= t["threshold"][node]
                at[inner] = np.where(left, t["leftChild"][node], t["rightChild"][node])

    rows = None
    for name, part in (("train", train), ("test", test)):
        marked = part.select(F.lit(name).alias("part"), c(label).cast("double").alias("label"), vector_to_array("features").alias("x"))
        rows = marked if rows is None else rows.unionByName(marked)
    found = rows.mapInPandas(descend, "depth int, part string, label double, prediction double")
    return median_difference(found, "label", "prediction", ["depth", "part"]).select("depth", "part", "median_diff")


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1):
    return KMeans(k=k, seed=seed).fit(features(df, columns))


def centres(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(prediction, column_name, centre, n) of a k-means model: the mean of the rows of each cluster.

    The means come from the rows, in one aggregation; of a model that has
    converged they are the model's own centres.  A cluster without rows is absent.
    """
    marked = model.transform(features(df, columns))
    means = marked.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in columns])
    return means.unpivot(["prediction", "n"], list(columns), "column_name", "centre")


def loadings(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, column_name, loading, explained) of a fitted PCA.

    The weight of largest size of a component is positive, so that signs do not
    depend on the solver.  A model has columns x k numbers; they ride on one row of ``df``.
    """
    cells = []
    weights, shares = model.pc.toArray(), model.explainedVariance.toArray()
    for k in range(weights.shape[1]):
        sign = 1.0 if weights[np.abs(weights[:, k]).argmax(), k] > 0 else -1.0
        cells += [F.struct(F.lit(k).alias("component"), F.lit(x).alias("column_name"), F.lit(sign * float(w)).alias("loading"),
                           F.lit(float(shares[k])).alias("explained")) for x, w in zip(columns, weights[:, k])]
    return df.agg(F.count(F.lit(1)).alias("__n")).select(F.inline(F.array(*cells)))


def blobs(df: DataFrame, key: str, centres: Sequence[tuple[float, float]], spread: float, seed: int = 101) -> DataFrame:
    """Two-dimensional Gaussian clusters, one point per row of ``df``."""
    which = F.pmod(F.xxhash64(F.lit(seed), c(key)), F.lit(len(centres))).cast("int")
    xs, ys = (F.array(*[F.lit(float(p[i])) for p in centres]) for i in (0, 1))
    return df.select(key, which.alias("blob")).select(
        key, "blob", (F.get(xs, c("blob")) + key_normal(key, seed) * spread).alias("x"), (F.get(ys, c("blob")) + key_normal(key, seed + 1) * spread).alias("y"))


def principal_components(df: DataFrame, columns: Sequence[str], k: int = 2):
    """PCA of the standardised columns: (model, scaled frame)."""
    scaled = features(standardize(df, columns), columns)
    return PCA(k=k, inputCol="features", outputCol="projected").fit(scaled), scaled


def fourier_features(df: DataFrame, columns: Sequence[str], gamma: float, count: int = 64, seed: int = 7) -> DataFrame:
    """Random Fourier features of the kernel exp(-gamma |x-y|^2) (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (count, len(columns)))
    shift = rng.uniform(0, 2 * math.pi, count)
    @F.pandas_udf("array<double>")
    def waves(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float).reshape(len(rows), len(columns))
        angle = np.tile(shift, (len(x), 1))
        for i in range(x.shape[1]):
            angle += w[:, i] * x[:, i, None]
        return pd.Series(list(np.cos(angle) * math.sqrt(2 / count)))

    x = F.array(*[c(name).cast("double") for name in columns])
    # a row with a missing value has missing features
    known = F.when(F.forall(x, lambda v: v.isNotNull()), waves(x)).otherwise(F.array_repeat(F.lit(None).cast("double"), count))
    return df.withColumn("features", array_to_vector(known))


def svm_grid(df: DataFrame, columns: Sequence[str], label: str, key: str, gammas: Sequence[float],
             penalties: Sequence[float], folds: int = 3) -> DataFrame:
    """Mean cross-validated accuracy of an approximate-rbf SVM for every (gamma, penalty).

    ``label`` is 0/1.  The columns are written once for all gammas, and the features
    of a gamma once, as all folds and penalties read them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(c(label), fold_of(c(key), folds).alias("fold"), *[c(x) for x in columns]).checkpoint()
    rows = []
    for gamma in gammas:
        data = fourier_features(base, columns, gamma)
        machine = LinearSVC(labelCol=label, maxIter=10)
        grid = ParamGridBuilder().addGrid(machine.regParam, list(penalties)).build()
        score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        cv = CrossValidator(estimator=machine, estimatorParamMaps=grid, evaluator=score, numFolds=folds, foldCol="fold", parallelism=4)
        fitted = cv.fit(data.select(label, "fold", "features").checkpoint())
        rows += [(float(gamma), float(p), float(m)) for p, m in zip(penalties, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "gamma double, penalty double, accuracy double")
