"""Machine-learning queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumentab.operators import distribution as dist
from lumentab.operators import learn, neighbours
from lumentab.plans.registry import query
from lumentab.session import ensure_checkpoint_dir, spread
from lumentab.plans.statistics import r, rounded

c = F.col

COLS = [f"f{k}" for k in range(64)]
_FEATS = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(64))
_STD = f"""raw AS (SELECT vec_id, label, {_FEATS} FROM embeddings),
std AS (SELECT vec_id, label, {', '.join(f'(f{k} - AVG(f{k}) OVER ()) / STDDEV_POP(f{k}) OVER () AS f{k}' for k in range(64))} FROM raw)"""


def vectors(t):
    return t.embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(64)])


def labelled(t):
    """Features and a 0/1 class."""
    return learn.features(vectors(t).withColumn("label", (c("label") >= 5).cast("double")), COLS)


def classes(t):
    return learn.features(vectors(t).withColumn("label", c("label").cast("double")), COLS)


def outcome(df):
    return df.select("vec_id", "label", "prediction")


def fit_and_predict(t, estimator, data, share=0.3):
    train, test = learn.split_rows(data, "vec_id", share)
    return outcome(estimator.fit(train).transform(test))


# --- splits and scaling ----------------------------------------------------

@query("train_test_split", "L1")
def train_test_split(t):
    train, test = learn.split_rows(t.orders.select("o_orderkey"), "o_orderkey", 0.3)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("ordered_split", "L2", """
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) <= FLOOR((SELECT COUNT(*) FROM orders) * 2 / 3.0::DOUBLE) AS is_train FROM orders""")
def ordered_split(t):
    return learn.ordered_split(t.orders.select("o_orderkey"), "o_orderkey", 2 / 3)


@query("kfold_predict", "L3")
def kfold_predict(t):
    return outcome(learn.out_of_fold(labelled(t), "vec_id", 10, learn.tree_classifier(depth=5).fit)).join(
        vectors(t).select("vec_id", learn.fold_of(c("vec_id"), 10).alias("fold")), "vec_id")


@query("standardize", "L4", f"WITH {_STD} SELECT vec_id, {', '.join(f'ROUND(f{k}, 6) + 0.0 AS f{k}' for k in range(64))} FROM std")
def standardize(t):
    return rounded(learn.standardize(vectors(t), COLS).drop("label"))


# --- regression ------------------------------------------------------------

def lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("linreg", "L5, L7")
def linreg(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    model = learn.linear_regression(lines(t), cols, "l_extendedprice")
    scored = model.transform(learn.features(lines(t), cols))
    return scored.select("l_orderkey", "l_linenumber", "prediction", (c("l_extendedprice") - c("prediction")).alias("residual"))


@query("residual_histogram", "L7", """
WITH f AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS a, REGR_INTERCEPT(l_extendedprice, l_quantity) AS b FROM lineitem),
e AS (SELECT l_extendedprice - (a * l_quantity + b) AS v FROM lineitem, f),
m AS (SELECT v, MIN(v) OVER () AS lo, MAX(v) OVER () AS hi FROM e)
SELECT CAST(LEAST(FLOOR((v - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, ROUND(MIN(lo + (hi - lo) / 50 * LEAST(FLOOR((v - lo) / (hi - lo) * 50), 49)), 2) + 0.0 AS left_edge,
 COUNT(*) AS n FROM m GROUP BY bin""")
def residual_histogram(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice")
    fit = rows.agg(F.struct(F.regr_slope("l_extendedprice", "l_quantity").alias("a"), F.regr_intercept("l_extendedprice", "l_quantity").alias("b"))).scalar()
    errors = rows.withColumn("fit", fit).select((c("l_extendedprice") - (c("fit.a") * c("l_quantity") + c("fit.b"))).alias("residual"))
    return rounded(dist.histogram(errors, "residual", 50), 2).select("bin", "left_edge", "n")


@query("linreg_1d", "L5", """
SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def linreg_1d(t):
    model = learn.linear_regression(lines(t), ["l_quantity"], "l_extendedprice")
    # the two fitted numbers, carried by one row of the table they come from
    return t.lineitem.agg(F.lit(round(float(model.coefficients[0]), 4)).alias("slope"), F.lit(round(float(model.intercept), 4)).alias("intercept"))


_GUESS = "(SELECT l_extendedprice AS actual, l_quantity * 1500 AS guess FROM lineitem)"


def guesses(t):
    return t.lineitem.select("l_returnflag", c("l_extendedprice").alias("actual"), (c("l_quantity") * 1500).alias("guess"))


@query("regression_metrics", "L6", f"""
SELECT ROUND(AVG(ABS(guess - actual)), 3) AS mae, ROUND(AVG((guess - actual) * (guess - actual)), 0) AS mse, ROUND(SQRT(AVG((guess - actual)**2)), 3) AS rmse FROM {_GUESS}""")
def regression_metrics(t):
    return rounded(learn.regression_metrics(guesses(t), "actual", "guess"), 3, mse=0)


@query("median_diff", "L8", f"SELECT ROUND(MEDIAN(ABS(guess - actual)), 4) AS median_diff FROM {_GUESS}")
def median_diff(t):
    return rounded(learn.median_difference(guesses(t), "actual", "guess"), 4)


#: the reference goes on to 35, Spark's trees stop at 30
DEPTHS = range(1, 30, 2)


@query("tree_depth_sweep", "L14")
def tree_depth_sweep(t):
    data = learn.features(vectors(t).withColumn("label", c("f0") * 2 + c("f1")), COLS[2:] + ["f0"])
    train, test = learn.split_rows(data, "vec_id", 0.5)
    return learn.depth_sweep(train, test, DEPTHS)


# --- classification --------------------------------------------------------

@query("logreg", "L9")
def logreg(t):
    return fit_and_predict(t, learn.logistic_regression(), labelled(t))


_TRUTH = """(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS guess FROM lineitem)"""


def verdicts(t):
    return t.lineitem.select(F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("actual"), F.when(c("l_quantity") > 25, 1).otherwise(0).alias("guess"))


@query("classification_report", "L10", f"""
WITH v AS (SELECT * FROM {_TRUTH}), k AS (SELECT DISTINCT actual AS label FROM v)
SELECT label, ROUND((SELECT COUNT(*) FROM v WHERE actual = label AND guess = label) / (SELECT COUNT(*) FROM v WHERE guess = label), 6) AS precision,
 ROUND((SELECT COUNT(*) FROM v WHERE actual = label AND guess = label) / (SELECT COUNT(*) FROM v WHERE actual = label), 6) AS recall,
 ROUND(2 * (SELECT COUNT(*) FROM v WHERE actual = label AND guess = label) / ((SELECT COUNT(*) FROM v WHERE guess = label) + (SELECT COUNT(*) FROM v WHERE actual = label)), 6) AS f1,
 (SELECT COUNT(*) FROM v WHERE actual = label) AS support FROM k""")
def classification_report(t):
    return rounded(learn.classification_report(verdicts(t), "actual", "guess"))


@query("confusion_matrix", "L11", f"""
SELECT actual, COUNT(*) FILTER (guess = 0) AS p0, COUNT(*) FILTER (guess = 1) AS p1, ROUND(COUNT(*) FILTER (guess = 0) / COUNT(*), 6) AS s0,
 ROUND(COUNT(*) FILTER (guess = 1) / COUNT(*), 6) AS s1 FROM {_TRUTH} GROUP BY actual""")
def confusion_matrix(t):
    v = verdicts(t)
    share = learn.confusion_matrix(v, "actual", "guess", [0, 1], normalise=True)
    return learn.confusion_matrix(v, "actual", "guess", [0, 1]).join(share.select("actual", r(c("p0")).alias("s0"), r(c("p1")).alias("s1")), "actual")


@query("accuracy", "L12", f"SELECT ROUND(AVG(CASE WHEN actual = guess THEN 1 ELSE 0 END), 6) AS accuracy FROM {_TRUTH}")
def accuracy(t):
    return rounded(learn.accuracy(verdicts(t), "actual", "guess"))


_KNN = f"""{_STD}, te AS (SELECT * FROM std WHERE vec_id % 10 < 3), tr AS (SELECT * FROM std WHERE vec_id % 10 >= 3),
pr AS (SELECT te.vec_id AS query, te.label AS actual, tr.vec_id AS neighbour, tr.label AS label,
 {' + '.join(f'POW(te.f{k} - tr.f{k}, 2)' for k in range(64))} AS d2 FROM te, tr),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM pr QUALIFY rank <= 39)"""


def ranked(t, k):
    ensure_checkpoint_dir(t.spark)
    data = learn.standardize(vectors(t), COLS).checkpoint()  # read three times
    test, train = data.where(c("vec_id") % 10 < 3), data.where(c("vec_id") % 10 >= 3)
    return neighbours.nearest(test, train, "vec_id", COLS, "label", k), test


@query("knn_predict", "L13", f"""
WITH {_KNN}, n AS (SELECT query, label, COUNT(*) AS n FROM rk WHERE rank <= 23 GROUP BY 1, 2)
SELECT query, FIRST(label ORDER BY n DESC, label) AS prediction FROM n GROUP BY query""")
def knn_predict(t):
    return neighbours.vote(ranked(t, 23)[0], 23)


@query("knn_elbow", "L13", f"""
WITH {_KNN}, ks AS (SELECT UNNEST(range(1, 40)) AS k), n AS (SELECT query, actual, k, label, COUNT(*) AS n FROM rk, ks WHERE rank <= k GROUP BY ALL),
b AS (SELECT query, actual, k, FIRST(label ORDER BY n DESC, label) AS p FROM n GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, ROUND(AVG(CASE WHEN p <> actual THEN 1 ELSE 0 END), 6) AS error_rate FROM b GROUP BY k""")
def knn_elbow(t):
    found, test = ranked(t, 39)
    return rounded(neighbours.elbow(found, test, "vec_id", "label", 39))


@query("tree_classify", "L15")
def tree_classify(t):
    return fit_and_predict(t, learn.tree_classifier(), classes(t))


@query("forest_classify", "L15")
def forest_classify(t):
    ensure_checkpoint_dir(t.spark)  # there the lineage of a forest's rows is cut
    return fit_and_predict(t, learn.forest_classifier(50), classes(t))


#: of the reference, whose trees grow without a limit; Spark's is 30
FOLDS, TREES = 10, 50


@query("forest_cv", "L16")
def forest_cv(t):
    ensure_checkpoint_dir(t.spark)
    scored = outcome(learn.out_of_fold(labelled(t), "vec_id", FOLDS, learn.forest_classifier(TREES, depth=30).fit))
    return learn.confusion_matrix(scored, "label", "prediction", [0.0, 1.0]).toDF("actual", "predicted_0", "predicted_1")


@query("score_by_class", "L17, F23")
def score_by_class(t):
    data = learn.features(vectors(t).withColumnRenamed("label", "kind").withColumn("label", c("f0") + c("f1")), COLS[1:])
    scored = learn.out_of_fold(data, "vec_id", 5, learn.tree_regressor(6).fit).withColumn("is_class0", c("kind") == 0)
    return learn.median_difference(scored, "label", "prediction", ["is_class0"])


#: the reference's grid, and the folds of its GridSearchCV by default
COSTS, GAMMAS, SVM_FOLDS = (0.1, 1.0, 10.0, 100.0, 1000.0), (1.0, 0.1, 0.01, 0.001, 0.0001), 5


@query("svm_grid", "L18")
def svm_grid(t):
    data = learn.standardize(spread(vectors(t)), COLS).withColumn("label", (c("label") >= 5).cast("double"))
    # C weighs the sum of the losses of the training rows, the penalty stands against their mean
    n = data.count() * (SVM_FOLDS - 1) / SVM_FOLDS
    out = learn.svm_grid(data, COLS, "label", "vec_id", GAMMAS, [1 / (x * n) for x in COSTS], folds=SVM_FOLDS)
    return out.withColumn("cost", F.round(1 / (c("penalty") * n), 6))


@query("kmeans", "L19")
def kmeans(t):
    data = learn.standardize(vectors(t), COLS)
    model = learn.kmeans(data, COLS, 4)
    return model.transform(learn.features(data, COLS)).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("kmeans_centres", "L19")
def kmeans_centres(t):
    data = learn.standardize(vectors(t), COLS)
    return learn.centres(learn.kmeans(data, COLS, 4), data, COLS)


@query("blobs", "L20")
def blobs(t):
    return learn.blobs(t.customer, "c_custkey", [(-9.0, 2.0), (3.0, -6.0), (6.0, 8.0), (-2.0, -9.0)], 1.0)


@query("pca", "L21")
def pca(t):
    model, scaled = learn.principal_components(vectors(t), COLS, 2)
    p = vector_to_array("projected")
    return model.transform(scaled).select("vec_id", "label", F.get(p, F.lit(0)).alias("pc1"), F.get(p, F.lit(1)).alias("pc2"))


@query("pca_loadings", "L21")
def pca_loadings(t):
    model, scaled = learn.principal_components(vectors(t), COLS, 2)
    return learn.loadings(model, scaled, COLS)


@query("mlp_classify", "L22")
def mlp_classify(t):
    return fit_and_predict(t, learn.network_classifier(len(COLS), 10), classes(t))


@query("softmax", "L23")
def softmax(t):
    data = t.embeddings.select("vec_id", c("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    from pyspark.ml.functions import array_to_vector
    return fit_and_predict(t, learn.softmax_regression(), data.withColumn("features", array_to_vector("v")))
