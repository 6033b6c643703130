"""The registered queries of the library, each over whole tables, and their SQL.

Numbers are rounded to six places (``r``) on both sides; adding zero turns -0 into 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import (
    cluster,
    decomposition,
    density,
    ensemble,
    feature_selection,
    linear,
    manifold,
    metrics,
    mixture,
    model_selection,
    naive_bayes,
    neighbors,
    preprocessing,
    timeseries,
    trees,
)
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def r(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keep, *[r(c).alias(c) for c in cols])


def sql_r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def each(template: str, cols: list[str] = LINE) -> str:
    return ", ".join(sql_r(template.format(c=c), c) for c in cols)


# ---------------------------------------------------------------- preprocessing
@query(f"SELECT l_orderkey, l_linenumber, {each('({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} FROM lineitem")
def scale_standard(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.StandardScaler().fit(df, LINE).transform(df), ["l_orderkey", "l_linenumber"], LINE)


@query(f"SELECT l_orderkey, l_linenumber, {each('({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} FROM lineitem")
def scale_minmax(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.MinMaxScaler().fit(df, LINE).transform(df), ["l_orderkey", "l_linenumber"], LINE)


@query(f"SELECT l_orderkey, l_linenumber, {each('{c} / max(abs({c})) OVER ()')} FROM lineitem")
def scale_maxabs(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.MaxAbsScaler().fit(df, LINE).transform(df), ["l_orderkey", "l_linenumber"], LINE)


_Q = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in LINE for q, n in ((0.5, "m"), (0.25, "a"), (0.75, "b")))


@query(f"WITH q AS (SELECT {_Q} FROM lineitem) SELECT l_orderkey, l_linenumber, {each('({c} - {c}_m) / ({c}_b - {c}_a)')} FROM lineitem, q")
def scale_robust(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.RobustScaler().fit(df, LINE).transform(df), ["l_orderkey", "l_linenumber"], LINE)


@query(f"SELECT l_orderkey, l_linenumber, {each('{c} / sqrt(' + ' + '.join(f'{x}*{x}' for x in LINE) + ')')} FROM lineitem")
def row_normalize_l2(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.Normalizer("l2").transform(df, LINE), ["l_orderkey", "l_linenumber"], LINE)


@query(f"SELECT l_orderkey, l_linenumber, {each('{c} / (' + ' + '.join(f'abs({x})' for x in LINE) + ')')} FROM lineitem")
def row_normalize_l1(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return rounded(preprocessing.Normalizer("l1").transform(df, LINE), ["l_orderkey", "l_linenumber"], LINE)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS l_quantity FROM lineitem")
def binarize(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return preprocessing.Binarizer(25).transform(df, ["l_quantity"])


# ---------------------------------------------------------------- metrics
def _judged(spark, d) -> DataFrame:
    """Quality as truth; not-toxic as prediction; a score and a weight from the text length."""
    df = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars").cast("double")
    return df.select("doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"), (n / (n + 1000)).alias("s"), (1 + F.pmod("n_chars", F.lit(3))).cast("double").alias("w"))


_J = "j AS (SELECT l.doc_id, quality AS y, 1 - toxic AS p, n_chars::DOUBLE / (n_chars::DOUBLE + 1000) AS s, (1 + n_chars % 3)::DOUBLE AS w FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"WITH {_J} SELECT {sql_r('sum(CASE WHEN y = p THEN w ELSE 0 END) / sum(w)', 'accuracy')} FROM j")
def accuracy(spark, d):
    return metrics.accuracy_score(_judged(spark, d), "y", "p", weight="w").select(r("accuracy").alias("accuracy"))


@query(f"WITH {_J}, k AS (SELECT DISTINCT y AS l FROM j UNION SELECT DISTINCT p FROM j) SELECT a.l AS truth, b.l AS predicted, coalesce(sum(w), 0.0)::DOUBLE AS value FROM k a CROSS JOIN k b LEFT JOIN j ON y = a.l AND p = b.l GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_judged(spark, d), "y", "p", weight="w").select("truth", "predicted", "value")


_PRF = "c AS (SELECT l, sum(CASE WHEN y = l AND p = l THEN w ELSE 0 END) AS tp, sum(CASE WHEN y = l THEN w ELSE 0 END) AS s, sum(CASE WHEN p = l THEN w ELSE 0 END) AS q FROM j, (SELECT unnest([0, 1]) AS l) GROUP BY l)"


@query(f"WITH {_J}, {_PRF} SELECT {sql_r('avg(tp / q)', 'precision')}, {sql_r('avg(tp / s)', 'recall')}, {sql_r('avg(2 * tp / (s + q))', 'f1')} FROM c")
def prf_macro(spark, d):
    return rounded(metrics.precision_recall_f1(_judged(spark, d), "y", "p", "macro", weight="w"), [], ["precision", "recall", "f1"])


@query(f"WITH {_J}, {_PRF} SELECT {sql_r('sum(s * tp / q) / sum(s)', 'precision')}, {sql_r('sum(tp) / sum(s)', 'recall')}, {sql_r('sum(s * 2 * tp / (s + q)) / sum(s)', 'f1')} FROM c")
def prf_weighted(spark, d):
    return rounded(metrics.precision_recall_f1(_judged(spark, d), "y", "p", "weighted", weight="w"), [], ["precision", "recall", "f1"])


@query(f"WITH {_J}, {_PRF} SELECT {sql_r('tp / q', 'precision')}, {sql_r('tp / s', 'recall')}, {sql_r('2 * tp / (s + q)', 'f1')} FROM c WHERE l = 1")
def prf_binary(spark, d):
    return rounded(metrics.precision_recall_f1(_judged(spark, d), "y", "p", "binary", weight="w"), [], ["precision", "recall", "f1"])


@query(f"WITH {_J} SELECT {sql_r('sum(-w * ln(CASE WHEN y = 1 THEN s ELSE 1 - s END)) / sum(w)', 'log_loss')} FROM j")
def log_loss(spark, d):
    return metrics.log_loss(_judged(spark, d), "y", "s", weight="w").select(r("log_loss").alias("log_loss"))


@query(f"""WITH {_J}, g AS (SELECT s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS t, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS f FROM j GROUP BY s),
    k AS (SELECT t, f, sum(t) OVER (ORDER BY s DESC) AS tp FROM g)
    SELECT {sql_r('sum(f * (tp - t / 2)) / (sum(t) * sum(f))', 'auc')} FROM k""")
def roc_auc(spark, d):
    value = metrics.roc_auc_score(_judged(spark, d), "y", "s", weight="w")
    return spark.createDataFrame([(value,)], "auc double").select(r("auc").alias("auc"))


@query(f"""WITH {_J}, g AS (SELECT s, count(*) FILTER (y = 1) AS t, count(*) FILTER (y <> 1) AS f FROM j GROUP BY s),
    k AS (SELECT s, sum(t) OVER (ORDER BY s DESC) AS tp, sum(f) OVER (ORDER BY s DESC) AS fp, sum(t) OVER () AS P FROM g)
    SELECT {sql_r('s', 'threshold')}, {sql_r('tp / (tp + fp)', 'precision')}, {sql_r('tp / P', 'recall')} FROM k""")
def pr_curve(spark, d):
    got = metrics.precision_recall_curve(_judged(spark, d), "y", "s").where("threshold is not null")
    return rounded(got, [], ["threshold", "precision", "recall"])


@query(f"""WITH {_J}, g AS (SELECT s, count(*) FILTER (y = 1) AS t, count(*) FILTER (y <> 1) AS f FROM j GROUP BY s),
    k AS (SELECT s, sum(t) OVER (ORDER BY s DESC) AS tp, sum(f) OVER (ORDER BY s DESC) AS fp, sum(t) OVER () AS P, sum(f) OVER () AS N FROM g)
    SELECT {sql_r('s', 'threshold')}, {sql_r('fp / N', 'fpr')}, {sql_r('tp / P', 'tpr')} FROM k""")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(_judged(spark, d), "y", "s").where("threshold < double('inf')"), [], ["threshold", "fpr", "tpr"])


@query(f"""WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem), e AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p, a FROM lineitem, m)
    SELECT {sql_r('1 - sum((y - p) * (y - p)) / sum((y - a) * (y - a))', 'r2')}, {sql_r('avg((y - p) * (y - p)) / 1e6', 'mse')}, {sql_r('avg(abs(y - p)) / 1e3', 'mae')} FROM e""")
def r2_mse_mae(spark, d):
    df = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    mse, mae = metrics.mean_squared_error(df, "y", "p"), metrics.mean_absolute_error(df, "y", "p")
    r2 = metrics.r2_score(df, "y", "p")
    return mse.crossJoin(mae).select(r(F.lit(r2)).alias("r2"), r(F.col("mse") / 1e6).alias("mse"), r(F.col("mae") / 1e3).alias("mae"))


# ---------------------------------------------------------------- feature selection
def _scores(spark, cols, scores) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(cols, scores)]
    return spark.createDataFrame(rows, "feature string, score double").select("feature", r("score").alias("score"))


def per_feature(template: str, cols: list[str] = LINE) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


_ANOVA = """SELECT '{c}' AS feature, round(((sum(n * (m - a) * (m - a))) / (count(*) - 1)) / (sum(v * n) / (sum(n) - count(*))), 6) + 0.0 AS score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS a FROM lineitem)"""


@query(per_feature(_ANOVA))
def f_classif_scores(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    return _scores(spark, LINE, feature_selection.f_classif(df, LINE, "l_returnflag")[0])


_CHI2 = """SELECT '{c}' AS feature, round(sum((s - e) * (s - e) / e), 6) + 0.0 AS score FROM (SELECT sum({c}) AS s,
    count(*) / (SELECT count(*) FROM lineitem) * (SELECT sum({c}) FROM lineitem) AS e FROM lineitem GROUP BY l_returnflag)"""


@query(per_feature(_CHI2))
def chi2_scores(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    return _scores(spark, LINE, feature_selection.chi2(df, LINE, "l_returnflag")[0])


_X = ["l_quantity", "l_discount", "l_tax"]


@query(per_feature("SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) + 0.0 AS score FROM lineitem", _X))
def r_regression_scores(spark, d):
    df = t(spark, d, "lineitem").select("l_extendedprice", *_X)
    return _scores(spark, _X, feature_selection.r_regression(df, _X, "l_extendedprice"))


@query(per_feature("SELECT '{c}' AS feature, round(k * k / (1 - k * k) * (n - 2), 6) + 0.0 AS score FROM (SELECT corr({c}, l_extendedprice) AS k, count(*) AS n FROM lineitem)", ["l_discount", "l_tax"]))
def f_regression_scores(spark, d):
    cols = ["l_discount", "l_tax"]
    df = t(spark, d, "lineitem").select("l_extendedprice", *cols)
    return _scores(spark, cols, feature_selection.f_regression(df, cols, "l_extendedprice")[0])


@query(per_feature("SELECT '{c}' AS feature, round(var_pop({c}) / 1e6, 6) + 0.0 AS score, var_pop({c}) > 0.01 AS kept FROM lineitem"))
def variance_threshold(spark, d):
    got = feature_selection.VarianceThreshold(0.01).fit(t(spark, d, "lineitem").select(*LINE), LINE)
    rows = [(c, float(v) / 1e6, bool(k)) for c, v, k in zip(LINE, got.variances_, got.support_)]
    return spark.createDataFrame(rows, "feature string, score double, kept boolean").select("feature", r("score").alias("score"), "kept")


@query(f"WITH s AS ({per_feature(_ANOVA)}) SELECT feature FROM s ORDER BY score DESC LIMIT 2")
def select_k_best(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    got = feature_selection.SelectKBest(k=2).fit(df, LINE, "l_returnflag")
    return spark.createDataFrame([(c,) for c in got.get_feature_names_out()], "feature string")


@query(f"WITH s AS ({per_feature(_ANOVA)}) SELECT feature FROM s WHERE score > (SELECT quantile_cont(score, 0.5) FROM s)")
def select_percentile(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    got = feature_selection.SelectPercentile(percentile=50).fit(df, LINE, "l_returnflag")
    return spark.createDataFrame([(c,) for c in got.get_feature_names_out()], "feature string")


_MI = """SELECT '{c}' AS feature, round(sum(n / w * ln(n * w / (a * b))), 6) + 0.0 AS score FROM (SELECT n, sum(n) OVER () AS w, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b
    FROM (SELECT {c} AS x, l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2))"""


@query(per_feature(_MI, ["l_quantity", "l_discount"]))
def mutual_info_discrete(spark, d):
    cols = ["l_quantity", "l_discount"]
    df = t(spark, d, "lineitem").select("l_returnflag", *cols)
    return _scores(spark, cols, feature_selection.mutual_info_discrete(df, cols, "l_returnflag"))


# ---------------------------------------------------------------- naive Bayes
_NBX = ["l_quantity", "l_discount", "l_tax"]


def _nb_sql(stats: str, joint: str) -> str:
    return f"""WITH x AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_returnflag AS c FROM lineitem), {stats},
        j AS (SELECT id, l_orderkey, l_linenumber, k.c AS c, {joint} AS v FROM x, k)
        SELECT l_orderkey, l_linenumber, first(c ORDER BY v DESC, c) AS prediction FROM j GROUP BY id, l_orderkey, l_linenumber"""


def _nb(spark, d, model) -> DataFrame:
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *_NBX)
    return model.fit(df, _NBX, "l_returnflag").predict(df).select("l_orderkey", "l_linenumber", "prediction")


_V = [f"x{i}" for i in range(3)]


@query(_nb_sql(
    f"e AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({v})' for v in _V)}) AS e FROM x), k AS (SELECT c, ln(count(*) / (SELECT count(*) FROM x)) AS p, {', '.join(f'avg({v}) AS m{v}, var_pop({v}) + any_value(e) AS s{v}' for v in _V)} FROM x, e GROUP BY c)",
    "p - 0.5 * (" + " + ".join(f"ln(2 * pi() * s{v}) + ({v} - m{v}) * ({v} - m{v}) / s{v}" for v in _V) + ")",
))
def gaussian_nb_predict(spark, d):
    return _nb(spark, d, naive_bayes.GaussianNB())


_MULTI = f"k0 AS (SELECT c, count(*) AS n, {', '.join(f'sum({v}) AS t{v}' for v in _V)} FROM x GROUP BY c)"


@query(_nb_sql(
    f"{_MULTI}, k AS (SELECT c, ln(n / sum(n) OVER ()) AS p, {', '.join(f'ln((t{v} + 1) / (tx0 + tx1 + tx2 + 3)) AS l{v}' for v in _V)} FROM k0)",
    "p + " + " + ".join(f"{v} * l{v}" for v in _V),
))
def multinomial_nb_predict(spark, d):
    return _nb(spark, d, naive_bayes.MultinomialNB())


@query(_nb_sql(
    f"{_MULTI}, k1 AS (SELECT c, {', '.join(f'sum(t{v}) OVER () + 1 - t{v} AS r{v}' for v in _V)} FROM k0), k AS (SELECT c, {', '.join(f'-ln(r{v} / (rx0 + rx1 + rx2)) AS l{v}' for v in _V)} FROM k1)",
    " + ".join(f"{v} * l{v}" for v in _V),
))
def complement_nb_predict(spark, d):
    return _nb(spark, d, naive_bayes.ComplementNB())


@query(_nb_sql(
    f"k0 AS (SELECT c, count(*) AS n, {', '.join(f'(sum(CASE WHEN {v} > 0.04 THEN 1 ELSE 0 END) + 1) / (count(*) + 2) AS q{v}' for v in _V)} FROM x GROUP BY c), k AS (SELECT *, ln(n / sum(n) OVER ()) AS p FROM k0)",
    "p + " + " + ".join(f"CASE WHEN {v} > 0.04 THEN ln(q{v}) ELSE ln(1 - q{v}) END" for v in _V),
))
def bernoulli_nb_predict(spark, d):
    return _nb(spark, d, naive_bayes.BernoulliNB(binarize=0.04))


@query("""WITH x AS (SELECT p_partkey, p_brand AS c, p_size AS a FROM part), n AS (SELECT c, count(*) AS n FROM x GROUP BY c),
    m AS (SELECT max(a) + 1 AS k FROM x), g AS (SELECT unnest(range(0, (SELECT k FROM m))) AS a),
    s AS (SELECT n.c, g.a, ln(n.n / (SELECT count(*) FROM x)) + ln((count(x.a) + 1) / (any_value(n.n) + (SELECT k FROM m))) AS v FROM n CROSS JOIN g LEFT JOIN x ON x.c = n.c AND x.a = g.a GROUP BY n.c, g.a, n.n)
    SELECT p_partkey, first(s.c ORDER BY round(v, 9) DESC, s.c) AS prediction FROM x JOIN s ON s.a = x.a GROUP BY p_partkey""")
def categorical_nb_predict(spark, d):
    df = t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("a"))
    model = naive_bayes.CategoricalNB().fit(df, ["a"], "p_brand")
    # equal counts in two brands are exact ties; rounding both sides alike keeps them ties
    names = {f"__j{k}": F.round(j, 9) for k, j in enumerate(model.joint())}
    return df.withColumns(names).withColumn("prediction", vec.argbest([F.col(n) for n in names], model.classes_)).select("p_partkey", "prediction")


# ---------------------------------------------------------------- neighbours and densities
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), k AS (SELECT a.vec_id AS q, b.vec_id AS n, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rnk FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY rnk <= 5)"


@query(f"WITH {_E} SELECT q AS query, n AS neighbor, rnk::INTEGER AS rank, {sql_r('dist', 'distance')} FROM k")
def kneighbors_embeddings(spark, d):
    got = neighbors.NearestNeighbors(5).fit(t(spark, d, "embeddings"), "vec_id", "embedding").kneighbors()
    return got.select("query", "neighbor", "rank", r("distance").alias("distance"))


def _self_vote(spark, d, model, y):
    """Neighbours of every row among the others."""
    return model.fit(t(spark, d, "embeddings"), "vec_id", "embedding", y)


@query(f"WITH {_E}, v AS (SELECT q, label, count(*) AS w FROM k JOIN e ON e.vec_id = n GROUP BY q, label) SELECT q AS query, first(label ORDER BY w DESC, label) AS prediction FROM v GROUP BY q")
def knn_classify(spark, d):
    model = _self_vote(spark, d, neighbors.KNeighborsClassifier(5), "label")
    return model.predict(None, "vec_id", "embedding")


@query(f"WITH {_E} SELECT q AS query, {sql_r('sum(label / dist) / sum(1 / dist)', 'prediction')} FROM k JOIN e ON e.vec_id = n GROUP BY q")
def knn_regress(spark, d):
    model = _self_vote(spark, d, neighbors.KNeighborsRegressor(5, weights="distance"), "label")
    return model.predict(None, "vec_id", "embedding").select("query", r("prediction").alias("prediction"))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS query, b.vec_id AS neighbor, {sql_r('list_distance(a.v, b.v)', 'distance')} FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 1.2")
def radius_neighbors(spark, d):
    got = neighbors.NearestNeighbors(radius=1.2).fit(t(spark, d, "embeddings"), "vec_id", "embedding").radius_neighbors()
    return got.select("query", "neighbor", r("distance").alias("distance"))


@query(f"SELECT a.s_suppkey AS query, {sql_r('ln(sum(exp(-0.5 * ((a.s_acctbal - b.s_acctbal) / 800.0) * ((a.s_acctbal - b.s_acctbal) / 800.0)))) - ln(count(*)) - ln(800.0) - 0.5 * ln(2 * pi())', 'log_density')} FROM supplier a, supplier b GROUP BY 1")
def kernel_density(spark, d):
    df = t(spark, d, "supplier").select("s_suppkey", F.array("s_acctbal").alias("v"))
    got = density.KernelDensity(800.0).fit(df, "s_suppkey", "v").score_samples(df, "s_suppkey", "v")
    return got.select("query", r("log_density").alias("log_density"))


# ---------------------------------------------------------------- linear models and covariance
@query(f"SELECT {sql_r('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {sql_r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')} FROM lineitem")
def linear_regression(spark, d):
    m = linear.LinearRegression().fit(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(m.coef_[0]), m.intercept_)], "slope double, intercept double").select(r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(f"WITH s AS (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1000.0) AS k, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem) SELECT {sql_r('k', 'slope')}, {sql_r('y - k * x', 'intercept')} FROM s")
def ridge_regression(spark, d):
    m = linear.Ridge(1000.0).fit(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(m.coef_[0]), m.intercept_)], "slope double, intercept double").select(r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(f"WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem), k AS (SELECT sign(c) * greatest(abs(c) - 500.0, 0) / v AS k, x, y FROM s) SELECT {sql_r('k', 'slope')}, {sql_r('y - k * x', 'intercept')} FROM k")
def lasso_regression(spark, d):
    m = linear.Lasso(500.0).fit(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(m.coef_[0]), m.intercept_)], "slope double, intercept double").select(r("slope").alias("slope"), r("intercept").alias("intercept"))


_CX = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sql_r(f'covar_pop({a}, {b})', 'value')} FROM lineitem" for a in _CX for b in _CX))
def empirical_covariance(spark, d):
    m = decomposition.EmpiricalCovariance().fit(t(spark, d, "lineitem").select(*_CX), _CX)
    rows = [(a, b, float(m.covariance_[i, j])) for i, a in enumerate(_CX) for j, b in enumerate(_CX)]
    return spark.createDataFrame(rows, "a string, b string, value double").select("a", "b", r("value").alias("value"))


@query("SELECT n::INTEGER AS n, floor(4 * ln(n) / (0.01 / 2 - 0.001 / 3))::INTEGER AS dim FROM (SELECT unnest([100, 1000, 10000]) AS n)")
def jl_min_dim(spark, d):
    return spark.createDataFrame([(n, decomposition.johnson_lindenstrauss_min_dim(n, 0.1)) for n in (100, 1000, 10000)], "n int, dim int")


# ---------------------------------------------------------------- clustering, composition, splits, series
@query(f"""WITH a AS (SELECT l_quantity AS x, l_tax * 100 AS y, CASE WHEN (l_quantity - 10) * (l_quantity - 10) + (l_tax * 100 - 2) * (l_tax * 100 - 2) <= (l_quantity - 40) * (l_quantity - 40) + (l_tax * 100 - 6) * (l_tax * 100 - 6) THEN 0 ELSE 1 END AS k FROM lineitem)
    SELECT k AS cluster, {sql_r('avg(x)', 'x')}, {sql_r('avg(y)', 'y')} FROM a GROUP BY k""")
def kmeans_step(spark, d):
    df = t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    m = cluster.KMeans(2, np.array([[10.0, 2.0], [40.0, 6.0]]), max_iter=1).fit(df, ["x", "y"])
    rows = [(k, *map(float, c)) for k, c in enumerate(m.cluster_centers_)]
    return spark.createDataFrame(rows, "cluster int, x double, y double").select("cluster", r("x").alias("x"), r("y").alias("y"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), c AS (SELECT a.id, a.x FROM s a JOIN s b ON abs(a.x - b.x) <= 150 GROUP BY a.id, a.x HAVING count(*) >= 3),
    g AS (SELECT id, x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 150 THEN 0 ELSE 1 END AS b FROM c), h AS (SELECT id, x, sum(b) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS grp FROM g),
    r AS (SELECT grp, row_number() OVER (ORDER BY min(id)) - 1 AS label FROM h GROUP BY grp), k AS (SELECT h.id, h.x, r.label FROM h JOIN r ON h.grp = r.grp)
    SELECT s.id, coalesce(max(k2.label), min(k.label), -1)::INTEGER AS label, max(k2.label) IS NOT NULL AS core FROM s LEFT JOIN k ON abs(s.x - k.x) <= 150 LEFT JOIN k k2 ON k2.id = s.id GROUP BY s.id""")
def dbscan(spark, d):
    df = t(spark, d, "supplier").select("s_suppkey", F.array("s_acctbal").alias("v"))
    return cluster.DBSCAN(150.0, 3).fit_predict(df, "s_suppkey", "v")


@query(f"SELECT l_orderkey, l_linenumber, {sql_r('(2 * l_quantity + l_discount + l_tax) / 4', 'prediction')} FROM lineitem")
def voting_mean(spark, d):
    df = t(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", r(ensemble.weighted_mean(["l_quantity", "l_discount", "l_tax"], [2, 1, 1])).alias("prediction"))


@query("SELECT doc_id, CASE WHEN (CASE WHEN quality = 0 THEN 2 ELSE 0 END) + (CASE WHEN toxic = 0 THEN 1 ELSE 0 END) >= (CASE WHEN quality = 1 THEN 2 ELSE 0 END) + (CASE WHEN toxic = 1 THEN 1 ELSE 0 END) THEN 0 ELSE 1 END AS prediction FROM labels")
def voting_hard(spark, d):
    return t(spark, d, "labels").select("doc_id", ensemble.hard_vote(["quality", "toxic"], [0, 1], [2, 1]).alias("prediction"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT count(*) // 5 FROM orders) AS fold FROM orders")
def kfold_assign(spark, d):
    return model_selection.KFold(5).folds(t(spark, d, "orders"), "o_orderkey").withColumn("fold", F.col("fold").cast("long"))


@query("""WITH c AS (SELECT n_nationkey AS g, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT count(*) AS groups, sum(n)::BIGINT AS members FROM c""")
def group_kfold_totals(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    folds = model_selection.GroupKFold(5).folds(df, "c_custkey", None, "c_nationkey").join(df, "c_custkey")
    return folds.groupBy("c_nationkey").agg(F.count_distinct("fold").alias("f"), F.count(F.lit(1)).alias("n")).where("f = 1").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey DESC) AS k FROM customer GROUP BY 1),
    d AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS g, 0 AS fold UNION ALL
        SELECT c.k, [CASE WHEN i = p THEN load[i] + c.n ELSE load[i] END FOR i IN range(1, 6)], c.g, p - 1 FROM (SELECT *, list_position(load, list_min(load)) AS p FROM d) e JOIN c ON c.k = e.k + 1)
    SELECT c_custkey, fold::INTEGER AS fold FROM customer JOIN d ON d.g = c_nationkey AND d.k > 0""")
def group_kfold_assign(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return model_selection.GroupKFold(5).folds(df, "c_custkey", None, "c_nationkey").select("c_custkey", F.col("fold").cast("int").alias("fold"))


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), s AS (SELECT unnest([0, 1, 2]) AS split)
    SELECT split, event_id, CASE WHEN i < n - (3 - split) * (n // 4) THEN 'train' ELSE 'test' END AS side FROM p, s WHERE i < n - (2 - split) * (n // 4)""")
def time_series_members(spark, d):
    df, whole = t(spark, d, "events").select("event_id"), None
    for k, parts in enumerate(model_selection.TimeSeriesSplit(3).split(df, "event_id")):
        for side, part in zip(("train", "test"), parts):
            own = part.select(F.lit(k).alias("split"), "event_id", F.lit(side).alias("side"))
            whole = own if whole is None else whole.unionAll(own)
    return whole


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), s AS (SELECT unnest([0, 1, 2]) AS k)
    SELECT k AS split, count(*) FILTER (i < n - (3 - k) * (n // 4)) AS train, count(*) FILTER (i >= n - (3 - k) * (n // 4) AND i < n - (2 - k) * (n // 4)) AS test FROM p, s GROUP BY k""")
def time_series_split(spark, d):
    df = t(spark, d, "events").select("event_id")
    rows = [(k, a.count(), b.count()) for k, (a, b) in enumerate(model_selection.TimeSeriesSplit(3).split(df, "event_id"))]
    return spark.createDataFrame(rows, "split int, train long, test long")


@query(f"SELECT event_id, {sql_r('value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)', 'value')} FROM events QUALIFY lag(value) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT NULL")
def series_difference(spark, d):
    df = t(spark, d, "events").select("event_id", "user_id", "value")
    return timeseries.difference(df, "user_id", "event_id", "value", 1).select("event_id", r("value").alias("value"))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(value) AS n, {sql_r('avg(value)', 'mean')}, {sql_r('var_pop(value)', 'var')} FROM events GROUP BY 1, 2")
def windowed_moments(spark, d):
    from ..streaming.incremental import windowed_moments as f

    df = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return f(df, "ts", ["event_type"], "value", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("mean").alias("mean"), r("var").alias("var"))


# ---------------------------------------------------------------- models, most of them without SQL
def _small(spark, d) -> tuple[DataFrame, list[str]]:
    """All embeddings as rows of eight coarse columns (mean of eight components each) and their label."""
    e = t(spark, d, "embeddings")
    parts = [F.aggregate(F.slice(F.col("embedding").cast("array<double>"), 8 * k + 1, 8), F.lit(0.0), lambda a, x: a + x).alias(f"x{k}") for k in range(8)]
    return e.select(F.col("vec_id").alias("id"), "label", *parts), [f"x{k}" for k in range(8)]


def _coefs(spark, m) -> DataFrame:
    w = np.atleast_2d(np.asarray(m.coef_, float))
    b = np.atleast_1d(np.asarray(m.intercept_, float))
    got = spark.createDataFrame(pd.DataFrame([(i, j, float(v)) for i, row in enumerate(w) for j, v in enumerate(row)] + [(i, -1, float(v)) for i, v in enumerate(b)], columns=["output", "feature", "weight"]))
    return rounded(got, ["output", "feature"], ["weight"])


_S = [f"x{k}" for k in range(8)]
_SMALL = "x AS (SELECT vec_id AS id, label, " + ", ".join(f"list_sum(embedding[{8 * k + 1}:{8 * k + 8}]::DOUBLE[]) AS x{k}" for k in range(8)) + " FROM embeddings)"
_O = ["x0", "x1", "x2"]
_ORDERS = "o AS (SELECT o_orderkey AS id, o_totalprice / 1e5 AS y, c_acctbal / 1e4 AS x0, c_nationkey / 25 AS x1, length(o_orderpriority)::DOUBLE AS x2 FROM orders JOIN customer ON o_custkey = c_custkey)"


def _sql_coefs(source: str, d: int, output: str = "0") -> str:
    """Rows of ``_coefs`` from a table with weights ``w`` and intercept ``c``."""
    return f"SELECT ({output})::BIGINT AS output, (j - 1)::BIGINT AS feature, {sql_r('w[j]', 'weight')} FROM {source}, unnest(range(1, {d + 1})) AS t(j) UNION ALL SELECT ({output})::BIGINT, -1, round(c, 6) + 0.0 FROM {source}"


_Z = [f"({c} - mx[{k + 1}])" for k, c in enumerate(_O)]
_LEVERAGE = " + ".join(f"{a} * v[{i + 1}][{j + 1}] * {b}" for i, a in enumerate(_Z) for j, b in enumerate(_Z))
_WGW = " + ".join(f"w[{i}] * g[{i}][{j}] * w[{j}]" for i in (1, 2, 3) for j in (1, 2, 3))


def _inverse3() -> str:
    """The inverse of ``n`` times (g + b I), three by three, by cofactors."""
    m = lambda i, j: f"(g[{i}][{j}]{' + b' if i == j else ''})"
    minor = lambda i, j: "({} * {} - {} * {})".format(*[m(p, q) for p, q in ((i % 3 + 1, j % 3 + 1), ((i + 1) % 3 + 1, (j + 1) % 3 + 1), (i % 3 + 1, (j + 1) % 3 + 1), ((i + 1) % 3 + 1, j % 3 + 1))])
    size = " + ".join(f"{m(1, j)} * {minor(1, j)}" for j in (1, 2, 3))
    return "[" + ", ".join("[" + ", ".join(f"{minor(j, i)} / ({size}) / n" for j in (1, 2, 3)) + "]" for i in (1, 2, 3)) + "]"


_INVERSE3 = _inverse3()
_WEIGHTS3 = "[" + ", ".join("n * (" + " + ".join(f"v[{i}][{j}] * r[{j}]" for j in (1, 2, 3)) + ")" for i in (1, 2, 3)) + "]"
_FIT_SQL = {
    "ridge_cv": f"""WITH RECURSIVE {_ORDERS}, s AS (SELECT o.*, alpha FROM o, (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS alpha)), {sql.ridge("g", "s", _O, "y", "any_value(alpha)", ["alpha"], inverse=True)},
        e AS (SELECT g.alpha, avg(pow((y - ({sql.linear(_O)})) / (1 - 1.0 / n - ({_LEVERAGE})), 2)) AS error FROM s JOIN g ON g.alpha = s.alpha GROUP BY g.alpha),
        best AS (SELECT g.* FROM g JOIN e USING (alpha) ORDER BY error, alpha LIMIT 1) {_sql_coefs("best", 3)}""",
    "ridge_classifier": f"""WITH RECURSIVE {_SMALL}, s AS (SELECT x.*, l.label AS cls, CASE WHEN x.label = l.label THEN 1.0 ELSE -1.0 END AS t FROM x, (SELECT DISTINCT label FROM x) l), {sql.ridge("g", "s", _S, "t", "1.0", ["cls"])},
        h AS (SELECT *, row_number() OVER (ORDER BY cls) - 1 AS place FROM g) {_sql_coefs("h", 8, "place")}""",
    "elastic_net": f"""WITH RECURSIVE {_ORDERS}, {sql.centered("s", "o", _O, "y")}, {sql.descent("cd", "s", 3, 0.005, 0.005, 400)},
        g AS (SELECT w, my - list_dot_product(w, mx) AS c FROM cd WHERE k = 1200) {_sql_coefs("g", 3)}""",
    # without a tube the squared loss is a ridge problem that penalises the intercept, too
    "linear_svr": f"""WITH RECURSIVE {_ORDERS}, z AS (SELECT *, 1.0 AS one FROM o),
        zm AS (SELECT [{", ".join("[" + ", ".join(f"2 * sum({a} * {b})" + (" + 1" if a == b else "") for b in [*_O, "one", "y"]) + "]" for a in [*_O, "one"])}]::DOUBLE[][] AS m FROM z),
        {sql.eliminated("zr", "zm", 4, 1)}, g AS (SELECT [m[i][5] FOR i IN range(1, 4)] AS w, m[4][5] AS c FROM zr WHERE k = 4) {_sql_coefs("g", 3)}""",
    "bayesian_ridge": f"""WITH RECURSIVE {_ORDERS}, {sql.centered("s", "o", _O, "y")}, e AS (SELECT 0 AS k, NULL::DOUBLE[] AS old, 1 / (yy + 2.220446049250313e-16) AS a, 1.0::DOUBLE AS l, false AS done FROM s UNION ALL
        SELECT k + 1, w, (n - gamma + 2e-6) / (greatest(n * (yy - 2 * list_dot_product(w, r) + {_WGW}), 0) + 2e-6), (gamma + 2e-6) / (list_dot_product(w, w) + 2e-6),
            coalesce(list_sum([abs(w[j] - old[j]) FOR j IN range(1, 4)]) < 1e-3, false)
        FROM (SELECT *, 3 - b * n * ({" + ".join(f"v[{i}][{i}]" for i in (1, 2, 3))}) AS gamma FROM (SELECT *, {_WEIGHTS3} AS w FROM (SELECT k, old, a, l, g, r, yy, n, b, {_INVERSE3} AS v FROM (SELECT e.*, s.*, l / a / n AS b FROM e, s WHERE NOT done AND k < 300)))))  ,
        last AS (SELECT *, l / a / n AS b FROM e, s ORDER BY k DESC LIMIT 1), f AS (SELECT *, {_WEIGHTS3} AS w FROM (SELECT *, {_INVERSE3} AS v FROM last)),
        h AS (SELECT w, my - list_dot_product(w, mx) AS c FROM f) {_sql_coefs("h", 3)}""",
}


def _fit(make: Callable, target: str = "y") -> Query:
    """Fit a linear model on the lineitem columns (scaled) or on the embeddings' labels."""

    def run(spark, d):
        if target == "label":
            df, cols = _small(spark, d)
            return _coefs(spark, make().fit(df, cols, "label"))
        df = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        df = df.select((F.col("o_totalprice") / 1e5).alias("y"), (F.col("c_acctbal") / 1e4).alias("x0"), (F.col("c_nationkey") / 25).alias("x1"), F.length("o_orderpriority").cast("double").alias("x2"), F.col("o_orderkey").alias("id"))
        m = make()
        return _coefs(spark, m.fit(df, ["x0", "x1", "x2"], "y", "id") if isinstance(m, linear.RANSACRegressor) else m.fit(df, ["x0", "x1", "x2"], "y"))

    return run


for _name, _make, _target in [
    ("ridge_cv", linear.RidgeCV, "y"),
    ("bayesian_ridge", linear.BayesianRidge, "y"),
    ("elastic_net", lambda: linear.ElasticNet(0.01), "y"),
    ("huber_regression", lambda: linear.HuberRegressor(), "y"),
    ("linear_svr", lambda: linear.LinearSVR(), "y"),
    ("ransac_regression", lambda: linear.RANSACRegressor(), "y"),
    ("mbsgd_regression", lambda: linear.MBSGDRegressor(), "y"),
    ("ridge_classifier", linear.RidgeClassifier, "label"),
    ("logistic_regression", lambda: linear.LogisticRegression(), "label"),
    ("linear_svc", lambda: linear.LinearSVC(), "label"),
]:
    QUERIES[_name] = _fit(_make, _target)
    if _name in _FIT_SQL:
        ORACLE_SQL[_name] = " ".join(_FIT_SQL[_name].split())


@query()
def mbsgd_classifier(spark, d):
    df = _judged(spark, d)
    return _coefs(spark, linear.MBSGDClassifier("log_loss").fit(df, ["s", "w"], "y"))


def _axes_sql(entry: str, shift: str) -> str:
    """Rows of _small along the three leading axes of a matrix of aggregates over pairs of columns."""
    rows = ", ".join("[" + ", ".join(entry.format(a=a, b=b) for b in _S) + "]" for a in _S)
    values = ", ".join(f"{c} - {shift.format(c=c)}" if shift else c for c in _S)
    parts = ", ".join(sql_r(f"list_dot_product(z, (SELECT v FROM a WHERE i = {k}))", f"pc{k}") for k in range(3))
    return f"""WITH RECURSIVE {_SMALL}, mm AS (SELECT [{rows}]::DOUBLE[][] AS m FROM x), {sql.axes("a", "mm", 8, 3)},
        zs AS (SELECT id, [{values}]::DOUBLE[] AS z FROM x) SELECT id, {parts} FROM zs"""


@query(_axes_sql("covar_pop({a}, {b})", "avg({c}) OVER ()"))
def pca_transform(spark, d):
    df, cols = _small(spark, d)
    return rounded(decomposition.PCA(3).fit(df, cols).transform(df), ["id"], ["pc0", "pc1", "pc2"])


@query(_axes_sql("avg({a} * {b})", ""))
def truncated_svd(spark, d):
    df, cols = _small(spark, d)
    return rounded(decomposition.TruncatedSVD(3).fit(df, cols).transform(df), ["id"], ["pc0", "pc1", "pc2"])


@query()
def incremental_pca(spark, d):
    df, cols = _small(spark, d)
    return decomposition.IncrementalPCA(2, batch_size=500).fit(df, cols, "id").transform(df).select("id", "pc0", "pc1")


@query()
def random_projection(spark, d):
    df, cols = _small(spark, d)
    a = decomposition.GaussianRandomProjection(3).fit(df, cols).transform(df, "g")
    return decomposition.SparseRandomProjection(3).fit(df, cols).transform(a, "s").select("id", "g0", "g1", "g2", "s0", "s1", "s2")


_DEV = " + ".join(f"pow({c} - (SELECT avg({c}) FROM x), 2)" for c in _S)


@query(f"""WITH {_SMALL}, f AS (SELECT count(*) AS n, avg(pow({_DEV}, 2)) AS q FROM x), s AS (SELECT {" + ".join(f"pow(covar_pop({a}, {b}), 2)" for a in _S for b in _S)} AS ss, {" + ".join(f"var_pop({a})" for a in _S)} AS tr FROM x),
    k AS (SELECT tr, (q - ss) / (8 * n) AS beta, (ss - 2 * (tr / 8) * tr + 8 * pow(tr / 8, 2)) / 8 AS delta FROM f, s) SELECT {sql_r("least(beta, delta) / delta", "shrinkage")}, {sql_r("tr", "trace")} FROM k""")
def ledoit_wolf(spark, d):
    df, cols = _small(spark, d)
    m = decomposition.LedoitWolf().fit(df, cols)
    return rounded(spark.createDataFrame([(float(m.shrinkage_), float(np.trace(m.covariance_)))], "shrinkage double, trace double"), [], ["shrinkage", "trace"])


@query()
def kernel_ridge(spark, d):
    df, cols = _small(spark, d)
    return density.KernelRidge(1.0, "rbf").fit(df, cols, "label", "id").predict(df).select("id", "prediction")


@query()
def kmeans_fit(spark, d):
    df, cols = _small(spark, d)
    return cluster.KMeans(10).fit(df, cols).predict(df).select("id", "cluster")


@query()
def agglomerative(spark, d):
    df, cols = _small(spark, d)
    m = cluster.AgglomerativeClustering(5).fit(df, cols, "id")
    return spark.createDataFrame(pd.DataFrame({"place": np.arange(len(m.labels_)), "label": m.labels_.astype(int)}))


@query()
def hdbscan(spark, d):
    df, cols = _small(spark, d)
    m = cluster.HDBSCAN(10).fit(df, cols, "id")
    return spark.createDataFrame(pd.DataFrame({"place": np.arange(len(m.labels_)), "label": m.labels_.astype(int), "probability": m.probabilities_, "outlier": m.outlier_scores_}))


@query()
def gaussian_mixture(spark, d):
    df, cols = _small(spark, d)
    return mixture.GaussianMixture(5, "diag").fit(df, cols).predict(df).select("id", "component")


@query()
def bayesian_mixture(spark, d):
    df, cols = _small(spark, d)
    return mixture.BayesianGaussianMixture(5, "diag").fit(df, cols).predict(df).select("id", "component")


@query()
def spectral_clustering(spark, d):
    df, cols = _small(spark, d)
    return manifold.SpectralClustering(n_clusters=5).fit_predict(df, cols, "id")


@query()
def spectral_embedding(spark, d):
    df, cols = _small(spark, d)
    return manifold.SpectralEmbedding(2).fit_transform(df, cols, "id")


@query()
def tsne(spark, d):
    df, cols = _small(spark, d)
    return manifold.TSNE().fit_transform(df, cols, "id")


@query()
def umap(spark, d):
    df, cols = _small(spark, d)
    return manifold.UMAP().fit_transform(df, cols, "id")


def _daily(spark, d) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@query()
def arima_forecast(spark, d):
    return timeseries.ARIMA((1, 1, 1)).fit_forecast(_daily(spark, d), "event_type", "day", "v", 5)


@query()
def auto_arima(spark, d):
    return timeseries.AutoARIMA(0, 1, 1).select(_daily(spark, d), "event_type", "day", "v")


@query()
def random_forest_classifier(spark, d):
    df, cols = _small(spark, d)
    return trees.RandomForestClassifier(max_depth=6).fit(df, cols, "label").predict(df).select("id", "prediction")


@query()
def random_forest_regressor(spark, d):
    df, cols = _small(spark, d)
    return trees.RandomForestRegressor(max_depth=6).fit(df, cols, "label").predict(df).select("id", "prediction")


@query()
def hist_gradient_boosting(spark, d):
    df, cols = _small(spark, d)
    return trees.HistGradientBoostingRegressor(max_depth=3).fit(df, cols, "label").predict(df).select("id", "prediction")


@query()
def hist_gradient_boosting_classifier(spark, d):
    df = _judged(spark, d)
    return trees.HistGradientBoostingClassifier(max_depth=2).fit(df, ["s", "w"], "y").predict_proba(df).select("doc_id", "p0", "p1")


@query()
def tree_shap(spark, d):
    df, cols = _small(spark, d)
    m = trees.HistGradientBoostingRegressor(20, max_depth=3).fit(df, cols, "label")
    return m.shap_values(df).select("id", *[f"shap_{c}" for c in cols])


@query(f"SELECT l_orderkey, l_linenumber, {sql_r('CASE WHEN l_quantity <= 20 THEN CASE WHEN l_tax <= 0.03 THEN 1.0 ELSE 2.0 END ELSE 4.0 END', 'prediction')} FROM lineitem")
def forest_inference(spark, d):
    tree = {"feature": [0, 1, -1, -1, -1], "threshold": [20.0, 0.03, 0, 0, 0], "left": [1, 2, -1, -1, -1], "right": [4, 3, -1, -1, -1], "value": [0.0, 0.0, 1.0, 2.0, 4.0]}
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    got = trees.ForestInference(trees=[tree]).load(["l_quantity", "l_tax"]).predict(df)
    return got.select("l_orderkey", "l_linenumber", r("prediction").alias("prediction"))


_HALF = f"p AS (SELECT *, {sql.fold('id', 2)} AS fold FROM x), halves AS (SELECT unnest([0, 1]) AS f)"
_MEMBERS = "(SELECT unnest([1.0, 0.0])::DOUBLE AS alpha)"


@query(f"""WITH RECURSIVE {_SMALL}, {_HALF}, s AS (SELECT p.*, f, alpha FROM p, halves, {_MEMBERS} WHERE fold <> f), {sql.ridge("g", "s", _S, "label", "any_value(alpha)", ["f", "alpha"])},
    oof AS (SELECT p.id, any_value(p.label) AS label, max({sql.linear(_S)}) FILTER (alpha = 1) AS a, max({sql.linear(_S)}) FILTER (alpha = 0) AS b FROM p JOIN g ON g.f = p.fold GROUP BY p.id), {sql.ridge("u", "oof", ["a", "b"], "label", "1.0")},
    whole AS (SELECT x.*, alpha FROM x, {_MEMBERS}), {sql.ridge("h", "whole", _S, "label", "any_value(alpha)", ["alpha"])},
    m AS (SELECT x.id, max({sql.linear(_S)}) FILTER (alpha = 1) AS a, max({sql.linear(_S)}) FILTER (alpha = 0) AS b FROM x, h GROUP BY x.id)
    SELECT id, {sql_r(sql.linear(["a", "b"]), "prediction")} FROM m, u""")
def stacking_regressor(spark, d):
    df, cols = _small(spark, d)
    m = ensemble.StackingRegressor([("a", linear.Ridge()), ("b", linear.LinearRegression())], linear.Ridge(), 2).fit(df, cols, "label", "id")
    return rounded(m.predict(df), ["id"], ["prediction"])


@query()
def stacking_classifier(spark, d):
    df, cols = _small(spark, d)
    m = ensemble.StackingClassifier([("a", linear.RidgeClassifier()), ("b", naive_bayes.GaussianNB())], linear.RidgeClassifier(), 2).fit(df, cols, "label", "id")
    return m.predict(df).select("id", "prediction")


def _r2(m, df, y) -> float:
    return metrics.r2_score(m.predict(df), y, "prediction")


def _support(spark, m) -> DataFrame:
    return spark.createDataFrame([(c, bool(k)) for c, k in zip(m.cols, m.support_)], "feature string, kept boolean")


def _rfe_sql(steps: int) -> str:
    """Moments once; then, ``steps`` times, a solve over the columns that are left and the one of least squared weight goes."""
    rows = ", ".join("[" + ", ".join([f"count(*) * covar_pop({a}, {b})" + (" + 1.0" if a == b else "") for b in _S] + [f"count(*) * covar_pop({a}, label)"]) + "]" for a in _S)
    out = [f"WITH RECURSIVE {_SMALL}, base AS (SELECT [{rows}]::DOUBLE[][] AS b FROM x), act0 AS (SELECT [true FOR i IN range(8)] AS act, b FROM base)"]
    for k in range(steps):
        out.append(f"m{k} AS (SELECT act, b, [[CASE WHEN act[i] AND (j = 9 OR act[j]) THEN b[i][j] WHEN i = j THEN 1.0 ELSE 0.0 END FOR j IN range(1, 10)] FOR i IN range(1, 9)] AS m FROM act{k})")
        out.append(sql.eliminated(f"r{k}", f"m{k}", 8, 1, (), ("act", "b")))
        out.append(f"w{k} AS (SELECT i FROM r{k}, unnest(range(1, 9)) AS t(i) WHERE k = 8 AND act[i] ORDER BY m[i][9] * m[i][9], i LIMIT 1)")
        out.append(f"act{k + 1} AS (SELECT [act[i] AND i <> gone FOR i IN range(1, 9)] AS act, b FROM act{k}, (SELECT max(i) AS gone FROM w{k}))")
    return ", ".join(out) + f" SELECT 'x' || (i - 1) AS feature, act[i] AS kept FROM act{steps}, unnest(range(1, 9)) AS t(i)"


@query(_rfe_sql(4))
def recursive_elimination(spark, d):
    df, cols = _small(spark, d)
    return _support(spark, feature_selection.RFE(linear.Ridge(), 4).fit(df, cols, "label"))


@query(f"WITH RECURSIVE {_SMALL}, {sql.ridge('g', 'x', _S, 'label', '1.0')} SELECT 'x' || (i - 1) AS feature, abs(w[i]) >= list_avg([abs(z) FOR z IN w]) AS kept FROM g, unnest(range(1, 9)) AS t(i)")
def select_from_model(spark, d):
    df, cols = _small(spark, d)
    return _support(spark, feature_selection.SelectFromModel(linear.Ridge()).fit(df, cols, "label"))


_R2 = "1 - sum(pow(label - p, 2)) / (count(*) * var_pop(label))"


@query(f"""WITH {_SMALL}, {_HALF}, u AS ({" UNION ALL ".join(f"SELECT {k} AS feature, {c} AS v, label, fold FROM p" for k, c in enumerate(_S))}),
    g AS (SELECT feature, f, avg(v) AS mv, avg(label) AS my, count(*) * covar_pop(v, label) / (count(*) * var_pop(v) + 1.0) AS w FROM u, halves WHERE fold <> f GROUP BY ALL),
    e AS (SELECT feature, f, {_R2} AS r2 FROM (SELECT u.feature, g.f, label, my + w * (v - mv) AS p FROM u JOIN g ON g.feature = u.feature AND g.f = u.fold) GROUP BY ALL),
    b AS (SELECT feature FROM e GROUP BY feature ORDER BY avg(r2) DESC, feature LIMIT 1) SELECT 'x' || i AS feature, i = (SELECT feature FROM b) AS kept FROM unnest(range(8)) AS t(i)""")
def sequential_selection(spark, d):
    df, cols = _small(spark, d)
    return _support(spark, feature_selection.SequentialFeatureSelector(linear.Ridge(), _r2, model_selection.KFold(2), 1).fit(df, cols, "label", "id"))


@query()
def mutual_info_knn(spark, d):
    df, cols = _small(spark, d)
    return _scores(spark, cols, feature_selection.mutual_info_classif(df, cols, "label", "id"))


@query(f"""WITH s AS ({per_feature(_ANOVA)}), n AS (SELECT count(*) - 3 AS d FROM lineitem), p AS (SELECT feature, pow(1 + 2 * score / d, -d / 2.0) AS p FROM s, n)
    SELECT feature, p < 0.05 AS fpr, p < 0.05 / 4 AS fwe FROM p""")
def select_fpr_fwe(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    fpr, fwe = (make().fit(df, LINE, "l_returnflag") for make in (feature_selection.SelectFpr, feature_selection.SelectFwe))
    return spark.createDataFrame([(c, bool(a), bool(b)) for c, a, b in zip(LINE, fpr.support_, fwe.support_)], "feature string, fpr boolean, fwe boolean")


@query(f"""WITH s AS ({per_feature(_ANOVA)}), n AS (SELECT count(*) - 3 AS d FROM lineitem), p AS (SELECT feature, pow(1 + 2 * score / d, -d / 2.0) AS p FROM s, n),
    k AS (SELECT *, p <= 0.05 * row_number() OVER (ORDER BY p) / count(*) OVER () AS under FROM p) SELECT feature, coalesce(p <= (SELECT max(p) FROM k WHERE under), false) AS kept FROM k""")
def select_fdr(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", *LINE)
    return _support(spark, feature_selection.SelectFdr().fit(df, LINE, "l_returnflag"))


@query(f"""WITH RECURSIVE {_SMALL}, {_HALF}, s AS (SELECT p.*, f, alpha FROM p, halves, (SELECT unnest([0.1, 10.0])::DOUBLE AS alpha) WHERE fold <> f), {sql.ridge("g", "s", _S, "label", "any_value(alpha)", ["f", "alpha"])},
    e AS (SELECT alpha, f, {_R2} AS r2 FROM (SELECT alpha, f, label, {sql.linear(_S)} AS p FROM p JOIN g ON g.f = p.fold) GROUP BY ALL),
    m AS (SELECT alpha, avg(r2) AS a, stddev_pop(r2) AS d FROM e GROUP BY alpha) SELECT alpha, {sql_r("a", "mean")}, {sql_r("d", "std")}, (rank() OVER (ORDER BY a DESC))::INTEGER AS rank FROM m""")
def grid_search(spark, d):
    df, cols = _small(spark, d)
    got = model_selection.GridSearchCV(linear.Ridge(), {"alpha": [0.1, 10.0]}, _r2, 2).fit(df, cols, "label", "id")
    res = got.cv_results_
    return spark.createDataFrame([(p["alpha"], float(m), float(s), int(k)) for p, m, s, k in zip(res["params"], res["mean_test_score"], res["std_test_score"], res["rank_test_score"])], "alpha double, mean double, std double, rank int").select("alpha", r("mean").alias("mean"), r("std").alias("std"), "rank")


@query(f"""WITH RECURSIVE {_SMALL}, p AS (SELECT *, {sql.fold("id", 3)} AS fold FROM x), s AS (SELECT p.*, f FROM p, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f), {sql.ridge("g", "s", _S, "label", "1.0", ["f"])}
    SELECT id, {sql_r(sql.linear(_S), "prediction")} FROM p JOIN g ON g.f = p.fold""")
def cross_val_predict(spark, d):
    df, cols = _small(spark, d)
    return rounded(model_selection.cross_val_predict(linear.Ridge(), df, cols, "label", "id", 3), ["id"], ["prediction"])


@query("""WITH c AS (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label),
    dealt AS (SELECT label, (row_number() OVER (ORDER BY c.f, vec_id) - 1) % 5 AS fold FROM embeddings JOIN c USING (label)),
    share AS (SELECT label, fold, count(*) AS n FROM dealt GROUP BY label, fold),
    ends AS (SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS upto FROM share),
    placed AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings)
    SELECT vec_id, CAST(min(fold) AS INTEGER) AS fold FROM placed JOIN ends USING (label) WHERE place <= upto GROUP BY vec_id""")
def stratified_kfold(spark, d):
    return model_selection.StratifiedKFold(5).folds(t(spark, d, "embeddings"), "vec_id", "label")


@query()
def stratified_group_kfold(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return model_selection.StratifiedGroupKFold(5).folds(df, "c_custkey", "c_mktsegment", "c_nationkey")


@query()
def shuffle_split(spark, d):
    train, test = model_selection.train_test_split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", random_state=0)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionAll(test.select("o_orderkey", F.lit("test").alias("side")))


@query(f"""WITH {_J}, b AS (SELECT min(s) AS lo, max(s) AS hi FROM j), g AS (SELECT k, CASE WHEN k = 49 THEN hi ELSE lo + k * ((hi - lo) / 49) END AS t FROM b, unnest(range(50)) AS u(k)),
    a AS (SELECT k, t, avg(CASE WHEN (y = 1) = (s >= t) THEN 1.0 ELSE 0.0 END) AS score FROM j, g GROUP BY k, t) SELECT {sql_r("t", "threshold")}, {sql_r("score", "score")} FROM a ORDER BY round(score, 12) DESC, k LIMIT 1""")
def tuned_threshold(spark, d):
    m = model_selection.TunedThresholdClassifier(lambda tp, fp, fn, tn: (tp + tn) / (tp + fp + fn + tn), 50).fit(_judged(spark, d), "y", "s")
    return rounded(spark.createDataFrame([(m.best_threshold_, m.best_score_)], "threshold double, score double"), [], ["threshold", "score"])
