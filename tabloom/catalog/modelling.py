"""Models, tuning, comparison, scoring and the run log."""

from pyspark.sql import functions as F

from tabloom.catalog.algebra import comoments, predicted, r2, solved
from tabloom.catalog.evaluating import BOARD_SQL, board
from tabloom.catalog.registry import query, table
from tabloom.catalog.series import MONTHLY_SQL, RATE, hash_sql, monthly
from tabloom.operators import encode as E
from tabloom.operators import evaluate as V
from tabloom.operators import lags as L
from tabloom.operators import models as M
from tabloom.operators import split as D
from tabloom.operators.boosting import ordered_statistics
from tabloom.plans import prepare as P
from tabloom.plans import score as R
from tabloom.plans import train as TR
from tabloom.sources import files, runlog
from tabloom.session import scratch_path

FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lines(spark, sf_dir):
    """Line items with a learnable amount; the test price itself is pure noise."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *FEATS, "l_extendedprice")
    amount = F.col("l_quantity") * 900 * (1 - F.col("l_discount")) + F.col("l_extendedprice") * 0.2
    return li.withColumn("amount", amount)


LINES_SQL = f"""SELECT l_orderkey, l_partkey, l_suppkey, {', '.join(FEATS)}, l_extendedprice,
  l_quantity * 900 * (1 - l_discount) + l_extendedprice * 0.2 AS amount, {hash_sql('l_orderkey')} % 100 < 20 AS is_test,
  {hash_sql('l_orderkey', 'fold')} AS fold_hash FROM lineitem"""


def split_lines(spark, sf_dir):
    return D.train_test(D.split(lines(spark, sf_dir), 0.2, "random", key=["l_orderkey"]))


FLAG_FEATS = ["big", "cheap", "late"]


def flags(spark, sf_dir):
    """Line items by three yes-no features. A tree that may grow three levels deep gives each of the eight groups the
    mean of its training rows, and so does boosting with such trees, whose first tree leaves nothing to the others."""
    made = lines(spark, sf_dir)
    return made.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "amount", (F.col("l_quantity") > 25).cast("double").alias("big"),
        (F.col("l_discount") > 0.05).cast("double").alias("cheap"), (F.col("l_linenumber") > 3).cast("double").alias("late"),
    )


FLAG_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
FLAGS_SQL = f"""SELECT l_orderkey, amount, (l_quantity > 25)::INTEGER::DOUBLE AS big, (l_discount > 0.05)::INTEGER::DOUBLE AS cheap,
  (l_linenumber > 3)::INTEGER::DOUBLE AS late, is_test, fold_hash FROM ({LINES_SQL})"""
GROUP_METRICS_SQL = f"""WITH t AS MATERIALIZED ({FLAGS_SQL}), g AS (SELECT big, cheap, late, avg(amount) AS guess FROM t WHERE NOT is_test GROUP BY ALL),
  m AS (SELECT {r2('amount', 'guess')} AS r2, sqrt(avg((amount - guess) * (amount - guess))) AS rmse, avg(abs(amount - guess)) AS mae
    FROM t JOIN g USING (big, cheap, late) WHERE is_test) """
METRICS_SQL = GROUP_METRICS_SQL + "SELECT round(r2, 4) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM m"


def split_flags(spark, sf_dir):
    return D.train_test(D.split(flags(spark, sf_dir), 0.2, "random", key=["l_orderkey"]))


def coefficients(fitted):
    return [*[float(c) for c in fitted.model.coefficients], float(fitted.model.intercept)]


GUESS = predicted(FEATS)
BETAS = ", ".join(f"round(b{i}, 3) AS {f}" for i, f in enumerate(FEATS))


@query(
    "linear_model",
    f"""WITH t AS ({LINES_SQL}), f AS ({solved(f"SELECT {comoments(FEATS, 'amount')} FROM t WHERE NOT is_test", 4)})
    SELECT {BETAS}, round(b, 2) AS intercept, (SELECT round({r2('amount', GUESS)}, 4) FROM t, f WHERE is_test) AS r2 FROM f""",
)
def linear_model(spark, sf_dir):
    train, test = split_lines(spark, sf_dir)
    fitted = M.fit_linear(train, FEATS, "amount")
    *slopes, intercept = coefficients(fitted)
    metrics = V.regression_metrics(fitted.predict(test), "amount", "prediction")
    found = [F.round(F.lit(b), 3).alias(f) for f, b in zip(FEATS, slopes, strict=True)]
    return metrics.select(*found, F.round(F.lit(intercept), 2).alias("intercept"), "r2")


@query(
    "ridge_model",
    f"""WITH t AS ({LINES_SQL}), f AS ({solved(f"SELECT {comoments(FEATS, 'amount')} FROM t WHERE NOT is_test", 4, alpha="1.0")})
    SELECT {BETAS}, round(b, 2) AS intercept FROM f""",
)
def ridge_model(spark, sf_dir):
    train, _ = split_lines(spark, sf_dir)
    *slopes, intercept = coefficients(M.fit_ridge(train, FEATS, "amount", 1.0))
    found = [F.round(F.lit(b), 3).alias(f) for f, b in zip(FEATS, slopes, strict=True)]
    return train.agg(F.count(F.lit(1)).alias("n")).select(*found, F.round(F.lit(intercept), 2).alias("intercept"))


def tree_metrics(spark, sf_dir, fit):
    train, test = split_flags(spark, sf_dir)
    fitted = fit(train, FLAG_FEATS, "amount")
    return V.regression_metrics(fitted.predict(test), "amount", "prediction")


@query("decision_tree", METRICS_SQL)
def decision_tree(spark, sf_dir):
    return tree_metrics(spark, sf_dir, M.fit_tree)


@query("random_forest", GROUP_METRICS_SQL + "SELECT round(r2, 2) AS group_r2, true AS near FROM m")
def random_forest(spark, sf_dir):
    """A hundred trees, each on its own draw of rows and features: near the group means, not equal to them."""
    train, test = split_flags(spark, sf_dir)
    found = V.regression_metrics(M.fit_forest(train, FLAG_FEATS, "amount").predict(test), "amount", "prediction")
    means = train.groupBy(*FLAG_FEATS).agg(F.avg("amount").alias("guess"))
    best = V.regression_metrics(test.join(F.broadcast(means), FLAG_FEATS), "amount", "guess").select(F.col("r2").alias("best"))
    return found.join(best, F.lit(True)).select(F.round("best", 2).alias("group_r2"), (F.abs(F.col("best") - F.col("r2")) < 0.05).alias("near"))


@query("gradient_boosting", METRICS_SQL)
def gradient_boosting(spark, sf_dir):
    return tree_metrics(spark, sf_dir, M.fit_boosting)


def _boosting(name, trees, **setting):
    @query(name, METRICS_SQL)
    def run(spark, sf_dir):
        return tree_metrics(spark, sf_dir, lambda train, feats, y: M.fit_boosting(train, feats, y, **setting))

    run.__doc__ = f"{trees} trees."


_boosting("boosting_xgboost", 100, booster="xgboost")
_boosting("boosting_lgbm", 100, booster="lgbm")
_boosting("boosting_preset_simple", 50, preset="simple")
_boosting("boosting_preset_advanced", 200, preset="advanced")


@query(
    "boosting_catboost",
    GROUP_METRICS_SQL + "SELECT round(r2, 2) AS group_r2, true AS near FROM m",
)
def boosting_catboost(spark, sf_dir):
    """The three features as one text: its ordered statistic tells the groups apart, but for its first rows."""
    text = F.concat_ws("-", *[F.col(f).cast("int").cast("string") for f in FLAG_FEATS])
    train, test = (part.withColumn("group", text) for part in split_flags(spark, sf_dir))
    fitted = M.fit_boosting(train, ["group"], "amount", booster="catboost", key=FLAG_KEY)
    found = V.regression_metrics(fitted.predict(test), "amount", "prediction")
    means = train.groupBy("group").agg(F.avg("amount").alias("guess"))
    best = V.regression_metrics(test.join(F.broadcast(means), "group"), "amount", "guess").select(F.col("r2").alias("best"))
    return found.join(best, F.lit(True)).select(F.round("best", 2).alias("group_r2"), (F.abs(F.col("best") - F.col("r2")) < 0.02).alias("near"))


@query("adaboost")
def adaboost(spark, sf_dir):
    """Twenty rounds."""
    return tree_metrics(spark, sf_dir, lambda train, feats, y: M.fit_adaboost(train, feats, y, trees=20))


@query(
    "ordered_target_statistics",
    f"""WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice, {hash_sql('o_orderkey', 'order')} AS h,
      avg(o_totalprice) OVER () AS prior FROM orders)
    SELECT o_orderkey, round((coalesce(sum(o_totalprice) OVER w, 0) + prior) / (count(*) OVER w + 1), 4) AS stat FROM t
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY h, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def ordered_target_statistics(spark, sf_dir):
    """Mean price of the earlier orders of the same priority; blocks of 1,000 rows carry their sums on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    made, _ = ordered_statistics(o, "o_orderpriority", "o_totalprice", ["o_orderkey"], limit=1000, block_rows=1000)
    return made.select("o_orderkey", F.round("o_orderpriority_stat", 4).alias("stat"))


def _fold_fits(k, source="t"):
    """Co-moments of the rows outside each fold."""
    return "\nUNION ALL ".join(f"SELECT {i} AS fold, {comoments(FEATS, 'amount')} FROM {source} WHERE fold <> {i}" for i in range(k))


def _ridge_cv_sql():
    sets = M.draws("ridge", 25)
    values = ", ".join(f"({i}, {p['alpha']!r}::DOUBLE)" for i, p in enumerate(sets))
    return f"""WITH a(trial, alpha) AS (VALUES {values}),
    t AS MATERIALIZED (SELECT *, fold_hash % 3 AS fold FROM ({LINES_SQL}) WHERE NOT is_test), f AS MATERIALIZED ({_fold_fits(3)}),
    b AS MATERIALIZED ({solved("SELECT * FROM f, a", 4, ["trial", "alpha", "fold"], alpha="alpha")}),
    r AS (SELECT trial, alpha, fold, {r2('amount', GUESS)} AS r2 FROM t JOIN b USING (fold) GROUP BY ALL)
    SELECT trial::BIGINT AS trial, round(alpha, 8) AS alpha, round(avg(r2), 6) AS score FROM r GROUP BY trial, alpha"""


@query("hyperparameter_search", _ridge_cv_sql())
def hyperparameter_search(spark, sf_dir):
    train, _ = split_lines(spark, sf_dir)
    found = M.search(train, FEATS, "amount", "ridge", ["l_orderkey"], trials=25, folds=3)
    rows = [(i, p["alpha"], s) for i, (p, s) in enumerate(found.trials)]
    made = spark.createDataFrame(rows, "trial bigint, alpha double, score double")
    return made.select("trial", F.round("alpha", 8).alias("alpha"), F.round("score", 6).alias("score"))


def _tree_search_sql():
    sets = ", ".join(f"({i}, {p['max_depth']}, {p['min_split']})" for i, p in enumerate(M.draws("dt", 25)))
    means = "\nUNION ALL ".join(f"SELECT {i} AS fold, big, cheap, late, avg(amount) AS guess FROM t WHERE fold <> {i} GROUP BY ALL" for i in range(3))
    return f"""WITH a(trial, max_depth, min_split) AS (VALUES {sets}),
    t AS MATERIALIZED (SELECT *, fold_hash % 3 AS fold FROM ({FLAGS_SQL}) WHERE NOT is_test), g AS ({means}),
    r AS (SELECT avg(r2) AS r2 FROM (SELECT fold, {r2('amount', 'guess')} AS r2 FROM t JOIN g USING (fold, big, cheap, late) GROUP BY fold))
    SELECT trial::BIGINT AS trial, max_depth::INTEGER AS max_depth, min_split::INTEGER AS min_split, round(r2, 6) AS score FROM a, r"""


@query("hyperparameter_search_trees", _tree_search_sql())
def hyperparameter_search_trees(spark, sf_dir):
    """Every setting drawn lets the tree reach the eight groups, so all settings score alike."""
    train, _ = split_flags(spark, sf_dir)
    found = M.search(train, FLAG_FEATS, "amount", "dt", ["l_orderkey"])
    rows = [(i, p["max_depth"], p["min_split"], s) for i, (p, s) in enumerate(found.trials)]
    made = spark.createDataFrame(rows, "trial bigint, max_depth int, min_split int, score double")
    return made.withColumn("score", F.round("score", 6))


@query(
    "cross_val_r2",
    f"""WITH t AS MATERIALIZED (SELECT *, fold_hash % 5 AS fold FROM ({LINES_SQL}) WHERE NOT is_test), f AS ({_fold_fits(5)}),
    b AS MATERIALIZED ({solved("SELECT * FROM f", 4, ["fold"])}),
    r AS (SELECT fold, {r2('amount', GUESS)} AS r2 FROM t JOIN b USING (fold) GROUP BY fold)
    SELECT fold::INTEGER AS fold, round(r2, 6) AS r2 FROM r""",
)
def cross_val_r2(spark, sf_dir):
    train, _ = split_lines(spark, sf_dir)
    scores = M.fold_scores(D.folds(train, 5, ["l_orderkey"]), FEATS, "amount", "linear")
    made = spark.createDataFrame(list(enumerate(scores)), "fold int, r2 double")
    return made.withColumn("r2", F.round("r2", 6))


@query(
    "model_importance",
    f"WITH t AS (SELECT * FROM ({LINES_SQL}) WHERE NOT is_test) "
    + "\nUNION ALL ".join(f"SELECT '{f}' AS feature, round(abs(corr({f}, amount)), 4) AS importance FROM t" for f in FEATS),
)
def model_importance(spark, sf_dir):
    train, _ = split_lines(spark, sf_dir)
    return M.importance(M.fit_linear(train, FEATS, "amount"), train, "amount")


def planted(train, test):
    """A target that one of the features tells alone."""
    return (part.withColumn("planted", F.col("big") * 100 + 7) for part in (train, test))


@query("model_importance_trees", "SELECT unnest(['big', 'cheap', 'late']) AS feature, unnest([1.0, 0.0, 0.0])::DOUBLE AS importance FROM (SELECT 1 FROM lineitem LIMIT 1)")
def model_importance_trees(spark, sf_dir):
    train, _ = planted(*split_flags(spark, sf_dir))
    return M.importance(M.fit_tree(train, FLAG_FEATS, "planted"), train, "planted")


@query(
    "first_pass_model",
    "SELECT unnest(['big', 'cheap', 'late']) AS feature, unnest([1.0, 0.0, 0.0])::DOUBLE AS importance, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS rmse,"
    " 0.0::DOUBLE AS mae FROM (SELECT 1 FROM lineitem LIMIT 1)",
)
def first_pass_model(spark, sf_dir):
    metrics, ranked = M.first_pass(*planted(*split_flags(spark, sf_dir)), FLAG_FEATS, "planted")
    row = metrics.first()
    return ranked.withColumns({k: F.lit(row[k]) for k in ("r2", "rmse", "mae")})


def _train_models_sql():
    linear = f"""lb AS ({solved(f"SELECT {comoments(FLAG_FEATS, 'amount')} FROM t WHERE NOT is_test", 3)}),
  l AS (SELECT {r2('amount', predicted(FLAG_FEATS))} AS r2 FROM t, lb WHERE is_test)"""
    exact = "\nUNION ALL ".join(f"SELECT '{m}' AS model, round(round(r2, 4), 3) AS r2, true AS sound FROM m" for m in ("dt", "gbm", "xgboost", "lgbm", "catboost"))
    loose = "\nUNION ALL ".join(f"SELECT '{m}' AS model, NULL::DOUBLE AS r2, true AS sound" for m in ("rf", "adaboost"))
    return f"""{GROUP_METRICS_SQL}, {linear} {exact} UNION ALL {loose}
  UNION ALL SELECT 'linear', round(round(r2, 4), 3), true FROM l UNION ALL SELECT 'ridge', round(round(r2, 4), 3), true FROM l"""


@query("train_models", _train_models_sql())
def train_models(spark, sf_dir):
    """All models, ridge with tuned penalty, ensembles of five trees; forest and AdaBoost have no closed form."""
    train, test = split_flags(spark, sf_dir)
    few = {name: {"trees": 5} for name in ("rf", "gbm", "xgboost", "lgbm", "catboost", "adaboost")}
    settings = M.TrainSettings(key=FLAG_KEY, cv_folds=3, params=few)
    names = ["linear", "dt", "rf", "gbm", "xgboost", "lgbm", "catboost", "adaboost"]
    done = M.train_models(train, test, FLAG_FEATS, "amount", names, settings).metrics
    tuned = M.TrainSettings(key=FLAG_KEY, cv_folds=3, tune=True)
    done = done.unionByName(M.train_models(train, test, FLAG_FEATS, "amount", ["ridge"], tuned).metrics)
    sound = F.col("error").isNull() & (F.col("r2") > 0.5) & (F.col("cv_r2") > 0.5) & (F.col("ci_worst") <= F.col("accuracy_pct"))
    shown = F.when(~F.col("model").isin("rf", "adaboost"), F.round("r2", 3))
    return done.select("model", shown.alias("r2"), (sound & (F.col("accuracy_pct") <= F.col("ci_best"))).alias("sound"))


SCORE_CONFIG = P.PrepareConfig(
    target="o_totalprice", features=("o_custkey", "o_orderstatus"), row_key=("o_orderkey",),
    onehot_columns=("o_orderstatus",), choose_time=False,
)


def order_rows(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("order_year"), F.date_format(d, "MMMM").alias("order_month"), "o_orderstatus",
        "o_custkey", (F.col("o_totalprice") * RATE).alias("o_totalprice"),
    )


def build_scorer(spark, sf_dir):
    frame, state = P.fit_prepare(order_rows(spark, sf_dir), SCORE_CONFIG)
    train, _ = D.train_test(D.split(frame, 0.2, "random", key=["o_orderkey"]))
    scaler = E.fit_scaler(train, state.features, "zscore")
    fitted = M.fit_linear(scaler.apply(train), state.features, "o_totalprice")
    return R.Scorer(state, scaler, {"linear": fitted}, "linear")


def fresh_rows(spark, sf_dir):
    """New raw rows: line items by ship date, without a customer."""
    d = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.year(d).alias("order_year"),
        F.date_format(d, "MMM").alias("order_month"), F.col("l_linestatus").alias("o_orderstatus"),
    )


@query("score_rows")
def score_rows(spark, sf_dir):
    return R.score(fresh_rows(spark, sf_dir), build_scorer(spark, sf_dir), keep=["l_orderkey", "l_partkey", "l_linenumber"])


@query("score_report")
def score_report(spark, sf_dir):
    scored = R.score(fresh_rows(spark, sf_dir), build_scorer(spark, sf_dir))
    return R.score_summary(scored, model="linear")


PLAIN_CONFIG = P.PrepareConfig(target="amount", features=("l_quantity",), row_key=("l_orderkey",), choose_time=False)
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def plain_scorer(spark, sf_dir):
    """Amount by quantity, which every fifth order lacks, by two models that come to the same straight line."""
    li = lines(spark, sf_dir).withColumn("l_quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")))
    frame, state = P.fit_prepare(li.select("l_orderkey", "l_quantity", "amount"), PLAIN_CONFIG)
    scaler = E.fit_scaler(frame, state.features, "zscore")
    ready = scaler.apply(frame)
    ridge = M.fit_ridge(ready, state.features, "amount", 0.0)
    return li, R.Scorer(state, scaler, {"linear": M.fit_linear(ready, state.features, "amount"), "ridge": ridge}, "linear")


# Gaps count as 0 for the fit and become the training mean in new rows.
PLAIN_SQL = f"""t AS MATERIALIZED (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, amount,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS q FROM ({LINES_SQL})),
  z AS (SELECT avg(q) AS mean, stddev_pop(q) AS dev FROM t),
  f AS (SELECT regr_slope(amount, coalesce((q - mean) / dev, 0)) AS s, regr_intercept(amount, coalesce((q - mean) / dev, 0)) AS i FROM t, z),
  p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, i + s * coalesce((q - mean) / dev, 0) AS p FROM t, z, f)"""


@query("score_rows_by_key", f"WITH {PLAIN_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(round(p, 4), 2) AS prediction FROM p")
def score_rows_by_key(spark, sf_dir):
    """New rows with and without the feature."""
    li, scorer = plain_scorer(spark, sf_dir)
    return R.score(li.drop("amount"), scorer, keep=LINE_KEY).withColumn("prediction", F.round("prediction", 2))


BATCH_SQL = f"""WITH {PLAIN_SQL}, b AS (SELECT quantile_cont(amount, 0.25) AS low, quantile_cont(amount, 0.75) AS high FROM t),
  c AS (SELECT round(round(avg(p), 4), 2) AS mean, round(round(stddev_pop(p), 4), 2) AS std, round(round(min(p), 4), 2) AS min, round(round(max(p), 4), 2) AS max, count(p)::BIGINT AS count,
    count(*) FILTER (WHERE p < low)::BIGINT AS poor, count(*) FILTER (WHERE p >= low AND p < high)::BIGINT AS at_risk,
    count(*) FILTER (WHERE p >= high)::BIGINT AS good FROM p, b)
  SELECT unnest(['linear', 'ridge']) AS model, *, round(100.0::DOUBLE * poor / count, 1) AS poor_pct, round(100.0::DOUBLE * at_risk / count, 1) AS at_risk_pct,
    round(100.0::DOUBLE * good / count, 1) AS good_pct FROM c"""


@query("score_batch_summary", BATCH_SQL)
def score_batch_summary(spark, sf_dir):
    """Population spread and tiers of each model's predictions."""
    li, scorer = plain_scorer(spark, sf_dir)
    done = R.batch_summary(li.drop("amount"), scorer, li, "amount")
    return done.withColumns({c: F.round(c, 2) for c in ("mean", "std", "min", "max")})


@query(
    "score_batch_sample",
    f"""WITH {PLAIN_SQL}, h AS (SELECT * FROM p ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(['linear', 'ridge']) AS model, round(round(p, 4), 2) AS prediction FROM h""",
)
def score_batch_sample(spark, sf_dir):
    """The first twenty rows."""
    li, scorer = plain_scorer(spark, sf_dir)
    return R.batch_sample(li.drop("amount"), scorer, LINE_KEY).withColumn("prediction", F.round("prediction", 2))


TRAIN_SQL = f"""WITH m AS (SELECT avg(CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END) AS mean FROM lineitem
    WHERE {hash_sql("l_orderkey")} % 100 >= 20),
  t AS (SELECT coalesce(CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END, mean) AS x,
    l_quantity * 900 * (1 - l_discount) + l_extendedprice * 0.2 AS amount,
    {hash_sql("l_orderkey")} % 100 < 20 AS is_test FROM lineitem, m),
  f AS (SELECT regr_slope(amount, x) AS s, regr_intercept(amount, x) AS i FROM t WHERE NOT is_test)
  SELECT 'linear' AS model_name, 'amount' AS target_column, 1::INTEGER AS feature_count, 'mean' AS missing,
    round(1 - sum((amount - s * x - i) * (amount - s * x - i)) / (count(*) * var_pop(amount)), 3) AS r2 FROM t, f WHERE is_test"""


@query("train_run", TRAIN_SQL)
def train_run(spark, sf_dir):
    """A whole run with gaps to fill, and its row in the log."""
    li = lines(spark, sf_dir).withColumn("l_quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")))
    config = TR.TrainConfig(
        P.PrepareConfig("amount", ("l_quantity",), row_key=("l_orderkey",), choose_time=False), models=("linear",), missing="mean"
    )
    path = scratch_path(spark, "runs")
    done = TR.train(li.select("l_orderkey", "l_quantity", "amount"), config)
    TR.log_run(done, path, "lineitem", config)
    return runlog.list_runs(spark, path).select(
        "model_name", "target_column", "feature_count", F.col("config")["missing"].alias("missing"),
        F.round(F.col("metrics")["r2"].cast("double"), 3).alias("r2"),
    )


SUMMARY_SQL = """SELECT 'plain' AS model, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, round(min(p), 4) AS min,
  round(max(p), 4) AS max, count(p)::BIGINT AS count FROM (SELECT l_quantity * 1900.0 + 5000.0 AS p FROM lineitem)"""


@query("score_summary", SUMMARY_SQL)
def score_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 1900.0 + 5000.0).alias("prediction"))
    return R.score_summary(li, model="plain")


@query("report_csv_sink", f"SELECT model, mean, std, min, max FROM ({SUMMARY_SQL})")
def report_csv_sink(spark, sf_dir):
    """Summary written as CSV and read back."""
    path = scratch_path(spark, "report")
    files.write_report(score_summary(spark, sf_dir), path)
    return spark.read.option("header", True).schema("model string, mean double, std double, min double, max double").csv(path)


@query(
    "run_log_append",
    BOARD_SQL
    + """SELECT model AS model_name, 'lineitem' AS dataset_name, 'l_extendedprice' AS target_column, 4::INTEGER AS feature_count,
      'tabular' AS modality, r2, '0.2' AS split FROM m""",
)
def run_log_append(spark, sf_dir):
    path = scratch_path(spark, "runs")
    scored = board(spark, sf_dir)
    for model in ("rough", "blended", "exact"):
        rows = runlog.run_rows(
            scored.where(F.col("model") == model), "lineitem", "l_extendedprice", 4, {"split": 0.2}, user="ann"
        )
        runlog.append_runs(rows, path)
    return runlog.list_runs(spark, path).select(
        "model_name", "dataset_name", "target_column", "feature_count", "modality",
        F.col("metrics")["r2"].cast("double").alias("r2"), F.col("config")["split"].alias("split"),
    )


@query(
    "run_log_list",
    BOARD_SQL + "SELECT model AS model_name, r2, 'ann' AS user_id FROM m WHERE model = 'blended'",
)
def run_log_list(spark, sf_dir):
    path = scratch_path(spark, "runs")
    scored = board(spark, sf_dir)
    for model, user in {"rough": "bob", "blended": "ann"}.items():
        rows = runlog.run_rows(scored.where(F.col("model") == model), "lineitem", "l_extendedprice", 4, user=user)
        runlog.append_runs(rows, path)
    return runlog.list_runs(spark, path, user="ann").select(
        "model_name", F.col("metrics")["r2"].cast("double").alias("r2"), "user_id"
    )


PREPARED_SQL = f"""WITH g AS (SELECT year(o_orderdate)::DOUBLE AS order_year, month(o_orderdate)::DOUBLE AS order_month, o_orderstatus,
  avg(o_totalprice * {RATE}::DOUBLE) AS o_totalprice, avg(o_custkey) AS o_custkey FROM orders GROUP BY ALL),
  raw AS (SELECT *, lag(o_totalprice, 1) OVER w AS l1, lag(o_totalprice, 12) OVER w AS l12,
    (lag(o_totalprice, 1) OVER w - lag(o_totalprice, 13) OVER w) / (lag(o_totalprice, 13) OVER w + 1e-8) AS gr,
    avg(o_totalprice) OVER (ORDER BY order_year, order_month, o_orderstatus ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3,
    avg(o_totalprice) OVER (ORDER BY order_year, order_month, o_orderstatus ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS r12
    FROM g WINDOW w AS (ORDER BY order_year, order_month, o_orderstatus)),
  p AS (SELECT order_year, order_month, o_orderstatus, o_totalprice, o_custkey,
    (order_year - min(order_year) OVER ()) * 12 + order_month - min(order_month) OVER () AS elapsed_time,
    sin(2 * pi() * order_month / 12) AS order_month_sin, cos(2 * pi() * order_month / 12) AS order_month_cos,
    (o_orderstatus = 'F')::DOUBLE AS o_orderstatus_F, (o_orderstatus = 'O')::DOUBLE AS o_orderstatus_O,
    (o_orderstatus = 'P')::DOUBLE AS o_orderstatus_P,
    coalesce(first_value(l1 IGNORE NULLS) OVER f, 0) AS target_lag_1, coalesce(first_value(l12 IGNORE NULLS) OVER f, 0) AS target_lag_yoy,
    coalesce(gr, 0) AS target_yoy_growth, coalesce(first_value(r3 IGNORE NULLS) OVER f, 0) AS target_rolling_mean_3,
    coalesce(first_value(r12 IGNORE NULLS) OVER f, 0) AS target_rolling_mean_yoy FROM raw
    WINDOW f AS (ORDER BY order_year, order_month, o_orderstatus ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

PREPARED_COLUMNS = [
    "o_custkey", "elapsed_time", "order_month_sin", "order_month_cos", "o_orderstatus_F", "o_orderstatus_O",
    "o_orderstatus_P", "target_lag_1", "target_lag_yoy", "target_yoy_growth", "target_rolling_mean_3", "target_rolling_mean_yoy",
]

PREPARE_CONFIG = P.PrepareConfig(
    target="o_totalprice", features=("order_year", "order_month", "o_custkey", "o_orderstatus"),
    group_by=("order_year", "order_month", "o_orderstatus"), onehot_columns=("o_orderstatus", "order_month"),
    modality="forecasting", choose_time=False,
)


@query(
    "prepare_dataset",
    PREPARED_SQL
    + "SELECT order_year, order_month, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in PREPARED_COLUMNS)
    + " FROM p",
)
def prepare_dataset(spark, sf_dir):
    frame, state = P.fit_prepare(order_rows(spark, sf_dir).drop("o_orderkey"), PREPARE_CONFIG)
    if list(state.features) != PREPARED_COLUMNS:
        raise AssertionError(f"unexpected feature order {state.features}")
    return frame.select(
        "order_year", "order_month", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"),
        *[F.round(c, 4).alias(c) for c in PREPARED_COLUMNS],
    )


@query(
    "prepare_new_rows",
    PREPARED_SQL
    + """, s AS (SELECT min(order_year) AS y0, min(order_month) AS m0, avg(target_lag_1) AS a, avg(target_lag_yoy) AS b,
      avg(target_yoy_growth) AS c, avg(target_rolling_mean_3) AS d, avg(target_rolling_mean_yoy) AS e FROM p),
    k AS (SELECT avg(o_custkey) AS cust FROM orders)
    SELECT l_orderkey, l_partkey, l_linenumber, round(cust, 4) AS o_custkey,
      round((year(l_shipdate) - y0) * 12 + month(l_shipdate) - m0, 4)::DOUBLE AS elapsed_time,
      round(sin(2 * pi() * month(l_shipdate) / 12), 4) AS order_month_sin, round(cos(2 * pi() * month(l_shipdate) / 12), 4) AS order_month_cos,
      (l_linestatus = 'F')::DOUBLE AS o_orderstatus_F, (l_linestatus = 'O')::DOUBLE AS o_orderstatus_O,
      (l_linestatus = 'P')::DOUBLE AS o_orderstatus_P, round(a, 2) AS target_lag_1, round(b, 2) AS target_lag_yoy,
      round(c, 4) AS target_yoy_growth, round(d, 2) AS target_rolling_mean_3, round(e, 2) AS target_rolling_mean_yoy
    FROM lineitem, s, k""",
)
def prepare_new_rows(spark, sf_dir):
    _, state = P.fit_prepare(order_rows(spark, sf_dir).drop("o_orderkey"), PREPARE_CONFIG)
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    made = P.apply_prepare(fresh_rows(spark, sf_dir), state, keep=keys)
    coarse = {"target_lag_1", "target_lag_yoy", "target_rolling_mean_3", "target_rolling_mean_yoy"}
    return made.select(*keys, *[F.round(c, 2 if c in coarse else 4).alias(c) for c in PREPARED_COLUMNS])


def _time_choice_sql():
    sets = {True: ["cust", "elapsed", "msin", "mcos"], False: ["cust", "y", "m", "msin", "mcos"]}
    shown = {
        True: "o_custkey,elapsed_time,order_month_sin,order_month_cos", False: "o_custkey,order_year,order_month,order_month_sin,order_month_cos"
    }
    parts = []
    for combined, feats in sets.items():
        fits = "\nUNION ALL ".join(f"SELECT {i} AS fold, {comoments(feats, 'v')} FROM t WHERE fold <> {i}" for i in range(3))
        guess = predicted(feats)
        name = "w" if combined else "o"
        parts.append(f"""{name}b AS MATERIALIZED ({solved(fits, len(feats), ["fold"], alpha="1.0", standard=True)}),
    {name} AS (SELECT avg(r2) AS r2 FROM (SELECT fold, {r2('v', guess)} AS r2 FROM t JOIN {name}b USING (fold) GROUP BY fold))""")
    key = "(year(o_orderdate)::DOUBLE)::VARCHAR || '|' || (month(o_orderdate)::DOUBLE)::VARCHAR || '|' || o_orderkey::VARCHAR"
    return f"""WITH t AS MATERIALIZED (SELECT year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, o_custkey::DOUBLE AS cust,
      (y - min(y) OVER ()) * 12 + m - min(m) OVER () AS elapsed, sin(2 * pi() * m / 12) AS msin, cos(2 * pi() * m / 12) AS mcos,
      o_totalprice * {RATE} AS v, {hash_sql(f"({key})", 'fold')} % 3 AS fold FROM orders), {", ".join(parts)}
    SELECT w.r2 >= o.r2 AS use_combined, CASE WHEN w.r2 >= o.r2 THEN '{shown[True]}' ELSE '{shown[False]}' END AS features,
      (SELECT count(*) FROM t)::BIGINT AS n_rows FROM w, o"""


@query("combined_time_choice", _time_choice_sql())
def combined_time_choice(spark, sf_dir):
    config = P.PrepareConfig(
        target="o_totalprice", features=("o_custkey",), row_key=("o_orderkey",), split_method="random", choose_time=True
    )
    frame, state = P.fit_prepare(order_rows(spark, sf_dir), config)
    counted = frame.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit(state.use_combined).alias("use_combined"), F.lit(",".join(state.features)).alias("features"), "n_rows")


@query(
    "monthly_forecast_quality",
    f"""WITH m AS (SELECT label, sort_key, sum(o_totalprice) / 1e6 AS y FROM ({MONTHLY_SQL}) GROUP BY ALL),
    g AS (SELECT *, lag(y) OVER (ORDER BY sort_key) AS l, row_number() OVER (ORDER BY sort_key) AS i, count(*) OVER () AS n FROM m),
    t AS (SELECT y, coalesce(l, y, 0) AS x, i > n - ceil(n * 0.2) AS is_test FROM g),
    f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM t WHERE NOT is_test)
    SELECT round(1 - sum((y - s * x - c) * (y - s * x - c)) / (count(*) * var_pop(y)), 4) AS r2,
      round(sqrt(avg((y - s * x - c) * (y - s * x - c))), 4) AS rmse, round(avg(abs(y - s * x - c)), 4) AS mae FROM t, f WHERE is_test""",
)
def monthly_forecast_quality(spark, sf_dir):
    """Monthly totals in millions -> lag features -> chronological split -> linear fit -> metrics."""
    months = monthly(spark, sf_dir, series=()).withColumn("o_totalprice", F.col("o_totalprice") / 1e6)
    lagged = L.lag_features(months, "o_totalprice", ["sort_key"], largest=L.MONTH_SERIES_BOUND)
    train, test = D.train_test(D.split(lagged, 0.2, "chronological", order_by=["sort_key"]))
    fitted = M.fit_linear(train, ["target_lag_1"], "o_totalprice")
    return V.regression_metrics(fitted.predict(test), "o_totalprice", "prediction")
