"""Training, prediction and ensembles."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.core import BINARY, MULTICLASS, REGRESSION, TaskSpec, local_rows
from tablewright.operators import knn, models, projection_index, training
from tablewright.operators.errors import top_features
from tablewright.operators.evaluation import builtin_importances, permutation_importance
from tablewright.plans.base import plan, r, rounded, table
from tablewright.plans.split_plans import _hash


def _rows(spark, folder):
    """Orders with a numeric key, five features and three targets."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return orders.join(customers, "o_custkey").select(
        "o_orderkey",
        "o_totalprice",
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
        (F.col("o_orderkey") % 97).alias("noise"),
        "o_orderstatus",
        F.when(F.col("o_totalprice") + F.col("c_acctbal") * 10 > 280_000, "high")
        .otherwise("low")
        .alias("level"),
        (F.col("c_acctbal") * 3 + F.col("c_nationkey") * 50 + F.col("o_orderkey") % 7).alias("y"),
    )


BINARY_TASK = TaskSpec("level", BINARY)
COLUMNS = ["o_totalprice", "balance", "nation", "noise"]


def _binary(spark, folder, folds=3):
    return training.training_set(_rows(spark, folder), COLUMNS, BINARY_TASK, ["o_orderkey"], folds)


def _regression(spark, folder, folds=3):
    return training.training_set(
        _rows(spark, folder), ["balance", "nation", "noise"], TaskSpec("y", REGRESSION),
        ["o_orderkey"], folds,
    )


@plan("train_model", "F7")
def train_model(spark, folder):
    run = training.train_model(
        _binary(spark, folder), "random_forest", {"n_estimators": 10, "max_depth": 5}
    )
    return training.run_table(spark, [run]).drop("run_id", "training_time")


@plan("train_multiclass", "F7")
def train_multiclass(spark, folder):
    data = training.training_set(
        _rows(spark, folder), COLUMNS, TaskSpec("o_orderstatus", MULTICLASS), ["o_orderkey"], 3
    )
    run = training.train_model(data, "xgboost", {"n_estimators": 3, "max_depth": 3})
    return training.run_table(spark, [run]).drop("run_id", "training_time")


@plan(
    "linear_regression_fit", "F7 F10",
    f"""SELECT o_orderkey, {r('''regr_slope(o_totalprice, o_orderkey) OVER () * o_orderkey +
 regr_intercept(o_totalprice, o_orderkey) OVER ()'''.replace(chr(10), ''), 2)} AS prediction
 FROM orders""",
)
def linear_regression_fit(spark, folder):
    """Least squares on one feature, scored on all rows."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    rows = training.assemble(
        orders.select(
            F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("label")
        ),
        ["x"],
    )
    model = models.make_learner("linear_regression", REGRESSION).fit(rows)
    out = training.predict(
        model, orders.select("o_orderkey", F.col("o_orderkey").cast("double").alias("x")), ["x"]
    )
    return rounded(out.select("o_orderkey", "prediction"), "prediction", digits=2)


_GAP_ROWS = """rows AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN c_nationkey END AS nation,
 o_totalprice + CASE WHEN c_nationkey >= 12 OR o_orderkey % 5 = 0 THEN 400000 ELSE 0 END AS y
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _gap_rows(spark, folder):
    """A feature that every fifth row lacks; these rows look like those of the large nations."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    odd = F.col("o_orderkey") % 5 == 0
    return orders.join(customers, "o_custkey").select(
        "o_orderkey", F.when(~odd, F.col("c_nationkey")).alias("nation"),
        (F.col("o_totalprice") + F.when((F.col("c_nationkey") >= 12) | odd, 400_000).otherwise(0))
        .alias("y"),
    )


@plan(
    "tree_with_gaps", "F7 F10",
    f"""WITH {_GAP_ROWS}, sides AS (SELECT t, side, o_orderkey, y,
 coalesce(nation < t, side = 'below') AS l FROM rows, (SELECT DISTINCT nation AS t FROM rows
 WHERE nation IS NOT NULL), (VALUES ('below'), ('above')) AS v(side)),
 fits AS (SELECT t, side, avg(y) FILTER (WHERE l) AS low, avg(y) FILTER (WHERE NOT l) AS high,
 sum(y) FILTER (WHERE l) * avg(y) FILTER (WHERE l)
 + sum(y) FILTER (WHERE NOT l) * avg(y) FILTER (WHERE NOT l) AS gain FROM sides GROUP BY t, side),
 best AS (SELECT * FROM fits WHERE gain IS NOT NULL ORDER BY gain DESC LIMIT 1)
 SELECT o_orderkey, {r("CASE WHEN coalesce(nation < t, side = 'below') THEN low ELSE high END", 2)}
 AS prediction FROM rows, best""",
)
def tree_with_gaps(spark, folder):
    """A tree of one split over a feature with gaps; the better side of them is learned."""
    rows = _gap_rows(spark, folder)
    data = training.training_set(
        rows, ["nation"], TaskSpec("y", REGRESSION), ["o_orderkey"], 3, missing="learn")
    model = data.fit(
        "extra_trees", {"n_estimators": 1, "max_depth": 1, "max_features": None}, 42)
    out = training.predict(model, rows, ["nation"])
    return rounded(out.select("o_orderkey", "prediction"), "prediction", digits=2)


@plan("train_with_gaps", "F7")
def train_with_gaps(spark, folder):
    """Fold scores of boosted trees on rows of which many lack a feature."""
    rows = _rows(spark, folder).withColumns({
        "balance": F.when(F.col("o_orderkey") % 4 != 0, F.col("balance")),
        "nation": F.when(F.col("balance") > 0, F.col("nation"))})
    data = training.training_set(
        rows, COLUMNS, BINARY_TASK, ["o_orderkey"], 3, missing="learn")
    run = training.train_model(data, "xgboost", {"n_estimators": 5, "max_depth": 3})
    return training.run_table(spark, [run]).drop("run_id", "training_time")


@plan("tune_candidates", "F8")
def tune_candidates(spark, folder):
    runs = training.tune(
        _binary(spark, folder),
        [
            {"model_type": "logistic_regression", "hyperparameters": {"max_iter": 50}},
            {"model_type": "random_forest", "hyperparameters": {"n_estimators": 5}},
            {"model_type": "svc", "hyperparameters": {"C": 1.0}},
        ],
    )
    return training.run_table(spark, runs).drop("training_time")


@plan("tune_regression", "F8")
def tune_regression(spark, folder):
    runs = training.tune(
        _regression(spark, folder),
        [
            {"model_type": "linear_regression"},
            {"model_type": "elasticnet", "hyperparameters": {"alpha": 0.1}},
            {"model_type": "lightgbm", "hyperparameters": {"n_estimators": 5, "max_depth": 3}},
        ],
    )
    return training.run_table(spark, runs).drop("training_time")


@plan("mlp_classifier", "F7")
def mlp_classifier(spark, folder):
    run = training.train_model(
        _binary(spark, folder, 2), "mlp_classifier",
        {"hidden_layer_sizes": (8,), "max_iter": 100},
    )
    return training.run_table(spark, [run]).drop("run_id", "training_time")


@plan("predict_probabilities", "F10")
def predict_probabilities(spark, folder):
    data = _binary(spark, folder)
    model = data.learner("logistic_regression", {"max_iter": 50}, 42).fit(data.rows)
    scored = training.predict(model, _rows(spark, folder), COLUMNS, data.classes)
    return scored.select("o_orderkey", "predicted_class", "prediction", "probability")


@plan("model_catalogue", "F13")
def model_catalogue(spark, folder):
    """Catalogue entries that fit the task of a column of the data."""
    from tablewright.core import resolve_task

    spec = resolve_task(table(spark, folder, "orders"), "o_totalprice")
    return models.available_models(spark, spec.task)


@plan("stacking_ensemble", "F14")
def stacking_ensemble(spark, folder):
    run = training.train_stacking(
        _binary(spark, folder),
        [
            {"model_type": "random_forest", "hyperparameters": {"n_estimators": 5}},
            {"model_type": "logistic_regression", "hyperparameters": {"max_iter": 30}},
        ],
        meta_params={"max_iter": 30},
    )
    rows = [("ensemble", run.mean_score, run.std_score), *run.components]
    return local_rows(spark, rows, "component string, mean_score double, std_score double")


@plan("seed_ensemble", "F16")
def seed_ensemble(spark, folder):
    run = training.train_seed_ensemble(
        _rows(spark, folder), COLUMNS, BINARY_TASK, ["o_orderkey"], "random_forest",
        {"n_estimators": 5, "max_depth": 4}, n_seeds=2, folds=2,
    )
    scored = run.model.transform(training.assemble(_rows(spark, folder), COLUMNS))
    return scored.select("o_orderkey", "prediction", "probability")


MODELS = ("m0", "m1", "m2", "m3")
_VOTES = """v AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
 """ + ", ".join(
    f"CASE WHEN event_id * {7 + 4 * i} % 10 < {6 + i % 2} THEN CASE WHEN event_type = 'purchase' "
    f"THEN 1 ELSE 0 END ELSE CAST(event_id % 2 AS INTEGER) END AS m{i}"
    for i in range(4)
) + " FROM events)"


def _votes(spark, folder):
    e = table(spark, folder, "events")
    label = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return e.select(
        "event_id", label.alias("label"),
        *[
            F.when((F.col("event_id") * (7 + 4 * i)) % 10 < 6 + i % 2, label)
            .otherwise((F.col("event_id") % 2).cast("int"))
            .alias(f"m{i}")
            for i in range(4)
        ],
    )


def _vote_sql(names):
    counts = {
        n: " + ".join(f"(CASE WHEN {n} = {m} THEN 1 ELSE 0 END)" for m in names) for n in names
    }
    top = f"greatest({', '.join(counts.values())})"
    return "CASE " + " ".join(f"WHEN {counts[n]} = {top} THEN {n}" for n in names) + " END"


@plan(
    "vote_combiner", "F17",
    f"""WITH {_VOTES} SELECT event_id, {_vote_sql(MODELS)} AS vote,
 {r('(m0 + m1 + m2 + m3) / 4.0e0')} AS mean FROM v""",
)
def vote_combiner(spark, folder):
    df = _votes(spark, folder)
    voted = training.combine_predictions(df, MODELS, BINARY).withColumnRenamed("prediction", "vote")
    both = training.combine_predictions(voted, MODELS, REGRESSION)
    return rounded(
        both.select("event_id", "vote", F.col("prediction").alias("mean")), "mean"
    )


def _subset_scores():
    """Accuracy of every ordered selection that greedy search can visit."""
    from itertools import permutations

    parts = []
    for size in range(1, len(MODELS) + 1):
        for p in permutations(MODELS, size):
            parts.append(
                f"SELECT '{','.join(p)}' AS s, {size} AS k, avg(CASE WHEN {_vote_sql(p)} = label "
                f"THEN 1.0e0 ELSE 0 END) AS a FROM v"
            )
    return " UNION ALL ".join(parts)


@plan(
    "hill_climbing", "F15",
    f"""WITH RECURSIVE {_VOTES}, sc AS ({_subset_scores()}),
 climb(k, s, a) AS (SELECT * FROM (SELECT k, s, a FROM sc WHERE k = 1 ORDER BY a DESC, s LIMIT 1)
 UNION ALL SELECT * FROM (SELECT n.k, n.s, n.a FROM climb c JOIN sc n ON n.k = c.k + 1
 AND starts_with(n.s, c.s || ',') AND n.a > c.a ORDER BY n.a DESC, n.s LIMIT 1))
 SELECT k AS step, split_part(s, ',', k) AS model, {r('a', 6)} AS score FROM climb""",
)
def hill_climbing(spark, folder):
    found = training.hill_climb(_votes(spark, folder), MODELS, BINARY)
    return rounded(
        local_rows(spark, found.steps, "step int, model string, score double"), "score", digits=6
    )


_BLEND = """b AS (SELECT event_id, value AS label, """ + ", ".join(
    f"value * 0.7e0 + (event_id // {10**i} % 10) * {12.5 + i}e0 AS m{i}" for i in range(4)
) + " FROM events)"


def _blend_scores():
    from itertools import permutations

    parts = []
    for size in range(1, len(MODELS) + 1):
        for p in permutations(MODELS, size):
            e = f"(label - ({' + '.join(p)}) / {size}.0e0)"
            parts.append(
                f"SELECT '{','.join(p)}' AS s, {size} AS k, "
                f"1 - avg({e} * {e}) / var_pop(label) AS a FROM b"
            )
    return " UNION ALL ".join(parts)


@plan(
    "hill_climbing_regression", "F15",
    f"""WITH RECURSIVE {_BLEND}, sc AS ({_blend_scores()}),
 climb(k, s, a) AS (SELECT * FROM (SELECT k, s, a FROM sc WHERE k = 1 ORDER BY a DESC, s LIMIT 1)
 UNION ALL SELECT * FROM (SELECT n.k, n.s, n.a FROM climb c JOIN sc n ON n.k = c.k + 1
 AND starts_with(n.s, c.s || ',') AND n.a > c.a ORDER BY n.a DESC, n.s LIMIT 1))
 SELECT k AS step, split_part(s, ',', k) AS model, {r('a', 6)} AS score FROM climb""",
)
def hill_climbing_regression(spark, folder):
    e = table(spark, folder, "events")
    df = e.select(
        F.col("value").alias("label"),
        *[
            (
                F.col("value") * 0.7
                + F.pmod(F.floor(F.col("event_id") / 10**i), F.lit(10)) * (12.5 + i)
            ).alias(f"m{i}")
            for i in range(4)
        ],
    )
    found = training.hill_climb(df, MODELS, REGRESSION)
    return rounded(
        local_rows(spark, found.steps, "step int, model string, score double"), "score", digits=6
    )


@plan("nearest_neighbours_projection", "F7")
def nearest_neighbours_projection(spark, folder):
    """Ten neighbours of every twentieth vector among all, by the index, with its measured recall."""
    usable = "embedding IS NOT NULL AND forall(embedding, v -> v IS NOT NULL)"
    vectors = table(spark, folder, "embeddings").where(usable).select(
        F.col("vec_id").alias("tid"), F.col("embedding").cast("array<double>").alias("x"),
        F.lit(0.0).alias("y"))
    asked = vectors.where(F.col("tid") % 20 == 0).select(F.col("tid").alias("qid"), "x")
    index = projection_index.build_index(vectors, cells=32)
    index = projection_index.calibrate(index, asked, vectors, 10, 0.95)
    found = projection_index.search(index, asked, 10)
    return found.select("qid", "place", "tid", "dist", F.lit(index.recall).alias("recall"))


@plan("feature_importance", "G8 I6")
def feature_importance(spark, folder):
    data = _binary(spark, folder)
    model = data.learner("random_forest", {"n_estimators": 10, "max_depth": 5}, 42).fit(data.rows)
    best = top_features(model, COLUMNS, 2)
    rows = [(f, v, f in best) for f, v in builtin_importances(model, COLUMNS)]
    return local_rows(spark, rows, "feature string, importance double, top boolean")


def _places_sql(r):
    """Partner of place i in repeat r: the first factor from the start that has none in common."""
    start = 65_537 + 7_919 * (r + 1) + 42
    factor = f"(SELECT min(a) FROM range({start}, {start + 1000}) AS t(a), size WHERE gcd(a, n) = 1)"
    return f"SELECT {r} AS r, i, (i * {factor} + {43 * (r + 1)} % n) % n AS partner FROM places, size"


@plan(
    "permutation_importance_of_a_formula", "G9 H2 H4",
    f"""WITH size AS (SELECT count(*) AS n FROM events), places AS (SELECT value AS y,
 CAST(user_id AS DOUBLE) AS a, CAST(event_id % 97 AS DOUBLE) AS b,
 row_number() OVER (ORDER BY {_hash('event_id')}, CAST(event_id AS VARCHAR)) - 1 AS i FROM events),
 pairs AS ({" UNION ALL ".join(_places_sql(r) for r in range(10))}),
 swapped AS (SELECT r, p.y, p.a, p.b, o.a AS oa, o.b AS ob FROM pairs JOIN places p USING (i)
 JOIN places o ON o.i = partner),
 errors AS (SELECT r, 1 - avg(pow(y - a / 20 - b / 2, 2)) / var_pop(y) AS plain,
 1 - avg(pow(y - oa / 20 - b / 2, 2)) / var_pop(y) AS sa,
 1 - avg(pow(y - a / 20 - ob / 2, 2)) / var_pop(y) AS sb FROM swapped GROUP BY r)
 SELECT 'a' AS feature, {r('avg(plain - sa)')} AS importance FROM errors
 UNION ALL SELECT 'b', {r('avg(plain - sb)')} FROM errors""",
)
def permutation_importance_of_a_formula(spark, folder):
    """Ten repeats over a stated formula in place of a fitted model."""
    rows = table(spark, folder, "events").select(
        "event_id", F.col("value").alias("label"), F.col("user_id").cast("double").alias("a"),
        (F.col("event_id") % 97).cast("double").alias("b"))

    def formula(d):
        x = vector_to_array("features")
        return d.withColumn("prediction", x[0] / 20 + x[1] / 2)

    found = permutation_importance(rows, formula, ["a", "b"], ["event_id"], REGRESSION)
    return rounded(found, "importance")


@plan("permutation_importance", "G9 H2")
def permutation(spark, folder):
    data = _binary(spark, folder)
    model = data.learner("logistic_regression", {"max_iter": 50}, 42).fit(data.rows)
    labelled = training.encode_label(_rows(spark, folder), BINARY_TASK, data.classes)
    return permutation_importance(
        labelled, lambda d: training.apply_model(model, d), COLUMNS, ["o_orderkey"], BINARY,
    )


@plan(
    "nearest_neighbours", "F7",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x
 FROM embeddings), q AS (SELECT a.vec_id AS qid, b.vec_id AS tid, sqrt(list_sum(list_transform(
 list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM e a, e b
 WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)
 SELECT qid, tid, CAST(place AS INTEGER) AS place, round(d, 6) + 0.0e0 AS dist FROM
 (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS place FROM q)
 WHERE place <= 5""",
)
def nearest(spark, folder):
    e = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("double").alias("y"),
    )
    queries = e.where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("qid"), "x")
    train = e.where(F.col("vec_id") % 3 != 0).select(F.col("vec_id").alias("tid"), "x", "y")
    found = knn.nearest_neighbours(queries, train, 5)
    return rounded(found.select("qid", "tid", "place", "dist"), "dist", digits=6)


@plan("knn_classifier", "F7 F10")
def knn_classifier(spark, folder):
    e = table(spark, folder, "embeddings")
    parts = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]
    rows = e.select("vec_id", "label", *parts)
    data = training.training_set(
        rows, [f"x{i}" for i in range(64)], TaskSpec("label", MULTICLASS), ["vec_id"], 2
    )
    run = training.train_model(data, "knn_classifier", {"n_neighbors": 5, "weights": "distance"})
    return training.run_table(spark, [run]).drop("run_id", "training_time")


@plan("knn_regressor", "F7")
def knn_regressor(spark, folder):
    run = training.train_model(_regression(spark, folder, 2), "knn_regressor", {"n_neighbors": 5})
    return training.run_table(spark, [run]).drop("run_id", "training_time")


# least squares on one feature, whose folds, fits and ensembles SQL can follow
_LINE = """line AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x,
 o_totalprice + o_custkey * 300 AS y FROM orders)"""


def _line(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("x"),
        (F.col("o_totalprice") + F.col("o_custkey") * 300).alias("y"))


def _folded(seed, folds):
    """Rows of ``line`` with their fold, as the seeded hash of the key gives it."""
    return (f"SELECT k, x, y, (row_number() OVER (ORDER BY {_hash('k', seed)}) - 1) * {folds} "
            "// count(*) OVER () AS fold FROM line")


def _fits(source, x="x", y="y", out="p", folds=3):
    """Predictions of each fold by the line through the rows of the other folds."""
    parts = [
        f"SELECT s.*, f.a + f.b * s.{x} AS {out} FROM {source} s, (SELECT regr_intercept({y}, {x}) AS a, "
        f"regr_slope({y}, {x}) AS b FROM {source} WHERE fold <> {k}) f WHERE fold = {k}"
        for k in range(folds)]
    return " UNION ALL ".join(parts)


def _fold_r2(source, p="p", y="y"):
    return f"SELECT fold, 1 - avg(pow({y} - {p}, 2)) / var_pop({y}) AS s FROM {source} GROUP BY fold"


LINE_TASK = TaskSpec("y", REGRESSION)


@plan(
    "tune_lines", "F8 F7",
    f"""WITH {_LINE}, f AS ({_folded(42, 3)}), oof AS ({_fits('f')}), r2 AS ({_fold_r2('oof')})
 SELECT model_type, hyperparameters, 'r2' AS metric, {r('avg(s)')} AS mean_score,
 {r('stddev_pop(s)')} AS std_score, 3 AS n_folds FROM r2,
 (VALUES ('linear_regression', '{{}}'), ('elasticnet', '{{"alpha": 0.0}}')) AS m(model_type, hyperparameters)
 GROUP BY model_type, hyperparameters""",
)
def tune_lines(spark, folder):
    """Two ways to the same least-squares line as candidates."""
    data = training.training_set(_line(spark, folder), ["x"], LINE_TASK, ["o_orderkey"], 3)
    runs = training.tune(data, [
        {"model_type": "linear_regression"},
        {"model_type": "elasticnet", "hyperparameters": {"alpha": 0.0}}])
    return rounded(training.run_table(spark, runs).drop("run_id", "training_time"),
                   "mean_score", "std_score")


@plan(
    "stacking_lines", "F14",
    f"""WITH {_LINE}, f AS ({_folded(42, 3)}), oof AS ({_fits('f')}), top AS ({_fits('oof', 'p', 'y', 'q')}),
 base AS ({_fold_r2('oof')}), meta AS ({_fold_r2('top', 'q')})
 SELECT 'ensemble' AS component, {r('avg(s)')} AS mean_score, {r('stddev_pop(s)')} AS std_score FROM meta
 UNION ALL SELECT 'linear_regression', {r('avg(s)')}, {r('stddev_pop(s)')} FROM base""",
)
def stacking_lines(spark, folder):
    """A line over the out-of-fold predictions of a line."""
    data = training.training_set(_line(spark, folder), ["x"], LINE_TASK, ["o_orderkey"], 3)
    run = training.train_stacking(data, [{"model_type": "linear_regression"}], "linear_regression")
    rows = [("ensemble", run.mean_score, run.std_score), *run.components]
    return rounded(local_rows(spark, rows, "component string, mean_score double, std_score double"),
                   "mean_score", "std_score")


@plan(
    "seed_ensemble_lines", "F16",
    f"WITH {_LINE}, "
    + ", ".join(f"f{i} AS ({_folded(i, 3)}), o{i} AS ({_fits(f'f{i}')}), r{i} AS ({_fold_r2(f'o{i}')})"
                for i in range(1, 6))
    + ", m AS (" + " UNION ALL ".join(f"SELECT avg(s) AS s FROM r{i}" for i in range(1, 6))
    + f") SELECT 5 AS n_seeds, {r('avg(s)')} AS mean_score, {r('stddev_pop(s)', 6)} AS std_score FROM m",
)
def seed_ensemble_lines(spark, folder):
    """Five seeds, each with folds of its own."""
    run = training.train_seed_ensemble(
        _line(spark, folder), ["x"], LINE_TASK, ["o_orderkey"], "linear_regression", n_seeds=5, folds=3)
    out = local_rows(spark, [(len(run.cv_scores), run.mean_score, run.std_score)],
                     "n_seeds int, mean_score double, std_score double")
    return rounded(rounded(out, "mean_score"), "std_score", digits=6)


@plan(
    "feature_importance_of_a_plane", "G8 I6",
    f"""WITH p AS (SELECT o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS a,
 CAST(o_orderkey % 97 AS DOUBLE) AS b FROM orders),
 c AS (SELECT covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab,
 covar_pop(a, y + 40 * a - 900 * b) AS ay, covar_pop(b, y + 40 * a - 900 * b) AS by_ FROM p),
 w AS (SELECT abs((ay * bb - by_ * ab) / (aa * bb - ab * ab)) AS wa,
 abs((by_ * aa - ay * ab) / (aa * bb - ab * ab)) AS wb FROM c)
 SELECT 'a' AS feature, {r('wa')} AS importance, wa > wb AS top FROM w
 UNION ALL SELECT 'b', {r('wb')}, wb > wa FROM w""",
)
def feature_importance_of_a_plane(spark, folder):
    """Absolute coefficients of least squares on two features, and the larger of them."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("a"),
        (F.col("o_orderkey") % 97).cast("double").alias("b"), "o_totalprice",
    ).withColumn("y", F.col("o_totalprice") + 40 * F.col("a") - 900 * F.col("b"))
    data = training.training_set(rows, ["a", "b"], LINE_TASK, ["o_orderkey"], 2)
    model = data.fit("linear_regression", None, 42)
    best = top_features(model, ["a", "b"], 1)
    found = [(f, v, f in best) for f, v in builtin_importances(model, ["a", "b"])]
    return rounded(local_rows(spark, found, "feature string, importance double, top boolean"), "importance")
