"""Run history, strategies, registry and run log."""

from pyspark.sql import functions as F

from tablewright.functions.expressions import composite_score
from tablewright.operators import runs
from tablewright.plans.base import RUNS, plan, pseudo_runs, r, rounded, scratch, table
from tablewright.sources.logs import append_runs, parse_lines, read_runs


@plan(
    "optimization_history", "G13 J1 H2",
    f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER w AS run_index, max(score) OVER w
 AS best_so_far, max(score) OVER (PARTITION BY workspace ORDER BY created_at, run_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM runs
 WINDOW w AS (PARTITION BY workspace ORDER BY created_at, run_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT workspace, run_id, score, created_at, model_type, run_index, best_so_far,
 previous IS NULL OR score > previous AS is_best FROM b""",
)
def optimization_history(spark, folder):
    return runs.optimization_history(pseudo_runs(spark, folder))


_BEST = """first_value({c}) OVER (PARTITION BY workspace ORDER BY score {d}, created_at, run_id)"""


@plan(
    "best_runs", "J1",
    f"""WITH {RUNS} SELECT DISTINCT workspace, {_BEST.format(c='run_id', d='DESC')}
 AS best_run_id, max(score) OVER (PARTITION BY workspace) AS best_score FROM runs""",
)
def best_runs(spark, folder):
    return runs.best_runs(pseudo_runs(spark, folder))


@plan(
    "best_runs_lower", "J1 G14",
    f"""WITH {RUNS} SELECT DISTINCT workspace, {_BEST.format(c='run_id', d='ASC')}
 AS best_run_id, min(score) OVER (PARTITION BY workspace) AS best_score FROM runs""",
)
def best_runs_lower(spark, folder):
    return runs.best_runs(pseudo_runs(spark, folder), metric="rmse")


# metrics in long form: one run per order priority
_METRICS = """m AS (SELECT o_orderpriority AS run_id, unnest(['accuracy', 'rmse']) AS metric,
 unnest([avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0 END), stddev_pop(o_totalprice)])
 AS value FROM orders GROUP BY 1)"""


def _metrics(spark, folder):
    stats = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"),
        F.stddev_pop("o_totalprice").alias("rmse"),
    )
    return stats.unpivot("run_id", ["accuracy", "rmse"], "metric", "value")


@plan(
    "compare_runs", "G12 G14",
    f"""WITH {_METRICS}, c AS (SELECT * FROM m WHERE run_id IN ('1-URGENT', '2-HIGH', '5-LOW')),
 b AS (SELECT run_id AS best FROM c WHERE metric = 'accuracy' ORDER BY value DESC LIMIT 1)
 SELECT c.run_id, c.metric, {r('c.value')} AS value, {r('c.value - t.value', 3)} AS delta_to_best,
 c.run_id = best AS is_best, 'accuracy' AS primary_metric FROM c, b JOIN m t
 ON t.run_id = best WHERE t.metric = c.metric""",
)
def compare_runs(spark, folder):
    out = runs.compare_runs(
        _metrics(spark, folder), ["1-URGENT", "2-HIGH", "5-LOW", "unknown run"]
    )
    return rounded(rounded(out, "value"), "delta_to_best", digits=3)


@plan(
    "metric_directions", "G14",
    f"""WITH {_METRICS} SELECT DISTINCT metric, metric IN ('rmse', 'mse', 'mae', 'log_loss')
 AS lower_is_better, CASE metric WHEN 'accuracy' THEN 1 WHEN 'rmse' THEN 5 END AS preference
 FROM m""",
)
def metric_directions(spark, folder):
    return runs.metric_directions(_metrics(spark, folder))


@plan(
    "score_trajectory", "J2",
    f"""WITH {RUNS} SELECT workspace, run_id, model_type, score, CAST(recency AS INTEGER)
 AS recency FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY created_at DESC,
 run_id DESC) AS recency FROM runs) WHERE recency <= 5""",
)
def score_trajectory(spark, folder):
    return runs.score_trajectory(pseudo_runs(spark, folder))


@plan(
    "strategy_sequences", "J3",
    f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY created_at,
 run_id) AS i FROM runs), b AS (SELECT workspace, max(score) AS s, count(*) AS n FROM o GROUP BY 1),
 t AS (SELECT o.workspace, min(i) AS i FROM o JOIN b ON o.workspace = b.workspace AND score = s
 GROUP BY 1) SELECT b.workspace, f.model_type AS baseline_model, z.model_type AS final_model,
 s AS final_score, n AS total_runs, t.i AS runs_to_best FROM b JOIN t USING (workspace)
 JOIN o f ON f.workspace = b.workspace AND f.i = 1
 JOIN o z ON z.workspace = b.workspace AND z.i = t.i""",
)
def strategy_sequences(spark, folder):
    return runs.strategy_sequences(pseudo_runs(spark, folder))


@plan(
    "strategy_path", "J3 H2",
    f"""WITH {RUNS} SELECT workspace, row_number() OVER (PARTITION BY workspace
 ORDER BY created_at, run_id) AS run_index, model_type FROM runs""",
)
def strategy_path(spark, folder):
    return runs.strategy_path(pseudo_runs(spark, folder))


@plan(
    "past_strategies", "J4",
    """SELECT ts AS date, event_type AS strategy, event_id FROM events
 ORDER BY ts DESC, event_type, event_id LIMIT 10""",
)
def past_strategies(spark, folder):
    return runs.past_strategies(
        table(spark, folder, "events").select(
            F.col("ts").alias("date"), F.col("event_type").alias("strategy"), "event_id"
        )
    )


@plan(
    "upsert_strategies", "J6",
    """SELECT size_class, task, mix, max_by(path, (updated_at, event_id)) AS path,
 max(updated_at) AS updated_at, max_by(event_id, (updated_at, event_id)) AS event_id FROM (SELECT
 CASE WHEN value < 20 THEN 'small' WHEN value < 80 THEN 'medium' ELSE 'large' END AS size_class,
 event_type AS task, CASE WHEN user_id % 2 = 0 THEN 'mixed' ELSE 'all_numeric' END AS mix,
 'path ' || event_id AS path, ts AS updated_at, event_id FROM events) GROUP BY 1, 2, 3""",
)
def upsert_strategies(spark, folder):
    value = F.col("value")
    entries = table(spark, folder, "events").select(
        F.when(value < 20, "small").when(value < 80, "medium").otherwise("large").alias(
            "size_class"
        ),
        F.col("event_type").alias("task"),
        F.when(F.col("user_id") % 2 == 0, "mixed").otherwise("all_numeric").alias("mix"),
        F.concat(F.lit("path "), F.col("event_id").cast("string")).alias("path"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )
    old = entries.where(F.col("event_id") % 2 == 0)
    new = entries.where(F.col("event_id") % 2 == 1)
    return runs.upsert_strategies(old, new, ["size_class", "task", "mix"], "updated_at")


@plan(
    "archetypes", "J6",
    """SELECT DISTINCT upper(event_type[1]) || event_type[2:] || ' binary classification, mostly '
 || 'numeric features' AS archetype FROM events""",
)
def archetypes(spark, folder):
    return table(spark, folder, "events").select(
        runs.archetype(
            F.col("event_type"), F.lit("binary_classification"), F.lit("mostly_numeric")
        ).alias("archetype")
    ).distinct()


@plan(
    "composite_score", "J7",
    f"""SELECT event_id, {r('''0.6e0 * greatest(0, least(1, value / 100)) + 0.25e0 * CASE WHEN
 user_id % 5 > 0 THEN greatest(0, least(1, 1 - (event_id % 7) * 1.0e0 / (user_id % 5))) ELSE 0 END
 + 0.15e0 * greatest(0, least(1, 1 - (event_id % 13) / 20.0e0))''')} AS composite FROM events""",
)
def composite(spark, folder):
    e = table(spark, folder, "events")
    score = composite_score(
        F.col("value") / 100, F.col("event_id") % 7, F.col("user_id") % 5,
        F.col("event_id") % 13, F.lit(20),
    )
    return rounded(e.select("event_id", score.alias("composite")), "composite")


REGISTRY = "SELECT event_id + 1 AS id, event_type AS model_type, value AS best_score FROM events"


def _registry(spark, folder):
    return table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("id"), F.col("event_type").alias("model_type"),
        F.col("value").alias("best_score"),
    )


@plan(
    "register_model", "J8",
    f"""WITH g AS ({REGISTRY}) SELECT * FROM g UNION ALL SELECT max(id) + 1, 'stacking', 0.5e0
 FROM g""",
)
def register_model(spark, folder):
    return runs.register_model(
        _registry(spark, folder), {"model_type": "stacking", "best_score": 0.5}
    )


@plan("current_best", "J8", f"{REGISTRY} ORDER BY id DESC LIMIT 1")
def current_best(spark, folder):
    return runs.current_best(_registry(spark, folder))


@plan(
    "run_log", "A7",
    """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE event_id % 4 <> 0""",
)
def run_log(spark, folder):
    """A log appended to twice, once by a writer that was cut short in every fourth line."""
    line = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '),
        F.get_json_object("props", "$.k"), F.lit("}"),
    )
    broken = F.when(F.col("event_id") % 4 == 0, F.substring(line, 1, 12)).otherwise(line)
    events, path = table(spark, folder, "events"), scratch(spark)
    even = F.col("event_id") % 2 == 0
    schema = "event_id long, k long"
    whole = parse_lines(events.where(~even).select(line.alias("line")), "line", schema)
    append_runs(whole, path)
    events.where(even).select(broken.alias("value")).write.mode("append").text(path)
    return read_runs(spark, path, schema)


