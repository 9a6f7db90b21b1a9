"""Walk-forward scores with their controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import families
from chronofold.plans import components, evaluate
from chronofold.plans.folds import Fold, walk_forward
from chronofold.plans.moments import MomentScorer
from chronofold.plans.predictions import PredictionStore
from chronofold.queries.roles import ORDER_SQL, order_history
from chronofold.sources import scratch

FEATURES = ["points_mean_5", "minutes_mean_5"]


def _frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Fold]]:
    stats = order_history(spark, sf_dir)
    rows = families.training_frame(families.deadlines(stats), stats, ["minutes", "total_points"], {"points_mean_5": ("total_points", "mean", 5), "minutes_mean_5": ("minutes", "mean", 5)})
    # All that follows makes several passes over these rows.
    rows = scratch.written(families.timeline(rows).withColumn("signal", F.col("label_total_points") * 0.5 + evaluate.noise(3, "player_code", "season", "gameweek_id")))
    times = [r[0] for r in rows.select("timeline").distinct().orderBy("timeline").collect()]
    return rows, walk_forward(times, 150, 60, embargo=1)


def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE by fold of the features, with a planted signal, and with a noise control."""
    rows, folds = _frame(spark, sf_dir)
    rows = rows.withColumn("noise", evaluate.noise(9, "player_code", "season", "gameweek_id"))
    sets = {"base": FEATURES, "signal": [*FEATURES, "signal"], "noise": [*FEATURES, "noise"]}
    scorer = MomentScorer(rows, folds, "label_total_points", [*FEATURES, "signal", "noise"])
    scorer.many(list(sets.values()))
    out = [(f, n, mae, base, name) for name, s in sets.items() for f, (n, mae, base) in scorer.by_fold(s).items()]
    return spark.createDataFrame(out, "fold int, n long, mae double, baseline_mae double, features string")


def shuffled_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled control keeps a column's sums within each season."""
    rows = order_history(spark, sf_dir).select("player_code", "season", "fixture_id", "minutes")
    out = evaluate.shuffled(rows, "minutes", ["season"], ["fixture_id"], 5, "dealt")
    return out.groupBy("season").agg(F.sum("minutes").alias("minutes"), F.sum("dealt").alias("dealt"), F.count(F.lit(1)).alias("n"))


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all folds measures of three programs: one that carries the label's own signal, a window over history, and one that can't be computed."""
    from chronofold.plans.discover import Setting, discover
    from chronofold.plans.nodes import FeatureProgram, Rolling, Source

    rows, folds = _frame(spark, sf_dir)
    rows = rows.withColumn("signal", F.col("label_total_points") * 0.5 + F.pmod(F.col("player_code") * 31 + F.col("gameweek_id") * 17, F.lit(13)) / 13.0)
    s = Setting(rows, order_history(spark, sf_dir), ("player_code", "season", "gameweek_id"), "label_total_points", ("points_mean_5",), tuple(folds), noise_trials=2, entity="player_code")
    programs = [FeatureProgram("planted", Source("signal", "entity")), FeatureProgram("window", Rolling(Source("total_points"), 3)), FeatureProgram("absent", Rolling(Source("nothing"), 3))]
    out = discover(s, programs)
    return out.select("feature", "leakage_passed", (F.col("verdict") == "accepted").alias("accepted"), *(F.round(c, 6).alias(c) for c in ("incremental", "win_rate", "missingness")))


DISCOVERY_SQL = f"""WITH {ORDER_SQL}, d AS (SELECT season, gameweek_id, min(kickoff_time) - INTERVAL 90 MINUTE AS t FROM hist GROUP BY ALL),
 l AS (SELECT player_code, season, gameweek_id, sum(total_points)::DOUBLE AS label FROM hist GROUP BY ALL),
 r AS (SELECT l.*, h.total_points AS p, row_number() OVER (PARTITION BY l.player_code, l.season, l.gameweek_id ORDER BY h.available_time DESC, h.kickoff_time DESC, h.season DESC, h.gameweek_id DESC, h.fixture_id DESC) AS k
  FROM l JOIN d USING (season, gameweek_id) LEFT JOIN hist h ON h.player_code = l.player_code AND h.available_time <= d.t),
 w AS (SELECT player_code, season, gameweek_id, label, avg(p) FILTER (WHERE k <= 5) AS base, avg(p) FILTER (WHERE k <= 3) AS win, label * 0.5 + (player_code * 31 + gameweek_id * 17) % 13 / 13.0 AS planted FROM r GROUP BY ALL),
 i AS (SELECT *, dense_rank() OVER (ORDER BY season, gameweek_id) - 1 AS i FROM w),
 f AS (SELECT x AS fold, 150 + 60 * x AS e FROM range(50) q(x) WHERE 150 + 60 * x + 1 + 60 <= (SELECT max(i) + 1 FROM i)),
 tr AS (SELECT f.fold, i.* FROM f JOIN i ON i.i < f.e), te AS (SELECT f.fold, i.* FROM f JOIN i ON i.i BETWEEN f.e + 1 AND f.e + 60),
 m AS (SELECT fold, avg(label) AS y0, coalesce(avg(base), 0) AS mb, coalesce(avg(win), 0) AS mw, coalesce(avg(planted), 0) AS mp FROM tr GROUP BY fold),
 c AS (SELECT fold, label - y0 AS y, coalesce(base - mb, 0) AS b, coalesce(win - mw, 0) AS w, coalesce(planted - mp, 0) AS p FROM tr JOIN m USING (fold)),
 s AS (SELECT fold, sum(b * b) + 1 AS bb, sum(b * y) AS byy, sum(w * w) + 1 AS ww, sum(w * y) AS wy, sum(b * w) AS bw, sum(p * p) + 1 AS pp, sum(p * y) AS py, sum(b * p) AS bp FROM c GROUP BY fold),
 x AS (SELECT te.fold, label, y0, coalesce(base - mb, 0) AS b, coalesce(win - mw, 0) AS w, coalesce(planted - mp, 0) AS p FROM te JOIN m USING (fold)),
 e AS (SELECT fold, count(*) AS n, avg(abs(y0 + b * byy / bb - label)) AS was,
   avg(abs(y0 + b * (byy * ww - wy * bw) / (bb * ww - bw * bw) + w * (wy * bb - byy * bw) / (bb * ww - bw * bw) - label)) AS win,
   avg(abs(y0 + b * (byy * pp - py * bp) / (bb * pp - bp * bp) + p * (py * bb - byy * bp) / (bb * pp - bp * bp) - label)) AS planted FROM x JOIN s USING (fold) GROUP BY fold)
SELECT 'planted' AS feature, true AS leakage_passed, true AS accepted, round(1 - sum(planted * n) / sum(was * n), 6) AS incremental, round(avg((planted < was)::INT), 6) AS win_rate, 0.0::DOUBLE AS missingness FROM e
UNION ALL SELECT 'window', true, false, round(1 - sum(win * n) / sum(was * n), 6), round(avg((win < was)::INT), 6), (SELECT round(avg((win IS NULL)::INT), 6) FROM w) FROM e
UNION ALL SELECT 'absent', false, false, 0.0, 0.0, 0.0"""


def component_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Fold]]:
    """Orders with labels of all families and one column for each order priority but one; folds over years."""
    orders = order_history(spark, sf_dir).select("fixture_id", "minutes", F.col("goals_scored").alias("goals"), F.year("kickoff_time").cast("long").alias("timeline"))
    priority = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fixture_id"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))
    rows = orders.join(priority, "fixture_id").select("*", *((F.col("priority") == k).cast("double").alias(f"priority_{k}") for k in (2, 3, 4, 5)))
    state = F.when(F.col("minutes") >= 60, 2).when(F.col("minutes") > 0, 1).otherwise(0)
    rows = rows.withColumns({"starts": (F.col("minutes") >= 45).cast("int"), "state": state})
    years = [r[0] for r in rows.select("timeline").distinct().orderBy("timeline").collect()]
    return rows, walk_forward(years, 3, 1, embargo=1)


PRIORITIES = [f"priority_{k}" for k in (2, 3, 4, 5)]
HEADS = [components.Head("minutes"), components.Head("goals", "poisson"), components.Head("starts", "binary"), components.Head("state", "classes", 3)]


def component_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, event and amount heads over all folds. With a column a priority, each head's best fit is the priority's share or mean, which SQL knows."""
    rows, folds = component_rows(spark, sf_dir)
    models = components.fit(rows, folds, PRIORITIES, HEADS[:3], ridge=0.0)
    reports = components.fold_reports(components.predict(rows, folds, models), models)
    return reports.select("fold", "label", "train_rows", "rows", *(F.round(c, 6).alias(c) for c in ("mae", "baseline_mae", "loss", "predicted_sd", "predicted_mean", "actual_mean")))


def minutes_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-class head beside the states that expected minutes and the chance to start would give."""
    rows, folds = component_rows(spark, sf_dir)
    models = components.fit(rows, folds, PRIORITIES, [HEADS[0], HEADS[2], HEADS[3]], ridge=0.0)
    reports = components.state_reports(components.predict(rows, folds, models), HEADS[3], "minutes", "starts")
    return reports.select("fold", "rows", *(F.round(c, 6).alias(c) for c in reports.columns if c not in ("fold", "rows")))


COMPONENT_SQL = """
 base AS (SELECT o_orderkey AS k, o_orderpriority AS g, year(o_orderdate) AS y, dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS i,
   (o_orderkey * 7) % 91 AS minutes, o_orderkey % 4 AS goals, CASE WHEN (o_orderkey * 7) % 91 >= 45 THEN 1 ELSE 0 END AS starts,
   CASE WHEN (o_orderkey * 7) % 91 >= 60 THEN 2 WHEN (o_orderkey * 7) % 91 > 0 THEN 1 ELSE 0 END AS state FROM orders),
 folds AS (SELECT e - 3 AS fold, e FROM range(3, 40) r(e) WHERE e + 1 <= (SELECT max(i) FROM base)),
 train AS (SELECT f.fold, b.* FROM folds f JOIN base b ON b.i < f.e),
 test AS (SELECT f.fold, b.* FROM folds f JOIN base b ON b.i = f.e + 1)"""


MOMENT_COLUMNS = ["minutes", "goals", "price", "fifth"]
MOMENT_SETS = [(), *((c,) for c in MOMENT_COLUMNS), *((a, b) for i, a in enumerate(MOMENT_COLUMNS) for b in MOMENT_COLUMNS[i + 1 :])]


def moment_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Fold]]:
    """Orders with four features, one of them missing here and there, and a label that hangs on two of them."""
    rows = order_history(spark, sf_dir).select("fixture_id", F.year("kickoff_time").cast("long").alias("timeline"), "minutes", F.col("goals_scored").alias("goals"), F.col("expected_goals").alias("price"), F.nullif(F.pmod("fixture_id", F.lit(5)), F.lit(0)).alias("fifth"), "total_points")
    rows = rows.withColumn("label", F.col("total_points") + F.col("goals") * 3 - F.col("price") * 2)
    years = [r[0] for r in rows.select("timeline").distinct().orderBy("timeline").collect()]
    return rows, walk_forward(years, 3, 1, embargo=1)


def moment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE of eleven feature sets by fold, from one matrix of moments and one pass over the validation rows."""
    rows, folds = moment_rows(spark, sf_dir)
    scorer = MomentScorer(rows, folds, "label", MOMENT_COLUMNS)
    scorer.many(MOMENT_SETS)
    out = [("+".join(s), f, n, mae, base, scorer.moment_jobs, scorer.score_jobs) for s in MOMENT_SETS for f, (n, mae, base) in scorer.by_fold(s).items()]
    frame = spark.createDataFrame(out, "features string, fold int, n long, mae double, baseline_mae double, moment_jobs int, score_jobs int")
    return frame.withColumns({c: F.round(c, 6) for c in ("mae", "baseline_mae")})


def kept_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold predictions of two sets, fitted in a first run and read in a second one; then one fact of the last fold's validation changes."""
    rows, folds = moment_rows(spark, sf_dir)
    store = PredictionStore(spark, f"{scratch.folder(spark)}/predictions")
    sets = {"goals": ["goals"], "goals+price": ["goals", "price"]}
    run = lambda frame: store.predictions(frame, folds, "label", sets, ["fixture_id"])
    run(rows)
    first = store.fits
    again = run(rows)
    second = store.fits - first
    last = rows.where(F.col("timeline").between(*folds[-1].validate)).agg(F.min("fixture_id")).first()[0]
    run(rows.withColumn("goals", F.when(F.col("fixture_id") == last, F.col("goals") + 1).otherwise(F.col("goals"))))
    third = store.fits - first - second
    scores = again.groupBy("set", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("label"))), 6).alias("mae"))
    return scores.select(F.col("set").alias("features"), "fold", "n", "mae", F.lit(first).alias("fits_at_first"), F.lit(second).alias("fits_again"), F.lit(third).alias("fits_after_a_change"))


def _pair_sql() -> str:
    """Ridge regressions of every single column and pair, solved by Cramer's rule; missing values at the mean of training."""
    values = {"minutes": "minutes", "goals": "goals", "price": "price", "fifth": "fifth"}
    centred = ", ".join(f"coalesce({v} - avg({v}) OVER w, 0) AS {c}" for c, v in values.items())
    test = ", ".join(f"coalesce(t.{v} - m.{c}, 0) AS {c}" for c, v in values.items())
    means = ", ".join(f"avg({v}) AS {c}" for c, v in values.items())
    parts = ["SELECT t.fold, '' AS features, abs(t.y0 - t.label) AS e, abs(t.y0 - t.label) AS b FROM centred_test t"]
    sums = []
    for c in MOMENT_COLUMNS:
        sums += [f"sum({c} * {c}) + 1 AS {c}_{c}", f"sum({c} * y) AS {c}_y"]
        parts.append(f"SELECT t.fold, '{c}', abs(t.y0 + t.{c} * s.{c}_y / s.{c}_{c} - t.label), abs(t.y0 - t.label) FROM centred_test t JOIN sums s USING (fold)")
    for i, a in enumerate(MOMENT_COLUMNS):
        for b in MOMENT_COLUMNS[i + 1 :]:
            sums.append(f"sum({a} * {b}) AS {a}_{b}")
            det = f"(s.{a}_{a} * s.{b}_{b} - s.{a}_{b} * s.{a}_{b})"
            wa, wb = f"(s.{a}_y * s.{b}_{b} - s.{b}_y * s.{a}_{b}) / {det}", f"(s.{b}_y * s.{a}_{a} - s.{a}_y * s.{a}_{b}) / {det}"
            parts.append(f"SELECT t.fold, '{a}+{b}', abs(t.y0 + t.{a} * {wa} + t.{b} * {wb} - t.label), abs(t.y0 - t.label) FROM centred_test t JOIN sums s USING (fold)")
    return f"""
 base AS (SELECT o_orderkey AS k, dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS i, ((o_orderkey * 7) % 91)::DOUBLE AS minutes, (o_orderkey % 4)::DOUBLE AS goals,
   o_totalprice / 70001.0 AS price, nullif(o_orderkey % 5, 0)::DOUBLE AS fifth, ((o_orderkey * 5) % 13 + (o_orderkey % 4) * 3 - (o_totalprice / 70001.0) * 2)::DOUBLE AS label FROM orders),
 folds AS (SELECT e - 3 AS fold, e FROM range(3, 40) r(e) WHERE e + 1 <= (SELECT max(i) FROM base)),
 train AS (SELECT f.fold, b.* FROM folds f JOIN base b ON b.i < f.e),
 means AS (SELECT fold, avg(label) AS y0, {means} FROM train GROUP BY fold),
 centred AS (SELECT fold, label - avg(label) OVER w AS y, {centred} FROM train WINDOW w AS (PARTITION BY fold)),
 sums AS (SELECT fold, {", ".join(sums)} FROM centred GROUP BY fold),
 centred_test AS (SELECT f.fold, m.y0, t.label, {test} FROM folds f JOIN base t ON t.i = f.e + 1 JOIN means m USING (fold)),
 errors AS ({" UNION ALL ".join(parts)})"""


PAIR_SQL = _pair_sql()


QUERIES = {"discovery": discovery, "walk_forward_scores": walk_forward_scores, "shuffled_control": shuffled_control, "component_models": component_models, "minutes_states": minutes_states, "moment_scores": moment_scores, "kept_predictions": kept_predictions}
ORACLE = {
    "discovery": DISCOVERY_SQL,
    "shuffled_control": "SELECT year(o_orderdate)::VARCHAR AS season, sum((o_orderkey * 7) % 91)::BIGINT AS minutes, sum((o_orderkey * 7) % 91)::BIGINT AS dealt, count(*) AS n FROM orders GROUP BY ALL",
    "component_models": f"""WITH {COMPONENT_SQL},
 fitted AS (SELECT fold, g, avg(minutes) AS minutes, avg(goals) AS goals, avg(starts) AS starts FROM train GROUP BY ALL),
 level AS (SELECT fold, count(*) AS n, avg(minutes) AS minutes, avg(goals) AS goals, avg(starts) AS starts FROM train GROUP BY fold),
 scored AS (
  SELECT fold, 'minutes' AS label, t.minutes AS y, f.minutes AS p, l.minutes AS b, l.n, (t.minutes - f.minutes) ** 2 AS loss FROM test t JOIN fitted f USING (fold, g) JOIN level l USING (fold)
  UNION ALL SELECT fold, 'goals', t.goals, f.goals, l.goals, l.n, 2 * (CASE WHEN t.goals > 0 THEN t.goals * ln(t.goals / f.goals) ELSE 0 END - (t.goals - f.goals)) FROM test t JOIN fitted f USING (fold, g) JOIN level l USING (fold)
  UNION ALL SELECT fold, 'starts', t.starts, f.starts, l.starts, l.n, -ln(CASE WHEN t.starts = 1 THEN f.starts ELSE 1 - f.starts END) FROM test t JOIN fitted f USING (fold, g) JOIN level l USING (fold))
SELECT fold::INTEGER AS fold, label, any_value(n) AS train_rows, count(*) AS rows, round(avg(abs(p - y)), 6) AS mae, round(avg(abs(b - y)), 6) AS baseline_mae, round(avg(loss), 6) AS loss,
  round(stddev_pop(p), 6) AS predicted_sd, round(avg(p), 6) AS predicted_mean, round(avg(y), 6) AS actual_mean FROM scored GROUP BY fold, label""",
    "minutes_states": f"""WITH {COMPONENT_SQL},
 fitted AS (SELECT fold, g, avg(minutes) AS minutes, avg(starts) AS starts, avg((state = 0)::INT) AS p0, avg((state = 1)::INT) AS p1, avg((state = 2)::INT) AS p2 FROM train GROUP BY ALL),
 other AS (SELECT *, greatest(starts, least(1.0, minutes / 70.0)) AS plays FROM fitted),
 states AS (SELECT *, greatest(0.0, least(plays, starts * 0.9 + greatest(0.0, (minutes - 60.0) / 30.0) * 0.1)) AS long FROM other),
 placed AS (SELECT t.fold, t.state, [p0, p1, p2] AS p, [1 - plays, plays - long, long] AS q FROM test t JOIN states b USING (fold, g)),
 squared AS (SELECT *, (p[1] - (state = 0)::INT) ** 2 + (p[2] - (state = 1)::INT) ** 2 + (p[3] - (state = 2)::INT) ** 2 AS pb, (q[1] - (state = 0)::INT) ** 2 + (q[2] - (state = 1)::INT) ** 2 + (q[3] - (state = 2)::INT) ** 2 AS qb FROM placed)
SELECT fold::INTEGER AS fold, count(*) AS rows, round(avg(-ln(greatest(p[state + 1], 1e-12))), 6) AS log_loss, round(avg(pb), 6) AS brier, round(avg(-ln(greatest(q[state + 1], 1e-12))), 6) AS baseline_log_loss, round(avg(qb), 6) AS baseline_brier,
  round(avg((state = 0)::INT), 6) AS share_0, round(avg((state = 1)::INT), 6) AS share_1, round(avg((state = 2)::INT), 6) AS share_2 FROM squared GROUP BY fold""",
    "moment_scores": f"WITH {PAIR_SQL} SELECT features, fold::INTEGER AS fold, count(*) AS n, round(avg(e), 6) AS mae, round(avg(b), 6) AS baseline_mae, 1 AS moment_jobs, 1 AS score_jobs FROM errors GROUP BY features, fold",
    "kept_predictions": f"WITH {PAIR_SQL} SELECT features, fold::INTEGER AS fold, count(*) AS n, round(avg(e), 6) AS mae, ((SELECT count(*) FROM folds) * 2)::INTEGER AS fits_at_first, 0 AS fits_again, 2 AS fits_after_a_change FROM errors WHERE features IN ('goals', 'goals+price') GROUP BY features, fold",
}
