"""Component models, moments, searches and kept predictions against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import leakage
from chronofold.plans import components, discover, evaluate
from chronofold.plans.folds import Fold
from chronofold.plans.moments import MomentScorer
from chronofold.plans.nodes import FeatureProgram, Rolling, Source
from chronofold.plans.predictions import PredictionStore, manifests

FOLDS = [Fold(0, (0, 9), (11, 13)), Fold(1, (0, 13), (15, 17)), Fold(2, (4, 15), (17, 19))]


def planted(n=3000, seed=4):
    """Rows whose labels are drawn from known weights on two features, one of them missing here and there."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(2, 1.5, n), rng.normal(-40, 20, n)
    eta = 0.3 + 0.4 * x - 0.01 * z
    logits = np.column_stack([np.zeros(n), 0.2 + 0.5 * x, -1 + 0.02 * z])
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    state = (rng.random(n)[:, None] > np.cumsum(p, 1)).sum(1)
    rows = []
    for k in range(n):
        rows.append((k, k % 20, float(x[k]), None if k % 17 == 0 else float(z[k]), 5.0, int(rng.poisson(np.exp(0.5 * eta[k]))), int(rng.random() < 1 / (1 + np.exp(-eta[k]))), int(state[k]), None if k % 31 == 0 else float(eta[k] + rng.normal()), 1))
    return rows


SCHEMA = "id long, timeline long, x double, z double, flat double, goals int, starts int, state int, amount double, always int"
HEADS = [components.Head("goals", "poisson"), components.Head("starts", "binary"), components.Head("state", "classes", 3), components.Head("amount"), components.Head("always", "binary")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(planted(), SCHEMA).repartition(3).persist()


def design(some, m):
    x = np.array([[np.nan if r[c] is None else r[c] for c in ("x", "z", "flat")] for r in some], float)
    return np.column_stack([np.nan_to_num((x - m.mean) / m.scale), np.ones(len(x))])


def test_heads_are_at_their_optimum_and_near_what_was_planted(rows):
    models = components.fit(rows, [*FOLDS, components.WHOLE], ["x", "z", "flat"], HEADS, ridge=0.5)
    data = [r.asDict() for r in rows.collect()]
    for f in [*FOLDS, components.WHOLE]:
        for h in HEADS[:4]:
            some = [r for r in data if f.train[0] <= r["timeline"] <= f.train[1] and r[h.label] is not None]
            m = models.fitted[f.index, h.label]
            z = design(some, m)
            mean = h.mean(z @ m.weights.T)
            y = h.target(np.array([r[h.label] for r in some], float))
            off = (mean - (y[:, None] == np.arange(3)))[:, 1:] if h.family == "classes" else mean - y[:, None]
            gradient = off.T @ z + 0.5 * np.where(np.arange(4) < 3, m.weights, 0)
            assert m.converged and np.abs(gradient).max() < 1e-4 * len(some) ** 0.5, (f, h)
        assert (f.index, "always") not in models.fitted
    goals = models.coefficients(-1, "goals")[0]
    assert goals[0] == pytest.approx(0.2, abs=0.03) and goals[1] == pytest.approx(-0.005, abs=0.002)
    state = models.coefficients(-1, "state")
    assert state[0][0] == pytest.approx(0.5, abs=0.15) and state[1][1] == pytest.approx(0.02, abs=0.012)


def test_squared_head_is_the_ridge_regression_of_the_moments(rows):
    models = components.fit(rows, FOLDS, ["x"], [components.Head("amount")], ridge=0.0)
    scorer = MomentScorer(rows, FOLDS, "amount", ["x", "z"], ridge=0.0)
    for m in scorer.models(["x"]):
        w = models.coefficients(m.fold, "amount")[0]
        assert w[0] == pytest.approx(m.weights[0], rel=1e-8)


def test_predictions_and_reports(rows):
    models = components.fit(rows, FOLDS, ["x", "z", "flat"], HEADS)
    predicted = components.predict(rows, FOLDS, models)
    assert predicted.count() == sum(rows.where(F.col("timeline").between(*f.validate)).count() for f in FOLDS)
    one = predicted.select(*(F.col(c) for h in HEADS for c in h.outputs)).first()
    assert sum(one[f"predicted_state_{k}"] for k in range(3)) == pytest.approx(1) and one["predicted_always"] is None
    reports = {(r.fold, r.label): r for r in components.fold_reports(predicted, models).collect()}
    assert set(reports) == {(f.index, h) for f in FOLDS for h in ("goals", "starts", "amount")}
    assert all(r.mae < r.baseline_mae and r.predicted_sd > 0 for k, r in reports.items() if k[1] != "goals")


def test_no_rows_and_no_features(spark, rows):
    assert components.fit(rows.limit(0), FOLDS, ["x"], HEADS).fitted == {}
    models = components.fit(rows, FOLDS, [], [HEADS[0]])
    mean = rows.where("timeline <= 9").agg(F.avg("goals")).first()[0]
    assert components.predict(rows, FOLDS[:1], models).first().predicted_goals == pytest.approx(mean)
    with pytest.raises(ValueError):
        components.Head("x", "other")


@pytest.mark.parametrize(("minutes", "start", "want"), [(0.0, 0.0, (1, 0, 0)), (35.0, 0.1, (0.5, 0.41, 0.09)), (80.0, 0.2, (0, 1 - 0.18 - 2 / 30, 0.18 + 2 / 30)), (120.0, 1.0, (0, 0, 1.0)), (-5.0, -0.5, (1, 0, 0))])
def test_reconciled_states(spark, minutes, start, want):
    got = spark.range(1).select(*components.reconciled_states(F.lit(minutes), F.lit(start))).first()
    assert tuple(got) == pytest.approx(want, abs=1e-9)


def test_any_set_from_one_matrix_of_moments_equals_a_fit_of_its_own(rows):
    scorer = MomentScorer(rows, FOLDS, "amount", ["x", "z", "flat", "goals"])
    for features in ([], ["x"], ["z", "x"], ["x", "z", "flat", "goals"]):
        alone = {r.fold: r for r in evaluate.score(rows, FOLDS, features, "amount").collect()}
        got = scorer.by_fold(features)
        assert {f: r.n for f, r in alone.items()} == {f: n for f, (n, _, _) in got.items()}
        assert all(mae == pytest.approx(alone[f].mae, rel=1e-9) and base == pytest.approx(alone[f].baseline_mae, rel=1e-9) for f, (_, mae, base) in got.items())
        for own, mine in zip(evaluate.fit_folds(rows, FOLDS, features, "amount"), scorer.models(features), strict=True):
            assert mine.weights == pytest.approx(own.weights, rel=1e-9, abs=1e-9) and mine.mean == pytest.approx(own.mean, rel=1e-9)
    assert scorer.moment_jobs == 1


def test_a_search_takes_one_pass_a_step(rows):
    scorer = MomentScorer(rows, FOLDS, "amount", ["x", "z", "flat", "goals", "state"])
    found = evaluate.greedy_search(["x", "z", "flat", "state", "x"], scorer, min_gain=1e-4, required=["goals"])
    assert found.chosen[0] == "x" and scorer.moment_jobs == 1 and scorer.score_jobs <= len(found.chosen) + 2
    alone = lambda s: evaluate.weighted_mae(evaluate.score(rows, FOLDS, list(s), "amount"))
    assert found.costs[1] == pytest.approx(alone(["goals", "x"]), rel=1e-9)
    beam = evaluate.beam_search(["x", "z", "flat"], scorer, width=2, depth=2)
    assert beam.truncated and "x" in beam.best and not evaluate.beam_search(["x", "z"], scorer, depth=2).truncated
    assert evaluate.beam_search(["x", "z", "flat"], scorer, most_evaluations=2).truncated


def test_kept_predictions_are_fitted_once_and_again_only_where_facts_change(spark, rows, tmp_path):
    store = PredictionStore(spark, f"file://{tmp_path}/store")
    sets = {"one": ["x"], "two": ["z", "x"]}
    run = lambda frame, sets=sets, folds=FOLDS: store.predictions(frame, folds, "amount", sets, ["id"]).where("amount IS NOT NULL")
    first = run(rows)
    mae = first.groupBy("set", "fold").agg(F.avg(F.abs(F.col("predicted") - F.col("amount"))).alias("m")).collect()
    for r in mae:
        own = {s.fold: s.mae for s in evaluate.score(rows, FOLDS, sets[r.set], "amount").collect()}
        assert r.m == pytest.approx(own[r.fold], rel=1e-9)
    assert (store.fits, store.reads) == (6, 0)
    assert run(rows.repartition(7)).count() == first.count() and (store.fits, store.reads) == (6, 6)
    # Another order of columns is the same set, a new set is one more, and another store object finds what is there.
    run(rows, {"two": ["x", "z"], "three": ["x", "flat"]})
    assert store.fits == 9
    # Time 18 is in the last fold's validation only; time 14 in the last fold's training only.
    for time, refitted in ((18, 2), (14, 2), (2, 4), (10, 4)):
        before = store.fits
        run(rows.withColumn("x", F.when((F.col("timeline") == time) & (F.col("id") % 100 == time % 20), F.col("x") + 1).otherwise(F.col("x"))))
        assert store.fits - before == refitted, time
    # A fact that comes after all folds changes none of them; a column that a set doesn't use doesn't either.
    before = store.fits
    run(rows.unionByName(rows.limit(1).withColumn("timeline", F.lit(99).cast("long"))))
    run(rows.withColumn("flat", F.lit(1.0)))
    assert store.fits == before


def test_manifests_tell_rows_apart(spark):
    make = lambda pairs: manifests(spark.createDataFrame(pairs, "id long, timeline long, x double"), [Fold(0, (0, 0), (1, 1))], ["x"], ["id"])
    one = make([(1, 0, 1.0), (2, 0, 2.0)])
    assert one == make([(2, 0, 2.0), (1, 0, 1.0)]) != make([(1, 0, 2.0), (2, 0, 1.0)]) and one != make([(1, 0, 1.0), (2, 0, None)])


def test_discovery_measures_what_it_judges_by(spark):
    rng = np.random.default_rng(8)
    base = [(p, t, float(rng.normal()), float(rng.normal())) for t in range(24) for p in range(40)]
    rows = spark.createDataFrame([(p, t, x, s, 3 * s + x + float(rng.normal()) * 0.1) for p, t, x, s in base], "player_code long, timeline long, x double, signal double, y double")
    rows = rows.withColumn("prediction_timestamp", F.timestamp_seconds(F.col("timeline") * 86400).cast("timestamp_ntz"))
    history = rows.select("player_code", F.col("signal").alias("past"), (F.col("prediction_timestamp") - F.expr("INTERVAL 1 HOUR")).alias("available_time"), (F.col("prediction_timestamp") - F.expr("INTERVAL 2 HOURS")).alias("kickoff_time"))
    folds = (Fold(0, (0, 9), (11, 13)), Fold(1, (0, 13), (15, 17)), Fold(2, (0, 17), (19, 21)))
    s = discover.Setting(rows, history, ("player_code", "timeline"), "y", ("x",), folds, entity="player_code", objective="y", picks=5)
    programs = [FeatureProgram("newest", Rolling(Source("past"), 1)), FeatureProgram("old", Rolling(Source("past"), 3, "std", min_periods=2)), FeatureProgram("absent", Rolling(Source("nothing"), 3))]
    got = {r.feature: r for r in discover.discover(s, programs).collect()}
    assert got["newest"].verdict == "accepted" and got["newest"].incremental > 0.8 and got["newest"].win_rate == 1.0
    assert got["newest"].decision_gain > 0.5 and got["newest"].objective_gain == pytest.approx(got["newest"].decision_gain)
    # Signals are drawn anew each time, so rankings are no likelier to hold than to turn.
    assert got["newest"].turnover == pytest.approx(0.5, abs=0.1)
    assert got["old"].verdict == "rejected" and got["old"].objective_gain == 0.0
    assert got["absent"].verdict == "rejected" and not got["absent"].leakage_passed and "nothing" in got["absent"].reason
    unmeasured = discover.discover(discover.Setting(rows, history, ("player_code", "timeline"), "y", ("x",), folds), programs[:1]).first()
    assert unmeasured.turnover is None and unmeasured.objective_gain is None and unmeasured.decision_gain is not None


def test_proofs_of_a_batch_are_those_of_its_programs(spark):
    day = F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz")
    facts = spark.range(60).select((F.col("id") % 5).alias("player_code"), (F.col("id") / 5).cast("int").alias("d"), F.col("id").cast("double").alias("points")).withColumns({"available_time": day, "kickoff_time": day})
    entities = spark.range(40).select((F.col("id") % 5).alias("player_code"), (F.col("id") / 5 + 2).cast("int").alias("d")).withColumn("prediction_timestamp", day)
    programs = [FeatureProgram("mean", Rolling(Source("points"), 3)), FeatureProgram("absent", Rolling(Source("nothing"), 3)), FeatureProgram("last", Rolling(Source("points"), 1))]
    batch = leakage.prove_programs(programs, entities, facts, ["player_code", "d"])
    assert batch == {p.name: leakage.prove_program(p, entities, facts, ["player_code", "d"]) for p in programs}


def test_walk_forward_scores_read_their_rows_once(spark):
    from chronofold.queries import evaluation

    out = evaluation.walk_forward_scores(spark, "/root/testdata/sf0.01")
    # Nothing of the frame is left to be computed again behind the scores.
    assert not out.inputFiles()
    rows, folds = evaluation._frame(spark, "/root/testdata/sf0.01")
    assert all("/orders.parquet" not in f for f in rows.inputFiles())
    want = {r.fold: r for r in evaluate.score(rows, folds, [*evaluation.FEATURES, "signal"], "label_total_points").collect()}
    got = {r.fold: r for r in out.where("features = 'signal'").collect()}
    assert want.keys() == got.keys() and len(got) >= 3
    for f, r in want.items():
        assert got[f].n == r.n and got[f].mae == pytest.approx(r.mae, abs=1e-9) and got[f].baseline_mae == pytest.approx(r.baseline_mae, abs=1e-9)


def test_discovery_deals_only_what_it_scores(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 20).alias("player_code"), (F.col("id") / 20).cast("long").alias("timeline"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 3).cast("double").alias("x"), F.lit("w").alias("wide"))
    rows = rows.withColumn("prediction_timestamp", F.timestamp_seconds(F.col("timeline") * 86400).cast("timestamp_ntz"))
    history = rows.select("player_code", F.col("y").alias("past"), F.col("prediction_timestamp").alias("available_time"), F.col("prediction_timestamp").alias("kickoff_time"))
    seen, write = [], discover.written
    monkeypatch.setattr(discover, "written", lambda df: seen.append(df.columns) or write(df))
    s = discover.Setting(rows, history, ("player_code", "timeline"), "y", ("x",), (Fold(0, (0, 9), (11, 14)),), noise_trials=1)
    discover.discover(s, [FeatureProgram("last", Rolling(Source("past"), 2))])
    assert [sorted(c) for c in seen] == [["last", "player_code", "timeline", "x", "y"]]
