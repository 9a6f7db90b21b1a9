"""Freeze checks, proofs, clusters, utilities, runs and replacement of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import embeddings, leakage, metrics, ranks, requests, scoring, squads
from chronofold.plans import evaluate, frozen
from chronofold.plans.folds import Fold
from chronofold.plans.nodes import Arith, FeatureProgram, Rolling, Source
from chronofold.plans.programs import residual_programs, seeded
from chronofold.sources import tables


def test_places_and_ranks_in_large_groups(spark):
    rng = np.random.default_rng(1)
    values = [None, 0.0, -0.0, float("inf"), float("-inf"), 1e-300, -1e300, *np.round(rng.normal(size=200), 1).tolist(), *[2.5] * 100]
    rows = [(k % 2 if k % 7 else None, v, k) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "g int, v double, k long")
    placed = ranks.places(frame, ["g"], "v", ["k"], "p").collect()
    for g in (0, 1, None):
        mine = sorted((r for r in placed if r.g == g), key=lambda r: r.p)
        assert [r.p for r in mine] == list(range(1, len(mine) + 1))
        keys = [(-np.inf if r.v is None else r.v, r.v is not None, r.k) for r in mine]
        assert all((a[0], a[2]) <= (b[0], b[2]) or a[1] < b[1] for a, b in zip(keys, keys[1:], strict=False))
    for r in ranks.unit_ranks(frame, ["g"], {"v": "u"}).collect():
        group = [x for g, x, _ in rows if g == r.g and x is not None]
        want = None if r.v is None else (sum(x < r.v for x in group) + (sum(x == r.v for x in group) - 1) / 2) / (len(group) - 1)
        assert r.u == (pytest.approx(want) if want is not None else None)


def test_rank_correlation_and_bins_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 300), rng.normal(size=300)
    frame = spark.createDataFrame([(int(a), float(b + a / 5), k) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x int, y double, k long")
    avg = lambda v: np.array([(v < i).sum() + ((v == i).sum() + 1) / 2 for i in v])
    want = np.corrcoef(avg(x), avg(y + x / 5))[0, 1]
    assert metrics.spearman(frame, "x", "y", []).first().spearman == pytest.approx(want)
    assert metrics.spearman(frame.withColumn("x", F.lit(1)), "x", "y", []).first().spearman == 0
    bins = metrics.calibration_bins(frame, "x", "y", 7, ["k"]).orderBy("bin").collect()
    assert [r.n for r in bins] == [43] * 6 + [42] and [r.predicted for r in bins] == pytest.approx([c.mean() for c in np.array_split(np.sort(x), 7)])


def test_freeze_checks():
    seen = frozenset({("2023-24", g) for g in range(1, 39)})
    good = frozen.Artifact(seen, "abc", ("a", "b"), (Fold(0, (1, 10), (12, 14)),), 1)
    plan = frozen.Experiment((("2024-25", 1, 10),), {"m": frozen.Pinned("abc", frozen.columns_hash(["a", "b"]), False)}, ("2024-25",), ("2022-23",), {"data": "x"})
    checks = frozen.assert_frozen(plan, {"m": good, "closed form": None}, {"data": "x"})
    assert len(checks) == 8 and all(c.passed for c in checks)
    bad = {
        "train_seasons_precede_test": ({"m": frozen.Artifact(frozenset({("2025-26", 1)}))}, plan),
        "no_model_overlap_with_evaluation_period": ({"m": frozen.Artifact(frozenset({("2024-25", 3)}))}, plan),
        "architecture_and_hyperparameters_frozen": ({"m": frozen.Artifact(seen, "other", ("a", "b"))}, plan),
        "feature_selection_frozen": ({"m": frozen.Artifact(seen, "abc", ("a", "b", "c"))}, plan),
        "calibration_not_fitted_on_test": ({"m": good}, frozen.Experiment(plan.windows, {"m": frozen.Pinned(price_calibration=True)}, ("2024-25",))),
        "thresholds_not_selected_on_test": ({"m": good}, frozen.Experiment(plan.windows, tuned_on=("2024-25",))),
        "folds_are_walk_forward": ({"m": frozen.Artifact(seen, "abc", ("a", "b"), (Fold(0, (1, 10), (11, 14)),), 1)}, plan),
    }
    for name, (artifacts, experiment) in bad.items():
        assert name in [c.name for c in frozen.freeze_checks(experiment, artifacts) if not c.passed]
        with pytest.raises(frozen.FreezeViolation):
            frozen.assert_frozen(experiment, artifacts)
    assert not frozen.freeze_checks(plan, {"m": good}, {"data": "y"})[-1].passed


def test_programs_are_proven_or_not(spark):
    facts = spark.createDataFrame([(p, k, float(k), k * 90) for p in range(3) for k in range(10)], "player_code int, day int, points double, minutes int").withColumns({"available_time": F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(day)"), "kickoff_time": F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(day)")})
    entities = facts.where("day % 3 = 2").select("player_code", F.col("available_time").alias("prediction_timestamp"))
    key = ["player_code", "prediction_timestamp"]
    assert leakage.prove_program(FeatureProgram("mean", Rolling(Source("points"), 3)), entities, facts, key) == (True, ("static", "point_in_time"), "")
    assert leakage.prove_program(FeatureProgram("absent", Rolling(Source("nothing"), 3)), entities, facts, key)[:2] == (False, ("static",))
    unproven = leakage.prove_program(FeatureProgram("late", Rolling(Source("points"), 3)), entities, facts.where("day < 3"), key)
    assert unproven[:2] == (False, ("static",)) and "not proven" in unproven[2]
    assert len(seeded()) == 15 and len(residual_programs(["threat", "creativity"])) == 12
    assert isinstance(residual_programs(["threat"])[0].root, Arith)


def cluster_rows(spark, n=900):
    rng = np.random.default_rng(4)
    group = np.arange(n) % 3
    x = np.column_stack([group * 4 + rng.normal(size=n), rng.normal(size=n), (group == 1) * 3 + rng.normal(size=n)])
    return spark.createDataFrame([(int(k), "2024", int(k) % 5, int(g), *map(float, r), float(r[1] * 2 + 1)) for k, (g, r) in enumerate(zip(group, x, strict=True))], "player_code int, label_season string, label_gameweek int, g int, a double, b double, c double, y double")


def test_clusters_by_aims_and_by_target(spark):
    rows = cluster_rows(spark)
    assert embeddings.column_weights(["team_value_growth", "broke"], ["value_mean_1", "other", "total_points_mean_5"]) == [2.4, 1.0, 1.4]
    model = embeddings.fit_cluster_model(rows, ["a", "b", "c"], aims=["broke"], k=3, components=3)
    out = embeddings.rolling_assignments(model, rows).collect()
    assert len(out) == 900 and len({r.cluster_model_version for r in out}) == 1 and all(0 <= r.membership_probability <= 1 for r in out)
    found = model.place(rows).groupBy("g", "cluster_id").count().orderBy(F.desc("count")).limit(3).collect()
    assert len({r.cluster_id for r in found}) == 3 and sum(r["count"] for r in found) > 800
    said = embeddings.cluster_summaries(model, rows).collect()
    assert sum(r["size"] for r in said) == 900 and all(r.label for r in said) and any("high a" in r.label for r in said)
    axes = embeddings.supervised_projection(model.embedding.transform(rows), "y", 2)
    direction = np.array(axes[0]) @ np.array(model.embedding.loadings)
    assert abs(direction[1]) > 0.99 * np.linalg.norm(direction) and abs(np.dot(axes[0], axes[1])) < 1e-9
    assert embeddings.supervised_projection(model.embedding.transform(rows.limit(50)), "y") is None
    with pytest.raises(ValueError):
        embeddings.fit_cluster_model(rows.limit(10), ["a", "b"])
    by_target = embeddings.fit_cluster_model(rows, ["a", "b", "c"], target="y", k=2, components=3)
    assert by_target.axes and by_target.version() != model.version()


def test_number_of_clusters(spark):
    rows = embeddings.fit_embedding(cluster_rows(spark), ["a", "c"], 2).transform(cluster_rows(spark))
    best, values = embeddings.choose_k(rows, (2, 3, 4))
    assert best == max(values, key=values.get) and set(values) == {2, 3, 4}
    assert embeddings.choose_k(rows, (2, 3), utilities={2: 10.0})[0] == 2


def test_utility_and_complementarity():
    total, terms, missing = evaluate.utility({"prediction": 0.1, "decision": None, "stability": 0.8}, complexity=3, turnover=None)
    assert total == pytest.approx(0.1 + 0.4 - 0.1 * np.log1p(2)) and set(missing) == {"decision", "objective", "complementarity", "turnover"}
    assert evaluate.relative_gain(0.9, 1.0, lower_is_better=True) == pytest.approx(0.1) and evaluate.relative_gain(None, 1.0) is None
    said = lambda **k: evaluate.complementarity(**{"leaks": False, "folds": 5, "incremental": 0.0, "stability": 0.9, "win_rate": 0.5, **k})
    assert said(leaks=True) == "leakage_suspected" and said(folds=1) == "insufficient_history" and said() == "redundant"
    assert said(incremental=0.01) == "globally_complementary" and said(incremental=0.01, stability=0.1) == "unstable"
    assert said(segments=[(300, 0.01)]) == "cluster_specific" and said(segments=[(30, 0.01)]) == "redundant"
    assert said(objective_gain=0.01, global_gain=0.0) == "objective_specific" and said(stability=0.1) == "unstable"


def test_search_says_when_it_was_cut_short():
    cost = lambda s: 10.0 - len(s)
    assert evaluate.greedy_search(["a", "b", "c"], cost, most=2).truncated and not evaluate.greedy_search(["a", "b"], cost, most=8).truncated
    assert evaluate.greedy_search(["a", "b", "c"], cost, most_evaluations=2).chosen == []


def test_max_noise_is_the_best_of_its_draws(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, k // 20, float(rng.normal()), float(rng.normal())) for k in range(400)], "id long, timeline long, x double, y double")
    folds = [Fold(0, (0, 9), (10, 14)), Fold(1, (0, 14), (15, 19))]
    scorer = evaluate.Scorer(rows, folds, "y")
    base = scorer(["x"])
    assert scorer(("x",)) == base and len(scorer.known) == 1
    best, ran = evaluate.max_noise_control(rows, folds, ["x"], "y", ["id"], trials=3)
    assert ran == 3 and best <= evaluate.max_noise_control(rows, folds, ["x"], "y", ["id"], trials=1)[0]


def test_tables_survive_a_replacement_that_was_cut_short(spark, tmp_path):
    store = tables.ParquetStore(spark, str(tmp_path))
    store.write_table("t", spark.range(3))
    fs, path = store._fs(f"{tmp_path}/t")
    fs.rename(path, store._fs(f"{tmp_path}/_old_t")[1])  # a crash between setting aside and naming
    assert store.read_table("t").count() == 3
    store.write_table("t", spark.range(5))
    assert store.read_table("t").count() == 5 and store.list_tables() == ["t"]
    store.append_table("t", spark.createDataFrame([(1.5,)], "id double"))
    assert store.read_table("t").dtypes == [("id", "double")] and store.read_table("t").count() == 6


def test_importance_of_older_tables_and_runs(spark, tmp_path):
    store = tables.ParquetStore(spark, f"{tmp_path}/s")
    tables.write_importance(store, "old", spark.createDataFrame([("f", 0.5)], "feature string, importance double"))
    assert tables.read_importance(store, "old").first()[2:] == ("ALL", 0)
    runs = tables.RunStore(spark, f"{tmp_path}/r")
    assert runs.completed_units().count() == 0 and runs.read_run("u_1", "x long") is None
    runs.write_run("u_1", spark.range(2).withColumnRenamed("id", "x"))
    spark.range(1).write.parquet(f"{tmp_path}/r/unit=u_2")
    (tmp_path / "r" / "unit=u_2" / "_SUCCESS").unlink()
    assert [r.unit for r in runs.completed_units().collect()] == ["u_1"]
    assert runs.read_run("u_1", "x long").count() == 2 and runs.read_run("u_2", "id long") is None


def test_price_calibration_of_bands(spark):
    rows = spark.createDataFrame([(50, 2.0), (120, 2.0), (None, 2.0), (50, 0.0)], "price int, expected_points double").withColumn("sd", F.lit(1.0))
    got = rows.withColumns(scoring.price_calibration()).collect()
    assert [(round(r.expected_points, 6), round(r.sd, 6)) for r in got] == [(2.141, 1.0), (2.0, round(1 + 0.29 / 0.6, 6)), (2.0, 1.0), (0.0, 1.0)]
    thin = {"budget": (-1.0, 99, 0.0)}
    assert rows.withColumns(scoring.price_calibration(thin)).first()[1:] == (2.0, 2.0)


def test_the_nearest_phrase_governs_a_name(spark):
    texts = ["Avoid Salah and keep Haaland", "start Saka and Bruno Fernandes, no Bruno Guimaraes", "I want Smith in the squad", "Fernandes (c)", "Salah is nice", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")
    names = spark.createDataFrame([("Salah", 1), ("Haaland", 2), ("Saka", 3), ("Bruno Fernandes", 4), ("Fernandes", 4), ("Bruno Guimaraes", 5), ("Bruno", 6), ("Smith", 7), ("Smith", 8)], "name string, player_code int")
    got = {(r.request_id, r.player_code): r.kind for r in requests.mentions(asked, names).collect()}
    assert got == {(0, 1): "exclude", (0, 2): "include", (1, 3): "start", (1, 4): "start", (1, 5): "exclude", (3, 4): "captain"}
    more = spark.createDataFrame([(0, "play 3-5-2, at most three players from Hull and leave £1.5m in the bank"), (1, "4-4-4")], "request_id int, text string")
    clubs = spark.createDataFrame([("Hull", 9)], "name string, team_id int")
    assert [tuple(r) for r in requests.shapes(more).collect()] == [(0, "3-5-2")] and [tuple(r) for r in requests.bank_floors(more).collect()] == [(0, 15)]
    assert requests.club_counts(asked, clubs).count() == 0
