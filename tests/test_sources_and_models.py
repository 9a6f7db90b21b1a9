"""Stores, snapshots, normalisation, scoring, squads, calibration, evaluation and streaming."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import calibration, changes, embeddings, scoring, squads
from chronofold.plans import evaluate, folds
from chronofold.sources import bronze, events, normalise, schema, tables
from chronofold.streaming import ingest

UTC = dt.timezone.utc


def test_parquet_store(spark, tmp_path):
    store = tables.ParquetStore(spark, str(tmp_path))
    store.write_table("t", spark.range(3))
    store.append_table("t", spark.range(3, 5).withColumn("more", F.lit("x")))
    assert store.list_tables() == ["t"] and sorted(str(r.more) for r in store.read_table("t").collect()) == ["None"] * 3 + ["x"] * 2
    store.write_table("t", store.read_table("t").where("id > 1"))
    assert store.query("SELECT count(*) AS n FROM t WHERE id >= :low", low=3).first().n == 2
    with pytest.raises(KeyError):
        store.read_table("nope")
    for bad in ("1t", "a b", "../x", ""):
        with pytest.raises(ValueError):
            store.read_table(bad)


def test_conform_and_empty(spark):
    out = schema.conform(spark.createDataFrame([("1", "x")], "player_code string, extra string"), schema.CANONICAL["players"])
    assert out.schema.fieldNames() == schema.CANONICAL["players"].fieldNames() and out.first().player_code == 1
    assert schema.empty(spark, schema.CANONICAL["teams"]).count() == 0 and len(schema.CANONICAL["player_gameweek_stats"]) == 37


def test_bronze(spark, tmp_path):
    store = bronze.BronzeStore(spark, str(tmp_path))
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    a = store.write("boot", b"one", observed=t, available=t)
    assert store.write("boot", b"one", observed=t, available=t) == a and store.read(a) == b"one"
    store.write("boot", b"two", observed=t, available=t + dt.timedelta(days=2))
    assert store.snapshots("boot").count() == 2
    assert store.latest(t + dt.timedelta(days=1)).first().path == a and store.latest().first().path != a
    with open(a, "wb") as f:
        import gzip

        f.write(gzip.compress(b"three"))
    with pytest.raises(ValueError):
        store.read(a)
    with pytest.raises(ValueError):
        store.write("boot", b"x", observed=dt.datetime(2024, 1, 1), available=t)


def test_normalise_payload(spark):
    payload = {"elements": [{"code": 9, "id": 1, "web_name": "A", "element_type": 3, "team": 2, "now_cost": 55, "status": "a", "news": "", "news_added": "bad", "selected_by_percent": "1.5"}], "teams": [{"id": 2, "code": 7, "name": "T", "short_name": "T"}], "events": [{"id": 1, "deadline_time": "2024-08-01T10:00:00Z", "finished": False, "is_current": True, "is_next": False}]}
    frame = normalise.parse_payload(spark.createDataFrame([(json.dumps(payload),)], "j string"), "j")
    at = F.lit(dt.datetime(2024, 8, 1)).cast("timestamp")
    p = normalise.players(frame, "2024-25", at).first()
    assert (p.player_code, p.position, p.news, p.news_added, p.selected_by_percent, p.current_price) == (9, "MID", None, None, 1.5, 55)
    assert normalise.teams(frame, "2024-25", at).first().team_code == 7
    assert normalise.gameweeks(frame, "2024-25", at).first().deadline_time == dt.datetime(2024, 8, 1, 10)


def test_archive_counts_what_it_drops(spark):
    rows = spark.createDataFrame([("1", "MID", "2024-08-01T10:00:00Z", 5), ("1", "AM", "2024-08-01T10:00:00Z", 5), ("8", "MID", "2024-08-01T10:00:00Z", 5), ("1", "MID", "x", 5)], "element string, position string, kickoff_time string, minutes long")
    elements = spark.createDataFrame([("1", "77"), ("1", "78")], "id string, code string")
    kept, counts = normalise.archive_season(rows, elements, "2024-25")
    assert counts.first().asDict() == {"kept": 1, "manager": 1, "unresolved": 1, "no_kickoff": 1}
    r = kept.first()
    assert r.player_code == 77 and r.available_time == dt.datetime(2024, 8, 1, 13)
    past = normalise.past_seasons(spark.createDataFrame([("2022/23",), ("junk",)], "season_name string")).collect()
    assert [(r.season, r.available_time) for r in past] == [("2022-23", dt.datetime(2023, 6, 30))]


def test_event_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "material")], "code long, materiality string")
    t = dt.datetime(2024, 1, 1)
    events.append_events(log, f"{tmp_path}/log", t)
    events.append_events(log.limit(0), f"{tmp_path}/log", t + dt.timedelta(days=1))
    back = events.read_events(spark, f"{tmp_path}/log", "code long, materiality string")
    assert back.count() == 1 and events.unread(back) == 1 and events.last_checked(spark, f"{tmp_path}/log") == t + dt.timedelta(days=1)


def test_ledger_and_prices(spark):
    moves = spark.createDataFrame([("a", w, n) for w, n in enumerate([0, 3, 0, 0, 0, 0, 0, 7])], "owner string, gameweek_id long, transfers long")
    got = [(r.free, r.hits) for r in scoring.transfer_ledger(moves).orderBy("gameweek_id").collect()]
    assert got == [(1, 0), (2, 4), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 8)]
    assert changes.rule_drift({"a": {"b": 1}, "c": 2}, {"a": {"b": 3}, "c": 2}) == [("a.b", 1, 3)]


def substitute(picks):
    """Automatic substitutions of one squad and week, one absent starter after the other."""
    bounds = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
    picks = sorted(picks, key=lambda p: p["place"])
    field = [p for p in picks if p["place"] <= 11]
    for absent in [p for p in field if p["minutes"] == 0]:
        for sub in picks[11:]:
            trial = [p for p in field if p is not absent] + [sub]
            if sub["minutes"] > 0 and sub not in field and all(low <= sum(p["position"] == k for p in trial) <= high for k, (low, high) in bounds.items()):
                field = trial
                break
    lead = [p for p in field if p["is_captain"] and p["minutes"] > 0] or [p for p in field if p["is_vice"] and p["minutes"] > 0]
    return {p["place"]: (2 if lead and p is lead[0] else 1) if p in field else 0 for p in picks}


def test_substitutes_keep_the_shape(spark):
    positions = ["GKP"] + ["DEF"] * 3 + ["MID"] * 5 + ["FWD"] * 2 + ["GKP", "FWD", "DEF", "DEF"]
    rng, rows = np.random.default_rng(0), []
    for squad in range(40):
        absent = rng.random(15) < (0.3 if squad else 0)
        rows += [(squad, 1, k + 1, p, 0 if absent[k] else 90, k == 9, k == 8) for k, p in enumerate(positions)]
    table = spark.createDataFrame(rows, "squad_id int, gameweek_id int, place int, position string, minutes int, is_captain boolean, is_vice boolean")
    out = squads.autosubs(table)
    assert out.columns == [*table.columns, "multiplier"]
    got = {(r.squad_id, r.place): r.multiplier for r in out.collect()}
    for squad in range(40):
        picks = [dict(zip(table.columns, r, strict=True)) for r in rows if r[0] == squad]
        assert {p: got[squad, p] for p in range(1, 16)} == substitute(picks), squad


def test_distribution_scores(spark):
    pmf = [0.1, 0.2, 0.4, 0.2, 0.1]
    frame = spark.createDataFrame([(k, k - 2, 0, pmf) for k in range(10)], "id long, actual int, pmf_support_min int, pmf array<double>")
    for r in calibration.score_distributions(frame, ["id"]).collect():
        cdf = np.cumsum(pmf)
        lattice = sum((cdf[k] - (r.actual <= k)) ** 2 for k in range(5)) + max(0, -r.actual) + max(0, r.actual - 5)
        assert r.crps == pytest.approx(lattice) and r["mean"] == pytest.approx(2.0)
        assert 0 <= r.pit <= 1 and r.inside_80 == int(0 <= r.actual <= 4 and (0 <= r.actual <= 4) and (r.actual in range(0 if 0.1 <= cdf[0] + 1e-12 else 1, 5)) and r.actual <= 3)
    out = calibration.gaussian_pmf(spark.createDataFrame([(3.0, 1.5)], "m double, s double"), "m", "s", 0, 10).first()
    assert sum(out.pmf) == pytest.approx(1) and out.pmf[3] == pytest.approx(math.erf(0.5 / (1.5 * math.sqrt(2))))


def test_embedding_and_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *(float(v) for v in rng.normal(size=3) + (k % 2) * 8)) for k in range(60)] + [(60, None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, c double")
    fit = embeddings.fit_embedding(frame, ["a", "b", "c"], 2)
    x = np.array([[math.nan if v is None else v for v in r[1:]] for r in rows])
    mean = np.nanmean(x, axis=0)
    z = np.where(np.isnan(x), mean, x) - mean
    z = z / z.std(axis=0)
    _, vectors = np.linalg.eigh(z.T @ z / len(z))
    out = fit.transform(frame).orderBy("id").collect()
    assert np.abs([r.embedding[0] for r in out]) == pytest.approx(np.abs(z @ vectors[:, -1]), abs=1e-6)
    placed = embeddings.assign(fit.transform(frame), embeddings.fit_clusters(fit.transform(frame), 2))
    assert len({(r.id % 2, r.cluster_id) for r in placed.where("id < 60").collect()}) == 2 and embeddings.silhouette(placed) > 0.7
    assert all(sum(r.memberships) == pytest.approx(1) for r in placed.collect())


def test_controls_search_and_importance(spark):
    random.seed(0)
    rows = [(t, p, random.random(), random.random()) for t in range(24) for p in range(25)]
    frame = spark.createDataFrame(rows, "timeline long, player long, signal double, other double").withColumn("y", F.col("signal") * 5 + F.col("other") * 0.01)
    fs = folds.walk_forward(list(range(24)), 12, 4)
    cost = lambda cs: evaluate.weighted_mae(evaluate.score(frame, fs, list(cs), "y"))
    chosen, costs = evaluate.greedy_search(["signal", "other"], cost, min_gain=0.01)
    assert chosen == ["signal"] and costs[1] < 0.2 * costs[0]
    gains = {(r.feature, r.fold): r.delta for r in evaluate.permutation_importance(frame, fs, ["signal", "other"], "y", ["timeline", "player"], repeats=1).collect()}
    assert all(gains[("signal", f.index)] > 10 * abs(gains[("other", f.index)]) for f in fs)
    drawn = spark.range(4000).select(evaluate.noise(1, "id").alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(drawn[0]) < 0.06 and abs(drawn[1] - 1) < 0.05


def test_acceptance_order():
    good = {"folds": 5, "win_rate": 0.8, "incremental": 0.01, "recent_degradation": 0.0, "missingness": 0.1, "turnover": 0.2, "beats_controls": True, "leaks": False}
    verdict = lambda **k: evaluate.Acceptance().verdict(**{**good, **k})[0]
    assert [verdict(), verdict(leaks=True), verdict(folds=1), verdict(beats_controls=False), verdict(missingness=0.9), verdict(win_rate=0.1)] == ["accepted", "rejected", "insufficient", "rejected", "revise", "experimental"]


def test_beam_search():
    cost = lambda s: 10 - len(set(s) & {"a", "b"}) + 0.1 * len(s)
    assert evaluate.beam_search(["a", "b", "c"], cost)[0] == ("a", "b")


def test_streamed_facts_are_kept_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame([(k % 3, t + dt.timedelta(hours=k % 5), k % 5) for k in range(30)], "player_code long, available_time timestamp, value long")
    facts.write.parquet(f"{tmp_path}/in")
    stream = ingest.facts_stream(spark, f"{tmp_path}/in", facts.schema, ["player_code"])
    query = ingest.append_facts(stream, f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == facts.distinct().count()


def test_no_task_of_a_clustering_reads_more_than_its_share(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    frame = spark.range(0, 1000, 1, 1).select(F.array((F.col("id") % 2 * 10).cast("double"), (F.col("id") % 7 / 10.0)).alias("embedding"))
    monkeypatch.setattr(embeddings, "CLUSTER_PART", 100, raising=False)
    sizes, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) or fit(self, rows))
    centroids = embeddings.fit_clusters(frame, 2)
    assert sum(sizes) == 1000 and max(sizes) <= 110
    assert sorted(round(c[0]) for c in centroids) == [0, 10]
