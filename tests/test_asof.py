"""As-of joins, windows, rates, leakage and families, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronofold.operators import asof, catalogue, families, leakage, rolling

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(1)
    facts = [(random.choice([1, 2, 3, None]), day(random.randint(0, 30)), k, float(k) if k % 5 else None, k % 4) for k in range(200)]
    facts.append((2, None, 999, 1.0, 1))
    rows = [(p, day(d)) for p in (1, 2, 3, 4, None) for d in (-1, 0, 5, 12, 40)] + [(1, day(5)), (3, None)]
    return facts, rows, spark.createDataFrame(facts, "player_code long, available_time timestamp, match long, xg double, minutes long"), spark.createDataFrame(rows, "player_code long, prediction_timestamp timestamp")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucketed", [False, True])
def test_asof_join(tables, strict, bucketed):
    facts, rows, source, entities = tables
    bucket = F.date_trunc("week", F.col("_t")) if bucketed else None
    got = sorted((str(r.player_code), str(r.prediction_timestamp), r.match) for r in asof.asof_join(entities, source, ["player_code"], strict=strict, bucket=bucket).collect())
    want = []
    for p, t in rows:
        seen = [f for f in facts if p is not None and t is not None and f[0] == p and f[1] is not None and (f[1] < t if strict else f[1] <= t)]
        best = max(seen, key=lambda f: (f[1], f[2]))[2] if seen else None
        want.append((str(p), str(t), best))
    assert [(a, b, str(c)) for a, b, c in got] == sorted((a, b, str(c)) for a, b, c in want) or sorted(map(str, got)) == sorted(map(str, want))


def test_asof_suffix_and_columns(tables):
    _, _, source, entities = tables
    out = asof.point_in_time_join(entities.withColumn("xg", F.lit(1.0)), source, ["player_code"], ["xg"])
    assert out.columns == ["player_code", "prediction_timestamp", "xg", "available_time", "xg_src"]
    with pytest.raises(KeyError):
        asof.point_in_time_join(entities, source, ["player_code"], ["nope"])


def test_stage_window(tables):
    facts, rows, source, entities = tables
    unique = entities.where("player_code IS NOT NULL AND prediction_timestamp IS NOT NULL").distinct()
    out = asof.stage_window(unique, source.where("player_code IS NOT NULL AND available_time IS NOT NULL"), ["player_code"], window=4, row_key=["player_code", "prediction_timestamp"], order_col="match").collect()
    got = defaultdict(list)
    for r in out:
        got[(r.player_code, r.prediction_timestamp)].append((r["rank"], r.match))
    known = {f[0] for f in facts if f[0] is not None and f[1] is not None}
    for p, t in {r for r in rows if None not in r}:
        seen = sorted(((f[1], f[2]) for f in facts if f[0] == p and f[1] is not None and f[1] <= t), reverse=True)[:4]
        want = list(enumerate(m for _, m in seen)) or ([] if p in known else [(0, None)])
        assert sorted(got[(p, t)], key=str) == sorted(want, key=str)


def test_rolling_and_min_periods(tables):
    facts, rows, source, entities = tables
    out = rolling.rolling_as_of(entities, source.where("available_time IS NOT NULL"), ["player_code"], {"m": ("xg", "mean"), "n": ("xg", "count"), "md": ("xg", "median")}, window=5, min_periods=3, order_col="match")
    for r in out.collect():
        seen = sorted(((f[1], f[2], f[3]) for f in facts if r.player_code is not None and r.prediction_timestamp is not None and f[0] == r.player_code and f[1] is not None and f[1] <= r.prediction_timestamp), key=lambda x: x[:2], reverse=True)[:5]
        values = sorted(v for *_, v in seen if v is not None)
        if len(values) < 3:
            assert r.m is None and r.md is None
        else:
            assert r.m == pytest.approx(sum(values) / len(values)) and r.n == len(values)
            assert r.md == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2)


def test_shrunk_rate(spark):
    facts = spark.createDataFrame([(1, day(0), 2.0, 90.0), (1, day(1), 1.0, 90.0), (2, day(0), 0.0, 10.0)], "player_code long, available_time timestamp, g double, minutes double")
    rows = spark.createDataFrame([(1, day(5)), (2, day(5)), (3, day(5))], "player_code long, prediction_timestamp timestamp")
    args = {"numerator": "g", "denominator": "minutes", "window": 5, "prior_strength": 3.0}
    got = {r.player_code: r.r for r in rolling.shrunk_rate_as_of(rows, facts, ["player_code"], output="r", prior_value=0.5, **args).collect()}
    assert got == pytest.approx({1: (3 + 1.5) / (180 + 270) * 90, 2: 1.5 / 280 * 90, 3: 0.5})
    pooled = 3 / 190 * 90
    got = {r.player_code: r.r for r in rolling.shrunk_rate_as_of(rows, facts, ["player_code"], output="r", **args).collect()}
    assert got[3] == pytest.approx(pooled) and got[1] == pytest.approx((3 + 3 * pooled) / 450 * 90)
    with pytest.raises(ValueError):
        rolling.shrunk_rate_as_of(rows, facts, ["player_code"], output="r", **{**args, "prior_strength": -1})


def test_catalogue_declares_180_specs_and_needs_its_columns(tables):
    specs = catalogue.catalogue_specs()
    assert len(specs) == 180 == len({s.name for s in specs})
    _, _, source, entities = tables
    with pytest.raises(KeyError):
        rolling.build_catalogue(entities, source, specs, ["player_code"], order_col="match")


@pytest.fixture(scope="module")
def matches(spark):
    random.seed(2)
    rows = [(p, f"{2022 + w // 10}-{23 + w // 10}", w, random.randint(1, 4), bool(w % 2), random.choice([0, 30, 90]), random.random(), random.random() * 2, random.randint(0, 3), random.randint(0, 12), w % 2, day(7 * w), day(7 * w) + dt.timedelta(hours=3)) for p in range(1, 6) for w in range(30)]
    return spark.createDataFrame(rows, "player_code long, season string, gameweek_id long, opponent_team_id long, was_home boolean, minutes long, expected_goals double, expected_goal_involvements double, goals_scored long, total_points long, clean_sheets long, kickoff_time timestamp, available_time timestamp").withColumns({"assists": F.col("goals_scored"), "bps": F.col("total_points")})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(p, p % 4 + 1, day(150)) for p in range(1, 8)], "player_code long, opponent_team_id long, prediction_timestamp timestamp")


BUILDERS = {
    "rolling": lambda e, s: rolling.rolling_as_of(e, s, ["player_code"], {"m": ("total_points", "mean")}, window=5, order_col="kickoff_time"),
    "rate": lambda e, s: rolling.shrunk_rate_as_of(e, s, ["player_code"], numerator="goals_scored", denominator="minutes", window=5, prior_strength=3.0, output="r"),
    "opponent": lambda e, s: families.opponent_features(e, families.opponent_strength(s)),
    "career": lambda e, s: families.career_features(e, s, floor_minutes=100),
    "recency": lambda e, s: families.recency_features(e, s, ["player_code"]),
}


@pytest.mark.parametrize("name", BUILDERS)
def test_nothing_leaks(matches, rows, name):
    past = matches.where(F.col("available_time") <= F.lit(day(150)))
    season = F.col("season")
    future = leakage.make_future_records(past, F.lit(day(151)), ["player_code", "gameweek_id"], keep=("player_code", "opponent_team_id")).withColumn("season", F.concat(season, F.lit("x")))
    leakage.assert_no_leakage(rows, past, future, BUILDERS[name], ["player_code"])


def test_a_leaky_builder_is_caught(matches, rows):
    past = matches.where(F.col("available_time") <= F.lit(day(150)))
    future = leakage.make_future_records(past, F.lit(day(151)), ["player_code", "gameweek_id"], keep=("player_code",))
    leaky = lambda e, s: e.join(s.groupBy("player_code").agg(F.sum("total_points").alias("p")), "player_code", "left")
    assert leakage.assert_detects_leakage(rows, past, future, leaky, ["player_code"]) == ["p"]
    with pytest.raises(leakage.LeakageError):
        leakage.assert_detects_leakage(rows, past, future, BUILDERS["rolling"], ["player_code"])
    with pytest.raises(ValueError):
        leakage.find_leakage(rows, past, future.limit(0), leaky, ["player_code"])


def test_leakage_split(matches, rows):
    some, past, future = leakage.leakage_split(rows, matches, most_rows=3)
    assert some.count() == 3 and past.count() + future.count() == matches.count() and future.count() > 0
    assert leakage.forbidden_columns(["label_x", "minutes"]) == ["label_x"]


def test_asof_plan_is_two_shuffles_at_most(tables):
    _, _, source, entities = tables
    plan = asof.asof_join(entities, source, ["player_code"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "CartesianProduct" not in plan


def test_catalogue_aggregates_are_taken_where_the_rows_stand(spark):
    random.seed(4)
    facts = [(p, random.choice([None, *map(day, range(12))]), k, random.choice([None, 0.0, 1.5, -2.25, 7.0, float("nan")]), random.choice([None, 30, 90])) for p in (1, 2, None) for k in range(60)]
    facts += [(5, None, k, 1.0, 90) for k in range(3)]
    rows = [(p, t, f"{p}{t}") for p in (1, 2, 4, 5, None) for t in (None, day(-1), *map(day, range(0, 12, 2)))]
    source = spark.createDataFrame(facts, "player_code long, available_time timestamp, match long, x double, minutes long")
    entities = spark.createDataFrame(rows, "player_code long, prediction_timestamp timestamp, name string")
    hows = [(h, w) for h in ("mean", "sum", "min", "max", "std", "median", "count") for w in (1, 4, 30)]
    specs = [rolling.FeatureSpec(f"{h}_{w}", "x", w, h, 2 if w == 4 else 1) for h, w in hows] + [rolling.FeatureSpec("rate", "x", 4, "shrunk_rate", denominator="minutes")]
    out = rolling.build_catalogue(entities, source, specs, ["player_code"], order_col="match")
    # One shuffle, of facts and rows: aggregates are in none.
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    # What the aggregates are by Spark's own windows along the history.
    used = source.select("player_code", "available_time", "match", "minutes", "x")
    history = rolling.history_frame(["player_code"], "available_time", "match", used.columns)
    plain = {f"{h}_{w}": rolling.aggregate(F.col("x"), h, rolling.last_rows(history, w), 2 if w == 4 else 1) for h, w in hows}
    plain["rate"] = rolling.shrunk(F.col("x"), F.col("minutes").cast("double"), rolling.last_rows(history, 4), 3.0, 90.0)
    want = rolling.attach(entities, used, plain, ["player_code"], history).withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    as_text = lambda frame: sorted(str(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)) for r in frame.collect())
    assert out.dtypes == want.dtypes and as_text(out) == as_text(want)
